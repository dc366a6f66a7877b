"""Training-data queries against their SQL, or against brute force on the smallest tables where SQL can't express them."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import DATA, duck, hold, spark_rows
from pyspark.sql import functions as F

from stratalith.llm import html, language, masked_lm, pii, registry, toxicity
from stratalith.llm.text import Words

SF = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    assert hold(registry.QUERIES[name](spark, SF), registry.SQL[name], "sf0.01") > 0


def test_language_on_held_out_documents(spark):
    out = registry.QUERIES["op2_zstd_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "lang", "n_chars")
    rows = out.filter("held_out").join(truth, "doc_id").filter("n_chars >= 40").collect()
    assert len(rows) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_held_out_documents(spark):
    out = registry.QUERIES["op3_fm_toxicity"](spark, f"{DATA}/sf0.1")
    rows = out.filter("held_out").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").select("toxic", "score", "predicted").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert len(bad) > 10 and np.mean([x > y for x in bad for y in good]) >= 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_pairs_weigh_more_than_their_parts():
    """Label 1 only where both terms meet: a machine with factors learns it, weights alone can't."""
    rng = np.random.default_rng(1)
    rows = [sorted({int(a) for a in np.nonzero(rng.random(4) < 0.5)[0]}) for _ in range(2000)]
    label = np.array([float(0 in r and 1 in r) != float(2 in r and 3 in r) for r in rows], float)
    term = np.concatenate([np.array(r, np.int64) for r in rows])
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for factors, least, most in ((4, 0.85, 1.0), (0, 0.0, 0.85)):
        machine = toxicity.fit(np.arange(4), term, text, label, factors=max(factors, 1))
        if not factors:
            machine.factor[:] = 0
        got = ((machine.score(term, text, len(rows)) >= 0.5) == label).mean()
        assert least <= got <= most


def test_masked_scores_tell_shuffled_texts(spark):
    """Texts that run through a cycle of words: their order is what the network learns, so shuffled ones score lower."""
    rng = np.random.default_rng(5)
    cycle = [f"w{chr(97 + i % 26)}{i}" for i in range(40)]
    texts = [[cycle[(at + i) % 40] for i in range(80)] for at in rng.integers(0, 40, 600)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    mixed = spark.createDataFrame([(i, " ".join(rng.permutation(t))) for i, t in enumerate(texts)], "doc_id long, text string")
    vocabulary = masked_lm.Vocabulary(masked_lm.bucket_counts(docs))
    network = masked_lm.trained(docs, vocabulary)
    a, b = ({r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.scored(d, network, ["doc_id"]).collect()} for d in (docs, mixed))
    assert np.mean([a[k] > b[k] for k in a]) > 0.95
    assert all(x < 0 for x in a.values())


def test_pairs_are_learned_from_texts(spark):
    """Toxic only where an insult meets a group; both words alone are as frequent in clean texts. The whole way through learned()."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        words = [f"filler{x}" for x in rng.integers(0, 300, 12)]
        a, b = rng.random(2) < 0.3
        words += ["zorgbad"] * int(a) + ["groupmention"] * int(b)
        rows.append((i, " ".join(str(w) for w in rng.permutation(words)), int(a != b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.learned(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"))
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, machine, keep=["doc_id"]).collect()}
    assert np.mean([(score[i] >= 0.5) == y for i, _, y in rows]) > 0.97


def test_toxicity_against_plain_python(spark):
    """Scores of the whole query by a term-by-term machine in plain Python."""
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = toxicity.toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    place = {int(b): i for i, b in enumerate(machine.buckets)}
    got = {r["doc_id"]: r["score"] for r in registry.QUERIES["op3_fm_toxicity"](spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        found = {place[int(b)] for b in toxicity.terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] if int(b) in place}
        total = machine.base + sum(machine.weight[i] for i in found)
        ordered = sorted(found)
        total += sum(float(machine.factor[i] @ machine.factor[j]) for k, i in enumerate(ordered) for j in ordered[k + 1 :])
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-9


def test_language_against_plain_python(spark):
    """Every prediction by one compression for each language, with the dictionaries handed over; whole texts, short ones too."""
    import zstandard as zstd

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = docs.filter(~language.held_out("doc_id")).select(F.col("doc_id").alias("key"), "text", "lang")
    dictionaries = language.samples(learn)
    assert set(dictionaries) == {r["lang"] for r in learn.filter("lang IS NOT NULL").select("lang").distinct().collect()}
    pack = {k: zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(v, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_LAZY, **language.ENCODER)) for k, v in dictionaries.items()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_zstd_language"](spark, SF).collect()}
    right = []
    for r in docs.collect():
        raw = re.sub(r"[\W\d_]+", " ", (r["text"] or "").lower()).strip().encode()
        sizes = {k: sum(len(p.compress(raw[i : i + 8192])) for i in range(0, len(raw), 8192)) for k, p in sorted(pack.items())}
        best = min(sizes, key=sizes.get) if raw else "und"
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["lang"] and raw and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            right.append(best == r["lang"])
    assert len(right) > 50 and np.mean(right) >= 0.95


def test_every_language_has_a_dictionary(spark):
    """Texts that open alike, languages whose lines all repeat, and 300 languages: none is lost."""
    shared = "one opening line of every text"
    rows = [(i, shared + "\n" + " ".join(w + chr(97 + i % 300 // 20) + chr(97 + i % 20) for w in ("wort", "satz", "rede")), f"l{i % 300:03d}") for i in range(900)] + [(2000 + i, shared, "copy") for i in range(5)]
    out = language.samples(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert len(out) == 301 and out["copy"] == shared.encode() and all(shared.encode() not in v for k, v in out.items() if k != "copy")


def plain_scores(texts, network):
    """Masked scores word by word, in plain Python, with the network's tables handed over."""
    v, out = network.vocabulary, []
    sig = lambda x: 1 / (1 + math.exp(-x))
    for text in texts:
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        raw = "\n".join(words).encode()
        token = [int(t) for t in v.tokens(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))] if words else []
        total = 0.0
        for i, t in enumerate(token):
            near = [int(v.input_of[token[i + by]]) if 0 <= i + by < len(token) else v.n_inputs - 1 for by in masked_lm.REACH]
            h = [math.tanh(sum(float(network.embed[j][near[j]][d]) for j in range(4))) for d in range(masked_lm.WIDTH)]
            z = [sum(h[d] * float(network.cluster[d][c]) for d in range(masked_lm.WIDTH)) + float(v.class_log[c]) for c in range(v.classes)]
            c = (t + 1).bit_length() - 1
            total += z[c] - math.log(sum(math.exp(x) for x in z))
            for k in range(c):
                heap, bit = (t + 1) >> (c - k), ((t + 1) >> (c - k - 1)) & 1
                s = float(v.lean[(1 << c) + heap])
                if k < v.depth[c]:
                    s += sum(h[d] * float(network.node[v.base[c] + heap - 1][d]) for d in range(masked_lm.WIDTH))
                total += math.log(sig(s) if bit else sig(-s))
        out.append((len(token), total))
    return out


def test_masked_scores_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").filter("length(text) < 3000 OR text IS NULL").limit(60)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "one")], "doc_id long, text string"))
    vocabulary = masked_lm.Vocabulary(masked_lm.bucket_counts(docs), support=4)
    network = masked_lm.trained(docs, vocabulary, rounds=3)
    got = {r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in masked_lm.scored(docs, network, ["doc_id"]).collect()}
    rows = docs.collect()
    for r, (n, total) in zip(rows, plain_scores([r["text"] for r in rows], network), strict=True):
        assert got[r["doc_id"]][0] == n and abs(got[r["doc_id"]][1] - total) < 1e-3 * max(1, n)
    every = probability_of_all(network)
    assert abs(every - 1) < 1e-4


def probability_of_all(network):
    """Sum of the probabilities of all tokens between two borders."""
    v = network.vocabulary
    return sum(math.exp(x) for x in [plain_token(network, t) for t in range(len(v.rank))])


def plain_token(network, t):
    v = network.vocabulary
    h = np.tanh(sum(network.embed[j][v.n_inputs - 1].astype(float) for j in range(4)))
    z = h @ network.cluster.astype(float) + v.class_log
    c = (t + 1).bit_length() - 1
    total = z[c] - np.log(np.exp(z).sum())
    for k in range(c):
        heap, bit = (t + 1) >> (c - k), ((t + 1) >> (c - k - 1)) & 1
        s = float(v.lean[(1 << c) + heap]) + (float(h @ network.node[v.base[c] + heap - 1]) if k < v.depth[c] else 0.0)
        total -= np.log1p(np.exp(-s if bit else s))
    return total


def test_masked_scores_do_not_depend_on_tasks(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    scores = [{r["doc_id"]: r["log_likelihood"] for r in masked_lm.pseudo_likelihood(docs.repartition(n), ["doc_id"]).collect()} for n in (2, 7)]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - scores[1][k]) <= 1e-3 * max(1, abs(scores[0][k])) for k in scores[0])


def test_pseudonyms_link_equal_values_and_keep_formats(spark):
    text = "card 4111 1111 1111 1111, mail ann.lee@example.com on 2024-02-29 from 10.0.0.1, ssn 123-45-6789, call (212) 555-0187"
    rows = spark.createDataFrame([(1, text), (2, "again ann.lee@example.com and 4111 1111 1111 1111"), (3, "4111 1111 1111 1112 is no card")], "doc_id long, text string")
    a, b, c = (r for r in pii.pseudonymized(rows, "k").orderBy("doc_id").collect())
    mask = lambda t: re.sub("[a-z]", "x", re.sub("[0-9]", "9", re.sub(r"\d+\.\d+\.\d+\.\d+", "IP", t)))
    assert mask(a["text"]) == mask(text) and a["n_replaced"] == 6 and Counter(a["kinds"]) == Counter(["card", "email", "date", "ip", "ssn", "phone"])
    card, mail = a["text"][5:24], a["text"].split("mail ")[1].split(" on")[0]
    assert card in b["text"] and mail in b["text"] and card != "4111 1111 1111 1111"
    digits = [int(x) for x in card if x != " "][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert c["text"] == "4111 1111 1111 1112 is no card" and c["n_replaced"] == 0


def test_pseudonyms_of_all_forms(spark):
    """Secrets in texts without a digit, names in capitals, dates in every order, international phone groups."""
    values = ["password: correcthorsebattery", "PASSWORD=correcthorsebattery", "API_KEY=abcdefghijkl", "25/12/2024", "12/25/2024", "2024/12/25", "25.12.2024", "25-12-2024", "1750-03-04", "+44 20 7946 0958", "+442079460958", "+49 (30) 901820"]
    rows = [(i, f"before {v} after") for i, v in enumerate(values)] + [(99, "pin 12 and password: correcthorsebattery"), (100, "sum +5 10 or 99.99.2024 or token ring")]
    out = {r["doc_id"]: r for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    mask = lambda t: re.sub("[a-z]", "x", re.sub("[A-Z]", "X", re.sub("[0-9]", "9", t)))
    for i, v in enumerate(values):
        assert out[i]["n_replaced"] == 1 and v not in out[i]["text"] and mask(out[i]["text"]) == mask(rows[i][1]), v
    assert out[0]["text"].split()[2] == out[99]["text"].split()[-1] and out[100]["text"] == rows[-1][1] and "+44 " in out[9]["text"]
    days = spark.range(20000).select(F.col("id").alias("doc_id"), F.explode(F.array(*(F.date_format(F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")), x) for x in ("MM/dd/yyyy", "dd/MM/yyyy")))).alias("text")).dropDuplicates(["text"])
    made = [r["text"] for r in pii.pseudonymized(days, "k").select("text").collect()]
    assert len(set(made)) == len(made) > 20000


def test_feistel_is_a_permutation(spark):
    every = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    out = [r[0] for r in every.select(pii.feistel(F.col("v"), "k", "x")).collect()]
    assert sorted(out) == sorted(f"{i:03d}" for i in range(1000))


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = ([int(x) for x in rng.integers(0, 5, rng.integers(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        found = sorted(html.shared_lines(a, b))
        assert len(found) == best[-1, -1]
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)


def test_pages_lose_what_neighbours_share(spark):
    page = "<html><body><div>Site name</div><p>Own &amp; text {0} of  the\n page</p><script>x()</script><p>All rights</p></body></html>"
    rows = spark.createDataFrame([(i, f"https://h.org/a/{i}", page.format(i)) for i in range(4)] + [(9, None, None)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.main_text(rows).collect()}
    assert out == {i: f"Own & text {i} of the page" for i in range(4)} | {9: ""}


def test_pages_are_differenced_wherever_their_lines_stand(spark):
    """Marked pages in folders of their own, with copies between them, over many ranges: shared lines go, own ones stay."""
    page = "<body><div>Own text {0}</div><article>Teaser {0}</article><article><p>Shared notice</p></article><div>All rights</div></body>"
    rows = [(i, f"https://h.org/2024/{i:02d}/slug/", page.format(i)) for i in range(20)] + [(100 + i, f"https://h.org/2024/07/slug/{i:02d}", page.format(7)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in ("8", "3"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert out == {i: f"Own text {k}\n\nTeaser {k}" for i, k in [(i, i) for i in range(20)] + [(100 + i, 7) for i in range(30)]}


def test_quality_counts_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in registry.QUERIES["op7_quality_rules"](spark, f"{DATA}/sf0.001").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))


def near_duplicates(texts, n=5, num=80, den=100):
    """The ids that stay: the smallest of each component of links, by all pairs that share a shingle."""
    words = {k: [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))] for k, t in texts.items()}
    grams = {k: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for k, w in words.items()}
    where = {}
    for k, g in grams.items():
        for x in g:
            where.setdefault(x, []).append(k)
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    shared = Counter((a, b) for ids in where.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    for (a, b), m in shared.items():
        if den * m >= num * (len(grams[a]) + len(grams[b]) - m):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k for k in texts if root(k) == k}


def test_pipeline_against_its_parts(spark, tmp_path):
    """Every stage on all that its predecessor kept: toxicity and pseudonyms by plain Python, near duplicates by all pairs, leaks and the mix by SQL."""
    import corpus_pipeline
    from test_pii import KEY, twin

    from stratalith.llm import mixing, templates

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    machine = toxicity.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    place = {int(b): i for i, b in enumerate(machine.buckets)}

    def is_toxic(text):
        raw = (text or "").encode()
        found = sorted({place[int(b)] for b in toxicity.terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] if int(b) in place})
        total = machine.base + sum(machine.weight[i] for i in found) + sum(float(machine.factor[i] @ machine.factor[j]) for k, i in enumerate(found) for j in found[k + 1 :])
        return bool((text or "").strip()) and total >= 0

    steps, step = [docs], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, SF).write.parquet(f"{tmp_path}/{i}")
        step = spark.read.parquet(f"{tmp_path}/{i}")
        assert step.columns == docs.columns
        steps.append(step)
    texts = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in steps]
    assert set(texts[1]) == {k for k, t in texts[0].items() if not is_toxic(t)}
    assert set(texts[2]) == near_duplicates(texts[1])
    leaked = {r[0] for r in duck(f"SELECT doc_id FROM ({templates.SQL['op8_template_leaks']})", "sf0.01", f"{tmp_path}/1/*.parquet")[1]}
    assert leaked and set(texts[3]) == set(texts[2]) - leaked
    assert pii.key_of(spark) == KEY and texts[4] == {k: twin(t)[0] for k, t in texts[3].items()}
    out = corpus_pipeline.STAGES[-1][1](spark, step, SF).select("doc_id", "text", "at", "copy").collect()
    names, mixed = duck(f"SELECT doc_id, copies FROM ({mixing.SQL['op10_curriculum_mix']})", "sf0.01", f"{tmp_path}/3/*.parquet")
    copies = {r[names.index("doc_id")]: r[names.index("copies")] for r in mixed}
    assert Counter(r["doc_id"] for r in out) == Counter({k: n for k, n in copies.items() if n})
    assert all(r["text"] == texts[4][r["doc_id"]] for r in out) and [r["at"] for r in out] == sorted(r["at"] for r in out)
    assert spark_rows(corpus_pipeline.run(spark, SF))[1].total() == len(out)


def test_early_positions_favour_the_early_source(spark):
    """Of sources with like sizes, the one whose weight falls stands before the one whose weight rises."""
    from stratalith.llm import mixing

    docs = spark.createDataFrame([(i, "some words of a text", "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    mean = {r["source"]: r["m"] for r in mixing.range_sorted(mixing.assigned(docs)).groupBy("source").agg(F.avg("at").alias("m")).collect()}
    assert mean["a"] < mean["b"] - 0.05 and mean["b"] < mean["c"] - 0.05


def test_language_letters():
    assert language.letters("Ab1, ÇD  e") == "ab çd e".encode()
