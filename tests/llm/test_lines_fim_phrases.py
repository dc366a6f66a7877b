"""Line dedup, learned cuts and phrase mining against plain Python, with nulls, ties, repeated rows and empty tables."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from compare import DATA, hold
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm import collocations, cuckoo, fim, lines, registry

DOCS = [
    (5, "Shared line of text\nown line of five\n  SHARED line of text \nshort"),
    (2, "shared LINE of text\t\nown line of two\n\nshort"),
    (9, "own line of two\nshort\nlast one here, end"),
    (None, "own line of two\nonly the null one\nshared line of text"),
    (7, None),
    (8, ""),
    (2, "shared LINE of text\t\nown line of two\n\nshort"),
    (11, "éééééééééé\nonly the null one"),
    (12, "ÉÉéééééééé\néééééééééé\nown line of two"),
]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def plain_lines(rows, holders=None):
    """(id, kept text, lines, dropped) by sets of holders; a null id comes last."""
    rank = lambda i: (i is None, i or 0)
    who = defaultdict(set)
    for i, t in rows if holders is None else holders:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                who[key(line)].add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= 10 and len(who[key(x)]) > 1 and min(who[key(x)], key=rank) != i)]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return Counter(out)


def got_lines(docs, index):
    return Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.deduplicated(docs, index).collect())


def test_lines_against_plain_python(spark):
    docs = frame(spark, DOCS)
    assert got_lines(docs, lines.inserted(lines.created(spark), docs)) == plain_lines(DOCS)


def test_lines_through_the_shards(spark, monkeypatch):
    """Filters too large to be sent to all tasks: keys meet them by shard, and the exact counts by a dealt join."""
    monkeypatch.setattr(lines, "SENT", -1)
    docs = frame(spark, DOCS)
    assert got_lines(docs, lines.inserted(lines.created(spark), docs)) == plain_lines(DOCS)


def test_inserted_deleted_and_opened_again(spark):
    """Any history of insertions and deletions gives the index of what is left; inserting again changes nothing."""
    parts = [DOCS[:3], DOCS[3:6], DOCS[6:]]
    index = lines.created(spark)
    for p in (*parts, parts[0]):
        index = lines.inserted(index, frame(spark, p))
    docs = frame(spark, DOCS)
    assert got_lines(docs, index) == plain_lines(DOCS)
    before = index
    index = lines.deleted(index, frame(spark, [(2,), (None,), (77,)], "doc_id long"))
    left = [r for r in DOCS if r[0] not in (2, None)]
    assert got_lines(frame(spark, left), index) == plain_lines(left)
    fresh = lines.inserted(lines.created(spark), frame(spark, left))
    refs = lambda x: sorted(map(tuple, x.references().collect()), key=str)
    assert refs(index) == refs(fresh) == refs(lines.compacted(index)) and index.keys == fresh.keys
    held = lambda x: x.filter_table().groupBy().sum("n_live", "n_shared").first()
    assert held(index) == held(fresh)
    again = lines.inserted(index, frame(spark, [r for r in DOCS if r[0] in (2, None)]))
    assert got_lines(docs, again) == plain_lines(DOCS)
    assert got_lines(docs, before) == plain_lines(DOCS)  # older versions stay readable
    assert lines.opened(spark, index.root).version == max(again.version, index.version + 1)


def test_a_larger_index_grows_its_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "PER_SHARD", 200)
    rows = [(i, "\n".join(f"line number {i * k % 701} of many" for k in range(1, 9))) for i in range(300)]
    index = lines.inserted(lines.inserted(lines.created(spark), frame(spark, rows[:40])), frame(spark, rows[40:]))
    assert index.shards > 1
    assert got_lines(frame(spark, rows), index) == plain_lines(rows)
    index = lines.deleted(index, frame(spark, [(i,) for i in range(0, 300, 2)], "doc_id long"))
    assert got_lines(frame(spark, rows[1::2]), index) == plain_lines(rows[1::2])


def test_empty_tables_and_other_columns(spark):
    none = frame(spark, [])
    index = lines.inserted(lines.created(spark), none)
    assert lines.deduplicated(none, index).count() == 0
    assert got_lines(frame(spark, [(1, "a line of some length")]), index) == Counter([(1, "a line of some length", 1, 0)])
    odd = spark.createDataFrame([(1, "a\nb", 3, "x", 4)], "doc_id long, text string, n_lines int, extra string, h1 int")
    out = lines.deduplicated(odd, lines.inserted(lines.created(spark), odd))
    assert out.columns == ["doc_id", "extra", "h1", "text", "n_lines", "n_dropped"] and out.first()["h1"] == 4


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 3000), st.floats(0, 1))
def test_filters_deny_no_key_that_they_hold(seed, n, share):
    rng = np.random.default_rng(seed)
    h = rng.integers(-(2**63), 2**63 - 1, (n, 2))
    made = cuckoo.Filter(cuckoo.buckets_for(n))
    while not made.add(h[:, 0], h[:, 1]):
        made = cuckoo.Filter(2 * made.buckets)
    cut = int(share * n)
    made.remove(h[:cut, 0], h[:cut, 1])
    made = cuckoo.Filter.of(made.to_bytes())
    assert made.held == n - cut
    assert cuckoo.Shards({0: made.to_bytes()}, 1).may_hold(h[cut:, 0], h[cut:, 1]).all()
    other = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    assert cuckoo.Shards({0: made.to_bytes()}, 1).may_hold(other[:, 0], other[:, 1]).mean() < 0.002


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 5), st.integers(1, 4000)), max_size=400), st.sampled_from([0, 1, 16, 1024]))
def test_learned_index_is_exact(steps, error):
    offsets = np.cumsum([0, *steps]).astype(np.int64)
    index = fim.fitted(offsets, error)
    assert (index.offset(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.residual).max() <= error + 1
    if error == 1024 and len(set(steps)) == 1:
        assert len(index.first) == 1


FIM = [(i, t) for i, t in enumerate([None, "", "one", "one\n", "\n", "\n\n\n", "a\r\nbé\nc", "x<P>y\nz", "a<\nS>b\n<", "日本\n語\n" * 400 + "end", "\n".join("w" * (i % 50) for i in range(3000))])] + [(None, "a\nb\nc"), (3, "one\n")]


def plain_fim(i, t, rate=100, spm=50):
    t = t or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    hexed = sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexed[j : j + 8], 16) for j in range(0, 32, 8)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (i, len(u), "plain", None, None, t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (i, len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,spm", [(100, 50), (0, 50), (60, 0)])
def test_fill_in_the_middle_against_plain_python(spark, rate, spm):
    docs = frame(spark, FIM)
    out = fim.filled(docs, rate=rate, spm=spm).withColumn("back", fim.restored()).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in out) == Counter(plain_fim(i, t, rate, spm) for i, t in FIM)
    assert Counter((r["doc_id"], r["back"]) for r in out) == Counter((i, t or "") for i, t in FIM)


def test_stored_index_gives_the_cuts_of_the_texts(spark):
    docs = frame(spark, FIM)
    index = fim.rank_index(docs, error=64)
    text = dict(FIM)
    for r in fim.cuts(index, copies=3).collect():
        data = (text[r["doc_id"]] or "").encode()
        ends = [0, *(m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+", data))]
        a, b = (x % len(ends) for x in fim.draws(7, r["doc_id"], r["copy"])[:2])
        assert (r["prefix_end"], r["middle_end"]) == tuple(sorted((ends[a], ends[b])))
    assert fim.filled(frame(spark, [])).count() == fim.rank_index(frame(spark, [])).count() == 0
    assert fim.filled(spark.createDataFrame([(1, "a\nb", "f", 2)], "doc_id long, text string, form string, `__text` int")).columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]


def plain_phrases(rows, support, top=2000):
    f = defaultdict(Counter)
    for lang, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        longer = defaultdict(int)
        found = {p: v for p, v in c.items() if len(p) > 1 and v >= support}
        for p, v in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], v)
        rows_ = []
        for p, a in found.items():
            score, _, l, r = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < 100 * a:
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return Counter(out)


def texts(n=400):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["É", "of", "THE"]
    rows = []
    for i in range(n):
        t = " ".join(str(w) for w in rng.choice(words, 60, p=np.array([15 - j for j in range(15)]) / 120))
        rows.append((["en", "de", None][i % 3], t + (". new york city hall\tis open; New  York" if i % 2 else ", a b")))
    return [*rows, ("en", None), ("en", ""), ("fr", " .,; "), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("shard_words,most", [(20_000_000, 2_000_000), (700, 2_000_000), (1, 2_000_000), (700, 0)])
def test_phrases_against_plain_python(spark, shard_words, most):
    """Large, small and single-text shards; keys sent to the tasks, or matched by a join."""
    rows = texts()
    out = collocations.collocations(frame(spark, rows, "lang string, text string").repartition(5), support=20, shard_words=shard_words, most=most, top=100)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(map(tuple, out.collect())) == plain_phrases(rows, 20, 100)


def test_scores_through_dealt_joins(spark):
    rows = texts(60)
    phrases, words = collocations.frequent_phrases(frame(spark, rows, "lang string, text string"), support=3)
    a, b = (Counter(map(tuple, collocations.scored(phrases, words, most).select("language", "phrase", "count", "l", "r", "score").collect())) for most in (1_000_000, 0))
    assert a == b and sum(a.values()) > 100


def test_wide_products_are_exact(spark):
    """Counts whose products pass 64 bits."""
    big = 3 * 10**12 + 7
    phrases = spark.createDataFrame([("en", "a b", 2, big)], "language string, phrase string, size int, count long")
    words = spark.createDataFrame([("en", None, 1, 10**14 + 3), ("en", "a", 1, big + 11), ("en", "b", 1, big + 5)], "language string, phrase string, size int, count long")
    assert collocations.scored(phrases, words).first()["score"] == 1000 * big * (10**14 + 3) // ((big + 11) * (big + 5))


def test_languages_with_fewer_phrases_than_the_support(spark):
    """Short texts of many languages: a shard has fewer phrases of a language than may stay hidden."""
    rows = [(f"l{i % 9}", "one two three " * (i % 7) + "four") for i in range(60)]
    out = collocations.collocations(frame(spark, rows, "lang string, text string").coalesce(1), support=25)
    assert Counter(map(tuple, out.collect())) == plain_phrases(rows, 25)


def test_phrases_of_empty_tables(spark):
    assert collocations.collocations(frame(spark, [], "lang string, text string")).count() == 0
    assert collocations.collocations(frame(spark, [("en", None)], "lang string, text string")).count() == 0
    assert collocations.local_support(100, 1, 1000) == 1 and collocations.local_support(100, 501, 1000) == 51


def test_phrases_of_a_larger_table(spark):
    """sf0.1: many phrases pass the support, in several shards."""
    assert hold(registry.QUERIES["op13_son_collocations"](spark, f"{DATA}/sf0.1"), registry.SQL["op13_son_collocations"], "sf0.1") > 1000


def test_buckets_keep_what_has_the_support(spark):
    """Where the support of a shard is one, only phrases whose bucket has the support overall are named."""
    rows = [(x or "und", t) for x, t in texts()]
    given = frame(spark, rows, "language string, text string").repartition(4)
    words = collocations.word_counts(given, 700)
    totals = {r["language"]: r["count"] for r in words.filter("word IS NULL").collect()}
    buckets = collocations.Buckets({}, 20)
    for sizes in (range(2, 3), range(3, 6)):
        buckets = collocations.bucketed(given, sizes, 20, None, buckets)
    sent = spark.sparkContext.broadcast(buckets)
    named = {likely: {r["key"] for r in collocations.mined(given, totals, 20, 1, None, sent if likely else None).filter("key IS NOT NULL").select("key").collect()} for likely in (False, True)}
    phrases = collocations.frequent_phrases(frame(spark, rows, "lang string, text string"), support=20)[0].count()
    assert named[True] < named[False] and phrases <= len(named[True]) < 1.1 * phrases < len(named[False])
