"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import html, jaccard, language, masked_lm, mixing, pii, quality, substrings, templates, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
COPY = " ".join(f"tok{i}" for i in range(120))
ROWS = [
    (1, COPY, "en", "a", len(COPY)), (2, COPY, "en", "a", len(COPY)), (2, COPY, "en", "a", len(COPY)), (3, COPY + " tail", None, None, None),
    (4, "", "en", "a", 0), (5, None, "de", "b", None), (None, COPY, "en", "a", 1), (6, LONG, "de", "b", len(LONG)), (7, "  \n\t ", "en", "c", 5),
    (8, "ein zwei üß中文 \U0001f600 drei", None, "c", 9), (None, None, None, None, None),
]
EXTRA = ["score", "size", "node", "kept", "label", "__class", "position", "windows", "kinds", "term", "host", "sig"]


def clash(df):
    return df.withColumns({c: F.lit("extra") for c in EXTRA})


OPS = {
    "jaccard": lambda d: jaccard.jaccard_components(d), "language": lambda d: language.scored(d, language.samples(d.select(F.col("doc_id").alias("key"), "text", "lang")), "text", ["doc_id"]),
    "toxicity": lambda d: toxicity.scored(d, toxicity.learned(d.select("doc_id", "text"), d.select("doc_id", (F.col("doc_id") % 2).alias("label"))), keep=["doc_id"]),
    "masked_lm": lambda d: masked_lm.pseudo_likelihood(d, ["doc_id"]), "substrings": lambda d: substrings.without_repeats(d),
    "pii": lambda d: pii.pseudonymized(d, "k"), "quality": lambda d: quality.quality(d), "mixing": lambda d: mixing.assigned(d),
}


@pytest.mark.parametrize("shape", ["plain", "clash", "empty"])
@pytest.mark.parametrize("name", sorted(OPS))
def test_every_row_has_a_result(spark, name, shape):
    docs = spark.createDataFrame([] if shape == "empty" else ROWS, SCHEMA)
    out = OPS[name](clash(docs) if shape != "plain" else docs).collect()
    assert len(out) == (0 if shape == "empty" else len(ROWS))


def test_jaccard_cases(spark):
    out = jaccard.jaccard_components(spark.createDataFrame(ROWS, SCHEMA), n=3, num=90, den=100).collect()
    of = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None}
    assert of == {1: (118, 1), 2: (118, 1), 3: (119, 1), 4: (0, 4), 5: (0, 5), 6: (of[6][0], 6), 7: (0, 7), 8: (3, 8)}
    assert sorted(str(r["component_id"]) for r in out if r["doc_id"] is None) == ["1", "None"]


def test_substring_cases(spark):
    out = substrings.without_repeats(spark.createDataFrame(ROWS, SCHEMA)).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in out if r["doc_id"] is not None and r["doc_id"] != 6)
    assert got == [(1, 120, 0), (2, 120, 120), (2, 120, 120), (3, 121, 120), (4, 0, 0), (5, 0, 0), (7, 0, 0), (8, 5, 0)]
    assert all(r["n_removed"] == 0 for r in out if r["doc_id"] is None)


def test_leak_cases(spark):
    item = "A train leaves the station with 40 passengers and travels 120 km before it reaches the northern harbour"
    moved = item.replace("40", "55").replace("120", "310")
    docs = spark.createDataFrame([(1, f"intro words {item} outro"), (2, f"x {moved} y"), (3, "something else entirely is written in this line of text here"), (4, None), (5, ""), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (None, item), (11, None), (12, "")], "item_id long, text string")
    out = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in templates.leaks(clash(docs), items).collect()}
    assert {(1, 10, True), (2, 10, False)} <= out and not {r for r in out if r[0] in (3, 4, 5)}
    assert templates.leaks(docs.limit(0), items).count() == 0 and templates.leaks(docs, items.limit(0)).count() == 0


def test_leaks_of_all_forms(spark):
    """Values of other lengths, names beyond Latin-1, items of few or no plain tokens, short items, long texts, phrases of many items."""
    base = "{} bought {} crates of fruit for the market and sold each of them at {} coins before the evening came"
    items = [
        (1, base.format("Anna", "12", "5")), (2, "12 14 16 18 20 22"), (3, "Forty Two"), (4, "41 43 47"), (5, "how many apples are left"),
        *((100 + i, "answer the following question with one of the given letters only " + " ".join(f"w{chr(97 + i)}x{chr(97 + j)}" for j in range(9))) for i in range(5)),
    ]
    docs = [
        (1, "so " + base.format("Mary Jane", "1,250", "2.5") + " indeed"), (2, "so " + base.format("Ωμέγα", "7", "3") + " indeed"), (3, "row 12 14 16 18 20 22 end"), (4, "FORTY Two!"), (5, "then Forty Two came"),
        (6, "41 43 47"), (7, "how many apples are left"), (8, "answer the following question with one of the given letters only please"), (9, "word " * 60_000 + base.format("Anna", "12", "5")), (10, "12 14 16 18 20"),
        (11, "× " + base.format("anna", "12", "5").replace("fruit", "fruits")),
    ]
    given = [spark.createDataFrame(r, f"{k} long, text string") for r, k in ((docs, "doc_id"), (items, "item_id"))]
    want = {(1, 1, False), (2, 1, False), (3, 2, True), (4, 3, True), (6, 4, True), (7, 5, True), (9, 1, True)}
    for bound in (64_000_000, 0):
        out = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in templates.leaks(*given, bound=bound).collect()}
        assert out == want | {(11, 1, True)}  # a word changed, a name in small letters


def test_page_cases(spark):
    rows = [(1, "https://h/x", "<p>one"), (1, "https://h/x", "<p>one"), (2, None, "<p>t&eacute;xt</p>"), (3, "https://h/y", None), (4, "", ""), (None, "no url", "<nav>menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "lines", "path", "host")})
    out = html.main_text(pages).collect()
    assert len(out) == len(rows) and {r["text"] for r in out if r["page_id"] == 2} == {"téxt"}
    assert html.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["plain", "clash", "empty"])
def test_stages(spark, tmp_path, shape):
    docs = spark.createDataFrame([] if shape == "empty" else ROWS, SCHEMA)
    docs = clash(docs) if shape == "clash" else docs
    spark.createDataFrame([(1, 0, 0), (6, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such passage is found in any of these documents at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(1, 0, None)], [(99, 0, 1)], [(1, 0, 1), (6, 0, 1)]])
def test_no_row_is_toxic_without_learned_labels(spark, tmp_path, labels):
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).count() == len(ROWS)


def test_texts_without_words_are_not_toxic(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    one = np.ones(1)
    monkeypatch.setattr(toxicity, "toxicity_model", lambda *_: toxicity.Machine(np.zeros(1, np.int64), 5.0, one, np.zeros((1, 1))))
    out = corpus_pipeline.reject_toxic(spark, spark.createDataFrame(ROWS, SCHEMA), str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["4", "5", "7", "None"]


@pytest.mark.parametrize("shape", ["plain", "clash"])
def test_mix_carries_the_texts(spark, shape):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 3 + 1), "en", "ab"[i % 2], 1) for i in [*range(20), 3]] + [(3, "another text", "de", "b", 2)], SCHEMA)
    mixed = mixing.assigned(docs).select("doc_id", "size", "copies").collect()
    out = corpus_pipeline.mix_sources(spark, docs if shape == "plain" else clash(docs), "").collect()
    assert len(out) == sum(r["copies"] for r in mixed) > 20
    texts = {(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"], r["lang"]) for r in out} <= texts and all(len(r["text"].split()) == r["size"] for r in out)
    assert [r["at"] for r in out] == sorted(r["at"] for r in out)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect() if r["doc_id"] is not None}


def test_language_cases(spark):
    docs = spark.createDataFrame(ROWS + [(20, "12 34 !?", "en", "a", 8), (21, "a", "en", "a", 1)], SCHEMA)
    same = {"aa": b"one and the same content", "bb": b"one and the same content"}
    out = by_id(language.scored(docs, same, "text", ["doc_id"]), "lang_pred", "score", "rejected")
    assert all(out[k] == ("und", 0.0, True) for k in (4, 5, 7, 20))
    assert out[1] == ("aa", 0.5, True) and out[21][0] == "aa" and 0 <= out[6][1] <= 1
    assert set(by_id(language.open_set(language.scored(docs, same, "text", ["doc_id"])), "lang_pred").values()) == {("und",)}
    assert set(by_id(language.scored(docs, {}, "text", ["doc_id"]), "lang_pred", "score").values()) == {("und", 0.0)}
    assert language.samples(docs.limit(0).select(F.col("doc_id").alias("key"), "text", "lang")) == {}


def test_toxicity_cases(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    none = toxicity.learned(docs.select("doc_id", "text"), docs.limit(0).select("doc_id", F.lit(1).alias("label")))
    assert set(by_id(toxicity.scored(docs, none, keep=["doc_id"]), "score").values()) == {(0.5,)}
    rows = [(i, "vile insult here" if i % 4 == 0 else "fine words here", None) for i in range(200)]
    many = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 0), (0, None), (None, 1), (999, 1)], "doc_id long, label int")
    machine = toxicity.learned(many, labels)
    got = by_id(toxicity.scored(many.unionByName(spark.createDataFrame([(500, None), (501, "")], "doc_id long, text string")), machine, keep=["doc_id"]), "score")
    base = 1 / (1 + np.exp(-machine.base))
    assert all((got[i][0] >= 0.5) == (i % 4 == 0) for i in range(200)) and abs(got[500][0] - base) < 1e-12 and got[500] == got[501]
    few = [toxicity.learned(many.repartition(n), labels, sample=50) for n in (1, 5)]
    assert np.array_equal(few[0].buckets, few[1].buckets) and np.allclose(few[0].weight, few[1].weight)


def test_masked_cases(spark):
    out = by_id(masked_lm.pseudo_likelihood(spark.createDataFrame(ROWS, SCHEMA), ["doc_id"]), "n_tokens", "log_likelihood", "mean_log_likelihood")
    assert all(out[k] == (0, 0.0, None) for k in (4, 5, 7)) and out[6][0] == 120_000 and out[1][1] < 0
    one = spark.createDataFrame([(1, "single"), (2, None)], "doc_id long, text string")
    assert by_id(masked_lm.pseudo_likelihood(one, ["doc_id"]), "n_tokens")[1] == (1,)


def test_pseudonym_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "call (212) 555-0187 " * 3000), (4, "nothing here")], "doc_id long, text string").withColumn("kinds", F.lit("x"))
    out = {r["doc_id"]: (r["text"], r["n_replaced"], len(r["kinds"])) for r in pii.pseudonymized(docs, "k").collect()}
    assert out[1] == (None, 0, 0) and out[2] == ("", 0, 0) and out[4] == ("nothing here", 0, 0)
    assert out[3][1:] == (3000, 3000) and len(set(out[3][0].split("call ")[1:])) == 1


def test_quality_cases(spark):
    out = by_id(quality.quality(spark.createDataFrame(ROWS, SCHEMA)), "n_words", "base_failed", "kept")
    assert all(out[k] == (0, True, False) for k in (4, 5, 7)) and out[1][0] == 120 and not out[1][1]


def test_mix_cases(spark):
    out = by_id(mixing.assigned(spark.createDataFrame(ROWS, SCHEMA)), "source", "size", "taken", "copies", "position")
    assert all(out[k][1:] == (0, 0, 0, []) for k in (4, 5, 7)) and out[3][0] is None and all(v[2] <= 2 * v[1] for v in out.values())
    sizes = spark.createDataFrame([("b", 100), (None, 100), ("a", 100)], "source string, source_size long")
    goal = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert goal == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}


def test_ties_and_repeated_rows_of_pages(spark):
    """Equally near neighbours: the next page decides; repeated rows are treated alike."""
    page = "<p>own {0}</p><p>{1}</p><p>longer words of page {0} that nobody else has</p>"
    rows = [(1, "https://h/b", page.format(1, "left")), (2, "https://h/c", page.format(2, "both")), (2, "https://h/c", page.format(2, "both")), (3, "https://h/d", page.format(3, "both"))]
    out = sorted((r["page_id"], r["n_deleted"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert out == [(1, 0), (2, 1), (2, 1), (3, 1)]
