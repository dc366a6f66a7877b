"""Retrieval over a stored index: postings sorted by term, boosts by path, pinned files, hybrid scores, citations.

An index is written once; a question reads only the row groups that hold its terms and one row of statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.sources.shared import small, written

# Words that widen a question, and what paths weigh for it.
EXPANSIONS = [
    ("auth authentication login oauth jwt session", "auth authentication authenticate authorization authorize login jwt oauth session password middleware guard"),
    ("database db sql storage persist used", "database db sql storage store repository model schema migration postgres sqlite mysql redis orm prisma mongoose sequelize gorm sqlx diesel"),
    ("route routes routing api endpoint defined", "route routes router routing api endpoint controller handler server get post put patch delete"),
]
#: words of the question -> (test of the path, values, boost)
PATH_BOOSTS = [
    ("what project do overview", [("is", ("readme.md",), 0.22), ("is", ("package.json", "pyproject.toml"), 0.12), ("begins", ("examples/",), -0.12)]),
    ("authentication auth login oauth jwt session", [("has", ("auth", "jwt", "middleware", "session", "login", "oauth", "security"), 0.34), ("ends", ("semgrep_rules.yml", "scanner.py"), -0.45)]),
    ("payment payments stripe billing invoice", [("has", ("payment", "stripe", "billing", "invoice", "checkout"), 0.18)]),
    ("database db sql model schema", [("has", ("database", "db", "sql", "storage", "store", "model", "schema", "chroma", "metadata"), 0.18), ("ends", ("store.py", "indexer.py", "retriever.py", "config.py"), 0.22)]),
    ("route routes routing api endpoint", [("has", ("route", "routing", "router", "view", "endpoint", "controller", "handler"), 0.16), ("ends", ("main.py", "main.ts", "main.tsx"), 0.28)]),
    (None, [("has", ("/compiled/",), -0.3), ("ends", (".min.js", ".bundle.js"), -0.3)]),
]
IMPLEMENTATION = "authentication auth login database db route routes api endpoint"
QUALITY = [
    ("part", ("test", "tests", "docs", "doc", "docs_src", "examples", "scripts"), -0.24), ("begins", ("docs_src/", "tests/", "test/", "scripts/", ".github/"), -0.22), ("ends", (".md", ".rst", ".txt"), -0.22),
    ("ends", (".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".go", ".rs", ".cs", ".kt", ".kts", ".php"), 0.16),
]
#: words inside the question -> words of paths whose files are pinned
PINNED = [("database db storage persist", "database db store storage repository sql"), ("auth authentication login jwt session", "auth jwt middleware session login oauth security")]
ROUTE_WORDS = ("routing", "route", "api", "endpoint")


def question_terms(question: str) -> list[str]:
    """Search words of a question with those that its subject brings along."""
    words = set(re.findall(rules.SEARCH_WORD, question.lower()))
    for said, brought in EXPANSIONS:
        if words & set(said.split()):
            words |= set(brought.split())
    return sorted(words)


def _holds(path: Column, how: str, values: tuple[str, ...]) -> Column:
    if how == "is":
        return path.isin(*values)
    if how == "part":
        return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, values)))
    test = {"has": path.contains, "begins": path.startswith, "ends": path.endswith}[how]
    return reduce(lambda a, b: a | b, map(test, values))


def path_boost(path: Column, terms: list[str]) -> Column:
    """What a path adds to the score of its chunks for a question of these terms."""
    low, out = F.lower(path), F.lit(0.0)
    for said, parts in PATH_BOOSTS:
        if said is None:  # compiled files, by one of two signs
            out = out + F.when(reduce(lambda a, b: a | b, (_holds(low, how, values) for how, values, _ in parts)), parts[0][2]).otherwise(0.0)
        elif set(said.split()) & set(terms):
            exact = [p for p in parts if p[0] == "is"]
            if exact:  # the first file name that fits
                out = out + reduce(lambda a, p: a.when(_holds(low, p[0], p[1]), p[2]), exact[1:], F.when(_holds(low, *exact[0][:2]), exact[0][2])).otherwise(0.0)
            for how, values, weight in (p for p in parts if p[0] != "is"):
                out = out + F.when(_holds(low, how, values), weight).otherwise(0.0)
    return out


def quality_boost(path: Column, terms: list[str]) -> Column:
    """Prefers source files for questions about the implementation."""
    if not set(IMPLEMENTATION.split()) & set(terms):
        return F.lit(0.0)
    return reduce(lambda a, p: a + F.when(_holds(F.lower(path), p[0], p[1]), p[2]).otherwise(0.0), QUALITY, F.lit(0.0))


def _counted(words: DataFrame) -> DataFrame:
    """doc_id, n_terms, term, freq: the distinct words of each row, counted inside its task; a row without words has a null term."""
    schema = words.select("doc_id", F.lit(0).cast("long").alias("n_terms"), F.lit("").alias("term"), F.lit(0).cast("long").alias("freq")).schema
    schema["term"].nullable = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, lists = b.column(0).slice(lo, 256), b.column(1).slice(lo, 256)
                n = pc.list_value_length(lists)
                empty = pc.indices_nonzero(pc.equal(n, 0)).cast(pa.int64())
                each = pa.table({"row": pc.list_parent_indices(lists).cast(pa.int64()), "term": pc.list_flatten(lists).cast(pa.string())}).group_by(["row", "term"]).aggregate([([], "count_all")])
                row = pa.concat_arrays([each["row"].combine_chunks(), empty])
                term = pa.concat_arrays([each["term"].combine_chunks(), pa.nulls(len(empty), pa.string())])
                freq = pa.concat_arrays([each["count_all"].combine_chunks(), pa.array([1] * len(empty), pa.int64())])
                yield pa.RecordBatch.from_arrays([ids.take(row), n.take(row).cast(pa.int64()), term, freq], names=schema.names)

    return words.mapInArrow(count, schema)


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of docs (doc_id, text), written: (term, doc_id, freq, n_terms) sorted by term; one row (docs, mean).

    Postings are counted in each row's own task and shuffled once, to their place in the order; only those of ids with
    several rows are added up before that. They are written first, as the order's bounds are found by a reading of their own.
    """
    words = docs.filter("text IS NOT NULL").select("doc_id", exprs.search_terms(F.col("text")).alias("words"))
    again = written(docs.filter("text IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again")))
    sent = small(again, again.count())
    each = written(_counted(words))
    marked = each.join(sent, each["doc_id"].eqNullSafe(again["doc_id"]), "left").select(each["*"], "again")
    several = marked.filter("again").groupBy("doc_id", "n_terms", "term").agg(F.sum("freq").alias("freq"))
    counted = marked.filter("again IS NULL").select(several.columns).unionByName(several)
    postings = written(counted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").select("term", "doc_id", "freq", "n_terms"))
    statistics = postings.filter("term IS NOT NULL").groupBy().agg(F.sum("freq").alias("words"))
    number = words.agg(F.count(F.lit(1)).alias("docs"))
    return postings, written(statistics.crossJoin(number).select("docs", (F.coalesce("words", F.lit(0)) / F.greatest("docs", F.lit(1))).alias("mean")))


def bm25(postings: DataFrame, statistics: DataFrame, terms: list[str], k1: float = 1.5, b: float = 0.75, okapi: bool = False) -> DataFrame:
    """doc_id, bm25 of documents that hold a term; only the terms' postings are read."""
    found = postings.filter(F.col("term").isin(*terms))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.greatest(F.lit(0.0), F.log(1 + ratio) if okapi else ratio)
    denominator = F.col("freq") + k1 * (1 - b + b * F.col("n_terms") / F.greatest(F.col("mean"), F.lit(1.0)))
    part = exprs.dec_round(idf * (F.col("freq") * (k1 + 1)) / denominator, 8).cast("decimal(28,8)")
    rows = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(statistics))  # as many rows as terms, and one
    return rows.groupBy("doc_id").agg(F.sum(part).cast("double").alias("bm25")).filter("bm25 > 0")


def lexical(postings: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, lexical: share of the terms that a document has, for those that have one."""
    return postings.filter(F.col("term").isin(*terms)).groupBy("doc_id").agg(exprs.dec_round(F.count(F.lit(1)) / len(terms), 4).alias("lexical"))


def hybrid(chunks: DataFrame, similarities: DataFrame, postings: DataFrame, statistics: DataFrame, question: str, pinned: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, path, score, origin: the best of vector, pinned and word candidates, keep the best of each, the `most` by score.

    chunks has doc_id, path; similarities doc_id, similarity; pinned has path of files that the question is about.
    """
    terms = question_terms(question)
    boost = path_boost(F.col("path"), terms) + quality_boost(F.col("path"), terms)
    known = chunks.select("doc_id", "path")
    words = lexical(postings, terms)
    near = similarities.join(known, "doc_id").join(words, "doc_id", "left").select("doc_id", "path", exprs.dec_round(0.66 * F.col("similarity") + 0.22 * F.coalesce("lexical", F.lit(0.0)) + boost, 4).alias("score"), F.lit("vector").alias("origin"))
    low = exprs.low_value(F.col("path"))
    first = pinned.select("path").distinct().orderBy(low, F.size(F.split("path", "/")), "path").limit(12)
    of_path = known.join(F.broadcast(first), "path").withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("doc_id"))).filter("r <= 3")
    held = of_path.join(words, "doc_id", "left").select("doc_id", "path", exprs.dec_round(0.72 + 0.18 * F.coalesce("lexical", F.lit(0.0)) + boost, 4).alias("score"), F.lit("pinned").alias("origin"))
    score = exprs.dec_round(F.least(F.lit(0.95), 0.42 + F.col("bm25") / 18 + boost), 4)
    by_words = bm25(postings, statistics, terms).join(known, "doc_id").select("doc_id", "path", score.alias("score"), F.lit("bm25").alias("origin"))
    best = near.unionByName(held).unionByName(by_words).groupBy("doc_id", "path").agg(F.max(F.struct("score", "origin")).alias("x"))
    return best.select("doc_id", "path", "x.*").orderBy(F.desc("score"), "doc_id").limit(most)


def pinned_files(question: str, special: DataFrame, paths: DataFrame) -> DataFrame:
    """path of the files that a question is about: routed and stored ones of special (path, routed, stored), and by words of paths."""
    low, parts = question.lower(), [paths.select("path").limit(0)]
    if any(w in low for w in ROUTE_WORDS):
        parts.append(special.filter("routed").select("path"))
    for i, (said, words) in enumerate(PINNED):
        if any(w in low for w in said.split()):
            parts.append(paths.filter(exprs.any_contains(F.lower("path"), words.split())).select("path"))
            if i == 0:
                parts.append(special.filter("stored").select("path"))
    return reduce(DataFrame.unionByName, parts).distinct()


def citations(chunks: DataFrame, most: int = 700) -> DataFrame:
    """chunks with their text redacted and cut to what a citation shows."""
    return chunks.withColumn("text", F.substring(exprs.redact(F.col("text")), 1, most))


def cited_only(answers: DataFrame, allowed: list[str]) -> DataFrame:
    """answers without the sentences that name a file outside `allowed`."""
    refs = lambda s: F.regexp_extract_all(s, F.lit(rules.FILE_REFERENCE), F.lit(1))
    parts = F.filter(F.split(F.trim("text"), r"(?<=[.!?])\s+"), lambda s: s != "")
    known = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    return answers.withColumn("text", F.array_join(F.filter(parts, lambda s: F.size(F.array_except(refs(s), known)) == 0), " "))
