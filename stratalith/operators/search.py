"""Retrieval: chunks, term statistics, BM25, vector and hybrid candidates, answer validation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.sources.shared import small, written

#: Characters of pieces that a task holds before it hands them on.
HELD = 1 << 21


def pieces(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int]]:
    """(start, piece, first line, last line) of overlapping pieces; a text is gone through once, however long."""
    line, counted, step = 1, 0, size - overlap
    for start in range(0, max(0, -(-(len(text) - size) // step)) * step + 1 if text else 0, step):
        line += text.count("\n", counted, start)
        counted = start
        piece = text[start : start + size]
        yield start, piece, line, line + piece.count("\n")


def chunks(files: DataFrame, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """path, start, text, line_start, line_end of overlapping pieces; the last ends where the text ends."""
    given = files.filter(F.length("text") > 0).select("path", "text")
    schema = given.select("path", F.lit(0).cast("long").alias("start"), "text", F.lit(0).alias("line_start"), F.lit(0).alias("line_end")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = [], 0  # a bounded number of pieces is held at once, however many rows and pieces a batch has
            for i in range(b.num_rows):
                for p in pieces(b.column(1)[i].as_py(), size, overlap):
                    found.append((i, *p))
                    held += len(p[1])
                    if held >= HELD:
                        yield made(b.column(0), found)
                        found, held = [], 0
            if found:
                yield made(b.column(0), found)

    def made(path: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        row, start, text, first, last = map(list, zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([path.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(text, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=schema.names)

    return given.mapInArrow(cut, schema)


def terms(docs: DataFrame, wanted=None) -> DataFrame:
    """doc_id, n_terms, term, freq of lower-cased search words, only `wanted` ones if given."""
    words = docs.select("doc_id", exprs.search_terms(F.col("text")).alias("words"))
    kept = F.filter("words", lambda w: w.isin(*wanted)) if wanted else F.col("words")
    rows = words.select("doc_id", F.size("words").cast("long").alias("n_terms"), F.explode(kept).alias("term"))
    return rows.groupBy("doc_id", "n_terms", "term").agg(F.count(F.lit(1)).alias("freq"))


def term_stats(docs: DataFrame, most: int = 100) -> DataFrame:
    """term, doc_freq, total: the most frequent terms by documents."""
    return terms(docs).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("freq").alias("total")).orderBy(F.desc("doc_freq"), "term").limit(most)


def bm25(docs: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75, okapi: bool = False) -> DataFrame:
    """doc_id, bm25 of documents that hold a query term.

    The idf has no logarithm, as the search it re-expresses has none; okapi=True takes it. Only postings of query terms
    are shuffled; the average length is one row.
    """
    sizes = docs.select(F.size(exprs.search_terms(F.col("text"))).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    found = terms(docs, query)
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.greatest(F.lit(0.0), F.log(1 + ratio) if okapi else ratio)
    denominator = F.col("freq") + k1 * (1 - b + b * F.col("n_terms") / F.greatest(F.col("mean"), F.lit(1.0)))
    part = exprs.dec_round(idf * (F.col("freq") * (k1 + 1)) / denominator, 8).cast("decimal(28,8)")
    rows = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes))
    return rows.groupBy("doc_id").agg(F.sum(part).cast("double").alias("bm25")).filter("bm25 > 0")


def final_score(score, boost=None):
    """Score of a BM25 candidate: within 0.42 and 0.95."""
    return exprs.dec_round(F.least(F.lit(0.95), 0.42 + score / 18 + (F.lit(0.0) if boost is None else boost)), 4)


def vector_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """vec_id, similarity to the query: the dot product of unit vectors, inside the JVM."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with("embedding", q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return vectors.select("vec_id", exprs.dec_round(dot, 4).alias("similarity"))


def overlap(text, query: list[str]):
    """Share of the query words that the text has."""
    wanted = F.array(*map(F.lit, sorted(set(query))))
    return exprs.dec_round(F.size(F.array_intersect(wanted, exprs.search_terms(text))) / len(set(query)), 4)


def best_candidates(parts: list[DataFrame], most: int) -> DataFrame:
    """Union of candidates (doc_id, score, origin), the best of each id, the `most` by score."""
    united = reduce(DataFrame.unionByName, parts)
    best = united.groupBy("doc_id").agg(F.max(F.struct("score", "origin")).alias("x")).select("doc_id", "x.*")
    return best.orderBy(F.desc("score"), "doc_id").limit(most)


def interleaved(files: DataFrame, group: str, key: str, quota: int) -> DataFrame:
    """The first `quota` of each group, in turns: position runs over rank, then group."""
    ranked = files.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col("r") <= quota)
    groups = written(files.select(group).distinct())
    index = groups.withColumn("g", F.row_number().over(Window.orderBy(F.col(group).asc_nulls_last())))  # a row for each group
    return ranked.join(small(index, groups.count()), ranked[group].eqNullSafe(index[group])).select(key, ranked[group], "r", "g")


def sentences(text):
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def validated(answers: DataFrame, allowed: list[str]) -> DataFrame:
    """answers with sentences, missing (files named that aren't allowed), unsupported (assertive sentences without a file) and confidence."""
    refs = lambda s: F.regexp_extract_all(s, F.lit(rules.FILE_REFERENCE), F.lit(1))
    parts = sentences(F.col("text"))
    assertive = F.filter(parts, lambda s: exprs.any_contains(F.lower(s), rules.ASSERTIVE) & (F.size(refs(s)) == 0))
    missing = F.size(F.array_except(F.array_distinct(refs(F.col("text"))), F.array(*map(F.lit, allowed)))).cast("long")
    out = answers.withColumns({"sentences": F.size(parts).cast("long"), "missing": missing, "unsupported": F.size(assertive).cast("long")})
    loss = F.least(F.lit(0.5), 0.12 * F.col("missing")) + F.least(F.lit(0.35), 0.07 * F.col("unsupported"))
    return out.withColumn("confidence", exprs.dec_round(F.greatest(F.lit(0.0), 0.95 - loss), 4))
