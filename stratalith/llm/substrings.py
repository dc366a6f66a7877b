"""Exact removal of long word sequences that also start in an earlier document, by FM-indexes over shards.

Equal windows of `window` words have equal minimizers (the least hash of their 8-grams), so runs of neighbouring
windows with one minimizer meet in one shard and shards can be searched on their own. Only runs whose minimizer occurs
in two documents go on. A shard's runs form one FM-index; every run is streamed through it by backward search over the
wavelet matrix, and the matching statistics against smaller documents that reach `window` words are the covered windows.
Runs with equal words (by 128 bits of hash) are stored and streamed once, as the run of their smallest document and as
that of all later ones, and the answers go to all documents that have them.

A minimizer with more than `most` different runs, or more words than a shard holds (a very common passage in ever
different surroundings), would make a shard too large: its windows are hashed one by one instead and reduced to their
smallest document before the shuffle, which is exact too and needs no shard.

Defined cases: a null or empty text has no words; a null id removes nothing and lends nothing; rows with the same id
never remove each other's words; a text shorter than the window keeps all; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.fmindex import FMIndex
from stratalith.llm.shared import WORD, dealt_join, small, written
from stratalith.llm.text import Words, runs, signed

GRAM = 8
KEY = ["mini", "class", "check"]
SHARD_WORDS = 400_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from each place on."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if width > have else out


def window_runs(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of the runs of neighbouring windows with one minimizer."""
    if words.n < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    gram = words.grams(GRAM)[0]
    ok = np.nonzero(np.arange(words.n) + window <= words.first[1:][words.doc])[0]
    least = _least(gram[: words.n - GRAM + 1], window - GRAM + 1)[ok]
    if not len(ok):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (words.doc[ok][1:] != words.doc[ok][:-1])])
    begin = np.nonzero(new)[0]
    return least[begin], ok[begin], np.diff(np.concatenate([begin, [len(ok)]]))


def run_rows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, version, mini, class, check, start, n) of every run; start counts words of the document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in runs(b.column(2)):
                words = Words(data, at)
                mini, start, n = window_runs(words, window)
                doc = words.doc[start]
                rows = pa.array(doc + lo)
                cls, check = (words.spans(start, start + n + window - 1, other) for other in (False, True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(signed(mini)), pa.array(signed(cls)), pa.array(signed(check)), pa.array((start - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc_id", "version", *KEY, "start", "n"],
                )

    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "version", "text")
    return known.mapInArrow(emit, known.drop("text").schema.add("mini", "long").add("class", "long").add("check", "long").add("start", "integer").add("n", "integer"))


def run_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """KEY, doc_id, later, hot and the words (with one space between) of the wanted runs; wanted has a row for each run."""
    about = [*KEY, "start", "n", "later", "hot"]
    by_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct(*about)).alias("runs"))
    joined = docs.join(by_doc.hint("merge"), ["doc_id", "version"]).select("doc_id", "text", "runs")  # one plan at every size
    schema = wanted.select(*KEY, "doc_id", "later", "hot").schema.add("words", "binary")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in runs(b.column(1)):
                words = Words(data, at)
                every = b.column(2).slice(lo, hi - lo)
                row, part = np.repeat(np.arange(hi - lo), np.diff(every.offsets.to_numpy())), every.flatten()
                begin = words.first[row] + part.field("start").to_numpy()
                end = begin + part.field("n").to_numpy() + window - 2
                texts = [bytes(data[i:j]) for i, j in zip(words.start[begin].tolist(), words.end[end].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in KEY), b.column(0).take(pa.array(row + lo)), part.field("later"), part.field("hot"), pa.array(texts, pa.binary())], names=schema.names)

    return joined.mapInArrow(emit, schema)


def _tokens(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers from 1, and bounds, of byte strings."""
    texts = pa.array(column, pa.large_binary()).cast(pa.large_string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    words = Words(data[: at[-1]], at)
    return np.unique(words.hash, return_inverse=True)[1] + 1, words.first


SPANS = "mini long, class long, check long, later boolean, lo int, hi int"


def covered_by_shard(rows: DataFrame, n_words: int, window: int) -> DataFrame:
    """KEY, later, lo, hi of covered windows, relative to the run, by one FM-index for each shard.

    later tells whether they are covered in documents after the run's smallest one, or in that one itself.
    """

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, bounds = _tokens(frame["words"])
        owner = np.unique(frame["doc_id"].to_numpy(), return_inverse=True)[1]
        again = np.nonzero(frame["later"].to_numpy())[0]
        query = np.concatenate([np.arange(len(frame)), again])
        size, at = FMIndex(tokens, bounds, owner).matching_statistics(query, np.concatenate([owner, owner[again] + 1]))
        hit = np.concatenate([[0], (size >= window).astype(np.int8), [0]])
        lo, hi = np.nonzero(np.diff(hit) > 0)[0], np.nonzero(np.diff(hit) < 0)[0]
        which = np.searchsorted(at, lo, "right") - 1
        keys = {c: frame[c].to_numpy()[query[which]] for c in KEY}
        return pd.DataFrame({**keys, "later": which >= len(frame), "lo": (lo - at[which]).astype(np.int32), "hi": (hi - at[which]).astype(np.int32)})

    shards = max(1, -(-n_words // SHARD_WORDS))
    sharded = rows.drop("hot").withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards)))
    return sharded.repartition(min(shards, 100_000), "shard").groupBy("shard").applyInPandas(search, SPANS)


def covered_by_hash(rows: DataFrame, window: int) -> DataFrame:
    """The same for runs of very common minimizers: each window's hash with its smallest document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, at in runs(b.column(5).cast(pa.large_string())):
                words = Words(data, at)
                begin = np.nonzero(np.arange(words.n) + window <= words.first[1:][words.doc])[0]
                row = pa.array(words.doc[begin] + lo)
                both = [pa.array(signed(words.spans(begin, begin + window, other))) for other in (False, True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(5)), *both, pa.array((begin - words.first[words.doc[begin]]).astype(np.int32))], names=[*KEY, "doc_id", "later", "h", "g", "lo"])

    kept = rows.select(*KEY, "doc_id", "later", "words")
    each = written(kept.mapInArrow(emit, kept.drop("words").schema.add("h", "long").add("g", "long").add("lo", "integer")))
    of_window = ["mini", "h", "g"]
    first = written(each.groupBy(*of_window).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).filter("least < last").drop("last"))
    own = dealt_join(each, first, of_window, "size", ["class", "lo"]).filter("least < doc_id").withColumn("later", F.lit(False))
    spans = own.unionByName(each.filter("later").withColumn("least", F.col("doc_id")))
    return spans.select(*KEY, "later", "lo", (F.col("lo") + 1).cast("int").alias("hi"))


def covered_windows(docs: DataFrame, window: int = 50, most: int = 2000) -> DataFrame:
    """(doc_id, version, lo, hi): windows from word lo to before word hi that also start in a smaller document.

    docs has doc_id, version (a hash of the text) and text.
    """
    every = run_rows(docs, window)
    shared = every.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("mini")
    shared = written(shared)
    table = written(every.join(small(shared, shared.count()), "mini", "left_semi"))
    first = F.min(F.struct("doc_id", "version", "start", "n")).alias("f")
    classes = written(table.groupBy(*KEY).agg(first, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).select(*KEY, "f.*", (F.col("last") > F.col("f.doc_id")).alias("later"), "size"))
    of_mini = classes.groupBy("mini").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.col("n") + window - 1).alias("words"))
    crowded = written(of_mini.select("mini", "classes", ((F.col("classes") > most) | (F.col("words") > SHARD_WORDS)).alias("hot")))
    wanted = written(dealt_join(classes, crowded, ["mini"], "classes", ["class"]))
    n_words = wanted.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("n") + window - 1)), F.lit(0))).first()[0]
    rows = written(run_words(docs, wanted, window))
    within = covered_by_shard(rows.filter("NOT hot"), n_words, window).unionByName(covered_by_hash(rows.filter("hot"), window))
    answers = within.groupBy(*KEY).agg(F.collect_list(F.struct("later", "lo", "hi")).alias("spans"))  # a run's own windows: at most some hundreds
    known = written(classes.select(*KEY, F.col("doc_id").alias("least"), "size").join(answers, KEY))
    placed = dealt_join(table, known, KEY, "size", ["doc_id", "start"]).filter("spans IS NOT NULL")
    mine = F.filter("spans", lambda x: x["later"] == (F.col("doc_id") > F.col("least")))
    each = placed.select("doc_id", "version", "start", F.explode(mine).alias("s"))
    return each.select("doc_id", "version", (F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each document."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("version"))
    spans = covered_windows(given.select("doc_id", "version", "text"), window)
    by_doc = written(spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    joined = given.join(by_doc.hint("merge"), ["doc_id", "version"], "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2)
            for lo, hi, data, at in runs(b.column(1)):
                words = Words(data, at)
                steps = np.zeros(words.n + 1, np.int64)
                for row in range(lo, hi):
                    if spans[row].is_valid:
                        base = words.first[row - lo]
                        for s in spans[row].as_py():
                            steps[base + s["lo"]] += 1
                            steps[base + s["hi"] + window - 1] -= 1
                kept = np.nonzero(np.cumsum(steps)[: words.n] == 0)[0]
                n_words, n_kept = np.diff(words.first), np.bincount(words.doc[kept], minlength=hi - lo)
                later = np.concatenate([[False], words.doc[kept][1:] == words.doc[kept][:-1]]) if len(kept) else np.zeros(0, bool)
                out, mask = data.copy(), np.zeros(len(data) + 1, np.int8)
                mask[words.start[kept]] += 1
                mask[words.end[kept]] -= 1
                mask = np.cumsum(mask)[: len(data)] > 0
                gap = words.start[kept[later]] - 1
                out[gap], mask[gap] = 32, True
                size = np.concatenate([[0], np.cumsum(mask)])[at]
                text = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(size.tobytes()), pa.py_buffer(out[mask].tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(n_words - n_kept), text.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    schema = given.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(remove, schema)


def op5_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op5_fm_substrings": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM g) WHERE m < doc_id),
r AS (SELECT doc_id, list(DISTINCT i + j) AS cut FROM c, range(0, 50) AS x(j) GROUP BY doc_id),
p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
x AS (SELECT DISTINCT doc_id, unnest(cut) AS i FROM r),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS t, count(*) AS n FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i WHERE x.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
}
QUERIES = {"op5_fm_substrings": op5_fm_substrings}
