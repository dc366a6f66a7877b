"""Toxicity by a factorization machine over hashed terms.

Terms are words and five-byte pieces of words, hashed to 2 ** 18 buckets; a text has a term or not. The machine adds a
weight for each term and, for each pair of terms, the product of two short factors, so an insult together with a
mention of a group may weigh more than both alone. It is fitted in numpy on a bounded sample of labelled texts
(`sample` rows at most, those with the least hash of the id), over the `n_terms` buckets that separate the classes best
there, with a z value of `least_z` at least, and over buckets that do so only together: of the `frequent` most frequent and
the 512 best, those in a pair whose z value is half above both of its parts' and `pair_z` or more.
Scoring reads whole texts in one pass; only the model is sent to the tasks (some 100 KB).

Defined cases: a null or empty text has no term and gets the model's base score; several labels of one id count as
their maximum, null labels not at all; without both classes in the sample every score is the share of label 1 (0.5
without labels); repeated rows count each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.language import held_out
from stratalith.llm.shared import written
from stratalith.llm.text import _BASE, _BYTE, _INVERSE, _LOWER, Words, _power, mix, runs

BITS = 18
PIECE = 5
#: ASCII characters that are neither letters nor digits part words; bytes of other letters don't.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all words and word pieces of a run of texts."""
    words = Words(data, at, lower=True, space=_BREAK)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power(_BASE, n)[:n], out=total[1:])
    inside = np.zeros(n + 1, np.int8)
    room = words.end - words.start >= PIECE
    inside[words.start[room]] += 1
    inside[words.end[room] - PIECE + 1] -= 1
    begin = np.nonzero(np.cumsum(inside[:n]) > 0)[0]
    piece = mix((total[begin + PIECE] - total[begin]) * _power(_INVERSE, n)[begin] ^ np.uint64(0x1D8E4E27C47D124F))
    text = np.concatenate([words.doc, np.searchsorted(at, begin, "right") - 1])
    return (np.concatenate([words.hash, piece]) >> np.uint64(64 - BITS)).astype(np.int64), text


def _distinct(bucket: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text << 32 | bucket)
    return key & 0xFFFFFFFF, key >> 32


class Machine:
    """score = sigmoid(base + sum of weights + sum over pairs of factor products) over the chosen buckets."""

    def __init__(self, buckets: np.ndarray, base: float, weight: np.ndarray, factor: np.ndarray):
        self.buckets, self.base, self.weight, self.factor = buckets, base, weight, factor

    def rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chosen term, text) without repetition."""
        place = np.full(1 << BITS, -1)
        place[self.buckets] = np.arange(len(self.buckets))
        bucket, text = terms(data, at)
        term = place[bucket]
        return _distinct(term[term >= 0], text[term >= 0])

    def score(self, term: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(text, self.weight[term], n)
        first = np.stack([np.bincount(text, f, n) for f in self.factor[term].T], 1) if len(term) else np.zeros((n, 1))
        second = np.bincount(text, (self.factor[term] ** 2).sum(1), n)
        return 1 / (1 + np.exp(-np.clip(self.base + linear + ((first**2).sum(1) - second) / 2, -30, 30)))


def fit(buckets: np.ndarray, term: np.ndarray, text: np.ndarray, label: np.ndarray, factors: int = 4, steps: int = 2500, decay: float = 1e-4) -> Machine:
    """A machine by Adagrad on the logistic loss; the random start is fixed. The rarer class weighs more, by the root of its rarity."""
    rng = np.random.default_rng(7)
    share = label.mean() if len(label) else 0.5
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    k = len(buckets)
    w, v = np.zeros(k), rng.normal(0, 0.01, (k, factors))
    if not k or share in (0, 1):
        return Machine(buckets, base, w, v * 0)
    seen_w, seen_v, seen_b = np.full(k, 1e-6), np.full((k, factors), 1e-6), 1e-6
    first = np.searchsorted(text, np.arange(len(label) + 1))
    cost = np.where(label == 1, np.sqrt((1 - share) / share), 1.0)
    batches = max(1, len(label) // 256)
    for _ in range(-(-steps // batches)):
        order = rng.permutation(len(label))
        for rows in np.array_split(order, batches):
            x = np.zeros((len(rows), k))
            for i, r in enumerate(rows):
                x[i, term[first[r] : first[r + 1]]] = 1
            s = x @ v
            z = base + x @ w + ((s**2).sum(1) - x @ (v**2).sum(1)) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) * cost[rows] / len(rows)
            gw, gv = x.T @ g + decay * w / 10, x.T @ (g[:, None] * s) - (x.T @ g)[:, None] * v + decay * v / 10
            seen_w, seen_v, seen_b = seen_w + gw**2, seen_v + gv**2, seen_b + g.sum() ** 2
            w, v, base = w - 0.2 * gw / np.sqrt(seen_w), v - 0.05 * gv / np.sqrt(seen_v), base - 0.2 * g.sum() / np.sqrt(seen_b)
    return Machine(buckets, float(base), w, v)


def _z(n1, n0, c1: int, c0: int):
    """How many standard errors lie between the shares of two classes."""
    p = (n1 + n0 + 1) / (c1 + c0 + 2)
    return np.abs(n1 / max(c1, 1) - n0 / max(c0, 1)) / np.sqrt(p * (1 - p) * (1 / max(c0, 1) + 1 / max(c1, 1)))


def paired(term: np.ndarray, text: np.ndarray, label: np.ndarray, n_terms: int, single: np.ndarray, pair_z: float, chunk: int = 4096) -> np.ndarray:
    """Terms of pairs that separate the classes better than both parts do; single holds the terms' own z values."""
    both = np.zeros((2, n_terms, n_terms), np.float32)
    single = single.astype(np.float32)
    first = np.searchsorted(text, np.arange(len(label) + 1))
    for i in range(0, len(label), chunk):
        stop = min(i + chunk, len(label))
        grid = np.zeros((stop - i, n_terms), np.float32)
        part = slice(first[i], first[stop])
        grid[text[part] - i, term[part]] = 1
        for y in (0, 1):
            mine = grid[label[i:stop] == y]
            both[y] += mine.T @ mine
    c1 = int(label.sum())
    z = _z(both[1], both[0], c1, len(label) - c1)
    z[np.arange(n_terms), np.arange(n_terms)] = 0
    good = (z >= pair_z) & (z > 1.5 * np.maximum(single[:, None], single[None, :])) & (both.sum(0) >= 20)
    return np.nonzero(good.any(1))[0]


def learned(texts: DataFrame, labels: DataFrame, sample: int = 20000, n_terms: int = 2048, least_z: float = 4.0, frequent: int = 1024, pair_z: float = 8.0) -> Machine:
    """A machine from texts (doc_id, text) and labels (doc_id, label 0 or 1); `sample` bounds the rows it is fitted on."""
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if not n:
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 1)))
    near = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, 1.5 * sample / n) * (1 << 30))
    chosen = near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(sample)
    rows = written(texts.join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("long").alias("label")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            label = np.asarray(b.column(1))
            for lo, _, data, at in runs(b.column(0)):
                bucket, text = _distinct(*terms(data, at))
                for y in (0, 1):
                    have[y] += np.bincount(bucket[label[text + lo] == y], minlength=1 << BITS)
        some = np.nonzero(have.sum(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(have[0][some]), pa.array(have[1][some])], names=["bucket", "n0", "n1"])

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    c0, c1 = sizes.get(0, 0), sizes.get(1, 0)
    counted = rows.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = counted.toArrow()
    bucket, n0, n1 = (table[c].to_numpy() for c in ("bucket", "n0", "n1"))
    z = _z(n1, n0, c1, c0)
    strong = np.nonzero(z >= least_z)[0]
    strong = strong[np.lexsort((bucket[strong], -z[strong]))][:n_terms]
    often = np.nonzero((n0 + n1 >= 8) & (n0 + n1 < 0.5 * (c0 + c1)))[0]
    often = often[np.lexsort((bucket[often], -(n0 + n1)[often]))][:frequent]
    buckets = np.unique(bucket[np.concatenate([strong, often])])
    single = z[np.argsort(bucket)][np.searchsorted(np.sort(bucket), buckets)]
    machine = Machine(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), 1)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in runs(b.column(0)):
                term, text = machine.rows(data, at)
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), lists], names=["label", "terms"])

    encoded = rows.mapInArrow(encode, "label long, terms array<int>").toArrow().to_pydict()
    order = sorted(range(len(encoded["label"])), key=lambda i: (encoded["label"][i], encoded["terms"][i]))
    label = np.array([encoded["label"][i] for i in order], np.float64)
    lists = [encoded["terms"][i] for i in order]
    term = np.concatenate([np.zeros(0, np.int64), *(np.array(t, np.int64) for t in lists)])
    text = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    keep, wide = np.isin(buckets, bucket[strong]), np.nonzero(np.isin(buckets, bucket[np.concatenate([strong[:512], often])]))[0]
    among = np.isin(term, wide)
    keep[wide[paired(np.searchsorted(wide, term[among]), text[among], label, len(wide), single[wide], pair_z)]] = True
    place = np.cumsum(keep) - 1
    used = keep[term]
    return fit(buckets[keep], place[term[used]], text[used], label)


def scored(docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The keep columns of docs with score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.value.score(*model.value.rows(data, at), hi - lo) for lo, hi, data, at in runs(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*keep, "score"])

    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    return given.mapInArrow(score, given.drop("__text").schema.add("score", "double"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Machine:
    """The model from the documents that are not held out."""
    train = labels.filter(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("label"))
    return learned(docs.select("doc_id", "text"), train)


def op3_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, machine, keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op3_fm_toxicity": op3_fm_toxicity}
