"""A stored vector index: inverted lists around centroids, probed by list, exact if asked.

fit() places centroids by spherical k-means on a bounded sample; store() assigns every vector to its nearest centroid and
writes one partition a list, so that a search reads the probed lists alone. A large list is dealt in parts. Each version
is a row of the manifest, written last: parts of the index, ids that later parts replace, lists with their reach.

search() compares a table of questions with the probed lists. With exact=True a second step visits every list that may
still hold a better vector: the angle between question and centroid, less the widest angle inside the list, bounds what
the list can reach. So results equal a full comparison, but lists out of reach are never read.

Similarity is the dot product of unit vectors, rounded half up to four digits; ties go to the smaller id. Defined cases:
vectors are stored as given and compared by direction alone, a vector of noughts has similarity 0 to all; null vectors are
not stored; of rows with one id in one batch any one stays; an empty index gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs
from stratalith.sources.shared import shared_dir, small, written

#: Rows that a task compares at once: of a list's part, and of the questions to it; rows that a task takes in all.
PART_ROWS, BLOCK_ROWS, TASK_ROWS = 50_000, 8_000, 100_000
_MANIFEST = "version long, parts array<string>, centroids array<array<float>>, id_type string, lists array<struct<list: int, rows: long, reach: double>>"


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


@dataclass(frozen=True)
class VectorIndex:
    """One version of an index below root."""

    spark: SparkSession
    root: str
    centroids: np.ndarray
    id_type: str
    version: int = 0
    parts: tuple[str, ...] = ()
    #: list -> (rows, cosine of the widest angle to its centroid)
    lists: dict[int, tuple[int, float]] | None = None

    def rows(self) -> DataFrame:
        """All stored rows with list, part and version; of an id the latest version. A filter on list prunes the files."""
        tables = [self.spark.read.option("basePath", f"{self.root}/{p}").parquet(f"{self.root}/{p}").withColumn("version", F.lit(i)) for i, p in enumerate(self.parts)]
        out = tables[0]
        for i, later in enumerate(tables[1:], 1):  # vectors of a batch replace those of the same id
            ids = later.select("vec_id")
            out = out.join(small(ids, self._size(i)), "vec_id", "left_anti").unionByName(later, allowMissingColumns=True)
        return out.filter("embedding IS NOT NULL")

    def _size(self, i: int) -> int:
        return self.spark.read.parquet(f"{self.root}/{self.parts[i]}").count()


def fit(vectors: DataFrame, lists: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids from `sample` rows at most (the only rows that reach the driver); by default the root of the row count, 1024 at most."""
    known = vectors.filter("embedding IS NOT NULL").select("embedding")
    n = known.count()
    lists = lists or min(1024, max(1, math.isqrt(n)))
    part = known if n <= sample else known.sample(min(1.0, 1.2 * sample / n), seed=seed).limit(sample)
    x = _unit(_matrix(part.toPandas()["embedding"])) if n else np.zeros((0, 1))
    if not len(x):
        return np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T[::-1])]  # the order of rows does not change the result
    centre = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        filled = np.bincount(near, minlength=len(centre)) > 0
        centre[filled] = _unit(total[filled])
    return centre


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with list and cosine to its centroid."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = vectors.withColumns({"list": F.lit(0), "cosine": F.lit(0.0)}).schema

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                cosine = _unit(_matrix(frame["embedding"])) @ sent.value.T
                near = cosine.argmax(1)
                yield frame.assign(list=near.astype(np.int32), cosine=cosine[np.arange(len(near)), near])

    return vectors.mapInPandas(assign, schema)


def store(vectors: DataFrame, centroids: np.ndarray, root: str | None = None) -> VectorIndex:
    """A new index of vectors (vec_id, embedding, further columns)."""
    kind = dict(vectors.dtypes)["vec_id"]
    index = VectorIndex(vectors.sparkSession, root or f"{shared_dir(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}", centroids, kind, 0, (), {})
    return upsert(index, vectors)


def upsert(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """The version with these vectors in place of those with their ids; a null vector takes its id away."""
    taken = vectors.filter("vec_id IS NOT NULL").dropDuplicates(["vec_id"])
    if not index.parts:
        taken = taken.filter("embedding IS NOT NULL")
    there = written(_assigned(taken.filter("embedding IS NOT NULL"), index.centroids))
    counted = there.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.min("cosine").alias("reach")).collect()  # a row a list
    counts = {r["list"]: (r["rows"], r["reach"]) for r in counted}
    sizes = index.spark.createDataFrame([(k, -(-n // PART_ROWS)) for k, (n, _) in counts.items()], "list int, parts int")
    dealt = there.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    gone = taken.filter("embedding IS NULL").withColumns({"list": F.lit(-1), "cosine": F.lit(None).cast("double"), "part": F.lit(0)})
    name = f"rows-{uuid.uuid4().hex}"
    dealt.unionByName(gone).repartition("list", "part").sortWithinPartitions("list", "part").write.partitionBy("list").parquet(f"{index.root}/{name}")
    lists = dict(index.lists or {})
    for k, (n, reach) in counts.items():
        lists[k] = (lists[k][0] + n, min(lists[k][1], reach)) if k in lists else (n, reach)
    new = replace(index, version=index.version + 1, parts=(*index.parts, name), lists=lists)
    row = (new.version, list(new.parts), [[float(v) for v in c] for c in new.centroids], new.id_type, [(k, n, r) for k, (n, r) in lists.items()])
    index.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{index.root}/manifest")
    return new


def opened(spark: SparkSession, root: str) -> VectorIndex:
    """The last version of the index below root."""
    r = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("version")).first()
    # the manifest keeps 32 bits of a centroid, so the reach is taken a little wider
    return VectorIndex(spark, root, np.array(r["centroids"], np.float64), r["id_type"], r["version"], tuple(r["parts"]), {x["list"]: (x["rows"], x["reach"] - 1e-5) for x in r["lists"]})


def _bounds(index: VectorIndex, questions: DataFrame) -> DataFrame:
    """(query_id, query, list, place, bound): every list that has rows, by the cosine of its centroid, and the most it can reach."""
    lists = sorted(index.lists)
    sent = index.spark.sparkContext.broadcast((index.centroids[lists], np.array(lists, np.int32), np.arccos(np.clip([index.lists[k][1] for k in lists], -1, 1))))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, names, reach = sent.value
        for frame in batches:
            for lo in range(0, len(frame), 256):
                part = frame.iloc[lo : lo + 256]
                cosine = np.clip(_unit(_matrix(part["embedding"])) @ centroids.T, -1, 1)
                order = np.argsort(-cosine, axis=1, kind="stable")
                bound = np.cos(np.maximum(np.arccos(cosine) - reach, 0))
                n, m = order.shape
                yield pd.DataFrame({
                    "query_id": np.repeat(part["query_id"].to_numpy(), m), "list": names[order].ravel(), "place": np.tile(np.arange(m, dtype=np.int32), n),
                    "bound": np.take_along_axis(bound, order, 1).ravel(),
                })

    kind = dict(questions.dtypes)["query_id"]
    return questions.mapInPandas(near, f"query_id {kind}, list int, place int, bound double")


def compare_tasks(asked: dict[int, int], rows: dict[int, int], least: int) -> int:
    """Tasks for so many questions and rows of each list, copies for parts and blocks included, TASK_ROWS in each."""
    total = sum(n * max(1, -(-rows.get(i, 0) // PART_ROWS)) + rows.get(i, 0) * -(-n // BLOCK_ROWS) for i, n in asked.items())
    return max(least, -(-total // TASK_ROWS))


def _first(value: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of each row, ties to the smaller column; values are whole."""
    n = value.shape[1]
    order = np.arange(n) - value * n
    if k >= n:
        return np.argsort(order, axis=1)
    near = np.argpartition(order, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(order, near, 1), axis=1), 1)


def _compared(index: VectorIndex, questions: DataFrame, visits: DataFrame, k: int, where: Column | str | None) -> DataFrame:
    """(query_id, vec_id, similarity): the best k of each visited part of a list, for each question."""
    rows = index.rows()
    rows = rows.filter(where) if where is not None else rows
    asked = visits.select("query_id", "list").join(questions, "query_id")
    wanted = written(asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")))
    blocks = wanted.select("list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    parts = F.array(*(F.lit(max(1, -(-index.lists.get(i, (1, 0))[0] // PART_ROWS))) for i in range(len(index.centroids))))
    asked = asked.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("list") + 1) - 1)))
    counts = {r["list"]: r["n"] for r in wanted.collect()}  # as many as lists at most; prunes the partitions that are read
    names = list(counts)
    tasks = compare_tasks(counts, {i: n for i, (n, _) in index.lists.items()}, index.spark.sparkContext.defaultParallelism)
    held = rows.filter(F.col("list").isin(names)).join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def best(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ours) and len(theirs):
            q, x, ids = _unit(_matrix(ours["embedding"])), _unit(_matrix(theirs["embedding"])), theirs["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for lo in range(0, len(q), 64):
                similarity = q[lo : lo + 64] @ x.T
                top = _first(np.floor(similarity * 1e4 + 0.5), k)
                out.append(pd.DataFrame({"query_id": np.repeat(ours["query_id"].to_numpy()[lo : lo + 64], top.shape[1]), "vec_id": ids[top.ravel()], "similarity": np.take_along_axis(similarity, top, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})

    kind = dict(questions.dtypes)["query_id"]
    keys = ["list", "part", "block"]
    ours, theirs = (df.repartition(tasks, *keys) for df in (asked.select(*keys, "query_id", "embedding"), held.select(*keys, "vec_id", "embedding")))
    found = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys))
    return found.applyInPandas(best, f"query_id {kind}, vec_id {index.id_type}, similarity double").withColumn("similarity", exprs.dec_round(F.col("similarity"), 4))


def search(index: VectorIndex, questions: DataFrame, k: int = 72, probe: int = 8, exact: bool = False, where: Column | str | None = None) -> DataFrame:
    """(query_id, place, vec_id, similarity) of the k nearest stored vectors of each question (query_id, embedding).

    where is a condition on the stored columns, such as "NOT sensitive"; only rows that meet it are compared.
    """
    questions = written(questions.filter("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", "embedding").dropDuplicates(["query_id"]))
    empty = index.spark.createDataFrame([], f"query_id {dict(questions.dtypes)['query_id']}, place int, vec_id {index.id_type}, similarity double")
    if not index.lists:
        return empty
    lists = written(_bounds(index, questions))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    top = lambda df: df.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "place", "vec_id", "similarity")
    found = _compared(index, questions, lists.filter(F.col("place") < probe), k, where)
    if exact:
        found = written(top(found))
        worst = found.groupBy("query_id").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("n"))
        reached = lists.filter(F.col("place") >= probe).join(worst, "query_id", "left").filter(f"coalesce(n, 0) < {k} OR bound + 1e-4 >= worst")
        found = found.drop("place").unionByName(_compared(index, questions, reached, k, where))
    return top(found)


def compacted(index: VectorIndex) -> VectorIndex:
    """An index of the same rows in one part, with the same centroids, in a new folder."""
    return store(index.rows().drop("list", "part", "cosine", "version"), index.centroids)
