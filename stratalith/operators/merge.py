"""A table merged by key: nodes and edges of property graphs, metadata records, vector payloads.

Rows lie in buckets by a hash of their key. A merge reads and writes only the buckets that its rows fall into; the row of
a key with the greatest order wins, the newer merge in a tie, so merges may come in any order and two of them equal one
of their union. A row whose `gone` is true takes its key away, for as long as its order is the greatest; it stays as a
mark in its bucket. A version is one row of the manifest, written last: a merge that dies leaves the version before it as
it was, and running it again is harmless. Versions share the buckets that did not change.

Defined cases: rows with a null in their key are not taken; of equal rows one stays; a null order is less than all others;
an empty merge makes a version without changes; columns that only one side has are null on the other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.sources.shared import shared_dir, written

_MANIFEST = "version long, keys array<string>, ordered string, buckets int, folders map<int,string>"


@dataclass(frozen=True)
class MergeTable:
    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    ordered: str
    buckets: int
    version: int = 0
    #: bucket -> folder that holds its rows
    folders: tuple[tuple[int, str], ...] = ()

    def _read(self, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folder in self.folders if buckets is None or b in buckets]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def rows(self) -> DataFrame | None:
        """The rows of this version, None if it has never had one."""
        out = self._read()
        return None if out is None else out.filter("NOT gone").drop("gone")


def created(spark: SparkSession, keys: list[str], ordered: str, root: str | None = None, buckets: int = 64) -> MergeTable:
    """An empty table; buckets should grow with the rows it will have (some hundred MB each)."""
    return MergeTable(spark, root or f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}", tuple(keys), ordered, buckets)


def opened(spark: SparkSession, root: str) -> MergeTable:
    r = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("version")).first()
    return MergeTable(spark, root, tuple(r["keys"]), r["ordered"], r["buckets"], r["version"], tuple(sorted(r["folders"].items())))


def merged(table: MergeTable, rows: DataFrame) -> MergeTable:
    """The version with rows put in."""
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in table.keys)
    new = rows.filter(known).withColumn("gone", F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False))
    new = written(new.withColumn("bucket", F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
    folders = dict(table.folders)
    if touched:
        old = table._read(touched)
        both = new.withColumn("__new", F.lit(1))
        if old is not None:
            bucket = F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")
            both = both.unionByName(old.withColumns({"bucket": bucket, "__new": F.lit(0)}), allowMissingColumns=True)
        rest = [c for c in both.columns if c not in (*table.keys, table.ordered, "__new", "bucket")]
        order = [F.col(table.ordered).desc_nulls_last(), F.desc("__new"), *(F.col(c).desc_nulls_last() for c in rest if not both.schema[c].dataType.typeName() == "map")]
        best = both.withColumn("__r", F.row_number().over(Window.partitionBy("bucket", *table.keys).orderBy(*order))).filter("__r = 1").drop("__r", "__new")
        folder = f"rows-{uuid.uuid4().hex}"
        best.write.partitionBy("bucket").parquet(f"{table.root}/{folder}")
        folders |= dict.fromkeys(touched, folder)
    made = replace(table, version=table.version + 1, folders=tuple(sorted(folders.items())))
    row = (made.version, list(made.keys), made.ordered, made.buckets, dict(made.folders))
    table.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{table.root}/manifest")
    return made
