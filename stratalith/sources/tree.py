"""Source trees as files: one distributed scan by Spark's binary reader."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs
from stratalith.operators.files import with_duplicates


def scan(spark: SparkSession, root: str, repo_id: str, max_bytes: int = 1_000_000) -> DataFrame:
    """repo_id, path, size, sha256, language, text, duplicate of the files under root that a scan does not skip.

    Sizes and names are filtered before contents are read; contents stay on the executors.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= max_bytes)
    base = re.sub("^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    relative = F.substring_index("path", base, -1)
    rows = raw.select(F.lit(repo_id).alias("repo_id"), relative.alias("path"), F.col("length").alias("size"), "content").filter(~exprs.ignored(F.col("path")))
    rows = rows.select("repo_id", "path", "size", F.sha2("content", 256).alias("sha256"), exprs.language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text"))
    return with_duplicates(rows)
