"""The queries of the engine by name, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.plans import q_code, q_drift, q_evidence, q_files, q_graph, q_history, q_requests, q_review, q_search, q_views, register  # noqa: F401  the modules register their queries


def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


QUERIES = {"language_summary": language_summary} | register.QUERIES
SQL = {"language_summary": "SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source, lang"} | register.SQL
