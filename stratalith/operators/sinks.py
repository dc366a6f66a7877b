"""Where results go: property graphs, vectors, run evidence and audit events, each written by its executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.operators import knowledge


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """nodes and edges as Parquet, partitioned by repository; relations that a property graph does not know become links."""
    nodes.write.partitionBy("repo_id").mode("overwrite").parquet(f"{folder}/nodes")
    edges.withColumn("relation", knowledge.relation_type(F.col("relation"))).write.partitionBy("repo_id").mode("overwrite").parquet(f"{folder}/edges")


def write_vectors(chunks: DataFrame, folder: str) -> None:
    """chunks with their vectors, partitioned by repository; only the repositories that are given are replaced."""
    chunks.write.partitionBy("repo_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def append_events(events: DataFrame, folder: str) -> None:
    """Results or audit events as JSON lines, added to what is there, partitioned by day."""
    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").mode("append").json(folder)


def done_batches(folder_table: DataFrame, size: int) -> DataFrame:
    """batch of those that are complete, so that a run may go on after them."""
    return folder_table.groupBy("batch").agg(F.countDistinct("run_id").alias("n")).filter(F.col("n") >= size).select("batch")
