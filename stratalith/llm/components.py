"""Connected components of an edge table by contraction; nothing but scalars reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node of its component.

    Each round points every label to its smallest neighbour, follows the pointers twice and contracts the edges; labels
    halve at least, so rounds grow with the logarithm of the nodes. A table is written in each round.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        for _ in range(2):
            again = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            up = up.join(again, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        up = written(up)
        labels = written(labels.join(up.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        edges = edges.join(up, "a", "left").select(F.coalesce("p", "a").alias("a"), "b")
        edges = edges.join(up.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
