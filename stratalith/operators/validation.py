"""Runs of validation over many repositories: summaries, merges of batches, gates, slow runs, failures.

runs has (batch, run_id, status, language, files, seconds, timeout, rss_mb, cpu_seconds, citation, retrieval, correctness);
stages has (batch, run_id, stage, seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs

# Least values of a batch.
GATES = {"mean_citation": 0.75, "mean_retrieval": 0.75, "mean_correctness": 0.80}
SIZES = ((5000, "large"), (1000, "medium"), (100, "small"))


def size_tier(files: Column) -> Column:
    return exprs.level(files, SIZES, "tiny")


def failure_stage(ingested: Column, analysed: Column) -> Column:
    """The first step that did not succeed."""
    return F.when(~F.coalesce(ingested, F.lit(False)), "ingestion").when(~F.coalesce(analysed, F.lit(False)), "analysis").otherwise("unknown")


def summary(runs: DataFrame) -> DataFrame:
    """batch, attempted, passed, failed, failure_rate, and means over the passed runs (0 without) of each batch."""
    passed = F.col("status") == "passed"
    mean = lambda c: exprs.dec_round(F.coalesce(F.avg(F.when(passed, F.col(c))), F.lit(0.0)), 3).alias(f"mean_{c}")
    out = runs.groupBy("batch").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(passed).alias("passed"), mean("citation"), mean("retrieval"), mean("correctness"))
    return out.withColumn("failed", F.col("attempted") - F.col("passed")).withColumn("failure_rate", exprs.dec_round(F.col("failed") / F.greatest(F.col("attempted"), F.lit(1)), 3))


def mixes(runs: DataFrame) -> DataFrame:
    """batch, kind (language or size), name, runs."""
    each = F.explode(F.array(F.struct(F.lit("language").alias("kind"), F.col("language").alias("name")), F.struct(F.lit("size").alias("kind"), size_tier(F.col("files")).alias("name")))).alias("x")
    return runs.select("batch", each).groupBy("batch", "x.kind", "x.name").agg(F.count(F.lit(1)).alias("runs"))


def merged(summaries: DataFrame) -> DataFrame:
    """One row for all batches: sums, and means weighted by the passed runs of each batch."""
    weighted = lambda c: exprs.dec_round(F.sum(F.col(c) * F.col("passed")) / F.greatest(F.sum("passed"), F.lit(1)), 3).alias(c)
    out = summaries.agg(*(F.sum(c).alias(c) for c in ("attempted", "failed")), *map(weighted, GATES), F.sum("passed").alias("passed"))
    return out.withColumn("failure_rate", exprs.dec_round(F.col("failed") / F.greatest(F.col("attempted"), F.lit(1)), 3))


def gates(summaries: DataFrame) -> DataFrame:
    """batch, gate of each least value that a batch misses; a failed run misses one too."""
    tests = [F.when(F.col(c) < least, F.lit(c)) for c, least in GATES.items()] + [F.when(F.col("failed") > 0, F.lit("failed"))]
    return summaries.select("batch", F.explode(F.array_compact(F.array(*tests))).alias("gate"))


def bottlenecks(stages: DataFrame, most: int = 10) -> DataFrame:
    """batch, stage, seconds, share, previous_seconds, delta_seconds: the slowest stages, held against those of the batch before."""
    sums = stages.groupBy("batch", "stage").agg(F.sum(F.col("seconds").cast("decimal(28,6)")).alias("s"))
    per = Window.partitionBy("batch")
    ranked = sums.withColumn("r", F.row_number().over(per.orderBy(F.desc("s"), "stage"))).withColumn("share", F.col("s").cast("double") / F.sum("s").over(per).cast("double")).filter(F.col("r") <= most)
    before = ranked.select((F.col("batch") + 1).alias("batch"), "stage", F.col("s").alias("p"))
    first = ranked.agg(F.min("batch").alias("first"))
    both = ranked.join(before, ["batch", "stage"], "left").crossJoin(F.broadcast(first)).filter("batch > first")
    s, p = F.col("s").cast("double"), F.coalesce("p", F.lit(0)).cast("double")
    return both.select("batch", "stage", exprs.dec_round(s, 3).alias("seconds"), exprs.dec_round(F.col("share"), 4).alias("share"), exprs.dec_round(p, 3).alias("previous_seconds"), exprs.dec_round(s - p, 3).alias("delta_seconds"))


def resources(runs: DataFrame) -> DataFrame:
    """batch, peak and mean memory, sum of processor seconds."""
    total = F.sum(F.coalesce("cpu_seconds", F.lit(0)).cast("decimal(28,6)")).cast("double")
    return runs.groupBy("batch").agg(exprs.dec_round(F.max("rss_mb"), 2).alias("rss_peak"), exprs.dec_round(F.avg(F.col("rss_mb").cast("decimal(28,6)")), 3).alias("rss_mean"), exprs.dec_round(total, 3).alias("cpu_total"))


def near_timeout(runs: DataFrame, share: float = 0.8, most: int = 20) -> DataFrame:
    """run_id, seconds, timeout of runs that took `share` of their limit or more, the slowest."""
    return runs.filter((F.col("timeout") > 0) & (F.col("seconds") >= F.col("timeout") * share)).orderBy(F.desc("seconds"), "run_id").limit(most).select("run_id", "seconds", "timeout")
