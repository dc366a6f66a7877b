"""Request logs: percentiles, rate limits, latest state, expiry, sessions; in batch, and windowed as a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs


def percentiles(requests: DataFrame) -> DataFrame:
    """requests, p50 (upper median), p95 (linear interpolation) and failures of each path, exact.

    Durations are counted first, so a path is a list of its different values with running counts, not of its requests.
    """
    totals = requests.groupBy("path").agg(F.count(F.lit(1)).alias("requests"), F.count("duration_ms").alias("n"), F.count_if("failed").alias("failures"))
    counts = requests.filter("duration_ms IS NOT NULL").groupBy("path", "duration_ms").agg(F.count(F.lit(1)).alias("c"))
    placed = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("path").orderBy("duration_ms"))).join(totals, "path")
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("duration_ms")))  # noqa: E731  the value at a place from 0
    exact = (F.col("n") - 1) * 0.95
    found = placed.groupBy("path").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(exact)).alias("lo"), at(F.ceil(exact)).alias("hi"))
    p95 = F.col("lo") + (F.col("hi") - F.col("lo")) * (exact - F.floor(exact))
    return totals.join(found, "path", "left").select("path", "requests", exprs.dec_round(F.col("p50"), 4).alias("p50"), exprs.dec_round(p95, 4).alias("p95"), "failures")


def rate_limited(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """request_id, in_window (accepted requests of the client and path in the seconds before it), limited.

    A request is rejected if `limit` accepted ones lie in the window; rejected ones don't count later. After a pause longer
    than the window nothing is remembered, so busy periods of a client and path are dealt and sorted apart; each is read
    once, in order, with `limit` times in memory, however long it is.
    """
    order = Window.partitionBy("client", "path").orderBy("at", "request_id")
    new = F.coalesce((F.col("at") - F.lag("at").over(order) > seconds * 1_000_000).cast("int"), F.lit(0))
    timed = requests.select("client", "path", "request_id", F.unix_micros("ts").alias("at"))
    periods = timed.withColumn("new", new).withColumn("period", F.sum("new").over(order)).drop("new")
    keys = ["client", "path", "period"]
    kind = requests.select("request_id").schema["request_id"].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = None, deque()
        for frame in frames:
            counts = []
            for *key, t in zip(*(frame[c] for c in (*keys, "at")), strict=True):
                if key != last:
                    last, log = key, deque()
                while log and log[0] < t - seconds * 1_000_000:
                    log.popleft()
                counts.append(len(log))
                if len(log) < limit:
                    log.append(t)
            n = pd.Series(counts, dtype="int32")
            yield pd.DataFrame({"request_id": frame["request_id"].reset_index(drop=True), "in_window": n, "limited": n >= limit})

    dealt = periods.repartition(*keys).sortWithinPartitions(*keys, "at", "request_id")
    return dealt.mapInPandas(fold, f"request_id {kind}, in_window int, limited boolean")


def expiries(requests: DataFrame, seconds: int) -> DataFrame:
    """client, last, expired: each request after which nothing came from its client for so long, and when that was."""
    following = F.lead("ts").over(Window.partitionBy("client").orderBy("ts", "request_id"))
    rows = requests.select("client", F.col("ts").alias("last"), following.alias("following"))
    late = F.col("last") + F.make_dt_interval(secs=F.lit(float(seconds)))
    return rows.filter(F.col("following").isNull() | (F.col("following") > late)).select("client", "last", late.alias("expired"))


def recent(requests: DataFrame, seconds: int) -> DataFrame:
    """requests, p50 (upper median), p95, failures of the last seconds up to the newest request; one row."""
    last = F.broadcast(requests.agg(F.max("ts").alias("now")))  # one row
    kept = requests.crossJoin(last).filter(F.col("ts") >= F.col("now") - F.make_dt_interval(secs=F.lit(float(seconds))))
    return percentiles(kept.withColumn("path", F.lit("all"))).drop("path")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the order columns; partial maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*")


def expired(rows: DataFrame, now: str, hours: int) -> DataFrame:
    """Rows whose ts is at most now less the retention."""
    return rows.filter(F.col("ts") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def sessions(requests: DataFrame, gap_hours: int = 6) -> DataFrame:
    """client, session, began, ended, requests: a pause of more than gap_hours begins a session."""
    order = Window.partitionBy("client").orderBy("ts", "request_id")
    pause = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(order)
    first = F.when(pause.isNull() | (pause > gap_hours * 3600), 1).otherwise(0)
    numbered = requests.select("client", "ts", "request_id").withColumn("first", first).withColumn("session", F.sum("first").over(order))
    return numbered.groupBy("client", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("requests"))


def windowed(requests: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests of each path and window; on a stream the watermark bounds the state."""
    timed = requests.withWatermark("ts", late) if requests.isStreaming else requests
    counted = timed.groupBy(F.window("ts", width), "path").agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"))
    return counted.select(F.col("window.start").alias("began"), "path", "requests", "failures")


def streamed(spark: SparkSession, source: DataFrame, name: str, checkpoint: str, output: str) -> DataFrame:
    """Runs a stream over all that is there into a Parquet table, and reads it."""
    run = source.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(source.schema).parquet(output)
