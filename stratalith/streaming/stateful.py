"""Streams with state of their own: rate limits, job states, expiry, live metrics.

State is kept in the RocksDB store for BUCKETS hashed groups of keys, so that a trigger calls Python once a group and not
once a key; a group's state is read and written whole, so it should fit a task with ease. It is bounded: the limiter holds at most `limit` times beside the rows
that the watermark has not passed yet, and forgets a client that pauses; a job is forgotten `keep_ms` after its last
event; expiry keeps the last time of a key until it has expired. Rows are folded in the order of their time once the
watermark has passed them, so the result does not depend on how they arrived, as long as they are not late; late rows
are dropped by the watermark.

Each batch twin is named in the docstring; what a stream has closed equals the twin's rows up to its watermark.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from stratalith.operators.reports import MOVES

#: Groups of keys; a stream must keep the number over its restarts.
BUCKETS = 1024
_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Items that a quantile sketch keeps a level; with 200 the rank of a quantile is off by less than 1.65 % in 99 of 100 cases.
SKETCH_ITEMS, RANK_ERROR = 200, 0.0165


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Sessions keep state in RocksDB inside: transformWithState needs it."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _bucket(*keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


class _InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then hands them on in order, key by key.

    `waiting` has (client, path, at: microseconds, id: text) of rows not yet passed, `kept` what a subclass remembers of a
    client and path as numbers.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "client string, path string, at long, id string")
        self.kept = handle.getListState("kept", "client string, path string, at long")

    def _wake(self, times: list[int]) -> None:
        """Wakes up when the watermark has passed the first of these times."""
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(_text(c), _text(p), int(at), str(i)) for frame in rows for c, p, at, i in zip(frame["client"], frame["path"], frame["at"], frame["id"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wake([r[2] for r in new])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        passed, logs, rest = {}, {}, []
        for c, p, at, i in self.waiting.get():
            if at < mark:
                passed.setdefault((c, p), []).append((int(at), i))
            else:
                rest.append((c, p, int(at), i))
        for c, p, at in self.kept.get():
            logs.setdefault((c, p), []).append(int(at))
        out, kept, times = [], [], [r[2] for r in rest]
        for one in passed.keys() | logs.keys():
            rows, log, again = self.fold(one, sorted(passed.get(one, ())), logs.get(one, []), mark)
            out += rows
            kept += [(*one, x) for x in log]
            times += again
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.kept.put(kept) if kept else self.kept.clear()
        self._wake(times)
        if out:
            yield pd.DataFrame(out)

    def fold(self, key, passed, log, mark) -> tuple[list[dict], list[int], list[int]]:
        """Rows to hand on, what stays remembered, and times at which to look again."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return None if pd.isna(value) else str(value)


def _rows(requests: DataFrame, late: str, path) -> DataFrame:
    """bucket, client, path, ts, at, id: by the bucket of client and path."""
    rows = requests.withWatermark("ts", late).select(F.col("client").cast("string").alias("client"), path.alias("path"), "ts", F.unix_micros("ts").alias("at"), F.col("request_id").cast("string").alias("id"))
    return rows.select(_bucket("client", "path"), "*")


class _Limiter(_InOrder):
    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit

    def fold(self, key, passed, log, mark):
        log, out = deque(log), []
        for at, i in passed:
            while log and log[0] < at - self.window:
                log.popleft()
            out.append({"client": key[0], "path": key[1], "request_id": i, "in_window": len(log), "limited": len(log) >= self.limit})
            if len(log) < self.limit:
                log.append(at)
        while log and log[0] < mark - self.window:  # nothing that may come can see these
            log.popleft()
        return out, list(log), [log[-1] + self.window] if log else []  # to forget a client that stays away


def rate_limits(requests: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """client, path, request_id, in_window, limited of a stream of requests; ids and clients come out as text. Twin: requests.rate_limited."""
    rows = _rows(requests, late, F.col("path"))
    out = StructType.fromDDL("client string, path string, request_id string, in_window int, limited boolean")
    return rows.groupBy("bucket").transformWithStateInPandas(_Limiter(seconds * 1_000_000, limit), out, "Append", "EventTime")


class _Expiry(_InOrder):
    def __init__(self, keep: int):
        self.keep = keep

    def fold(self, key, passed, log, mark):
        out, last = [], log[0] if log else None
        for at, _ in passed:
            if last is not None and at - last > self.keep:
                out.append(last)
            last = at
        if last is not None and last + self.keep < mark:
            out.append(last)
            last = None
        rows = [{"client": key[0], "last": pd.Timestamp(x, unit="us"), "expired": pd.Timestamp(x + self.keep, unit="us")} for x in out]
        return (rows, [], []) if last is None else (rows, [last], [last + self.keep])


def expiries(requests: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """client, last, expired: a row each time that nothing came from a client for so long. Twin: requests.expiries."""
    rows = _rows(requests, late, F.lit(""))
    return rows.groupBy("bucket").transformWithStateInPandas(_Expiry(seconds * 1_000_000), StructType.fromDDL("client string, last timestamp, expired timestamp"), "Append", "EventTime")


class _Jobs(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", "job_id string, state string, moves int, refused int, seen long")

    def _known(self, now: int) -> dict:
        """State of each job of the bucket that is not forgotten."""
        return {job: (state, moves, refused, seen) for job, state, moves, refused, seen in self.jobs.get() if self.keep_ms is None or seen + self.keep_ms > now}

    def _keep(self, known: dict) -> None:
        self.jobs.put([(job, *x) for job, x in known.items()]) if known else self.jobs.clear()
        if known and self.keep_ms is not None:
            self.handle.registerTimer(min(x[3] for x in known.values()) + self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms is not None else 0
        known, out = self._known(now), []
        events = pd.concat(list(rows)).sort_values(["position", "wanted"], kind="stable")
        for job, position, wanted in zip(map(_text, events["job_id"]), events["position"].tolist(), events["wanted"].tolist(), strict=True):
            state, moves, refused, _ = known.get(job, ("queued", 0, 0, now))
            accepted = wanted in MOVES.get(state, ())
            state, moves, refused = (wanted, moves + 1, refused) if accepted else (state, moves, refused + 1)
            known[job] = (state, moves, refused, now)
            out.append((job, int(position), wanted, accepted, state, moves, refused))
        self._keep(known)
        yield pd.DataFrame(out, columns=["job_id", "position", "wanted", "accepted", "state", "moves", "refused"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(timerValues.getCurrentProcessingTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def job_states(moves: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """job_id, position, wanted, accepted, state, moves, refused of a stream of events (job_id, position, wanted).

    Events of one trigger are taken by position, those of later triggers after them. keep_ms: after so long without an
    event a job is forgotten. Twin: reports.job_states, by each job's last row.
    """
    kind = dict(moves.dtypes)["job_id"]
    out = StructType.fromDDL("job_id string, position int, wanted string, accepted boolean, state string, moves int, refused int")
    mode = "None" if keep_ms is None else "ProcessingTime"  # with a time to live, triggers go on without data
    given = moves.select(F.col("job_id").cast("string").alias("job_id"), "position", "wanted").select(_bucket("job_id"), "*")
    return given.groupBy("bucket").transformWithStateInPandas(_Jobs(keep_ms), out, "Append", mode).withColumn("job_id", F.col("job_id").cast(kind))


def live_metrics(requests: DataFrame) -> DataFrame:
    """path, requests, failures, slowest, p50 and p95 since the start: exact counters, quantiles by a mergeable sketch (RANK_ERROR).

    For update or complete mode on a stream; over a table it is the stream's twin but for the sketch's choices.
    """
    known = F.col("duration_ms").cast("double")
    counted = requests.groupBy("path").agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"), F.max(known).alias("slowest"), F.kll_sketch_agg_double(known, SKETCH_ITEMS).alias("sketch"))
    timed = F.col("slowest").isNotNull()
    quantile = lambda q: F.when(timed, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return counted.select("path", "requests", "failures", "slowest", quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))


def exported(metrics: DataFrame) -> DataFrame:
    """line: counters and gauges of live_metrics in the text form that scrapers read."""
    label = F.concat(F.lit('{path="'), F.regexp_replace(F.regexp_replace("path", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    quantile = lambda q, c: F.concat(F.lit("request_duration_ms"), label, F.lit(f',quantile="{q}"}} '), F.col(c).cast("string"))
    lines = [F.concat(F.lit("requests_total"), label, F.lit("} "), F.col("requests").cast("string")), F.concat(F.lit("request_failures_total"), label, F.lit("} "), F.col("failures").cast("string")), quantile("0.5", "p50"), quantile("0.95", "p95")]
    return metrics.select(F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line"))


def snapshots(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete"):
    """Starts a query that writes each trigger's rows as folder/batch=N; a trigger that is run again replaces its own folder."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """The rows of the last snapshot (complete mode), or the last row of each key (update mode)."""
    every = spark.read.option("basePath", folder).parquet(folder)
    last = every.agg(F.max("batch").alias("batch")) if key is None else every.groupBy(key).agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last) if key is None else last, [c for c in ("batch", key) if c]).drop("batch")


def closed(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream with state over all that is there into a Parquet table below folder, and reads what it has closed."""
    with rocksdb(spark):
        run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
