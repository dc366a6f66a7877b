"""Queries over request logs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs
from stratalith.operators.reports import MOVES
from stratalith.plans.register import query
from stratalith.sources import bind
from stratalith.sources.shared import shared_dir
from stratalith.streaming import requests as ops
from stratalith.streaming import stateful

_R = "r AS (SELECT event_id AS request_id, ts, user_id AS client, event_type AS path, value AS duration_ms, event_type = 'error' AS failed FROM events)"


@query(f"""WITH {_R} SELECT path, count(*) AS requests, {exprs.dec_round_sql("list_sort(list(duration_ms))[count(*) // 2 + 1]", 4)} AS p50, {exprs.dec_round_sql("quantile_cont(duration_ms, 0.95)", 4)} AS p95, count(*) FILTER (failed) AS failures FROM r GROUP BY path""")
def request_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.percentiles(bind.requests(spark, sf_dir))


@query(f"""WITH RECURSIVE {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY client, path ORDER BY ts, request_id) AS k FROM r),
w AS (SELECT client, path, k, request_id, 0 AS in_window, [ts] AS log FROM o WHERE k = 1
UNION ALL SELECT o.client, o.path, o.k, o.request_id, len(list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS))::INT, CASE WHEN len(list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS)) < 2 THEN list_append(list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS), o.ts) ELSE list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS) END
  FROM w JOIN o ON o.client = w.client AND o.path = w.path AND o.k = w.k + 1) SELECT request_id, in_window, in_window >= 2 AS limited FROM w""")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rate_limited(bind.requests(spark, sf_dir), 86400, 2)


@query(f"""WITH {_R}, x AS (SELECT * FROM r WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 72 HOURS)
SELECT count(*) AS requests, {exprs.dec_round_sql("list_sort(list(duration_ms))[count(*) // 2 + 1]", 4)} AS p50, {exprs.dec_round_sql("quantile_cont(duration_ms, 0.95)", 4)} AS p95, count(*) FILTER (failed) AS failures FROM x""")
def recent_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recent(bind.requests(spark, sf_dir), 72 * 3600)


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role FROM conversations")
def step_sequence_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = bind.table(spark, sf_dir, "conversations")
    return steps.select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("next_role"))


@query(f"WITH {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts DESC, request_id DESC) AS k FROM r) SELECT client, request_id, path, duration_ms FROM o WHERE k = 1")
def latest_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest(bind.requests(spark, sf_dir), "client", "ts", "request_id").select("client", "request_id", "path", "duration_ms")


@query(f"WITH {_R} SELECT request_id, client FROM r WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 168 HOURS")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.expired(bind.requests(spark, sf_dir), "2024-01-30 00:00:00", 168).select("request_id", "client")


@query(f"""WITH {_R}, l AS (SELECT *, lag(ts) OVER (PARTITION BY client ORDER BY ts, request_id) AS last FROM r), s AS (SELECT client, ts, sum((last IS NULL OR ts - last > INTERVAL 6 HOURS)::INT) OVER (PARTITION BY client ORDER BY ts, request_id) AS session FROM l)
SELECT client, session::BIGINT AS session, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended, count(*) AS requests FROM s GROUP BY client, session""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.sessions(bind.requests(spark, sf_dir))
    return found.select("client", "session", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "requests")


@query(f"WITH {_R} SELECT epoch(date_trunc('hour', ts))::BIGINT AS began, path, count(*) AS requests, count(*) FILTER (failed) AS failures FROM r GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.windowed(bind.requests(spark, sf_dir)).withColumn("began", F.unix_timestamp("began"))


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{sf_dir}/events.parquet*")
    return bind.as_requests(events)


@query(f"WITH {_R}, g AS (SELECT date_trunc('hour', ts) AS began, path, count(*) AS requests, count(*) FILTER (failed) AS failures FROM r GROUP BY ALL) SELECT began, path, requests, failures FROM g WHERE began + INTERVAL 1 HOUR <= (SELECT max(ts) FROM r) - INTERVAL 1 HOUR")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by Structured Streaming in append mode: the last open windows stay unwritten."""
    stream = ops.windowed(_request_stream(spark, sf_dir))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return ops.streamed(spark, stream, f"windowed_{uuid.uuid4().hex[:8]}", f"{base}/checkpoint", f"{base}/out").withColumn("began", F.col("began").cast("timestamp_ntz"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


_MARK = "(SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 1 HOUR FROM r)"


@query(f"""WITH RECURSIVE {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY client, path ORDER BY ts, request_id::VARCHAR) AS k FROM r),
w AS (SELECT client, path, k, request_id, ts, 0 AS in_window, [ts] AS log FROM o WHERE k = 1
UNION ALL SELECT o.client, o.path, o.k, o.request_id, o.ts, len(list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS))::INT, CASE WHEN len(list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS)) < 2 THEN list_append(list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS), o.ts) ELSE list_filter(w.log, lambda x: x >= o.ts - INTERVAL 24 HOURS) END
  FROM w JOIN o ON o.client = w.client AND o.path = w.path AND o.k = w.k + 1) SELECT request_id, in_window, in_window >= 2 AS limited FROM w WHERE ts < {_MARK}""")
def stream_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter as a stream: the requests that the watermark has passed."""
    out = stateful.closed(spark, stateful.rate_limits(_request_stream(spark, sf_dir), 86400, 2), _folder(spark))
    return out.select(F.col("request_id").cast("long").alias("request_id"), "in_window", "limited")


@query(f"""WITH {_R}, n AS (SELECT client, ts, lead(ts) OVER (PARTITION BY client ORDER BY ts, request_id) AS following FROM r)
SELECT client, epoch_us(ts) AS last, epoch_us(ts + INTERVAL 12 HOURS) AS expired FROM n WHERE (following IS NULL OR following > ts + INTERVAL 12 HOURS)""")
def client_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.expiries(bind.requests(spark, sf_dir), 12 * 3600)
    return out.select("client", F.unix_micros("last").alias("last"), F.unix_micros("expired").alias("expired"))


@query(f"""WITH {_R}, n AS (SELECT client, ts, lead(ts) OVER (PARTITION BY client ORDER BY ts, request_id) AS following FROM r)
SELECT client, epoch_us(ts) AS last, epoch_us(ts + INTERVAL 12 HOURS) AS expired FROM n WHERE (following IS NULL OR following > ts + INTERVAL 12 HOURS) AND ts + INTERVAL 12 HOURS < {_MARK}""")
def stream_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: what has expired before its watermark."""
    out = stateful.closed(spark, stateful.expiries(_request_stream(spark, sf_dir), 12 * 3600), _folder(spark))
    return out.select(F.col("client").cast("long").alias("client"), F.unix_micros("last").alias("last"), F.unix_micros("expired").alias("expired"))


_ACCEPTED = "CASE state " + " ".join(f"WHEN '{s}' THEN wanted IN ({', '.join(map(exprs.quoted, after))})" for s, after in MOVES.items() if after) + " ELSE false END"
_WANTED = "CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' WHEN 2 THEN 'cancel_requested' WHEN 3 THEN 'cancelled' ELSE 'failed' END"


@query(f"""WITH RECURSIVE e AS (SELECT o_custkey AS job_id, {_WANTED} AS wanted, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS position FROM orders),
w AS (SELECT job_id, 0 AS position, 'queued' AS state, 0 AS moves, 0 AS refused FROM (SELECT DISTINCT job_id FROM e)
UNION ALL SELECT e.job_id, e.position, CASE WHEN {_ACCEPTED} THEN wanted ELSE state END, moves + ({_ACCEPTED})::INT, refused + (NOT {_ACCEPTED})::INT FROM w JOIN e ON e.job_id = w.job_id AND e.position = w.position + 1)
SELECT job_id, position, state, moves, refused FROM w WHERE position > 0""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of each job's states, with what was refused, as a stream of the orders taken for wishes."""
    wanted = F.expr(_WANTED)
    numbered = bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), wanted.alias("wanted"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"))
    base = _folder(spark)
    numbered.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(numbered.schema).parquet(f"{base}/in")
    return stateful.closed(spark, stateful.job_states(stream), base).select("job_id", "position", "state", "moves", "refused")


@query(f"WITH {_R} SELECT path, count(*) AS requests, count(*) FILTER (failed) AS failures, max(duration_ms) AS slowest, true AS p50_close, true AS p95_close FROM r GROUP BY path")
def stream_live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream in complete mode, with whether its quantiles lie within the sketch's error of their ranks."""
    base = _folder(spark)
    stateful.snapshots(stateful.live_metrics(_request_stream(spark, sf_dir)), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    live = stateful.newest(spark, f"{base}/out")
    rows = bind.requests(spark, sf_dir).join(F.broadcast(live.select("path", "p50", "p95")), "path")  # a row for each path
    share = lambda c: F.avg((F.col("duration_ms") <= F.col(c)).cast("int"))
    ranks = rows.groupBy("path").agg(share("p50").alias("r50"), share("p95").alias("r95"))
    near = lambda c, q: F.abs(F.col(c) - q) <= 2 * stateful.RANK_ERROR
    return live.join(ranks, "path").select("path", "requests", "failures", "slowest", near("r50", 0.5).alias("p50_close"), near("r95", 0.95).alias("p95_close"))
