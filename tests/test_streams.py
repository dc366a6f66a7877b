"""Streams with state against their batch twins: rows out of order in many files, restarts, forgotten keys, replays."""

import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.operators import reports
from stratalith.streaming import requests, stateful

BEGAN = datetime(2024, 1, 1)
SCHEMA = "request_id long, ts timestamp, client long, path string, duration_ms double, failed boolean"


def request_rows(n=400, seed=4):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 6 * 3600, n))
    return [(i, BEGAN + timedelta(seconds=int(t)), int(rng.integers(0, 6)), str(rng.choice(["/a", "/b"])), None if i % 17 == 0 else float(rng.integers(1, 900)), bool(rng.random() < 0.2)) for i, t in enumerate(at)]


#: Passes every watermark that a test waits for.
END = (10_000, BEGAN + timedelta(days=9), 99, "/end", 1.0, False)


def in_files(spark, tmp_path, rows, parts=4, seed=0):
    """A stream of files, a file a trigger, whose rows are shuffled within half an hour."""
    rng = np.random.default_rng(seed)
    late = [(r[1] + timedelta(seconds=int(rng.integers(0, 1700))), r) for r in rows]
    order = [r for _, r in sorted(late, key=lambda x: x[0])]
    for part in np.array_split(np.arange(len(order)), parts):
        add(spark, tmp_path, [order[i] for i in part])
    return opened(spark, tmp_path)


def add(spark, tmp_path, rows):
    n = len(list(tmp_path.glob("in/*.parquet"))) if (tmp_path / "in").exists() else 0
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f{n:04d}.parquet")


def opened(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_limits_of_rows_out_of_order(spark, tmp_path):
    rows = request_rows()
    stream = stateful.rate_limits(in_files(spark, tmp_path, [*rows, END]), 1200, 3)
    got = {(int(r["request_id"]), r["in_window"], r["limited"]) for r in stateful.closed(spark, stream, f"{tmp_path}/s").collect()}
    batch = {tuple(r) for r in requests.rate_limited(spark.createDataFrame(rows, SCHEMA), 1200, 3).collect()}
    assert got == batch and len(got) == len(rows) and 0 < sum(x[2] for x in got) < len(rows)


def plain_limits(rows, seconds, limit):
    log, out = {}, set()
    for i, ts, client, path, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        kept = [t for t in log.get((client, path), []) if t >= ts - timedelta(seconds=seconds)]
        out.add((i, len(kept), len(kept) >= limit))
        log[client, path] = [*kept, ts] if len(kept) < limit else kept
    return out


def test_batch_limits_against_plain_python(spark):
    """Long busy periods, equal times and clients that pause."""
    rows = request_rows(900, 8) + [(5000 + i, BEGAN + timedelta(days=1, milliseconds=37 * (i // 2)), 1, "/hot", 1.0, False) for i in range(3000)]
    out = {tuple(r) for r in requests.rate_limited(spark.createDataFrame(rows, SCHEMA).repartition(7), 30, 5).collect()}
    assert out == plain_limits(rows, 30, 5)
    assert requests.rate_limited(spark.createDataFrame([], SCHEMA), 30, 5).count() == 0


def test_expiry_goes_on_after_a_restart(spark, tmp_path):
    """Half of the files, then the rest with END from the same checkpoint: rows as in one batch, and no state is left."""
    rows = request_rows()
    in_files(spark, tmp_path, rows[:200])
    stateful.closed(spark, stateful.expiries(opened(spark, tmp_path), 1500), f"{tmp_path}/s")
    in_files(spark, tmp_path, rows[200:])
    add(spark, tmp_path, [END])
    got = stateful.closed(spark, stateful.expiries(opened(spark, tmp_path), 1500), f"{tmp_path}/s")
    key = lambda df: sorted(tuple(r) for r in df.select(F.col("client").cast("long"), "last", "expired").collect())
    batch = requests.expiries(spark.createDataFrame([*rows, END], SCHEMA), 1500).filter("client <> 99")
    assert key(got) == key(batch) and len(key(got)) > 6


def test_state_is_forgotten_when_clients_go(spark, tmp_path):
    """Many clients come once and go: after the watermark has passed them no rows of state remain but END's."""
    for k in range(3):
        add(spark, tmp_path, [(100 * k + i, BEGAN + timedelta(hours=5 * k, seconds=i), 1000 * k + i, "/a", 1.0, False) for i in range(60)])
    add(spark, tmp_path, [END])
    name = f"l{uuid.uuid4().hex[:8]}"
    with stateful.rocksdb(spark):
        run = stateful.rate_limits(opened(spark, tmp_path), 60, 3).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    assert spark.table(name).count() == 180
    held = {c.name: 0 for c in spark.table(name).schema}
    assert held and run.recentProgress[-1].stateOperators[0].numRowsTotal <= 12
    assert max(p.stateOperators[0].numRowsTotal for p in run.recentProgress) > 60


MOVES = [(1, 0, "running"), (1, 1, "running"), (1, 2, "complete"), (1, 3, "running"), (2, 0, "complete"), (2, 1, "cancelled"), (3, 0, "running"), (3, 1, "cancel_requested"), (3, 2, "cancelled")]


def test_job_states_of_a_stream(spark, tmp_path):
    """One event a trigger for each job; the last row of each job is the batch's; a repeated start is refused."""
    schema = "job_id long, position int, wanted string"
    for k in range(4):
        spark.createDataFrame([m for m in MOVES if m[1] == k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    rows = stateful.closed(spark, stateful.job_states(stream), f"{tmp_path}/s").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        last[r["job_id"]] = (r["state"], r["moves"], r["refused"])
    batch = {r["job_id"]: (r["state"], r["moves"], r["refused"]) for r in reports.job_states(spark.createDataFrame(MOVES, schema)).collect()}
    assert last == batch and len(rows) == len(MOVES)
    assert {(r["job_id"], r["position"]) for r in rows if not r["accepted"]} == {(1, 1), (1, 3), (2, 0)}


@pytest.mark.parametrize("mode,key", [("complete", None), ("update", "path")])
def test_counters_after_a_restart_and_a_replay(spark, tmp_path, mode, key):
    rows = request_rows()
    in_files(spark, tmp_path, rows[:250], 2)
    run = lambda: stateful.snapshots(stateful.live_metrics(opened(spark, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/c", mode).awaitTermination()
    run()
    in_files(spark, tmp_path, rows[250:], 2)
    run()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    for c in (tmp_path / "c" / "commits").glob(f"*{last}*"):
        c.unlink()  # as if the driver had died before it noted the last batch: it is run again and replaces its folder
    run()
    live = {r["path"]: r for r in stateful.newest(spark, f"{tmp_path}/out", key).collect()}
    batch = {r["path"]: r for r in stateful.live_metrics(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert live.keys() == batch.keys() == {"/a", "/b"}
    for path, r in live.items():
        assert all(r[c] == batch[path][c] for c in ("requests", "failures", "slowest"))
        known = sorted(x[4] for x in rows if x[3] == path and x[4] is not None)
        for q, c in ((0.5, "p50"), (0.95, "p95")):
            lo, hi = np.searchsorted(known, r[c], "left") / len(known), np.searchsorted(known, r[c], "right") / len(known)
            assert lo - 2 * stateful.RANK_ERROR <= q <= hi + 2 * stateful.RANK_ERROR


def test_exported_lines(spark):
    rows = spark.createDataFrame([('/a"b\\c', 3, 1, None, None, None), ("/d", 2, 0, 9.0, 4.5, 9.0)], "path string, requests long, failures long, slowest double, p50 double, p95 double")
    assert {r["line"] for r in stateful.exported(rows).collect()} == {
        'requests_total{path="/a\\"b\\\\c"} 3', 'request_failures_total{path="/a\\"b\\\\c"} 1', 'requests_total{path="/d"} 2', 'request_failures_total{path="/d"} 0',
        'request_duration_ms{path="/d",quantile="0.5"} 4.5', 'request_duration_ms{path="/d",quantile="0.95"} 9.0',
    }


def test_jobs_of_one_group_are_told_apart(spark, tmp_path, monkeypatch):
    """A call of Python takes many keys; each has its own state, and null is one of them."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    wishes = ("running", "complete", "failed", "cancelled")
    moves = [(job, p, wishes[(j + p * p) % 4]) for j, job in enumerate([*range(300), None]) for p in (2, 1, 3)]
    spark.createDataFrame(moves, "job_id long, position int, wanted string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id long, position int, wanted string").parquet(f"{tmp_path}/in")
    expected = set()
    for j, job in enumerate([*range(300), None]):
        state, n = "queued", 0
        for p in (1, 2, 3):
            wanted = wishes[(j + p * p) % 4]
            if wanted in stateful.MOVES.get(state, ()):
                state, n = wanted, n + 1
            expected.add((job, p, state, n, p - n))
    run = stateful.job_states(stream)
    with stateful.rocksdb(spark):
        query = run.writeStream.format("memory").queryName("grouped_jobs").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.table("grouped_jobs")
    assert {(r["job_id"], r["position"], r["state"], r["moves"], r["refused"]) for r in got.collect()} == expected and got.count() == len(moves)
    assert len({k for k in spark.range(300).select(stateful._bucket("id")).toPandas()["bucket"]}) == 2


def test_a_silent_job_is_forgotten_beside_busy_ones():
    """keep_ms counts for each job, though jobs of one group are kept together."""
    import pandas as pd

    class State(list):
        get = lambda self: iter(list(self))
        put = lambda self, rows: self.__setitem__(slice(None), rows)

    class Handle:
        timers: list = []
        getListState = lambda self, *_: State()
        registerTimer = lambda self, at: self.timers.append(at)

    class At:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    jobs = stateful._Jobs(100)
    jobs.init(Handle())
    send = lambda job, wanted, now: next(jobs.handleInputRows((0,), iter([pd.DataFrame({"job_id": [job], "position": [1], "wanted": [wanted]})]), At(now)))["state"][0]
    assert [send("a", "running", 0), send("b", "running", 60), send("b", "complete", 120), send("a", "complete", 130)] == ["running", "running", "complete", "queued"]
    list(jobs.handleExpiredTimer((0,), At(225), None))
    assert [r[0] for r in jobs.jobs] == ["a"] and 100 in Handle.timers
