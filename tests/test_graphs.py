"""Path, reach and service operators against brute force on small graphs, cyclic ones too."""

import random
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from stratalith.operators import graph, history, knowledge, reports

LINK = "repo_id string, source string, target string"


def links(seed, n=9, m=22, back=True):
    rng = random.Random(seed)
    out = set()
    while len(out) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b and (back or a < b):
            out.add((f"n{a}", f"n{b}"))
    return sorted(out)


def longest(edges, start, most, fan_out):
    """The longest simple path, ties by the least; fan_out targets of each node in order."""
    after = {a: sorted({t for s, t in edges if s == a})[:fan_out] for a, _ in edges}
    best = [start]

    def walk(path):
        nonlocal best
        if len(path) > len(best) or (len(path) == len(best) and path < best):
            best = list(path)
        if len(path) < most:
            for t in after.get(path[-1], []):
                if t not in path:
                    walk([*path, t])

    walk([start])
    return best


@pytest.mark.parametrize("fan_out", [8, 2])
def test_longest_paths_of_cyclic_and_acyclic_graphs(spark, fan_out):
    graphs = {f"r{i}": links(i, back=i % 2 == 0) for i in range(4)} | {"loops": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("a", "a"), ("b", "x")]}
    rows = [(r, a, b) for r, e in graphs.items() for a, b in e]
    starts = [(r, s) for r, e in graphs.items() for s in sorted({a for a, _ in e})[:4]] + [("r0", "unknown")]
    table = spark.createDataFrame(rows, LINK)
    got = {(r["repo_id"], r["start"]): r["path"] for r in knowledge.longest_paths(table, spark.createDataFrame(starts, "repo_id string, start string"), 6, fan_out).collect()}
    assert got == {(r, s): longest(graphs[r], s, 6, fan_out) for r, s in starts}


def test_rows_of_a_step_are_bounded_by_nodes(spark, monkeypatch):
    """A ladder has 2 ** k paths to its k-th rung, but two nodes there."""
    sizes, real = [], knowledge.written
    monkeypatch.setattr(knowledge, "written", lambda df: sizes.append((df.columns, real(df).count())) or real(df))
    ladder = [("r", f"{i}{x}", f"{i + 1}{y}") for i in range(9) for x in "ab" for y in "ab"]
    out = knowledge.longest_paths(spark.createDataFrame(ladder, LINK), spark.createDataFrame([("r", "0a")], "repo_id string, start string"), 9).collect()
    assert out[0]["path"] == [f"{i}a" for i in range(9)]
    assert max(n for c, n in sizes if "path" in c) == 2


def test_nodes_on_cycles(spark):
    rows = [("r", a, b) for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("s", "s")]]
    assert {r["node"] for r in knowledge.on_cycles(spark.createDataFrame(rows, LINK)).collect()} == {"a", "b", "c"}


def distances(edges, start):
    near, seen, d = {start}, {start: 0}, 0
    while near:
        d += 1
        near = {y for a, b in edges for x, y in ((a, b), (b, a)) if x in near} - seen.keys()
        seen |= dict.fromkeys(near, d)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths(spark, seed):
    edges = links(seed, 14, 17)
    table = spark.createDataFrame(edges, "source string, target string")
    far = distances(edges, "n0")
    for end in ("n3", "n9", "n0", "nowhere"):
        rows = sorted(map(tuple, graph.shortest_path(table, "n0", end).select("step", "source", "target").collect()))
        assert [r[0] for r in rows] == list(range(1, far.get(end, 0) + 1))
        assert all((a, b) in edges for _, a, b in rows)
        at = "n0"
        for _, a, b in rows:
            assert at in (a, b)
            at = b if a == at else a
        assert at == end or end not in far


def test_a_long_chain_is_found_from_both_ends(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(8)]
    table = spark.createDataFrame(chain, "source string, target string")
    rows = sorted(map(tuple, graph.shortest_path(table, "c08", "c00").collect()))
    assert rows == [(i + 1, a, b) for i, (b, a) in enumerate(pairwise([f"c{8 - i:02d}" for i in range(9)]))]


@pytest.mark.parametrize("most", [10_000, 3])
def test_reach_with_split_hubs(spark, most):
    edges = [*links(5, 12, 30), *((f"in{i}", "hub") for i in range(20)), *(("hub", f"out{i}") for i in range(7))]
    table = spark.createDataFrame([("r", *e) for e in edges] + [("r", *edges[0])], LINK)
    one = {}
    for a, b in edges:
        one.setdefault(a, set()).add(b)
    near = {a: s | {z for y in s for z in one.get(y, ())} for a, s in one.items()}
    back = {}
    for a, s in near.items():
        for b in s:
            back.setdefault(b, set()).add(a)
    nodes = near.keys() | back.keys()
    want = {(x, len(near.get(x, ())), len(back.get(x, ()))) for x in nodes}
    assert {tuple(r) for r in knowledge.reach(table, most).select("node", "forward", "backward").collect()} == want
    for r in knowledge.reach_estimated(table).collect():
        assert abs(r["forward"] - len(near.get(r["node"], ()))) <= 1 and abs(r["backward"] - len(back.get(r["node"], ()))) <= 1


def test_sketched_reach_makes_a_row_an_edge(spark):
    """A hub of many edges: its sketch is joined, not its edges; the estimate stays within five standard errors."""
    edges = spark.range(60_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("source"), F.lit("hub").alias("target"))
    out = spark.range(30_000).select(F.lit("r").alias("repo_id"), F.lit("hub").alias("source"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("target"))
    got = knowledge.reach_estimated(edges.unionByName(out)).filter("node IN ('a7', 'b9', 'hub')").collect()
    by = {r["node"]: (r["forward"], r["backward"]) for r in got}
    assert abs(by["a7"][0] / 30_001 - 1) < 0.08 and abs(by["b9"][1] / 60_001 - 1) < 0.08 and abs(by["hub"][0] / 30_000 - 1) < 0.08


def test_service_graph(spark):
    found = spark.createDataFrame([("r", "src/api/a.py", 2, 1), ("r", "web/b.ts", 0, 4)], "repo_id string, path string, routes long, symbols long")
    hot = spark.createDataFrame([("r", "src/db/c.py", 9), ("r", "web/b.ts", 3)], "repo_id string, path string, risk_score long")
    risks = spark.createDataFrame([("r", "src/db/c.py", 70), ("r", "x", 5)], "repo_id string, path string, risk long")
    edges = spark.createDataFrame([("r", "x", "web/b.ts", "imports"), ("r", "x", "y", "imports"), ("r", "src/db/c.py", "z", "defines"), ("q", "x", "web/b.ts", "imports")], "repo_id string, source string, target string, relation string")
    nodes = reports.service_nodes(found, hot, risks)
    assert [(r["path"], r["routes"], r["symbols"], r["risk"]) for r in nodes.orderBy("path").collect()] == [("src/api/a.py", 2, 1, 0), ("src/db/c.py", 0, 0, 70), ("web/b.ts", 0, 4, 0)]
    assert {tuple(r) for r in reports.service_edges(edges, nodes, risks).collect()} == {("r", "x", "web/b.ts", "imports", 5), ("r", "src/db/c.py", "z", "defines", 70)}
    assert reports.service_nodes(found.limit(0), hot.limit(0), risks).count() == 0


def test_coupling_pairs_files_inside_a_commit(spark):
    """No join of commits with themselves; commits with one file, more than 40, or no name don't count."""
    sizes = {1: 2, 2: 1, 3: 40, 4: 41, 5: 3, None: 4}
    rows = [(sha, f, f"d{f % 3}") for sha, n in sizes.items() for f in range(n) for _ in range(2)]
    expected = Counter((a, b) for n in (2, 40, 3) for a in range(n) for b in range(a + 1, n) if a % 3 != b % 3)
    out = history.coupling(spark.createDataFrame(rows, "sha long, file long, domain string"), 2000)
    assert {(r["source"], r["target"]): r["co_changes"] for r in out.collect()} == expected
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
