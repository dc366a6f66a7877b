"""Containment joins, request flows, merged tables, SARIF documents and as-of series against plain Python."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalith.operators import code, containment, history, merge, reports, retrieval, reviews, sarif, validation


@pytest.mark.parametrize("sent", [32 << 20, 40])
def test_contained_is_a_nested_loop(spark, sent):
    """One automaton, or needles in many parts."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abÉ/.") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 30))) for i in range(60)] + [(60, None), (61, ""), (62, "ABAB"), (62, "ABAB")]
    needles = [(word(rng.randrange(1, 4)),) for _ in range(30)] + [(None,), ("",), ("Ab",), ("aB",)]
    got = containment.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "needle string"), "text", "needle", ["id"], sent)
    low = {n.lower() for (n,) in needles if n}
    want = sorted((i, n) for i, t in texts if t for n in low if n in t.lower())
    assert sorted(map(tuple, got.collect())) == want and want
    assert containment.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "needle string"), "text", "needle", ["id"]).count() == 0


def test_related_tests_is_a_nested_loop(spark):
    changed = [("p1", "src/Main.py"), ("p1", "a/b.c.ts"), ("p2", "x/tool.go"), ("p2", ".env")]
    tests = ["tests/test_main.py", "t/TOOLBOX_test.go", "tests/bb.py", "tests/none.rs"]
    out = reviews.related_tests(spark.createDataFrame(changed, "pr string, path string"), spark.createDataFrame([(t,) for t in tests], "path string"))
    stem = lambda p: p.split("/")[-1].split(".")[0].lower()
    assert {tuple(r) for r in out.collect()} == {(pr, t) for pr, p in changed for t in tests if stem(p) and stem(p) in t.lower()}


PARTS = [
    ("r1", "route", "api/login.py", "POST /login", "do_login", "/login do_login api/login.py"), ("r1", "service", "auth/session.py", "auth/session.py", "Sessions", "auth/session.py Sessions"),
    ("r1", "service", "web/page.ts", "web/page.ts", "Pages", "web/page.ts Pages"), ("r1", "model", "db/user.py", "User", "db/user.py", "User db/user.py"),
    ("r1", "external", "requirements.txt", "stripe", "payments from requirements.txt", "stripe payments"), ("r2", "route", "x.py", "GET /x", "/x", "/x x.py"),
]


def test_request_flows(spark):
    parts = spark.createDataFrame(PARTS, "repo_id string, kind string, path string, name string, detail string, about string")
    members = containment.flow_members(parts).cache()
    layer = F.when(F.col("path").startswith("web/"), "Frontend").otherwise("Service")
    steps = containment.flow_steps(members, layer)
    flow = {(r["repo_id"], r["intent"]): r for r in containment.request_flows(members, steps, parts).collect()}
    assert len(flow) == 2 * len(containment.FLOW_INTENTS)
    about = {(p[0], p[1], p[2]): p[5].lower() for p in PARTS}
    for (repo, intent), r in flow.items():
        hit = {k for (rp, k, _), t in about.items() if rp == repo and any(w in t for w in containment.FLOW_INTENTS[intent])}
        if intent == "data_flow":  # what stands in where nothing speaks of data
            hit |= {k for (rp, k, _) in about if rp == repo and k in ("route", "model")}
        assert r["confidence"] == ("high" if "route" in hit and hit & {"service", "model"} else "medium" if hit else "low"), (repo, intent)
    login = [(r["layer"], r["component"], r["detail"]) for r in steps.filter("repo_id = 'r1' AND intent = 'authentication'").orderBy("step").collect()]
    assert login == [("Frontend", "Client", "Calls POST /login"), ("API", "api/login.py", "do_login"), ("Service", "auth/session.py", "Sessions"), ("Database", "User", "Persistence evidence in db/user.py")]
    assert flow["r1", "authentication"]["diagram"] == "sequenceDiagram\n  participant Frontend\n  participant API\n  participant Service\n  participant Database\n  Frontend->>API: do_login\n  API->>Service: Sessions\n  Service->>Database: Persistence evidence in db/user.py"
    assert flow["r2", "payment"]["diagram"].endswith("Analyst->>Repository: No payment flow detected")
    assert flow["r1", "payment"]["diagram"] == "sequenceDiagram\n  participant External\n  Analyst->>External: payments from requirements.txt"


def test_affected_services(spark):
    domains = spark.createDataFrame([("r", "api", 3, 1, 0, "API", ["api/a.py", "api/b.py"]), ("r", "db", 2, 0, 2, "Data", ["db/c.py"]), ("q", "api", 1, 0, 0, "API", ["z/y.py"])], "repo_id string, name string, file_count long, routes long, security_findings long, role string, samples array<string>")
    questions = spark.createDataFrame([(1, "What is the API?"), (2, "nothing"), (3, None)], "question_id long, text string")
    chunks = spark.createDataFrame([(2, "r", "C.PY"), (3, "r", "old/api/b.py"), (3, "q", "db/c.py"), (3, "r", None)], "question_id long, repo_id string, path string")
    out = {tuple(r) for r in containment.affected_services(questions, chunks, domains).collect()}
    assert out == {(1, "r", "api", "API", "medium"), (1, "q", "api", "API", "low"), (2, "r", "db", "Data", "high"), (3, "r", "api", "API", "medium")}


ROW = "repo string, id string, v string, at long, gone boolean"


def merge_rows(seed, n=60):
    rng = random.Random(seed)
    return [(f"r{rng.randrange(2)}", f"n{rng.randrange(25)}", f"v{seed}{i}", rng.randrange(1000) * 100 + i, rng.random() < 0.2) for i in range(n)]


def test_merges_in_any_order_equal_one_of_their_union(spark):
    a, b = merge_rows(1), merge_rows(2)
    put = lambda *batches: _all(spark, batches)
    want = {}
    for r in a + b:
        if (r[0], r[1]) not in want or want[r[0], r[1]][3] < r[3]:
            want[r[0], r[1]] = r
    want = sorted(r[:4] for r in want.values() if not r[4])
    tables = [put(a, b), put(b, a), put(a + b), put(a, b, a)]
    assert all(sorted(tuple(r) for r in t.rows().select("repo", "id", "v", "at").collect()) == want for t in tables)
    again = merge.opened(spark, tables[0].root)
    assert again == tables[0]


def _all(spark, batches):
    t = merge.created(spark, ["repo", "id"], "at", buckets=8)
    for x in batches:
        t = merge.merged(t, spark.createDataFrame(x, ROW))
    return t


def test_a_merge_writes_touched_buckets_and_a_dead_one_changes_nothing(spark, monkeypatch):
    t = _all(spark, [merge_rows(3)])
    one = merge.merged(t, spark.createDataFrame([("r0", "n1", "new", 10**9, False)], ROW))
    assert len(set(one.folders) - set(t.folders)) == 1
    before = sorted(map(str, one.rows().collect()))

    def die(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(merge, "replace", die)
    with pytest.raises(RuntimeError):
        merge.merged(one, spark.createDataFrame([("r0", "n1", "lost", 2 * 10**9, False)], ROW))
    monkeypatch.undo()
    assert sorted(map(str, merge.opened(spark, t.root).rows().collect())) == before
    assert merge.merged(one, spark.createDataFrame([(None, "n1", "x", 1, False)], ROW)).rows().count() == len(before)
    wider = merge.merged(one, spark.createDataFrame([("r0", "n1", 5, 3 * 10**9)], "repo string, id string, size int, at long"))
    assert wider.rows().filter("size = 5 AND v IS NULL").count() == 1


def test_sarif_documents(spark, tmp_path):
    """Each file is one document with its rules, and gives the findings back; quotes and line ends survive."""
    rows = [("r", "eval", "high", 'says "no"\nand more', "a.py", 0), ("r", "eval", "odd", "m2 \\ ", "b.py", 7), ("r", "xss", "low", None, "é.py", 3), ("q/1", "eval", "critical", "m", "c.py", 2), ("r", "eval", "high", 'says "no"\nand more', "a.py", 0)]
    found = spark.createDataFrame(rows, "repo_id string, rule_id string, severity string, message string, path string, line int")
    sarif.write_documents(found, f"{tmp_path}/out")
    files = sorted(tmp_path.glob("out/repo_id=*/part-*"))
    assert len(files) == 2
    for f in files:
        run = json.loads(f.read_text())["runs"][0]
        rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert rules == sorted(rules) and {r["ruleId"] for r in run["results"]} == set(rules)
    level = {"high": "error", "critical": "error", "low": "note"}
    got = sorted(map(str, (tuple(r) for r in sarif.read_documents(spark, f"{tmp_path}/out").collect())))
    assert got == sorted(map(str, ((r[0], r[1], level.get(r[2], "warning"), r[3], r[4], max(1, r[5])) for r in rows)))
    sarif.write_documents(found.limit(0), f"{tmp_path}/none")


def test_sarif_documents_of_many_tasks(spark, tmp_path):
    """A document stays one file when its lines are too many to be put into one task."""
    found = spark.range(4000).selectExpr("concat('r', id % 5) AS repo_id", "concat('rule', id % 7) AS rule_id", "'high' AS severity", "'m' AS message", "concat('f', id) AS path", "cast(id % 90 + 1 AS int) AS line")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        sarif.write_documents(found, f"{tmp_path}/out")
    finally:
        for k in small:
            spark.conf.unset(k)
    assert len(list(tmp_path.glob("out/repo_id=*/part-*"))) == 5
    got = sarif.read_documents(spark, f"{tmp_path}/out").select("repo_id", "rule_id", "path", "line")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, found.select("repo_id", "rule_id", "path", "line").collect()))


def test_as_of(spark):
    rng = random.Random(7)
    day = datetime(2024, 1, 1)
    snaps = [(f"r{rng.randrange(2)}", day + timedelta(days=rng.randrange(90)), rng.choice([None, rng.randrange(9)]), rng.choice([None, rng.randrange(9)])) for _ in range(50)]
    points = [(f"r{i}", day + timedelta(days=d)) for i in range(3) for d in range(-5, 100, 3)]
    out = history.as_of(spark.createDataFrame(points, "repo_id string, at timestamp"), spark.createDataFrame(snaps, "repo_id string, at timestamp, a int, b int"), ["a", "b"])
    for r in out.collect():
        for k, c in ((2, "a"), (3, "b")):
            known = [(s[1], s[k]) for s in snaps if s[0] == r["repo_id"] and s[1] <= r["at"] and s[k] is not None]
            assert r[c] == (max(known)[1] if known else None)
    assert out.count() == len(points)


def test_small_operators_without_a_query(spark):
    """Failure stages, redacted records, texts for retrieval, citations, routes of files."""
    secret = "api_key = 'abcdefghijklmnop1234567890'"
    row = spark.createDataFrame([("Path a.py", secret)], "name string, text string")
    cited = retrieval.citations(row.select(F.concat(F.col("text"), F.lit(" x" * 600)).alias("text"))).first()["text"]
    assert len(cited) == 700 and "abcdefghijklmnop" not in cited
    masked = row.select(reports.redacted_map(F.create_map(F.lit("k"), F.col("text"))).alias("m")).first()["m"]
    assert "abcdefghijklmnop" not in masked["k"]
    text = row.select(reports.retrieval_text(F.lit("src/a.py"), F.lit(3), F.lit(9), F.col("text")).alias("t")).first()["t"]
    assert text.startswith("File: src/a.py\nLines: 3-9\n") and "abcdefghijklmnop" not in text
    stages = spark.createDataFrame([(None, None), (False, True), (True, None), (True, False), (True, True)], "a boolean, b boolean").select(validation.failure_stage(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in stages] == ["ingestion", "ingestion", "analysis", "analysis", "unknown"]
    assert code.route_path("pages/users/[id].tsx").endswith("users/:id")
