"""Empty tables, single rows and null cells for the operators; small exact cases that the driver's tables don't reach."""

import pytest
from pyspark.sql import functions as F

from stratalith.operators import code, drift, graph, knowledge, logs, portfolio, repository, retrieval, reviews, security, validation, views
from stratalith.streaming import requests

FILES = "repo_id string, path string, language string, size long, text string"
FOUND = "repo_id string, path string, rule_id string, severity string, line int, message string"
SYMBOLS = f"repo_id string, path string, {code.SYMBOL}"


@pytest.fixture(scope="module")
def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in (("files", FILES), ("found", FOUND), ("symbols", SYMBOLS), ("edges", "source string, target string, relation string"))}


def test_empty_tables(spark, empty):
    files, found, symbols = empty["files"], empty["found"], empty["symbols"]
    links = knowledge.relations(files, symbols)
    stack, notes, metrics = repository.stack(files), code.notes(files), code.python_metrics(files)
    debt = repository.debt(files, notes, metrics)
    hot = knowledge.hotspots(files, links, found)
    every = [
        code.symbols(files), knowledge.dependency_nodes(files, symbols), knowledge.entities(files, symbols), links, hot, knowledge.domains(files, symbols, found), knowledge.clusters(files, symbols, found), knowledge.insights(files, symbols, found, links),
        knowledge.critical_path(links, hot), knowledge.dependency_flows(links), knowledge.reach(links), stack, debt, repository.scores(files, symbols, found, stack, debt), repository.components(files), repository.style(files, stack), repository.special_files(files, symbols),
        portfolio.teams(knowledge.domains(files, symbols, found)), portfolio.framework_concentration(stack), views.top_findings(found), views.symbol_chunks(files, symbols), security.line_findings(files), security.entropy_findings(files),
    ]
    assert [df.count() for df in every] == [0] * len(every)


def test_graph_of_no_and_of_one_node(spark, empty):
    one = spark.createDataFrame([("a", True)], "id string, risky boolean")
    assert tuple(graph.metrics(one.limit(0), empty["edges"]).first()) == (0, 0, 0.0, 0)
    assert tuple(graph.metrics(one, empty["edges"]).first()) == (1, 0, 0.0, 20)
    assert graph.shortest_path(empty["edges"], "a", "b").count() == 0


def test_shortest_path_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(15)], "source string, target string")
    rows = graph.shortest_path(edges, "n15", "n00").orderBy("step").collect()
    assert [(r["source"], r["target"]) for r in rows] == [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(14, -1, -1)]


def test_security_score_counts_all_files(spark, empty):
    files = spark.createDataFrame([("r", f"f{i}", "Go", 1, "") for i in range(100)] + [("clean", "x", "Go", 1, "")], FILES)
    found = spark.createDataFrame([("r", "f1", "x", "medium", 1, "m")], FOUND)
    assert {r["repo_id"]: r["security_score"] for r in repository.security(files, found).collect()} == {"r": 97.8, "clean": 100.0}
    assert repository.security(files.limit(0), found).count() == 0


def test_limiter_does_not_count_rejected_requests(spark):
    rows = spark.createDataFrame([(i, t, "c", "/") for i, t in enumerate([0, 1, 2, 9, 11, 12, 40])], "request_id long, s long, client string, path string").select("request_id", F.timestamp_seconds("s").alias("ts"), "client", "path")
    out = {r["request_id"]: (r["in_window"], r["limited"]) for r in requests.rate_limited(rows, 10, 2).collect()}
    assert out == {0: (0, False), 1: (1, False), 2: (2, True), 3: (2, True), 4: (1, False), 5: (1, False), 6: (0, False)}


def test_logs_and_diffs(spark):
    log = f"{logs.MARK}\x1fabc\x1f2024-01-02\x1ffix: a thing\n3\t1\tsrc/a.py\n-\t-\tpic.png\n\n{logs.MARK}\x1fdef\x1f2024-01-01\x1fempty\n"
    given = spark.createDataFrame([("r", log), ("s", None), ("t", "")], "repo_id string, text string")
    assert [(r["sha"], str(r["date"]), r["subject"], r["files"], r["additions"], r["deletions"]) for r in logs.commits(given).orderBy("position").collect()] == [("abc", "2024-01-02", "fix: a thing", 2, 3, 1), ("def", "2024-01-01", "empty", 0, 0, 0)]
    assert {(r["path"], r["additions"]) for r in logs.commit_files(given).collect()} == {("src/a.py", 3), ("pic.png", 0)}
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-old\n+new\n+++more\n@@ -9 +9 @@\n+z\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n-bye\n"
    rows = logs.diff_files(spark.createDataFrame([(1, diff), (2, None)], "pr long, text string")).collect()
    assert [(r["path"], r["additions"], r["deletions"], r["hunks"]) for r in rows] == [("x", 2, 2, 2)]
    paths = spark.createDataFrame([("a\\b//c",), ("./x/y",)], "p string")
    assert [r[0] for r in paths.select(logs.normal_path(F.col("p"))).collect()] == ["a/b/c", "x/y"]


def test_related_tests_contain_the_stem(spark):
    changed = spark.createDataFrame([(1, "src/Auth.py"), (1, "src/.env"), (2, "lib/zz.go")], "pr long, path string")
    tests = spark.createDataFrame([("tests/test_auth_flow.py",), ("tests/other.py",)], "path string")
    assert {tuple(r) for r in reviews.related_tests(changed, tests).collect()} == {(1, "tests/test_auth_flow.py")}


def test_retrieval_against_plain_python(spark):
    docs = [(1, "auth login flow", "src/auth/login.py"), (2, "the route table route", "README.md"), (3, None, "a.py"), (4, "database store", "src/db/store.py")]
    given = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    postings, statistics = retrieval.index(given)
    got = {r["doc_id"]: r["bm25"] for r in retrieval.bm25(postings, statistics, ["route", "auth", "nothing"]).collect()}
    n, mean = 3, (3 + 4 + 2) / 3
    want = lambda df, freq, size: max(0, (n - df + 0.5) / (df + 0.5)) * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * size / max(mean, 1)))
    assert got == {1: pytest.approx(want(1, 1, 3)), 2: pytest.approx(want(1, 2, 4))}
    assert retrieval.index(given.limit(0))[0].count() == 0
    terms = retrieval.question_terms("How does login work?")
    assert {"jwt", "guard", "login"} <= set(terms) and "prisma" not in terms
    paths = spark.createDataFrame([d[2:] for d in docs], "path string")
    boosts = {r["path"]: (round(r["a"], 2), round(r["b"], 2)) for r in paths.select("path", retrieval.path_boost(F.col("path"), terms).alias("a"), retrieval.quality_boost(F.col("path"), terms).alias("b")).collect()}
    assert boosts["src/auth/login.py"] == (0.34, 0.16) and boosts["README.md"] == (0.0, -0.22) and boosts["a.py"] == (0.0, 0.16)


def test_drift_of_equal_sides_is_none(spark):
    facts = spark.createDataFrame([("r", "domain", "d", "x"), ("r", "api", "GET /", None)], "repo_id string, kind string, key string, payload string")
    assert drift.changes(facts, facts).count() == 0
    assert {(r["kind"], r["change"]) for r in drift.changes(facts, facts.limit(0)).collect()} == {("domain", "removed"), ("api", "removed")}


def test_validation_of_no_runs(spark):
    runs = spark.createDataFrame([], "batch int, run_id long, status string, language string, files long, seconds double, timeout int, rss_mb double, cpu_seconds double, citation double, retrieval double, correctness double")
    assert validation.summary(runs).count() == 0 and validation.merged(validation.summary(runs)).first()["attempted"] is None
    levels = spark.createDataFrame([(5,), (100,), (999,), (5000,)], "n long").select(validation.size_tier(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in levels] == ["tiny", "small", "small", "large"]


def test_views(spark):
    rows = spark.createDataFrame([(90.0, None), (None, None), (200.0, 100.0)], "a double, b double")
    assert [r[0] for r in rows.select(views.executive_score([F.col("a"), F.col("b")])).collect()] == [90, None, 100]
    names = spark.createDataFrame([(" A b!c ",), ("...",)], "n string")
    assert [tuple(r) for r in names.select(views.slug(F.col("n")), views.safe_name(F.trim("n"))).collect()] == [("a-b-c", "A-b-c"), ("", "repository")]


def test_graph_modes(spark):
    nodes = spark.createDataFrame([(x, x.split(":")[0], k) for x, k in (("repo:r", "repository"), ("file:a", "file"), ("file:b", "file"), ("risk:1", "security_finding"), ("owner:T", "owner"), ("service:s", "service"))], "id string, label string, kind string")
    edges = spark.createDataFrame([("repo:r", "file:a", "CONTAINS"), ("repo:r", "file:b", "CONTAINS"), ("file:a", "file:b", "IMPORTS"), ("risk:1", "file:b", "AFFECTS"), ("owner:T", "service:s", "OWNS")], "source string, target string, relation string")
    ask = lambda *a, **k: {tuple(r) for r in graph.graph_query(nodes, edges, *a, **k).collect()}
    assert len(ask("overview")) == 5 and len(ask("hotspots")) == 5 and ask("ownership") == {("owner:T", "service:s", "OWNS")}
    assert ask("shortest_path", "RISK", "file:a") == {("risk:1", "file:b", "AFFECTS"), ("file:a", "file:b", "IMPORTS")} and ask("shortest_path", "risk", "nowhere") == set()
    assert ask("dependency", "file:a") == {("file:a", "file:b", "IMPORTS")} and ask("blast_radius", "owner", depth=1) == {("owner:T", "service:s", "OWNS")}
    assert ask("security_propagation", depth=1) == {("risk:1", "file:b", "AFFECTS")}


def test_sinks(spark, tmp_path):
    from stratalith.operators import sinks

    nodes, edges = spark.createDataFrame([("r", "a", "a", "file")], "repo_id string, id string, label string, kind string"), spark.createDataFrame([("r", "a", "b", "odd")], "repo_id string, source string, target string, relation string")
    sinks.write_graph(nodes, edges, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/edges").first()["relation"] == "LINKED_TO"
    for text in ("old", "new"):
        sinks.write_vectors(spark.createDataFrame([("r", text), (text, "x")], "repo_id string, text string"), f"{tmp_path}/v")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/v").select("repo_id", "text").collect()} == {("r", "new"), ("old", "x"), ("new", "x")}
    for i in (1, 2):
        sinks.append_events(spark.createDataFrame([(i, 7)], "batch int, run_id long").withColumn("ts", F.lit("2024-01-01").cast("timestamp")), f"{tmp_path}/e")
    assert {r["batch"] for r in sinks.done_batches(spark.read.json(f"{tmp_path}/e"), 1).collect()} == {1, 2}


def test_chunks_are_handed_on_in_bounded_batches(spark, monkeypatch):
    """Pieces don't gather in a task, whatever the rows of a batch; the rows stay the same."""
    from stratalith.operators import search

    docs = spark.createDataFrame([(f"p{i}", ("word\n" * 300 + "end") * (i % 4)) for i in range(40)], "path string, text string").coalesce(1)
    every = sorted(map(tuple, search.chunks(docs).collect()))
    monkeypatch.setattr(search, "HELD", 2000)
    assert sorted(map(tuple, search.chunks(docs).collect())) == every
    assert len({r[0] for r in every}) == 30


def test_postings_are_counted_in_their_row(spark):
    """Only ids with several rows are added up by a shuffle before the order's own; rows without words stay."""
    from collections import Counter

    from stratalith.operators import retrieval

    rows = [(1, "alpha beta alpha"), (1, "alpha gamma beta"), (1, "alpha"), (2, "beta"), (None, "alpha beta"), (None, "beta alpha"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = retrieval._counted(docs.filter("text IS NOT NULL").selectExpr("doc_id", "filter(split(text, ' '), x -> x <> '') AS words"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for i, t in rows:
        for w in (t or "").split():
            want[i, w, len(t.split())] += 1
    got = {(r["doc_id"], r["term"], r["n_terms"]): r["freq"] for r in retrieval.index(docs)[0].filter("term IS NOT NULL").collect()}
    assert got == dict(want)
    assert retrieval.index(docs)[0].filter("term IS NULL").count() == 1
