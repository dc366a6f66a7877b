"""Small exact cases of operators that the driver's tables don't reach."""

from pyspark.sql import functions as F

from stratalith.functions import exprs
from stratalith.operators import graph, history, search, security
from stratalith.streaming import requests


def test_redaction_of_assignments_bearers_and_long_tokens(spark):
    token = "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xYz"
    rows = spark.createDataFrame([("api_key = 'abcd1234efgh'",), ("Authorization: Bearer abcdefghijklmnop1234",), (token,), ("plain text",)], "text string")
    out = [r[0] for r in rows.select(exprs.redact(F.col("text"))).collect()]
    assert out == ["api_key = '[REDACTED]'", "Authorization: Bearer [REDACTED]", "[REDACTED]", "plain text"]


def test_language_and_ignored_paths(spark):
    rows = spark.createDataFrame([("a/b.py",), ("Dockerfile",), ("x/y.min.js",), ("node_modules/a.ts",), ("notes",)], "path string")
    out = rows.select(exprs.language(F.col("path")), exprs.ignored(F.col("path"))).collect()
    assert [tuple(r) for r in out] == [("Python", False), ("Dockerfile", False), ("JavaScript", True), ("TypeScript", True), ("Text", False)]


def test_weighted_mean_skips_nulls(spark):
    rows = spark.createDataFrame([(80.0, None), (80.0, 40.0), (None, None)], "a double, b double")
    out = [r[0] for r in rows.select(exprs.weighted_mean([(F.col("a"), 3), (F.col("b"), 1)])).collect()]
    assert out == [80.0, 70.0, None]


def test_degree_counts_self_loops_twice(spark):
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b")], "source string, target string")
    assert {tuple(r) for r in graph.degrees(edges).collect()} == {("a", 4), ("b", 2)}


def test_shortest_path_none_and_self(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "d")], "source string, target string")
    assert graph.shortest_path(edges, "a", "d").count() == 0
    assert [tuple(r) for r in graph.shortest_path(edges, "b", "a").collect()] == [(1, "a", "b")] and graph.shortest_path(edges, "a", "a").count() == 0


def test_blast_radius_depth_is_held(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)], "source long, target long")
    seed = spark.createDataFrame([(0,)], "node long")
    assert graph.blast_radius(edges, seed, 1).count() == 1
    assert graph.blast_radius(edges, seed, 99).count() == 4


def test_churn_adds_the_whole_commit(spark):
    touched = spark.createDataFrame([("s", "a", "d", 3, 1), ("s", "b", "d", 2, 0)], "sha string, file string, domain string, additions long, deletions long")
    commits = spark.createDataFrame([("s", "2024-01-01")], "sha string, date string")
    assert {(r["file"], r["churn"]) for r in history.file_history(touched, commits).collect()} == {("a", 6), ("b", 6)}


def test_drift_levels(spark):
    rows = spark.createDataFrame([(0, 0), (2, 0), (4, 0), (0, 9)], "domains_added long, domains_removed long")
    assert [tuple(r)[2:] for r in history.drift_score(rows).collect()] == [(0, "stable"), (20, "minor"), (40, "material"), (100, "major")]


def test_review_risk_joins(spark):
    changed = spark.createDataFrame([(1, "backend/api/auth.py"), (1, "tests/x_test.md")], "pr long, path string")
    hot = spark.createDataFrame([("backend/api/auth.py", 50)], "path string, risk_score long")
    out = {r["path"]: r["risk"] for r in history.review_risk(changed, hot, changed.filter("path like 'backend%'")).collect()}
    assert out == {"backend/api/auth.py": 71, "tests/x_test.md": 0}
    score = history.review_score(history.review_risk(changed, hot, changed.limit(0))).collect()[0]
    assert score["risk_score"] == 15 + 46 + 16 and score["risk_level"] == "critical"


def test_chunks_cover_the_text(spark):
    text = "".join(f"line {i}\n" for i in range(900))
    out = search.chunks(spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "x")], "path string, text string")).orderBy("path", "start").collect()
    mine = [r for r in out if r["path"] == "a"]
    assert text == mine[0]["text"] + "".join(r["text"][220:] for r in mine[1:])
    assert mine[-1]["line_end"] == 901 and [r["path"] for r in out][-1] == "d"


def test_validated_answers(spark):
    rows = spark.createDataFrame([("It uses `a.py`. The router calls nothing. Fine.",), ("",), (None,)], "text string")
    out = [(r["sentences"], r["missing"], r["unsupported"], r["confidence"]) for r in search.validated(rows, ["b.py"]).collect()]
    assert out[:2] == [(3, 1, 1, 0.76), (0, 0, 0, 0.95)]


def test_findings_of_lines(spark):
    files = spark.createDataFrame([("r", "a.py", "x = 1\npassword = 'longsecret1'\neval(x)"), ("r", "tests/t.py", "eval(y)")], "repo_id string, path string, text string")
    out = {(r["path"], r["line"], r["rule_id"], r["severity"]) for r in security.line_findings(files).collect()}
    assert out == {("a.py", 2, "hardcoded-secret", "high"), ("a.py", 3, "python-eval", "medium"), ("tests/t.py", 1, "python-eval", "low")}


def test_upper_median(spark):
    rows = spark.createDataFrame([("p", float(v), False) for v in (1, 2, 3, 4)], "path string, duration_ms double, failed boolean")
    assert requests.percentiles(rows).collect()[0]["p50"] == 3.0


def test_stream_agrees_with_batch(spark):
    from compare import DATA

    from stratalith import catalogue

    batch = {(r["began"], r["path"]): r["requests"] for r in catalogue.QUERIES["windowed_counts"](spark, f"{DATA}/sf0.01").collect()}
    live = catalogue.QUERIES["stream_windowed_counts"](spark, f"{DATA}/sf0.01").withColumn("began", F.unix_timestamp("began")).collect()
    assert len(live) > 0.9 * len(batch) and all(batch[r["began"], r["path"]] == r["requests"] for r in live)


def test_scan_of_a_tree(spark, tmp_path):
    from stratalith.sources import tree

    for name, text in {"a/b.py": "x = 1", "a/c.py": "x = 1", "node_modules/d.js": "y", "README.md": "hello", "big.txt": "z" * 50}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    out = {r["path"]: (r["size"], r["language"], r["text"], r["duplicate"]) for r in tree.scan(spark, f"file://{tmp_path}", "r", 40).collect()}
    assert out == {"a/b.py": (5, "Python", "x = 1", False), "a/c.py": (5, "Python", "x = 1", True), "README.md": (5, "Markdown", "hello", False)}


def test_sarif(spark, tmp_path):
    from stratalith.operators import sarif

    rows = spark.createDataFrame([("r", "eval", "high", "m1", "a.py", 0), ("r", "eval", "odd", "m2", "b.py", 7)], "repo_id string, rule_id string, severity string, message string, path string, line int")
    out = [r["result"].asDict(True) for r in sarif.results(rows).collect()]
    assert [(x["level"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in out] == [("error", 1), ("warning", 7)]
    assert [r["message"] for r in sarif.rules_of(rows).collect()] == ["m2"]
    sarif.export(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_pieces_of_any_text():
    """Lines of pieces by plain counting, for texts around the sizes; and symbols too large for one piece."""
    from stratalith.operators.search import pieces

    for n in (0, 1, 9, 10, 11, 18, 26, 27, 300):
        text = "".join("\n" if i % 7 == 3 else "é" for i in range(n))
        got = list(pieces(text, 10, 2))
        starts = [] if not n else list(range(0, max(0, -(-(n - 10) // 8)) * 8 + 1, 8))
        assert got == [(s, text[s : s + 10], text[:s].count("\n") + 1, text[: s + 10].count("\n") + 1) for s in starts]


def test_large_symbols_come_in_pieces(spark):
    from stratalith.operators import views

    text = "import x\n" + "def a():\n" + "    y = 1\n" * 50 + "def b():\n    pass\n"
    files = spark.createDataFrame([("r", "m.py", "Python", text), ("r", "n.txt", "Text", "plain")], "repo_id string, path string, language string, text string")
    symbols = spark.createDataFrame([("r", "m.py", "function", "a", None, 2), ("r", "m.py", "function", "b", None, 53)], "repo_id string, path string, kind string, name string, owner string, line int")
    whole = {r["symbol"]: r for r in views.symbol_chunks(files, symbols).collect()}
    assert (whole["a"]["line_start"], whole["a"]["line_end"], whole["b"]["line_start"]) == (2, 52, 53) and whole[None]["text"] == "plain"
    cut = [r for r in views.symbol_chunks(files, symbols, 100).collect() if r["symbol"] == "a"]
    lines = text.split("\n")
    assert len(cut) > 4 and all(len(r["text"]) <= 100 and r["text"].split("\n")[-1] in lines[r["line_end"] - 1] for r in cut)
