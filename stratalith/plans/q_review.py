"""Queries over captured logs and diffs, reviews of pull requests, validation runs and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, repo_rules, rules
from stratalith.operators import history, knowledge, logs, portfolio, repository, reviews, validation
from stratalith.plans import q_code
from stratalith.plans.register import query
from stratalith.sources import bind, sources


def git_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, text: the orders of each customer as a log with numbers of lines, the newest first; every third line item is binary."""
    orders = bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    added = F.when(F.col("l_linenumber") == 3, F.lit("-")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    lines = bind.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("\t", added, F.col("l_linenumber").cast("string"), F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".py"))).alias("x"))
    body = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("x")), "\n").alias("body"))  # an order has seven lines at most
    head = F.concat_ws(logs.CUT, F.lit(logs.MARK), F.col("o_orderkey").cast("string"), F.col("d").cast("string"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    pieces = orders.join(body, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", F.struct((-F.unix_date("d")).alias("d"), "o_orderkey", F.concat(head, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n\n")).alias("t")).alias("p"))
    return pieces.groupBy(F.col("o_custkey").alias("repo_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("text"))


_ADDED = "CASE l_linenumber WHEN 3 THEN 0 ELSE l_quantity::INT END"


@query(f"""SELECT o_custkey AS repo_id, o_orderkey::VARCHAR AS sha, o_orderdate::DATE AS date, 'order ' || o_orderkey AS subject, count(l_orderkey) AS files, coalesce(sum({_ADDED}), 0)::BIGINT AS additions, coalesce(sum(l_linenumber), 0)::BIGINT AS deletions,
(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) - 1)::INT AS position FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate QUALIFY position < 120""")
def git_log_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.commits(git_logs(spark, sf_dir), 120)


@query(f"SELECT o_custkey AS repo_id, o_orderkey::VARCHAR AS sha, 'src/f' || l_partkey || '.py' AS path, {_ADDED} AS additions, l_linenumber::INT AS deletions FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def git_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.commit_files(git_logs(spark, sf_dir))


@query("""SELECT o_custkey AS repo_id, o_orderdate::DATE AS date, o_orderkey::VARCHAR AS sha, 'p' || o_orderkey AS subject, 'a.py;b/c.py' AS paths FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 20""")
def git_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = bind.table(spark, sf_dir, "orders")
    piece = F.struct("o_orderkey", F.concat(F.lit(logs.MARK), F.to_date("o_orderdate").cast("string"), F.lit("|"), F.col("o_orderkey").cast("string"), F.lit("|p"), F.col("o_orderkey").cast("string"), F.lit("\na.py\nb/c.py\n\n")).alias("t"))
    texts = orders.groupBy(F.col("o_custkey").alias("repo_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "").alias("text"))
    return logs.timeline(texts).withColumn("paths", F.array_join("paths", ";"))


@query("SELECT p_brand AS repo_id, CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'M' END AS status, 'src/f ' || p_partkey || '.py' AS path FROM part")
def git_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("p_size") % 3 == 0, "A").otherwise("M"), F.lit("\tsrc/f "), F.col("p_partkey").cast("string"), F.lit(".py"))
    return logs.status_changes(bind.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("repo_id")).agg(F.array_join(F.collect_list(line), "\n").alias("text")))


@query("""WITH a AS (SELECT p_brand AS repo_id, p_partkey AS k FROM part WHERE p_partkey % 10 < 8), b AS (SELECT p_brand AS repo_id, p_partkey AS k, p_size > 40 AS moved FROM part WHERE p_partkey % 10 >= 1)
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, CASE WHEN a.k IS NULL THEN 'A' WHEN b.k IS NULL THEN 'D' ELSE 'M' END AS status, 'f' || coalesce(a.k, b.k) AS path FROM a FULL JOIN b ON a.k = b.k AND a.repo_id = b.repo_id WHERE a.k IS NULL OR b.k IS NULL OR moved""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bind.table(spark, sf_dir, "part")
    side = lambda keep, text: part.filter(keep).select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.sha2(text, 256).alias("sha256"))
    return logs.changes_between(side("p_partkey % 10 < 8", F.col("p_name")), side("p_partkey % 10 >= 1", F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))))


@query("""SELECT l_orderkey AS pr, 'src/f' || l_partkey || '.py' AS path, sum(l_linenumber)::BIGINT AS additions, sum(l_quantity::INT % 5)::BIGINT AS deletions, count(*) AS hunks FROM lineitem GROUP BY ALL""")
def diff_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".py"))
    piece = F.concat(F.lit("diff --git a/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/./"), path, F.lit("\n@@ -1 +1 @@\n"), F.repeat(F.lit("+new\n"), F.col("l_linenumber").cast("int")), F.repeat(F.lit("-old\n"), F.col("l_quantity").cast("int") % 5))
    diffs = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pr")).agg(F.array_join(F.collect_list(piece), "").alias("text"))
    return logs.diff_files(diffs)


_CHANGED = f"{sources.ALL_SQL}, ch AS (SELECT repo_id AS pr, path, language, size AS additions, length(path) AS deletions FROM src)"
_NAME = "string_split(path, '/')[-1]"
_DEPS = f"dp AS (SELECT pr, path, CASE WHEN {_NAME} IN ('Dockerfile', 'docker-compose.yml') THEN 'deployment dependency' ELSE 'runtime dependency' END AS surface, CASE WHEN {_NAME} IN ('Dockerfile', 'docker-compose.yml') OR ends_with({_NAME}, '.lock') THEN 'high' ELSE 'medium' END AS risk FROM ch WHERE {_NAME} IN ({', '.join(map(exprs.quoted, reviews.DEPENDENCY_FILES))}))"
_LAYER = exprs.case_contains_sql("path", rules.REVIEW_LAYERS, "application")
_APIS = f"ap AS (SELECT pr, path, coalesce(r, 0) AS routes, CASE WHEN r > 0 THEN 'high' ELSE 'medium' END AS risk FROM ch LEFT JOIN (SELECT path AS p, count(*) AS r FROM sym WHERE kind = 'route' GROUP BY path) q ON q.p = ch.path WHERE r > 0 OR {_LAYER} = 'interface')"
_TESTS = f"rt AS (SELECT DISTINCT pr, t.path AS test FROM ch JOIN (SELECT DISTINCT path FROM src WHERE contains(lower(path), 'test')) t ON contains(lower(t.path), lower(string_split(string_split(ch.path, '/')[-1], '.')[1])) WHERE string_split(string_split(ch.path, '/')[-1], '.')[1] <> '')"


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.files(spark, sf_dir).select(F.col("repo_id").alias("pr"), "path", "language", F.col("size").alias("additions"), F.length("path").cast("long").alias("deletions"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_code._symbols(spark, sf_dir).filter("kind = 'route'").groupBy("path").agg(F.count(F.lit(1)).alias("routes"))


@query(f"WITH {_CHANGED}, {_DEPS} SELECT * FROM dp")
def pr_dependency_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.dependency_changes(_changed(spark, sf_dir))


@query(f"WITH {_CHANGED}, {_APIS} SELECT * FROM ap")
def pr_api_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.api_changes(_changed(spark, sf_dir), _routed(spark, sf_dir))


_SIGNALS = ", ".join(f"CASE WHEN contains(lower(path), {exprs.quoted(t)}) THEN {exprs.quoted(t)} END" for t in reviews.SENSITIVE)


@query(f"WITH {_CHANGED}, s AS (SELECT pr, path, list_filter([{_SIGNALS}], lambda x: x IS NOT NULL) AS signals FROM ch) SELECT pr, path, array_to_string(signals[1:6], ',') AS signals, CASE WHEN {exprs.any_contains_sql('lower(path)', reviews.MOST_SENSITIVE)} THEN 'high' ELSE 'medium' END AS risk FROM s WHERE len(signals) > 0")
def pr_sensitive_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.sensitive_changes(_changed(spark, sf_dir)).withColumn("signals", F.array_join("signals", ","))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.files(spark, sf_dir).filter(F.lower("path").contains("test")).select("path").distinct()


@query(f"WITH {_CHANGED}, {_TESTS} SELECT * FROM rt")
def pr_related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.related_tests(_changed(spark, sf_dir), _tests(spark, sf_dir))


_TWO = "CASE WHEN len(string_split(path, '/')) > 2 AND string_split(path, '/')[1] IN ('src', 'app', 'backend', 'frontend') THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"
_FILE_RISK = f"""{q_code._HOT}, fr AS (SELECT pr, path, {_LAYER} AS layer, greatest(0, least(30, coalesce(risk_score, 0)) + CASE WHEN (pr, path) IN (SELECT (repo_id, path) FROM bad) THEN 25 ELSE 0 END + CASE WHEN {_LAYER} IN ('interface', 'data', 'security') THEN 16 ELSE 0 END
  + CASE WHEN ends_with(lower(path), '.yml') OR ends_with(lower(path), '.json') OR {_NAME} = 'Dockerfile' THEN 12 ELSE 0 END - CASE WHEN contains(lower(path), 'test') OR contains(lower(path), 'spec') THEN 10 ELSE 0 END)::BIGINT AS risk
  FROM ch LEFT JOIN (SELECT repo_id AS pr, path, risk_score FROM hot) USING (pr, path)),
sc AS (SELECT pr, least(100, 15 + sum(risk) + count(DISTINCT {_TWO}) * 8)::BIGINT AS risk_score FROM fr GROUP BY pr), cm AS (SELECT p_brand AS pr, count(DISTINCT p_size % 4) AS commits FROM part GROUP BY p_brand)"""
_lev = lambda c: exprs.level_sql(c, rules.REVIEW_LEVELS, "low")


@query(f"""WITH {_CHANGED}, {_DEPS}, {_APIS}, {_TESTS}, {_FILE_RISK}, z AS (SELECT pr, count(*) AS files, sum(additions + deletions)::BIGINT AS lines, count(DISTINCT {_TWO}) AS domains FROM ch GROUP BY pr),
q AS (SELECT z.*, risk_score, (SELECT count(*) FROM rt WHERE rt.pr = z.pr) AS related_tests, (SELECT count(*) FROM dp WHERE dp.pr = z.pr) AS dependency_changes, (SELECT count(*) FROM ap WHERE ap.pr = z.pr) AS api_changes, (SELECT bool_or(layer IN ('security', 'data')) FROM fr WHERE fr.pr = z.pr) AS deep, commits FROM z JOIN sc USING (pr) JOIN cm USING (pr)),
w AS (SELECT *, CASE WHEN related_tests > 0 THEN 'high' ELSE 'medium' END AS test_confidence, least(100, risk_score + CASE WHEN deep THEN 12 ELSE 0 END + CASE WHEN domains >= 3 THEN 10 ELSE 0 END)::BIGINT AS deployment_score FROM q),
x AS (SELECT *, {_lev("deployment_score")} AS deployment_level, least(100, greatest(0, risk_score + CASE test_confidence WHEN 'high' THEN -10 ELSE 0 END + dependency_changes * 6 + api_changes * 7))::BIGINT AS regression_score, least(100, risk_score + files * 2 + lines // 45 + commits * 3)::BIGINT AS complexity_score FROM w)
SELECT pr, risk_score, files, lines, domains, related_tests, dependency_changes, api_changes, test_confidence, deployment_score, deployment_level, CASE WHEN risk_score >= 75 OR deployment_level = 'critical' THEN 'block until staff/security approval' WHEN risk_score >= 55 OR deployment_level = 'high' THEN 'staff review required' WHEN risk_score >= 35 THEN 'targeted owner review' ELSE 'standard review' END AS release_gate,
regression_score, {_lev("regression_score")} AS regression_level, complexity_score, {_lev("complexity_score")} AS complexity_level FROM x""")
def pr_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _changed(spark, sf_dir)
    files, symbols, findings = q_code._given(spark, sf_dir)
    serious = findings.filter("severity IN ('critical', 'high', 'medium')").select("repo_id", "path")
    hot = knowledge.hotspots(files, knowledge.relations(files, symbols), findings)
    risks = history.review_risk(changed.select("pr", F.col("pr").alias("repo_id"), "path"), hot, serious)
    commits = bind.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("pr")).agg(F.countDistinct(F.col("p_size") % 4).alias("commits"))
    related = reviews.related_tests(changed, _tests(spark, sf_dir))
    return reviews.assessment(history.review_score(risks), changed, risks, related, True, reviews.dependency_changes(changed), reviews.api_changes(changed, _routed(spark, sf_dir)), commits)


@query(f"""WITH {_CHANGED}, m AS (SELECT repo_id AS pr, 'c' || n AS sha, list_filter(string_split('fix mod' || n || ' readme', ' '), lambda x: x <> '') AS words FROM brands), h AS (SELECT m.pr, sha, ch.path FROM m JOIN ch ON ch.pr = m.pr WHERE len(list_filter(words, lambda w: contains(lower(ch.path), w))) > 0)
SELECT m.pr, m.sha, coalesce((SELECT array_to_string(list(path ORDER BY path)[1:8], ';') FROM h WHERE h.pr = m.pr), '') AS files FROM m""")
def pr_impact_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _changed(spark, sf_dir)
    n = F.regexp_extract("pr", "[0-9]+", 0)
    commits = changed.select("pr").distinct().select("pr", F.concat(F.lit("c"), n).alias("sha"), F.concat(F.lit(" Fix mod"), n, F.lit("  README")).alias("message"))
    return reviews.touched_by_message(commits, changed).withColumn("files", F.array_join("files", ";"))


_RUNS = """runs AS (SELECT (o_orderkey % 10)::INT AS batch, o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'passed' END AS status, o_orderpriority AS language, (o_totalprice / 50)::BIGINT AS files, (o_totalprice / 1000)::DECIMAL(28,6)::DOUBLE AS seconds, 180 AS timeout,
(o_custkey % 900)::DOUBLE AS rss_mb, (o_orderkey % 60)::DOUBLE AS cpu_seconds, (o_custkey % 101)::DOUBLE / 100 AS citation, (o_orderkey % 101)::DOUBLE / 100 AS retrieval, 1.0::DOUBLE AS correctness FROM orders)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, price = F.col, F.col("o_totalprice")
    return bind.table(spark, sf_dir, "orders").select(
        (c("o_orderkey") % 10).cast("int").alias("batch"), c("o_orderkey").alias("run_id"), F.when(c("o_orderstatus") == "P", "failed").otherwise("passed").alias("status"), c("o_orderpriority").alias("language"), F.round(price / 50).cast("long").alias("files"),
        (price / 1000).cast("decimal(28,6)").cast("double").alias("seconds"), F.lit(180).alias("timeout"), (c("o_custkey") % 900).cast("double").alias("rss_mb"), (c("o_orderkey") % 60).cast("double").alias("cpu_seconds"),
        ((c("o_custkey") % 101) / 100).alias("citation"), ((c("o_orderkey") % 101) / 100).alias("retrieval"), F.lit(1.0).alias("correctness"),
    )


_r3 = lambda x: exprs.dec_round_sql(x, 3)
_SUMMARY = f"""{_RUNS}, sm AS (SELECT batch, count(*) AS attempted, count(*) FILTER (status = 'passed') AS passed, {", ".join(f"{_r3(f'coalesce(avg({c}) FILTER (status = {exprs.quoted(chr(112) + 'assed')}), 0)')} AS mean_{c}" for c in ("citation", "retrieval", "correctness"))},
count(*) FILTER (status <> 'passed') AS failed FROM runs GROUP BY batch)"""


@query(f"WITH {_SUMMARY} SELECT *, {_r3('failed / greatest(attempted, 1)')} AS failure_rate FROM sm")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summary(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS} SELECT batch, 'language' AS kind, language AS name, count(*) AS runs FROM runs GROUP BY ALL UNION ALL SELECT batch, 'size', {exprs.level_sql("files", validation.SIZES, "tiny")}, count(*) FROM runs GROUP BY ALL""")
def validation_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.mixes(_runs(spark, sf_dir))


@query(f"""WITH {_SUMMARY} SELECT sum(attempted)::BIGINT AS attempted, sum(failed)::BIGINT AS failed, sum(passed)::BIGINT AS passed, {", ".join(f"{_r3(f'sum({c} * passed) / greatest(sum(passed), 1)')} AS {c}" for c in validation.GATES)}, {_r3("sum(failed) / greatest(sum(attempted), 1)")} AS failure_rate FROM sm""")
def validation_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.merged(validation.summary(_runs(spark, sf_dir)))


@query(f"WITH {_SUMMARY}, g AS (SELECT batch, unnest([{', '.join(f'CASE WHEN {c} < {v} THEN {exprs.quoted(c)} END' for c, v in validation.GATES.items())}, CASE WHEN failed > 0 THEN 'failed' END]) AS gate FROM sm) SELECT * FROM g WHERE gate IS NOT NULL")
def regression_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.gates(validation.summary(_runs(spark, sf_dir)))


@query(f"""WITH {_RUNS}, st AS (SELECT batch, language AS stage, sum(seconds::DECIMAL(28,6)) AS s FROM runs GROUP BY ALL), rk AS (SELECT *, s::DOUBLE / (sum(s) OVER (PARTITION BY batch))::DOUBLE AS share FROM st QUALIFY row_number() OVER (PARTITION BY batch ORDER BY s DESC, stage) <= 10)
SELECT a.batch, a.stage, {_r3("a.s::DOUBLE")} AS seconds, {exprs.dec_round_sql("a.share", 4)} AS share, {_r3("coalesce(b.s, 0)::DOUBLE")} AS previous_seconds, {_r3("a.s::DOUBLE - coalesce(b.s, 0)::DOUBLE")} AS delta_seconds FROM rk a LEFT JOIN rk b ON b.batch = a.batch - 1 AND b.stage = a.stage WHERE a.batch > (SELECT min(batch) FROM rk)""")
def validation_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.bottlenecks(_runs(spark, sf_dir).withColumnRenamed("language", "stage"))


@query(f"WITH {_RUNS} SELECT batch, {exprs.dec_round_sql('max(rss_mb)', 2)} AS rss_peak, {_r3('sum(rss_mb) / count(*)')} AS rss_mean, {_r3('sum(cpu_seconds)')} AS cpu_total FROM runs GROUP BY batch")
def validation_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.resources(_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT run_id, seconds, timeout FROM runs WHERE seconds >= timeout * 0.8 ORDER BY seconds DESC, run_id LIMIT 20")
def near_timeout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.near_timeout(_runs(spark, sf_dir))


_DEPS_SQL = f"{q_code._STACK}, ds AS (SELECT repo_id, unnest(list_concat(frameworks, package_managers)) AS dependency FROM stack)"


@query(f"WITH {sources.ALL_SQL}, {_DEPS_SQL}, n AS (SELECT dependency, count(DISTINCT repo_id) AS repos FROM ds GROUP BY dependency HAVING count(DISTINCT repo_id) > 1), e AS (SELECT repo_id, dependency, repos FROM ds JOIN n USING (dependency) ORDER BY repo_id, dependency LIMIT 160) SELECT repo_id AS source, 'dependency:' || dependency AS target, 'uses' AS relation FROM e")
def portfolio_overlap_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.overlap_graph(q_code._deps(spark, sf_dir))


@query(f"""WITH {sources.ALL_SQL}, {q_code._STACK}, f AS (SELECT unnest(frameworks) AS framework FROM stack), n AS (SELECT count(*) AS n FROM stack), c AS (SELECT framework, count(*) AS repos FROM f GROUP BY framework)
SELECT framework, repos, {exprs.dec_round_sql("repos / n * 100", 1)} AS portfolio_share, CASE WHEN repos / n >= 0.8 THEN 'high' WHEN repos / n >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM c, n""")
def framework_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.framework_concentration(repository.stack(sources.files(spark, sf_dir)))


_SPACED = f"{sources.ALL_SQL}, {q_code._BAD}, {q_code._SPACES}"


def _spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.domains(*q_code._given(spark, sf_dir))


@query(f"""WITH {_SPACED}, fc AS (SELECT repo_id, count(*) AS files FROM src GROUP BY repo_id), s6 AS (SELECT * FROM spaces QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_count DESC, name) <= 6)
SELECT repo_id, name, file_count, {exprs.dec_round_sql("file_count / files * 100", 1)} AS share, CASE WHEN file_count / files >= 0.5 THEN 'critical ownership concentration' ELSE 'ownership concentration' END AS risk FROM s6 JOIN fc USING (repo_id) WHERE file_count / files >= 0.1""")
def ownership_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a tenth as the least share: the bound repositories have eight domains of like size."""
    return portfolio.ownership_concentration(_spaces(spark, sf_dir), sources.files(spark, sf_dir), 0.1)


@query(f"""WITH {_SPACED}, fc AS (SELECT repo_id, count(*) AS files FROM src GROUP BY repo_id)
SELECT repo_id, name, {exprs.dec_round_sql("least(100.0, file_count::DOUBLE / files * 45 + security_findings * 18 + CASE WHEN routes > 0 THEN 10 ELSE 0 END + CASE WHEN data_models > 0 THEN 12 ELSE 0 END)", 1)} AS risk FROM spaces JOIN fc USING (repo_id)""")
def service_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.service_risk(_spaces(spark, sf_dir), sources.files(spark, sf_dir))


@query(f"""WITH {_SPACED}, s AS (SELECT DISTINCT repo_id, lower(string_split(name, '/')[-1]) AS service FROM spaces WHERE role IN ('API boundary', 'Data layer', 'Trust boundary', 'Product capability'))
SELECT service, count(*) AS repos FROM s WHERE service NOT IN ('src', 'app', 'backend', 'frontend') GROUP BY service HAVING count(*) > 1 ORDER BY repos DESC, service LIMIT 20""")
def duplicate_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.duplicate_services(_spaces(spark, sf_dir))


@query(f"""WITH {sources.ALL_SQL}, {q_code._HOT}, f AS (SELECT repo_id, path, message AS risk, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 30 WHEN 'medium' THEN 18 ELSE 8 END AS risk_score FROM found QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path, line, rule_id) <= 5),
h AS (SELECT repo_id, path, CASE WHEN sensitive THEN 'security finding and dependency centrality' ELSE 'dependency centrality' END AS risk, risk_score FROM hot QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, path) <= 3)
SELECT * FROM (SELECT * FROM f UNION ALL SELECT * FROM h) ORDER BY risk_score DESC, repo_id, path, risk LIMIT 20""")
def portfolio_top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = q_code._given(spark, sf_dir)
    return portfolio.top_risks(findings, knowledge.hotspots(files, knowledge.relations(files, symbols), findings))


@query(f"""WITH {_SPACED}, o AS (SELECT *, {exprs.case_contains_sql("repo_id || '/' || name", rules.OWNERS, "Core Engineering")} AS team FROM spaces)
SELECT team, count(DISTINCT repo_id) AS repos, count(*) AS services, count(*) FILTER (security_findings > 0) AS critical_services, min({exprs.by_value_sql("team", {k: v[0] for k, v in repo_rules.TEAMS.items()}, 1)})::INT AS bus_factor,
{exprs.dec_round_sql("count(*) / (SELECT count(*) FROM o) * 100", 1)} AS share, CASE WHEN count(*) / (SELECT count(*) FROM o) >= 0.5 THEN 'high' WHEN count(*) / (SELECT count(*) FROM o) >= 0.25 THEN 'medium' ELSE 'low' END AS concentration FROM o GROUP BY team""")
def team_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.teams(_spaces(spark, sf_dir))


@query(f"""WITH {sources.ALL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY repo_id, path, line) AS k FROM found)
SELECT 'Remediate ' || rule_id AS action, (SELECT count(DISTINCT repo_id) FROM found f WHERE f.rule_id = r.rule_id) AS impact, string_agg(path, ';' ORDER BY k) AS evidence FROM r WHERE k <= 6 GROUP BY rule_id ORDER BY impact DESC, action LIMIT 12""")
def remediation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.remediation(sources.findings(spark, sf_dir)).withColumn("evidence", F.array_join("evidence", ";"))


@query(f"""WITH {sources.ALL_SQL}, {q_code._SCORES} SELECT count(*) AS repositories, {exprs.dec_round_sql("avg(cto)", 1)} AS cto, {exprs.dec_round_sql("avg(security)", 1)} AS security, {exprs.dec_round_sql("avg(production)", 1)} AS production FROM scores""")
def portfolio_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.score(q_code._scores(spark, sf_dir))
