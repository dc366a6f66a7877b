"""Queries of evidence, payloads and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import code, containment, evidence, graph, knowledge, payloads, reports, repository, sarif
from stratalith.plans import q_code
from stratalith.plans.register import query
from stratalith.sources import bind, sources
from stratalith.sources.shared import shared_dir, written


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = q_code._given(spark, sf_dir)
    about, _ = q_code._facts(spark, sf_dir)
    links = knowledge.relations(files, symbols)
    acquired = repository.acquisition(about, findings.filter("severity = 'critical'"))
    distinct = links.distinct()
    return evidence.signals(about, repository.security(files, findings), knowledge.entities(files, symbols), distinct, knowledge.hotspots(files, links, findings), acquired, q_code._debt(spark, sf_dir))


_TOP = lambda x: f"least(100.0, {x})::DOUBLE"
_FLOOR = lambda x: f"greatest(0.0, {x})::DOUBLE"
_SIGNALS = f"""{q_code._ABOUT}, en AS (SELECT repo_id, count(*) AS entities FROM (SELECT repo_id, path AS id FROM src UNION SELECT repo_id, {q_code._TARGET} FROM sym WHERE kind NOT IN ('import', 'export')) GROUP BY repo_id), rl AS (SELECT repo_id, count(*) AS relations FROM (SELECT DISTINCT * FROM rel) GROUP BY repo_id),
hs AS (SELECT repo_id, sum(risk_score) AS hot_sum FROM hot GROUP BY repo_id), a0 AS (SELECT about.*, critical, high, critical + high + medium + low AS found_n, entities, relations, coalesce(hot_sum, 0) AS hot_sum,
  round(least(95.0, 35 + test_files::DOUBLE / about.files * 220)::DECIMAL(38,10), 1)::DOUBLE AS test_confidence, (45 + (docs = 100)::INT * 35 + has_docs::INT * 15)::DOUBLE AS documentation FROM about JOIN sec USING (repo_id) JOIN en USING (repo_id) JOIN rl USING (repo_id) LEFT JOIN hs USING (repo_id)),
sg AS (SELECT *, {_FLOOR("100 - critical * 25")} AS critical_signal, {_FLOOR("100 - high * 12")} AS high_signal, {_FLOOR("100 - found_n::DOUBLE / files * 120")} AS density_signal, 100.0::DOUBLE AS coverage, {_TOP("entities * 2 + relations")} AS graph_signal, {_TOP("45 + routes * 12")} AS route_signal,
  {_TOP("35 + domains * 7 + components * 4")} AS modularity_signal, {_TOP("hotspots * 12 + hot_sum")} AS hotspot_signal, {_TOP("found_n * 12")} AS finding_risk, {_TOP("hotspots * 14")} AS hotspot_risk, 0.0::DOUBLE AS debt_risk,
  {_TOP("18 * ((security < 55)::INT + (debt < 55)::INT + (production < 55)::INT + (cto < 55)::INT + (test_confidence < 55)::INT + (documentation < 55)::INT)")} AS flag_risk FROM a0),
fx AS (SELECT repo_id, unnest([{", ".join(f"{{'score': '{score}', 'factor': '{name}', 'value': {name}::DOUBLE, 'weight': {weight}::DOUBLE, 'inverse': {str(inverse).lower()}}}" for score, parts in evidence.FACTORS.items() for name, weight, inverse in parts)}]) AS x FROM sg),
fc2 AS (SELECT repo_id, x.score AS score, x.factor AS factor, {exprs.dec_round_sql("x.value", 1)} AS value, x.weight AS weight, {exprs.dec_round_sql("CASE WHEN x.inverse THEN 100 - x.value ELSE x.value END * x.weight", 2)} AS impact, x.value >= 70 AS strong FROM fx)"""


@query(f"WITH {sources.ALL_SQL}, {_SIGNALS} SELECT * FROM fc2")
def evidence_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.factors(_signals(spark, sf_dir))


@query(f"WITH {sources.ALL_SQL}, {_SIGNALS} SELECT repo_id, score, {exprs.dec_round_sql('sum(impact::DECIMAL(20,2))::DOUBLE', 1)} AS value, count(*) FILTER (strong) AS strong, count(*) FILTER (NOT strong) AS weak FROM fc2 GROUP BY ALL")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.composite(evidence.factors(_signals(spark, sf_dir)))


def _pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of pull requests, a supplier each; some are broken."""
    n = F.col("s_suppkey").cast("string")
    wrap = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return bind.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pr"), wrap('[{"filename": "a', n, '.py", "status": "modified", "additions": ', n, ', "changes": 3}, {"filename": "b.py", "deletions": 2}]').alias("files"),
        wrap('[{"sha": "c', n, '", "commit": {"message": "first ', n, '\\nbody", "author": {"name": "", "date": "2024-01-01"}}, "author": {"login": "u', n, '"}}]').alias("commits"),
        F.when(F.col("s_suppkey") % 10 == 0, F.lit("{broken")).otherwise(wrap('[{"user": {"login": "r"}, "body": "', F.repeat(F.lit("x"), 1200), '", "position": 4}]')).alias("comments"), F.lit('[{"name": "ci", "status": "completed", "conclusion": null}]').alias("checks"),
    )


@query("SELECT s_suppkey AS pr, 'a' || s_suppkey || '.py' AS path, 'modified' AS status, s_suppkey::INT AS additions, 0 AS deletions, 3 AS changes FROM supplier UNION ALL SELECT s_suppkey, 'b.py', '', 0, 2, 0 FROM supplier")
def pull_request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.pull_files(_pulls(spark, sf_dir))


@query("SELECT s_suppkey AS pr, 'c' || s_suppkey AS sha, 'first ' || s_suppkey AS message, 'u' || s_suppkey AS author, '2024-01-01' AS date FROM supplier")
def pull_request_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.pull_commits(_pulls(spark, sf_dir))


@query("SELECT s_suppkey AS pr, 'r' AS author, repeat('x', 1000) AS body, '' AS path, 4 AS line FROM supplier WHERE s_suppkey % 10 <> 0")
def pull_request_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.pull_comments(_pulls(spark, sf_dir))


@query("SELECT s_suppkey AS pr, 'ci' AS name, 'completed' AS status, NULL::VARCHAR AS conclusion FROM supplier")
def pull_request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.pull_checks(_pulls(spark, sf_dir))


@query("""SELECT n_name AS repo_id, 'a.py' AS path, 'B' || n_nationkey AS rule_id, 'high' AS severity, 7 AS line, 'bad' AS message FROM nation UNION ALL SELECT n_name, 'b.py', 'r.x', 'medium', n_nationkey::INT, 'Semgrep finding' FROM nation
UNION ALL SELECT n_name, 'lock', 'trivy-CVE-' || n_nationkey, 'critical', 1, 'lib CVE-' || n_nationkey || ': Vulnerable dependency' FROM nation""")
def scanner_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    texts = {
        "bandit": F.concat(F.lit('{"results": [{"filename": "a.py", "test_id": "B'), n, F.lit('", "issue_severity": "HIGH", "line_number": 7, "issue_text": "bad"}]}')),
        "semgrep": F.concat(F.lit('{"results": [{"path": "b.py", "check_id": "r.x", "start": {"line": '), n, F.lit('}, "extra": {"severity": "WARNING"}}]}')),
        "trivy": F.concat(F.lit('{"Results": [{"Target": "lock", "Vulnerabilities": [{"VulnerabilityID": "CVE-'), n, F.lit('", "Severity": "CRITICAL", "PkgName": "lib"}]}, {"Target": "none"}]}')), "other": F.lit("{broken"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("scanner"), v.alias("text")) for k, v in texts.items()))).alias("x")
    return payloads.scanner_findings(bind.table(spark, sf_dir, "nation").select(F.col("n_name").alias("repo_id"), rows).select("repo_id", "x.*"))


@query(f"""WITH {sources.ALL_SQL}, {q_code._LINKS}, f AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY source, target, relation) AS r FROM links)
SELECT repo_id, sha256('flowchart LR' || chr(10) || string_agg('  "' || source || '" -->|' || relation || '| "' || target || '"', chr(10) ORDER BY r)) AS digest FROM f WHERE r <= 40 GROUP BY repo_id""")
def dependency_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.diagram(knowledge.dependency_edges(q_code._files(spark, sf_dir), q_code._symbols(spark, sf_dir)))
    return found.select("repo_id", F.sha2("diagram", 256).alias("digest"))


@query(f"""WITH {sources.ALL_SQL}, {q_code._SCORES} SELECT repo_id, '# ' || repo_id || chr(10) || chr(10) || '| Score | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Security | ' || format('{{:.1f}}', security) || ' |' || chr(10) || '| Readiness | ' || format('{{:.1f}}', production) || ' |' AS text FROM scores""")
def score_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.markdown(q_code._scores(spark, sf_dir), {"security": "Security", "production": "Readiness"})


@query(f"""WITH {sources.ALL_SQL}, c AS (SELECT repo_id, path, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind IN ('class', 'function', 'method')) AS symbols FROM sym GROUP BY ALL)
SELECT * FROM c WHERE routes > 0 OR symbols > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY routes DESC, symbols DESC, path) <= 60""")
def architecture_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.services(q_code._symbols(spark, sf_dir))


_SERVED = f"""{sources.ALL_SQL}, {q_code._HOT}, c AS (SELECT repo_id, path, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind IN ('class', 'function', 'method')) AS symbols FROM sym GROUP BY ALL),
sv AS (SELECT * FROM c WHERE routes > 0 OR symbols > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY routes DESC, symbols DESC, path) <= 60), a AS (SELECT repo_id, path, sum({q_code._RISK}) AS a FROM found GROUP BY ALL),
pr AS (SELECT repo_id, path, least(100, coalesce(a, 0) + coalesce(3 * connectivity, 0))::BIGINT AS risk FROM src LEFT JOIN a USING (repo_id, path) LEFT JOIN hot USING (repo_id, path)),
sn AS (SELECT repo_id, path, {q_code._DOMAIN} AS domain, {exprs.case_contains_sql("path", rules.EXPLORER_LAYERS, "Application")} AS layer, coalesce(routes, 0) AS routes, coalesce(symbols, 0) AS symbols, coalesce(risk, 0) AS risk
  FROM (SELECT repo_id, path FROM sv UNION SELECT repo_id, path FROM hot) LEFT JOIN sv USING (repo_id, path) LEFT JOIN pr USING (repo_id, path))"""


def _served(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, all service nodes, risks) of the made repositories."""
    files, symbols, findings = q_code._given(spark, sf_dir)
    links = written(knowledge.relations(files, symbols))
    hot = knowledge.hotspots(files, links, findings)
    risks = written(repository.path_risk(files, findings, hot, repository.debt_items(q_code._metrics(spark, sf_dir))))
    return links, reports.service_nodes(reports.services(symbols), hot, risks, None), risks


@query(f"WITH {_SERVED} SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 120")
def service_explorer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.ranked(_served(spark, sf_dir)[1], 120, "path")


@query(f"""WITH {_SERVED}, se AS (SELECT DISTINCT rel.repo_id, source, target, relation FROM rel WHERE EXISTS (SELECT 1 FROM sn WHERE sn.repo_id = rel.repo_id AND sn.path IN (source, target)))
SELECT se.repo_id, source, target, relation, greatest(coalesce(x.risk, 0), coalesce(y.risk, 0)) AS risk FROM se LEFT JOIN pr x ON x.repo_id = se.repo_id AND x.path = source LEFT JOIN pr y ON y.repo_id = se.repo_id AND y.path = target
QUALIFY row_number() OVER (PARTITION BY se.repo_id ORDER BY source, target, relation) <= 240""")
def service_explorer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.service_edges(*_served(spark, sf_dir))


@query(f"WITH {_SERVED} SELECT repo_id, path, risk FROM sn QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY risk DESC, path) <= 8")
def high_risk_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _served(spark, sf_dir)[1]
    return knowledge.ranked(nodes, 8, F.desc("risk"), "path").select("repo_id", "path", "risk")


@query(f"""WITH {sources.ALL_SQL}, {q_code._HOT}, {q_code._SPACES}, c AS (SELECT repo_id, path, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind IN ('class', 'function', 'method')) AS symbols FROM sym GROUP BY ALL), sv1 AS (SELECT * FROM c WHERE routes > 0 OR symbols > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY routes DESC, symbols DESC, path) <= 60),
i AS (SELECT repo_id, {q_code._DOMAIN} AS name, sum(routes) AS r, sum(symbols) AS s FROM sv1 GROUP BY ALL), a AS (SELECT repo_id, path, sum({q_code._RISK}) AS a FROM found GROUP BY ALL), pr AS (SELECT repo_id, path, least(100, coalesce(a, 0) + coalesce(3 * connectivity, 0)) AS risk FROM src LEFT JOIN a USING (repo_id, path) LEFT JOIN hot USING (repo_id, path)),
w AS (SELECT repo_id, {q_code._DOMAIN} AS name, max(risk) AS risk FROM pr WHERE risk > 0 GROUP BY ALL)
SELECT {exprs.case_contains_sql("name", rules.OWNERS, "Core Engineering")} AS team, count(*) AS domains, coalesce(sum(r), 0)::BIGINT AS routes, coalesce(sum(s), 0)::BIGINT AS symbols, coalesce(max(risk), 0)::BIGINT AS worst FROM spaces LEFT JOIN i USING (repo_id, name) LEFT JOIN w USING (repo_id, name) GROUP BY team""")
def ownership_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = q_code._given(spark, sf_dir)
    hot = knowledge.hotspots(files, knowledge.relations(files, symbols), findings)
    risks = repository.path_risk(files, findings, hot, repository.debt_items(q_code._metrics(spark, sf_dir)))
    return reports.owners(knowledge.domains(files, symbols, findings), reports.services(symbols), risks)


@query("""SELECT o_custkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN 'complete' WHEN o_custkey % 3 = 1 THEN 'cancelled' ELSE 'queued' END AS state, CASE o_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END::INT AS moves, CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END::INT AS refused FROM (SELECT DISTINCT o_custkey FROM orders)""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {0: ("running", "complete", "running"), 1: ("running", "cancel_requested", "cancelled"), 2: ("complete", "failed")}
    jobs = bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id")).distinct()
    pick = F.when(F.col("job_id") % 3 == 0, F.array(*map(F.lit, wanted[0]))).when(F.col("job_id") % 3 == 1, F.array(*map(F.lit, wanted[1]))).otherwise(F.array(*map(F.lit, wanted[2])))
    return reports.job_states(jobs.select("job_id", F.posexplode(pick).alias("position", "wanted")))


@query(f"""WITH {sources.ALL_SQL} SELECT repo_id, rule_id, 'found' AS message, count(*) AS results, count(*) FILTER (severity IN ('critical', 'high')) AS errors FROM found GROUP BY ALL""")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the exported documents with their results."""
    findings = sources.findings(spark, sf_dir)
    each = sarif.results(findings).groupBy("repo_id", F.col("result.ruleId").alias("rule_id")).agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("result.level") == "error").alias("errors"))
    return sarif.rules_of(findings).join(each, ["repo_id", "rule_id"])


@query(f"""WITH {sources.ALL_SQL}, {q_code._ABOUT} SELECT repo_id, {exprs.dec_round_sql("least(100.0, greatest(0.0, 45 + docker::INT * 12 + has_ci::INT * 12 + least(18.0, components * 1.5) - least(15, hotspots)))", 1)} AS scalability,
least(100, 14 * 5 + 3 * components + 2 * least(12, 10) + 2 * least(routes, 10) + 2 * least(stored_files, 5))::BIGINT AS quality FROM about""")
def executive_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalability as executives read it, and the quality of the extracted architecture: five diagrams, ten important files."""
    c = F.col
    about, _ = q_code._facts(spark, sf_dir)
    ready = 45 + F.when(c("docker"), 12).otherwise(0) + F.when(c("has_ci"), 12).otherwise(0) + F.least(F.lit(18.0), c("components") * 1.5) - F.least(F.lit(15), c("hotspots"))
    quality = F.least(F.lit(100), 14 * 5 + 3 * c("components") + 2 * 10 + 2 * F.least(c("routes"), F.lit(10)) + 2 * F.least(c("stored_files"), F.lit(5)))
    return about.select("repo_id", exprs.dec_round(exprs.clamp(ready, 0.0, 100.0), 1).alias("scalability"), quality.cast("long").alias("quality"))


@query(f"""WITH {sources.ALL_SQL}, {q_code._PROJECTED}, e AS (SELECT 'owner:' || {q_code._OWNER} AS source, 'service:' || repo_id || ':' || name AS target, 'OWNS' AS relation FROM spaces WHERE repo_id = 'Brand#1') SELECT * FROM e""")
def graph_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = knowledge.projection(*(df.filter("repo_id = 'Brand#1'") for df in q_code._given(spark, sf_dir)), q_code._deps(spark, sf_dir).filter("repo_id = 'Brand#1'"))
    return graph.graph_query(nodes, edges, "ownership")


@query(f"""WITH {sources.ALL_SQL}, {q_code._LINKS}, n AS (SELECT DISTINCT repo_id, id FROM (SELECT repo_id, target AS id FROM links UNION ALL SELECT repo_id, path FROM src))
SELECT repo_id, id FROM n WHERE contains(lower(id), 'load') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id) = 1""")
def graph_node_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = knowledge.dependency_nodes(q_code._files(spark, sf_dir), q_code._symbols(spark, sf_dir)).withColumn("label", F.col("id"))
    return knowledge.resolved(nodes, "LOAD")


@query(f"WITH {sources.ALL_SQL} SELECT repo_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM src GROUP BY ALL")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise("")
    return sources.files(spark, sf_dir).groupBy("repo_id", folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("SELECT count(DISTINCT user_id) AS clients, count(*) AS requests FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def active_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bind.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    return events.crossJoin(last).filter(F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS")).agg(F.countDistinct("user_id").alias("clients"), F.count(F.lit(1)).alias("requests"))


_DESCRIBED = exprs.case_contains_sql("path", rules.SERVICE_TEXTS, "Behaviour of the application")
_ASKED = f"""{sources.ALL_SQL}, {q_code._BAD}, {q_code._SPACES}, qs AS (SELECT p_partkey AS question_id, 'What does the Server do with ' || p_name AS text FROM part WHERE p_partkey % 10 < 4 AND p_partkey % 4 = 3),
ck AS (SELECT p_partkey AS question_id, src.repo_id, CASE p_partkey % 3 WHEN 0 THEN path WHEN 1 THEN 'old/' || upper(path) ELSE string_split(path, '/')[-1] END AS path
  FROM part JOIN src ON src.repo_id = p_brand AND regexp_extract(src.path, '([0-9]+)\\.[a-zA-Z]+$', 1) = p_partkey::VARCHAR AND p_partkey % 10 < 4)"""


def _spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.domains(*q_code._given(spark, sf_dir)).withColumnRenamed("sample_files", "samples")


@query(f"""WITH {_ASKED}, m AS (SELECT question_id, repo_id, name FROM qs, spaces WHERE contains(lower(text), lower(name))
UNION SELECT question_id, spaces.repo_id, name FROM ck JOIN spaces ON ck.repo_id = spaces.repo_id WHERE len(list_filter(sample_files, lambda x: contains(lower(x), lower(ck.path)) OR contains(lower(ck.path), lower(x)))) > 0)
SELECT question_id, repo_id, name AS service, role, CASE WHEN security_findings > 0 THEN 'high' WHEN routes > 0 THEN 'medium' ELSE 'low' END AS risk FROM m JOIN spaces USING (repo_id, name)
QUALIFY row_number() OVER (PARTITION BY question_id, repo_id ORDER BY file_count DESC, name) <= 8""")
def affected_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that questions name, or whose files lie in the paths of what was found for them."""
    part = bind.table(spark, sf_dir, "part").filter("p_partkey % 10 < 4")
    questions = part.filter("p_partkey % 4 = 3").select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("What does the Server do with "), "p_name").alias("text"))
    files = sources.files(spark, sf_dir).select("repo_id", "path", F.regexp_extract("path", r"([0-9]+)\.[a-zA-Z]+$", 1).alias("number"))
    ends = files.join(part.select(F.col("p_partkey").alias("question_id"), F.col("p_partkey").cast("string").alias("number"), F.col("p_brand").alias("repo_id")), ["repo_id", "number"])
    path = F.when(F.col("question_id") % 3 == 0, F.col("path")).when(F.col("question_id") % 3 == 1, F.concat(F.lit("old/"), F.upper("path"))).otherwise(exprs.file_name(F.col("path")))
    return containment.affected_services(questions, ends.select("question_id", "repo_id", path.alias("path")), _spaces(spark, sf_dir))


@query(f"""WITH {sources.ALL_SQL}, {q_code._BAD}, {q_code._SPACES}, c AS (SELECT repo_id, path FROM src WHERE size % 3 = 0)
SELECT c.repo_id, name, count(DISTINCT path) AS changed_files FROM spaces JOIN c ON c.repo_id = spaces.repo_id WHERE contains(lower(path), lower(name)) OR list_contains(sample_files, path) GROUP BY ALL""")
def impacted_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains whose name or samples a change touches."""
    return containment.impacted(_spaces(spark, sf_dir), sources.files(spark, sf_dir).filter("size % 3 = 0").select("repo_id", "path"))


_INTENTS = ", ".join(f"('{i}', [{', '.join(map(exprs.quoted, ts))}])" for i, ts in containment.FLOW_INTENTS.items())


def _flow_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, symbols, _ = q_code._given(spark, sf_dir)
    joined = lambda *c: F.concat_ws(" ", *c)
    row = lambda df, kind, name, detail, about: df.select("repo_id", F.lit(kind).alias("kind"), "path", name.alias("name"), detail.alias("detail"), about.alias("about"))
    routes, models = (symbols.filter(F.col("kind") == k).drop("kind") for k in ("route", "model"))
    described = exprs.case_contains(F.col("path"), rules.SERVICE_TEXTS, "Behaviour of the application")
    parts = row(routes, "route", joined("method", "name"), F.coalesce(F.nullif("handler", F.lit("")), "name"), joined("name", F.coalesce("handler", F.lit("")), "path"))
    parts = parts.unionByName(row(reports.services(symbols), "service", F.col("path"), described, joined("path", described)))
    return parts.unionByName(row(models, "model", F.col("name"), F.col("path"), joined("name", "path")))


@query(f"""WITH {sources.ALL_SQL}, c AS (SELECT repo_id, path, count(*) FILTER (kind = 'route') AS r, count(*) FILTER (kind IN ('class', 'function', 'method')) AS s FROM sym GROUP BY ALL),
sv AS (SELECT * FROM c WHERE r > 0 OR s > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY r DESC, s DESC, path) <= 60),
parts AS (SELECT DISTINCT repo_id, kind, path, concat_ws(' ', method, name) AS name, coalesce(nullif(handler, ''), name) AS detail, concat_ws(' ', name, coalesce(handler, ''), path) AS about FROM sym WHERE kind = 'route'
UNION ALL SELECT repo_id, 'service', path, path, {_DESCRIBED}, path || ' ' || {_DESCRIBED} FROM sv UNION ALL SELECT DISTINCT repo_id, kind, path, name, path, name || ' ' || path FROM sym WHERE kind = 'model'),
w(intent, ts) AS (VALUES {_INTENTS}), m AS (SELECT repo_id, intent, kind FROM parts, w WHERE len(list_filter(ts, lambda t: contains(lower(about), t))) > 0),
st AS (SELECT repo_id, 'data_flow' AS intent, kind FROM parts WHERE kind IN ('route', 'model') AND NOT EXISTS (SELECT 1 FROM m WHERE m.repo_id = parts.repo_id AND m.kind = parts.kind AND m.intent = 'data_flow') QUALIFY row_number() OVER (PARTITION BY repo_id, kind) <= 6),
n AS (SELECT repo_id, intent, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind = 'service') AS services, count(*) FILTER (kind = 'model') AS models FROM (SELECT * FROM m UNION ALL SELECT * FROM st) GROUP BY ALL)
SELECT b.repo_id, w.intent, coalesce(routes, 0) AS routes, coalesce(services, 0) AS services, coalesce(models, 0) AS models, 0::BIGINT AS external,
  CASE WHEN routes > 0 AND (services > 0 OR models > 0) THEN 'high' WHEN routes > 0 OR services > 0 OR models > 0 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT DISTINCT repo_id FROM src) b CROSS JOIN w LEFT JOIN n ON n.repo_id = b.repo_id AND n.intent = w.intent""")
def request_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs to each request flow of each repository, and how sure that is."""
    members = written(containment.flow_members(_flow_parts(spark, sf_dir)))
    layer = exprs.case_contains(F.col("path"), rules.EXPLORER_LAYERS, "Application")
    found = containment.request_flows(members, containment.flow_steps(members, layer), sources.files(spark, sf_dir))
    return found.select("repo_id", "intent", "routes", "services", "models", "external", "confidence")


@query(f"""WITH {sources.ALL_SQL} SELECT repo_id, rule_id, CASE lower(severity) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'warning' END AS level, message, path, greatest(1, line) AS line FROM found""")
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings as read back from one document for each repository."""
    folder = f"{shared_dir(spark)}/sarif-{uuid.uuid4().hex}"
    sarif.write_documents(sources.findings(spark, sf_dir), folder)
    return sarif.read_documents(spark, folder)
