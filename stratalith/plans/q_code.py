"""Queries over source files: symbols, graphs, stack, debt, scores and reviews. The SQL starts from the symbols the texts were made with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, repo_rules, rules
from stratalith.operators import code, knowledge, repository
from stratalith.plans.register import query
from stratalith.sources import sources
from stratalith.sources.shared import dealt, stored, written

_WITH = f"WITH {sources.ALL_SQL}"
_MODULES = r"mods AS (SELECT repo_id, regexp_replace(path, '\.[^./]*$', '') AS module, max(path) AS file FROM src GROUP BY ALL)"
_DRAFTS = f"""{_MODULES}, drafts AS (SELECT s.repo_id, s.path AS source, coalesce(m.file, s.name) AS target, 'imports' AS relation, CASE WHEN m.file IS NULL THEN 'module' ELSE 'file' END AS kind, NULL::INT AS line, 1 AS rank
  FROM sym s LEFT JOIN mods m ON m.repo_id = s.repo_id AND m.module = replace(s.name, '.', '/') WHERE s.kind = 'import'
  UNION ALL SELECT repo_id, path, path || '::' || CASE kind WHEN 'method' THEN owner || '.' || name WHEN 'route' THEN method || ' ' || name ELSE name END, CASE kind WHEN 'route' THEN 'exposes' WHEN 'model' THEN 'models' ELSE 'defines' END,
    CASE kind WHEN 'model' THEN 'database_model' ELSE kind END, line, CASE kind WHEN 'function' THEN 2 WHEN 'method' THEN 3 WHEN 'class' THEN 4 WHEN 'route' THEN 5 ELSE 6 END FROM sym WHERE kind NOT IN ('import', 'export'))"""
_LINKS = f"{_DRAFTS}, links AS (SELECT repo_id, source, target, arg_max(relation, rank) AS relation FROM drafts GROUP BY ALL)"
_LABEL = "coalesce(owner || '.', '') || name"
_TARGET = f"CASE kind WHEN 'route' THEN 'route:' || path || ':' || method || ':' || name WHEN 'model' THEN 'model:' || path || ':' || name ELSE 'symbol:' || path || ':' || CASE kind WHEN 'class' THEN 'classes' ELSE kind || 's' END || ':' || {_LABEL} END"
_RELATIONS = f"""{_LINKS}, rel AS (SELECT repo_id, path AS source, {_TARGET} AS target, CASE kind WHEN 'route' THEN 'exposes' WHEN 'model' THEN 'persists' ELSE 'defines' END AS relation FROM sym WHERE kind NOT IN ('import', 'export') UNION ALL SELECT * FROM links),
deg AS (SELECT repo_id, path, count(*) AS n FROM (SELECT repo_id, source AS path FROM rel UNION ALL SELECT repo_id, target FROM rel) GROUP BY ALL)"""
_BAD = "bad AS (SELECT DISTINCT repo_id, path FROM found WHERE severity IN ('critical', 'high', 'medium'))"
_HOT = f"""{_RELATIONS}, {_BAD}, top AS (SELECT * FROM deg QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, path) <= 40),
hot AS (SELECT t.repo_id, t.path, n AS connectivity, n + CASE WHEN b.path IS NULL THEN 0 ELSE 8 END AS risk_score, b.path IS NOT NULL AS sensitive FROM top t SEMI JOIN src s ON s.repo_id = t.repo_id AND s.path = t.path
  LEFT JOIN bad b ON b.repo_id = t.repo_id AND b.path = t.path QUALIFY row_number() OVER (PARTITION BY t.repo_id ORDER BY risk_score DESC, t.path) <= 20)"""
_SPLIT = "string_split(path, '/')"
_DOMAIN = rf"CASE WHEN len({_SPLIT}) = 1 THEN regexp_replace(path, '^(.+)\.[^.]*$', '\1') WHEN len({_SPLIT}) > 2 AND {_SPLIT}[1] IN ('src', 'app', 'backend', 'frontend') THEN {_SPLIT}[1] || '/' || {_SPLIT}[2] ELSE {_SPLIT}[1] END"
_ROLE = exprs.case_contains_sql("name || ' ' || array_to_string(paths[1:20], ' ')", rules.DOMAIN_ROLES, "Product capability")
_SPACES = f"""d AS (SELECT s.repo_id, {_DOMAIN.replace("path", "s.path")} AS name, s.path, b.path IS NOT NULL AS bad FROM src s LEFT JOIN bad b ON b.repo_id = s.repo_id AND b.path = s.path),
g AS (SELECT repo_id, name, count(*) AS file_count, count(*) FILTER (bad) AS security_findings, list(path ORDER BY path) AS paths FROM d GROUP BY ALL),
k AS (SELECT repo_id, {_DOMAIN} AS name, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind = 'model') AS data_models FROM sym GROUP BY ALL),
spaces AS (SELECT g.repo_id, g.name, file_count, coalesce(routes, 0) AS routes, coalesce(data_models, 0) AS data_models, security_findings, {_ROLE.replace("name ||", "g.name ||")} AS role, paths[1:8] AS sample_files FROM g LEFT JOIN k ON k.repo_id = g.repo_id AND k.name = g.name
  QUALIFY row_number() OVER (PARTITION BY g.repo_id ORDER BY file_count DESC, g.name) <= 24)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.files(spark, sf_dir)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "symbols", sf_dir, lambda: written(_parsed(spark, sf_dir)))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(dealt(_files(spark, sf_dir), "repo_id", "path")).drop("is_async")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "metrics", sf_dir, lambda: written(code.python_metrics(dealt(_files(spark, sf_dir).filter("language = 'Python'"), "repo_id", "path"))))


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _files(spark, sf_dir), _symbols(spark, sf_dir), sources.findings(spark, sf_dir)


@query(f"{_WITH} SELECT repo_id, path, kind, name, owner, line, method, handler, orm FROM sym")
def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)


@query(f"{_WITH} SELECT repo_id, path, CASE language WHEN 'Python' THEN 'PART_' || regexp_extract(path, '[0-9]+') || '_KEY' ELSE 'PART_' || regexp_extract(path, '[0-9]+') || '_URL' END AS name FROM src WHERE path LIKE 'src/api/%' OR language = 'JavaScript'")
def source_env_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.env_variables(_files(spark, sf_dir))


@query(f"{_WITH} SELECT repo_id, path, 'TODO' AS tag, 'check part ' || regexp_extract(path, '[0-9]+') AS text, 6 AS line FROM src WHERE path LIKE 'src/api/%'")
def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.notes(_files(spark, sf_dir))


@query(f"{_WITH} SELECT repo_id, path, json_extract_string(text, '$.name') AS name, array_to_string(list_sort(json_keys(text, '$.dependencies')), ',') AS dependencies, '' AS dev_dependencies, '' AS scripts FROM src WHERE language = 'JSON'")
def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.manifest_keys(_files(spark, sf_dir)).select("repo_id", "path", "name", *(F.array_join(c, ",").alias(c) for c in ("dependencies", "dev_dependencies", "scripts")))


@query(f"{_WITH}, {_LINKS} SELECT * FROM links")
def dependency_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.dependency_edges(_files(spark, sf_dir), _symbols(spark, sf_dir))


@query(f"""{_WITH}, {_DRAFTS}, e AS (SELECT repo_id, target AS id, kind, line, rank FROM drafts UNION ALL SELECT repo_id, path, 'file', NULL, 0 FROM src)
SELECT repo_id, id, kind, line FROM e QUALIFY row_number() OVER (PARTITION BY repo_id, id ORDER BY rank DESC, kind DESC, line DESC NULLS LAST) = 1""")
def dependency_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.dependency_nodes(_files(spark, sf_dir), _symbols(spark, sf_dir))


@query(f"""{_WITH}, {_LINKS}, n AS (SELECT repo_id, count(DISTINCT id) AS n FROM (SELECT repo_id, target AS id FROM links UNION ALL SELECT repo_id, path FROM src) GROUP BY repo_id),
g AS (SELECT repo_id, id, count(*) AS degree FROM (SELECT repo_id, source AS id FROM links UNION ALL SELECT repo_id, target FROM links) GROUP BY ALL)
SELECT repo_id, id, {exprs.dec_round_sql("degree / (n - 1)", 6)} AS centrality FROM g JOIN n USING (repo_id) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY centrality DESC, id) <= 10""")
def important_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols = _files(spark, sf_dir), _symbols(spark, sf_dir)
    return knowledge.central(knowledge.dependency_edges(files, symbols), knowledge.dependency_nodes(files, symbols))


@query(f"""{_WITH}, e AS (SELECT repo_id, path AS id, {_SPLIT}[-1] AS label, 'file' AS kind, path, NULL::INT AS line, {exprs.case_contains_sql("path", rules.KNOWLEDGE_LAYERS, "application")} AS layer FROM src
UNION ALL SELECT repo_id, {_TARGET}, {_LABEL}, CASE kind WHEN 'route' THEN kind WHEN 'model' THEN 'data_model' ELSE 'symbol' END, path, line, NULL FROM sym WHERE kind NOT IN ('import', 'export'))
SELECT DISTINCT * FROM e""")
def knowledge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.entities(_files(spark, sf_dir), _symbols(spark, sf_dir))


@query(f"{_WITH}, {_RELATIONS} SELECT repo_id, source, target, relation, count(*) AS n FROM rel GROUP BY ALL")
def knowledge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct relations, with how often each is stated."""
    return knowledge.relations(_files(spark, sf_dir), _symbols(spark, sf_dir)).groupBy("repo_id", "source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH}, {_HOT} SELECT * FROM hot")
def knowledge_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = _given(spark, sf_dir)
    return knowledge.hotspots(files, knowledge.relations(files, symbols), findings)


@query(f"{_WITH}, {_BAD}, {_SPACES} SELECT repo_id, name, file_count, routes, data_models, security_findings, role, array_to_string(sample_files, ';') AS sample_files FROM spaces")
def knowledge_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.domains(*_given(spark, sf_dir)).withColumn("sample_files", F.array_join("sample_files", ";"))


_CLUSTER = ", ".join(f"CASE WHEN {exprs.any_contains_sql('lower(path)', tokens)}{' OR routed' if name == 'API' else ''} THEN '{name}' END" for name, tokens in repo_rules.CLUSTERS)


@query(f"""{_WITH}, {_BAD}, p AS (SELECT s.repo_id, s.path, (s.repo_id, s.path) IN (SELECT (repo_id, path) FROM sym WHERE kind = 'route') AS routed, (s.repo_id, s.path) IN (SELECT (repo_id, path) FROM bad) AS bad FROM src s),
c AS (SELECT repo_id, bad, list_filter([{_CLUSTER}], lambda x: x IS NOT NULL) AS names FROM p), u AS (SELECT repo_id, bad, unnest(CASE WHEN len(names) > 0 THEN names ELSE ['Application'] END) AS name FROM c)
SELECT repo_id, name, count(*) AS member_count, count(*) FILTER (bad) AS security_findings FROM u GROUP BY ALL""")
def knowledge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.clusters(*_given(spark, sf_dir))


@query(f"""{_WITH}, {_HOT}, i AS (SELECT repo_id, 1 AS part, 'god_class_candidate' AS type, 'medium' AS severity, path AS entity, 0 AS o FROM sym WHERE kind IN ('class', 'function', 'method') GROUP BY repo_id, path HAVING count(*) >= 18
UNION ALL SELECT b.repo_id, 2, 'dependency_bottleneck', CASE WHEN n >= 12 THEN 'high' ELSE 'medium' END, b.path, -n FROM (SELECT * FROM deg QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, path) <= 8) b SEMI JOIN src s ON s.repo_id = b.repo_id AND s.path = b.path WHERE n >= 6
UNION ALL SELECT * FROM (SELECT repo_id, 3, 'hotspot', CASE WHEN sensitive THEN 'high' ELSE 'medium' END, path, -risk_score FROM hot QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, path) <= 8)
UNION ALL SELECT * FROM (SELECT repo_id, 4, 'security_hotspot', 'high', path, 0 FROM bad QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 8))
SELECT repo_id, type, severity, entity FROM i QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY part, o, entity) <= 30""")
def knowledge_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = _given(spark, sf_dir)
    return knowledge.insights(files, symbols, findings, knowledge.relations(files, symbols))


def _paths_sql(links: str, starts: str, longest: int) -> str:
    """Recursive enumeration of simple paths with at most eight branches; CTEs end in best(repo_id, start, path)."""
    return f"""steps AS (SELECT repo_id, source, target FROM {links} QUALIFY row_number() OVER (PARTITION BY repo_id, source ORDER BY target) <= 8),
walk AS (SELECT repo_id, start, [start] AS path FROM {starts} UNION ALL SELECT w.repo_id, start, list_append(path, s.target) FROM walk w JOIN steps s ON s.repo_id = w.repo_id AND s.source = path[-1] WHERE len(path) < {longest} AND NOT list_contains(path, s.target)),
best AS (SELECT repo_id, start, path FROM walk QUALIFY row_number() OVER (PARTITION BY repo_id, start ORDER BY len(path) DESC, path) = 1)"""


@query(f"""WITH RECURSIVE {sources.ALL_SQL}, {_HOT}, first AS (SELECT repo_id, path AS start, risk_score FROM hot QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, path) = 1), {_paths_sql("rel", "first", 8)}
SELECT repo_id, array_to_string(path, ' > ') AS path, risk_score FROM best JOIN first USING (repo_id, start)""")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = _given(spark, sf_dir)
    links = written(knowledge.relations(files, symbols))
    found = knowledge.critical_path(links, knowledge.hotspots(files, links, findings))
    return found.withColumn("path", F.array_join("path", " > "))


@query(f"""WITH RECURSIVE {sources.ALL_SQL}, {_LINKS}, busy AS (SELECT repo_id, source AS start, count(*) AS n FROM links GROUP BY repo_id, source QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, source) <= 16), {_paths_sql("links", "busy", 7)}
SELECT repo_id, start, array_to_string(path, ' > ') AS path FROM best WHERE len(path) > 1 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY len(path) DESC, start) <= 12""")
def dependency_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knowledge.dependency_flows(written(knowledge.dependency_edges(_files(spark, sf_dir), _symbols(spark, sf_dir))))
    return found.select("repo_id", "start", F.array_join("path", " > ").alias("path"))


@query(f"""{_WITH}, {_LINKS}, one AS (SELECT DISTINCT repo_id, source, target FROM links), near AS (SELECT * FROM one UNION SELECT a.repo_id, a.source, b.target FROM one a JOIN one b ON a.repo_id = b.repo_id AND a.target = b.source),
f AS (SELECT repo_id, source AS node, count(*) AS n FROM near GROUP BY ALL), b AS (SELECT repo_id, target AS node, count(*) AS n FROM near GROUP BY ALL)
SELECT repo_id, node, coalesce(f.n, 0) AS forward, coalesce(b.n, 0) AS backward FROM f FULL JOIN b USING (repo_id, node)""")
def blast_radius_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.reach(knowledge.dependency_edges(_files(spark, sf_dir), _symbols(spark, sf_dir)))


@query(f"""{_WITH}, {_LINKS} SELECT repo_id, node, true AS forward_close, true AS backward_close FROM (SELECT repo_id, source AS node FROM links UNION SELECT repo_id, target FROM links)""")
def reach_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketched counts lie within five standard errors of the exact ones."""
    links = written(knowledge.dependency_edges(_files(spark, sf_dir), _symbols(spark, sf_dir)))
    guess = knowledge.reach_estimated(links).toDF("repo_id", "node", "f", "b")
    near = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= 1 + 0.08 * F.col(b))
    return knowledge.reach(links).join(guess, ["repo_id", "node"], "left").select("repo_id", "node", near("f", "forward").alias("forward_close"), near("b", "backward").alias("backward_close"))


_FRAMEWORKS = "list_filter([CASE WHEN n % 2 = 0 THEN 'FastAPI' END, CASE WHEN n % 2 = 0 THEN 'Flask' END, CASE WHEN n % 3 = 1 THEN 'Next.js' END, CASE WHEN n % 3 = 1 THEN 'React' END, CASE WHEN n % 7 = 0 THEN 'SQL/database' END], lambda x: x IS NOT NULL)"
_MANAGERS = "list_filter([CASE WHEN n % 3 = 1 THEN 'npm' END, CASE WHEN n % 2 = 0 THEN 'pip/uv' END], lambda x: x IS NOT NULL)"
_STACK = f"stack AS (SELECT repo_id, n, list_sort({_FRAMEWORKS}) AS frameworks, list_sort({_MANAGERS}) AS package_managers, CASE WHEN n % 3 = 0 THEN ['Docker'] ELSE [] END AS build_tools, n % 5 <> 0 AS has_ci, n % 3 = 0 AS docker FROM brands)"


@query(f"{_WITH}, {_STACK} SELECT repo_id, array_to_string(frameworks, ',') AS frameworks, array_to_string(package_managers, ',') AS package_managers, array_to_string(build_tools, ',') AS build_tools, CASE WHEN has_ci THEN 'GitHub Actions' ELSE '' END AS ci_cd, docker FROM stack")
def stack_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.stack(_files(spark, sf_dir)).select("repo_id", *(F.array_join(c, ",").alias(c) for c in ("frameworks", "package_managers", "build_tools", "ci_cd")), "docker")


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.stack(_files(spark, sf_dir)).select("repo_id", F.explode(F.concat("frameworks", "package_managers")).alias("dependency"))


_DEPTH = f"len({_SPLIT}) - 1"
_OWNER = exprs.case_contains_sql("repo_id || '/' || name", rules.OWNERS, "Core Engineering")
_TEST = "(starts_with(lower(path), 'tests/') OR contains(lower(path), '/tests/') OR regexp_matches(lower(path), '([.]test[.]tsx?|[.]spec[.]tsx?|_test[.]py)$') OR contains(string_split(lower(path), '/')[-1], 'test_'))"
_DEPLOY = "(string_split(lower(path), '/')[-1] IN ('dockerfile', 'docker-compose.yml', 'docker-compose.yaml', 'fly.toml') OR starts_with(lower(path), '.github/workflows/') OR starts_with(lower(path), 'deploy/') OR regexp_matches(lower(path), '([.]tf|[.]tfvars|render[.]yaml|railway[.]toml)$'))"
_PROJECTED = f"""{_LINKS}, {_BAD}, {_SPACES}, {_STACK}, deps AS (SELECT repo_id, unnest(list_concat(frameworks, package_managers)) AS dependency FROM stack),
ends AS (SELECT l.* FROM links l SEMI JOIN src a ON a.repo_id = l.repo_id AND a.path = l.source SEMI JOIN src b ON b.repo_id = l.repo_id AND b.path = l.target)"""


@query(f"""{_WITH}, {_PROJECTED}, e AS (
SELECT repo_id, 'CONTAINS' AS relation, sum({_DEPTH}) + count(*) AS n FROM src GROUP BY repo_id UNION ALL SELECT repo_id, 'CONTAINS', count(*) FROM sym WHERE kind IN ('class', 'function') GROUP BY repo_id
UNION ALL SELECT repo_id, 'CONTAINS', count(*) + sum(len(sample_files)) FROM spaces GROUP BY repo_id UNION ALL SELECT repo_id, 'AFFECTS', count(*) FILTER ({_TEST}) + count(*) FILTER ({_DEPLOY}) FROM src GROUP BY repo_id
UNION ALL SELECT repo_id, 'EXPOSES', count(*) FROM sym WHERE kind = 'route' GROUP BY repo_id UNION ALL SELECT repo_id, 'LINKED_TO', count(*) FROM spaces GROUP BY repo_id UNION ALL SELECT repo_id, 'OWNS', count(*) FROM spaces GROUP BY repo_id
UNION ALL SELECT repo_id, CASE relation WHEN 'imports' THEN 'IMPORTS' ELSE 'CALLS' END, count(*) FROM ends GROUP BY ALL UNION ALL SELECT repo_id, 'AFFECTS', count(*) FROM found GROUP BY repo_id
UNION ALL SELECT repo_id, 'DEPENDS_ON', count(*) FROM deps GROUP BY repo_id UNION ALL SELECT repo_id, 'USES', count(*) FROM deps GROUP BY repo_id)
SELECT repo_id, relation, sum(n)::BIGINT AS edges FROM e GROUP BY ALL HAVING sum(n) > 0""")
def projection_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = knowledge.projection(*_given(spark, sf_dir), _deps(spark, sf_dir))
    return edges.groupBy("repo_id", knowledge.relation_type(F.col("relation")).alias("relation")).agg(F.count(F.lit(1)).alias("edges"))


@query(f"""{_WITH}, {_PROJECTED}, n AS (
SELECT repo_id, 'repository' AS kind, 'r' AS id FROM brands UNION ALL SELECT repo_id, 'directory', array_to_string({_SPLIT}[1:i], '/') FROM (SELECT repo_id, path, unnest(range(1, len({_SPLIT}))) AS i FROM src) UNION ALL SELECT repo_id, 'file', path FROM src
UNION ALL SELECT repo_id, 'test', path FROM src WHERE {_TEST} UNION ALL SELECT repo_id, 'deployment', path FROM src WHERE {_DEPLOY} UNION ALL SELECT repo_id, kind, path || ':' || name FROM sym WHERE kind IN ('class', 'function')
UNION ALL SELECT repo_id, 'api', path || ':' || method || ' ' || name FROM sym WHERE kind = 'route' UNION ALL SELECT repo_id, unnest(['domain', 'service']), name FROM spaces UNION ALL SELECT repo_id, 'owner', {_OWNER} FROM spaces
UNION ALL SELECT repo_id, 'security_finding', rule_id || ':' || path || ':' || line FROM found UNION ALL SELECT repo_id, 'dependency', dependency FROM deps)
SELECT repo_id, kind, count(DISTINCT id) AS nodes FROM n GROUP BY ALL""")
def projection_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = knowledge.projection(*_given(spark, sf_dir), _deps(spark, sf_dir))
    return nodes.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("nodes"))


@query()
def projection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density and health of the projections; tests hold them against plain Python."""
    nodes, edges = knowledge.projection(*_given(spark, sf_dir), _deps(spark, sf_dir))
    return knowledge.graph_metrics(nodes, edges)


#: Maintainability of the Python texts by path: no operators in the first two, one call in the third.
_DEBT = """debt AS (SELECT repo_id, files, debt_items, todos, large_files, mi AS mean_maintainability, least(100.0, greatest(0.0, round((mi - todos / files * 45 - large_files / files * 35)::DECIMAL(38,10), 1)::DOUBLE)) AS debt_score
FROM (SELECT repo_id, count(*) AS files, 0::BIGINT AS debt_items, count(*) FILTER (path LIKE 'src/api/%') AS todos, count(*) FILTER (size > 150000) AS large_files, 100.0::DOUBLE AS mi FROM src GROUP BY repo_id))"""


def _debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return repository.debt(files, code.notes(files), _metrics(spark, sf_dir))


@query(f"{_WITH}, {_DEBT} SELECT * FROM debt")
def debt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _debt(spark, sf_dir)


_SEVERITY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in rules.RANK)
_SECURE = f"""sv AS (SELECT repo_id, {_SEVERITY} FROM found GROUP BY repo_id), fc AS (SELECT repo_id, count(*) AS files FROM src GROUP BY repo_id),
sec AS (SELECT repo_id, files, {", ".join(f"coalesce({s}, 0) AS {s}" for s in rules.RANK)}, round((100 - least(80.0, 20 * coalesce(critical, 0) + 6 * coalesce(high, 0) + least(35.0, coalesce(medium, 0)::DOUBLE / files * 220) + least(10.0, coalesce(low, 0)::DOUBLE / files * 5)))::DECIMAL(38,10), 1)::DOUBLE AS security_score FROM fc LEFT JOIN sv USING (repo_id))"""


@query(f"{_WITH}, {_SECURE} SELECT * FROM sec")
def repository_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.security(_files(spark, sf_dir), sources.findings(spark, sf_dir))


_weighted = lambda weights: exprs.dec_round_sql(" + ".join(f"{c} * {w}::DOUBLE" for c, w in weights.items()), 1)
_SCORES = f"""{_SECURE}, {_DEBT}, {_STACK}, mk AS (SELECT repo_id, bool_or(contains(lower(path), 'test') OR contains(lower(path), 'spec')) AS tested, bool_or(lower({_SPLIT}[-1]) = 'readme.md') AS documented FROM src GROUP BY repo_id),
ct AS (SELECT repo_id, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind IN ('function', 'class')) AS symbols FROM sym GROUP BY repo_id),
b0 AS (SELECT repo_id, sec.files, routes, symbols, security_score AS security, debt_score AS debt, CASE WHEN tested THEN 100 ELSE 35 END AS tests, CASE WHEN has_ci THEN 100 ELSE 35 END AS ci, CASE WHEN docker THEN 100 ELSE 45 END AS container, CASE WHEN len(package_managers) > 0 THEN 90 ELSE 50 END AS dependency,
  CASE WHEN documented THEN 100 ELSE 45 END AS docs, least(100.0, 45 + routes * 8 + symbols * 1.5)::DOUBLE AS code, least(95, 30 + least(sec.files, 40) + 15 + CASE WHEN len(package_managers) > 0 THEN 10 ELSE 0 END)::BIGINT AS confidence FROM sec JOIN debt USING (repo_id) JOIN stack USING (repo_id) JOIN mk USING (repo_id) JOIN ct USING (repo_id)),
b1 AS (SELECT *, {_weighted(rules.PRODUCTION_WEIGHTS)} AS production, {_weighted(repo_rules.RECRUITER_WEIGHTS)} AS recruiter FROM b0), b2 AS (SELECT *, {_weighted(rules.CTO_WEIGHTS)} AS cto FROM b1), scores AS (SELECT *, {exprs.dec_round_sql("100 - cto", 1)} AS risk FROM b2)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = _given(spark, sf_dir)
    return repository.scores(files, symbols, findings, repository.stack(files), _debt(spark, sf_dir))


@query(f"{_WITH}, {_SCORES} SELECT * FROM scores")
def score_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(f"{_WITH}, {_SCORES} SELECT repo_id, security, production, cto, confidence FROM scores")
def score_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("repo_id", "security", "production", "cto", "confidence")


@query(f"""{_WITH}, {_SCORES}, g AS (SELECT repo_id, unnest([('production', 'tests', tests < 100), ('production', 'ci', ci < 100), ('production', 'container', container < 100), ('production', 'docs', docs < 100), ('recruiter', 'docs', docs < 100), ('recruiter', 'tests', tests < 100),
('recruiter', 'debt', debt < 80), ('cto', 'security', security < 85), ('cto', 'debt', debt < 80), ('cto', 'ci', ci < 100)]) AS x FROM scores) SELECT repo_id, x[1] AS score, x[2] AS gap FROM g WHERE x[3]""")
def score_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.score_gaps(_scores(spark, sf_dir))


_TOP = f"CASE WHEN contains(path, '/') THEN {_SPLIT}[1] ELSE regexp_replace(path, '^(.+)[.][^.]*$', '\\1') END"
_PARTS = f"""pt AS (SELECT repo_id, {_TOP} AS name, count(*) AS file_count, list(path ORDER BY path) AS paths FROM src GROUP BY ALL),
parts AS (SELECT repo_id, name, file_count, {exprs.case_contains_sql("name || ' ' || array_to_string(paths[1:20], ' ')", repo_rules.COMPONENT_ROLES, "Application code")} AS role FROM pt QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_count DESC, name) <= 14)"""


@query(f"{_WITH}, {_PARTS} SELECT * FROM parts")
def architecture_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.components(_files(spark, sf_dir))


@query(f"""{_WITH}, {_STACK}, t AS (SELECT repo_id, bool_or(starts_with(path, 'frontend/')) AS front, bool_or(starts_with(path, 'backend/')) AS back, count(DISTINCT CASE WHEN contains(path, '/') THEN {_SPLIT}[1] END) AS top_folders FROM src GROUP BY repo_id)
SELECT repo_id, CASE WHEN list_contains(frameworks, 'Next.js') THEN 'Frontend web application' WHEN list_contains(frameworks, 'FastAPI') THEN 'API service' WHEN front AND back THEN 'Full-stack application' WHEN top_folders > 5 THEN 'Multi-component repository' ELSE 'General software repository' END AS style, top_folders
FROM t JOIN stack USING (repo_id)""")
def architecture_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return repository.style(files, repository.stack(files))


_PLAIN = f"NOT (len(list_intersect(string_split(lower(path), '/'), [{', '.join(map(exprs.quoted, rules.LOW_VALUE_PARTS))}])) > 0 OR regexp_matches(lower(path), '^(docs_src/|tests/|test/|scripts/|[.]github/)'))"
_MARKED = f"""mq AS (SELECT repo_id, path, bool_or(kind = 'route') AS r, bool_or(kind = 'model') AS m FROM sym GROUP BY ALL),
marked AS (SELECT * FROM (SELECT s.repo_id, s.path, coalesce(r, false) OR ({_PLAIN.replace("path", "s.path")} AND {exprs.any_contains_sql("lower(s.path)", repo_rules.ROUTE_FILES)}) AS routed, coalesce(m, false) OR ({_PLAIN.replace("path", "s.path")} AND {exprs.any_contains_sql("lower(s.path)", repo_rules.DATA_FILES)}) AS stored
  FROM src s LEFT JOIN mq ON mq.repo_id = s.repo_id AND mq.path = s.path) WHERE routed OR stored)"""


@query(f"{_WITH}, {_MARKED} SELECT * FROM marked")
def architecture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.special_files(_files(spark, sf_dir), _symbols(spark, sf_dir)).select("repo_id", "path", "routed", "stored")


@query(f"""{_WITH}, a AS (SELECT repo_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM src GROUP BY repo_id)
SELECT a.*, {", ".join(f"(SELECT count(*) FROM sym WHERE sym.repo_id = a.repo_id AND kind = '{k}') AS {n}" for n, k in (("functions", "function"), ("methods", "method"), ("classes", "class"), ("routes", "route"), ("models", "model")))} FROM a""")
def repository_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.statistics(_files(spark, sf_dir), _symbols(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, symbols, findings = _given(spark, sf_dir)
    found_stack = repository.stack(files)
    found = repository.scores(files, symbols, findings, found_stack, _debt(spark, sf_dir))
    links = written(knowledge.relations(files, symbols))
    hot = knowledge.hotspots(files, links, findings)
    flows = knowledge.dependency_flows(written(knowledge.dependency_edges(files, symbols)))
    about = repository.facts(files, found, found_stack, hot, knowledge.domains(files, symbols, findings), repository.components(files), flows, repository.special_files(files, symbols))
    return written(about), findings


#: Each start's longest flow has two nodes here, or three through the shared file.
_ABOUT = f"""{_SCORES}, {_HOT}, {_SPACES}, {_PARTS}, {_MARKED}, nm AS (SELECT repo_id, count(*) FILTER (contains(lower(path), 'test') OR contains(lower(path), 'spec')) AS test_files, bool_or(contains(lower(path), 'docs/')) AS has_docs, bool_or(starts_with(lower(path), '.github/')) AS has_ci_files FROM src GROUP BY repo_id),
sp AS (SELECT repo_id, count(*) AS hotspots, max(connectivity) AS most_connected FROM hot GROUP BY repo_id), ns AS (SELECT repo_id, count(*) AS domains, max(file_count) AS largest, count(*) FILTER (role = 'API boundary') AS api_domains FROM spaces GROUP BY repo_id),
cp AS (SELECT repo_id, count(*) AS components FROM parts GROUP BY repo_id), st AS (SELECT repo_id, count(*) FILTER (stored) AS stored_files FROM marked GROUP BY repo_id),
lf AS (SELECT repo_id, max(CASE WHEN relation = 'imports' AND target = 'shared/base.py' THEN 3 ELSE 2 END) AS longest_flow FROM links WHERE source IN (SELECT source FROM (SELECT repo_id AS r, source, count(*) AS n FROM links GROUP BY repo_id, source QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, source) <= 16) WHERE r = links.repo_id) GROUP BY repo_id),
about AS (SELECT scores.*, docker, has_ci, test_files, has_docs, has_ci_files, coalesce(hotspots, 0) AS hotspots, coalesce(most_connected, 0) AS most_connected, domains, largest, api_domains, components, coalesce(stored_files, 0) AS stored_files, longest_flow
  FROM scores JOIN stack USING (repo_id) JOIN nm USING (repo_id) LEFT JOIN sp USING (repo_id) JOIN ns USING (repo_id) JOIN cp USING (repo_id) LEFT JOIN st USING (repo_id) JOIN lf USING (repo_id))"""
_r1 = lambda x: exprs.dec_round_sql(x, 1)


@query(f"""{_WITH}, {_ABOUT}, q AS (SELECT *, least(100.0, greatest(0.0, 45 + docker::INT * 12 + has_ci::INT * 10 + least(14.0, components * 1.5) + (routes > 0)::INT * 10 - least(18.0, hotspots * 1.2)))::DOUBLE AS scalability, {_r1("least(95.0, greatest(20.0, 100 - largest::DOUBLE / files * 120))")} AS bus_factor,
least(95.0, 35 + test_files::DOUBLE / files * 220)::DOUBLE AS test_confidence, (35 + has_ci::INT * 35 + docker::INT * 15)::DOUBLE AS ci_cd_maturity, (45 + (docs = 100)::INT * 35 + has_docs::INT * 15)::DOUBLE AS documentation FROM about),
z AS (SELECT *, (production + ci_cd_maturity + documentation + scalability) / 4 AS operational, (cto * 0.24::DOUBLE + security * 0.22::DOUBLE + production * 0.2::DOUBLE + debt * 0.18::DOUBLE + test_confidence * 0.08::DOUBLE + documentation * 0.08::DOUBLE) / 1.0::DOUBLE AS ready FROM q)
SELECT repo_id, {", ".join(f"{_r1(c)} AS {c}" for c in ("scalability", "bus_factor", "test_confidence", "ci_cd_maturity", "documentation", "operational"))}, {_r1("ready")} AS readiness,
CASE WHEN repo_id IN (SELECT repo_id FROM found WHERE severity = 'critical') THEN 'High Risk Candidate' WHEN ready >= 78 THEN 'Strong Acquisition Candidate' WHEN ready >= 62 THEN 'Moderate Risk Candidate' ELSE 'High Risk Candidate' END AS verdict FROM z""")
def acquisition_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    about, findings = _facts(spark, sf_dir)
    return repository.acquisition(about, findings.filter("severity = 'critical'"))


@query(f"""{_WITH}, {_ABOUT}, f8 AS (SELECT repo_id, count(*) AS f, count(*) FILTER (severity = 'critical') AS critical_risks FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path, line, rule_id) <= 8) GROUP BY repo_id),
q AS (SELECT about.*, least(10, coalesce(f, 0) + least(5, hotspots))::BIGINT AS risks, coalesce(critical_risks, 0) AS critical_risks, ((tests < 100)::INT + (NOT has_ci_files)::INT + (docs < 100)::INT + (security < 80)::INT + (stored_files = 0)::INT)::BIGINT AS gaps FROM about LEFT JOIN f8 USING (repo_id))
SELECT repo_id, risks, critical_risks, gaps, CASE WHEN cto >= 80 AND risks <= 2 AND gaps <= 3 THEN 'strong' WHEN cto >= 65 AND risks <= 5 THEN 'moderate' WHEN cto >= 50 THEN 'early' ELSE 'high-risk' END AS investment_readiness,
CASE WHEN security < 55 OR critical_risks > 0 THEN 'do not approve without remediation' WHEN gaps > 5 THEN 'approve only with enterprise hardening plan' WHEN cto >= 75 THEN 'approve technical diligence with monitoring' ELSE 'request remediation plan before approval' END AS recommendation FROM q""")
def due_diligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.diligence(*_facts(spark, sf_dir))


@query(f"""{_WITH}, {_ABOUT}, q AS (SELECT repo_id, {_r1("greatest(0, 100 - longest_flow * 5 - most_connected * 4 - hotspots * 2)")} AS coupling, {_r1("least(100, greatest(0, 45 + docker::INT * 15 + has_ci::INT * 20 + least(15, routes * 3) - least(18, hotspots * 2)))")} AS scalability,
{_r1("least(100, 45 + domains * 5 + api_domains * 8 - api_domains * 3)")} AS boundaries, {_r1("least(100.0, greatest(0.0, 85 - largest::DOUBLE / files * 75 + least(15, domains * 2)))")} AS modularity, {_r1("debt")} AS maintainability FROM about)
SELECT *, {_r1("coupling * 0.25::DOUBLE + scalability * 0.2::DOUBLE + boundaries * 0.2::DOUBLE + modularity * 0.2::DOUBLE + maintainability * 0.15::DOUBLE")} AS review FROM q""")
def architecture_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.architecture_review(_facts(spark, sf_dir)[0])


@query(f"{_WITH} SELECT DISTINCT repo_id, 'PART_' || regexp_extract(path, '[0-9]+') || '_URL' AS name FROM src WHERE language = 'JavaScript'")
def external_integrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return repository.external_integrations(code.env_variables(files), repository.stack(files))


_RISK = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in repo_rules.PATH_RISK.items()) + " ELSE 6 END"


@query(f"""{_WITH}, {_HOT}, a AS (SELECT repo_id, path, sum({_RISK}) AS a FROM found GROUP BY ALL)
SELECT repo_id, path, least(100, coalesce(a, 0) + coalesce(3 * connectivity, 0))::BIGINT AS risk FROM src LEFT JOIN a USING (repo_id, path) LEFT JOIN hot USING (repo_id, path) WHERE coalesce(a, 0) + coalesce(3 * connectivity, 0) > 0""")
def path_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, findings = _given(spark, sf_dir)
    hot = knowledge.hotspots(files, knowledge.relations(files, symbols), findings)
    return repository.path_risk(files, findings, hot, repository.debt_items(_metrics(spark, sf_dir)))
