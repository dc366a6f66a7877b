"""Queries over files, paths, text lines and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import files as files_ops
from stratalith.operators import repository, security
from stratalith.plans.register import query
from stratalith.sources import bind, sources


@query(f"WITH {bind.FILES_SQL} SELECT repo_id, count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT language) AS languages, max(size) AS largest FROM files GROUP BY repo_id")
def files_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.statistics(bind.files(spark, sf_dir))


@query(f"""WITH {bind.PATHS_SQL}, l AS (SELECT repo_id, {exprs.by_value_sql("lower(regexp_extract(path, '([.][^./]+)$', 1))", rules.LANGUAGES, "Text")} AS language FROM paths),
c AS (SELECT repo_id, language, count(*) AS files, language NOT IN ({", ".join(map(exprs.quoted, rules.NON_SOURCE))}) AS is_source FROM l GROUP BY ALL)
SELECT repo_id, language AS primary_language, files AS primary_files, n AS n_languages FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY is_source DESC, files DESC, language) AS r, count(*) OVER (PARTITION BY repo_id) AS n FROM c) WHERE r = 1""")
def language_summary_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.primary_language(bind.paths(spark, sf_dir).withColumn("language", exprs.language(F.col("path"))))


@query(f"WITH {bind.FILES_SQL} SELECT repo_id, path, row_number() OVER (PARTITION BY sha256 ORDER BY path) > 1 AS duplicate FROM files")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.with_duplicates(bind.files(spark, sf_dir).drop("text")).select("repo_id", "path", "duplicate")


_DOMAIN = "CASE WHEN len(string_split(path, '/')) > 2 AND string_split(path, '/')[1] IN ('src', 'app', 'backend', 'frontend') THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"


@query(f"""WITH {bind.PATHS_SQL} SELECT path, {_DOMAIN} AS domain, {exprs.case_contains_sql("path", rules.KNOWLEDGE_LAYERS, "application")} AS knowledge_layer,
{exprs.case_contains_sql("path", rules.EVOLUTION_LAYERS, "application")} AS evolution_layer, {exprs.case_contains_sql("path", rules.REVIEW_LAYERS, "application")} AS review_layer,
{exprs.case_contains_sql("path", rules.EXPLORER_LAYERS, "Application")} AS explorer_layer, {exprs.case_contains_sql("path", rules.OWNERS, "Core Engineering")} AS owner,
{exprs.case_contains_sql("path", rules.SERVICE_TEXTS, "Behaviour of the application")} AS service FROM paths""")
def path_domain_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.classified(bind.paths(spark, sf_dir)).select("path", "domain", "knowledge_layer", "evolution_layer", "review_layer", "explorer_layer", "owner", "service")


@query(f"""WITH {bind.PATHS_SQL}, p AS (SELECT repo_id, string_split(path, '/') AS s FROM paths), a AS (SELECT repo_id, array_to_string(s[1:i], '/') AS folder, i AS depth FROM (SELECT repo_id, s, unnest(range(1, len(s))) AS i FROM p))
SELECT repo_id, folder, depth, count(*) AS files FROM a GROUP BY ALL""")
def ancestor_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.folders(bind.paths(spark, sf_dir))


_LOW = (
    f"len(list_intersect(string_split(lower(path), '/'), [{', '.join(map(exprs.quoted, rules.LOW_VALUE_PARTS))}])) > 0 OR regexp_matches(lower(path), '^(docs_src/|tests/|test/|scripts/|[.]github/)') OR regexp_matches(lower(path), '[.](md|rst|txt|yml|yaml)$')"
)


@query(f"WITH {bind.PATHS_SQL}, f AS (SELECT repo_id, path, {_LOW} AS low FROM paths) SELECT repo_id, path, low FROM (SELECT *, bool_or(NOT low) OVER (PARTITION BY repo_id) AS any_good FROM f) WHERE NOT low OR NOT any_good")
def low_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.production_first(bind.paths(spark, sf_dir).select("repo_id", "path", exprs.low_value(F.col("path")).alias("low")))


@query(f"WITH {bind.PATHS_SQL} SELECT repo_id, count(*) AS files, sum((len(list_intersect(string_split(path, '/'), [{', '.join(map(exprs.quoted, rules.IGNORED_PARTS))}])) > 0 OR regexp_matches(path, '[.](min|bundle)[.]js$') OR regexp_matches(lower(path), '[.]({'|'.join(rules.IGNORED_SUFFIXES)})$'))::INT)::BIGINT AS ignored FROM paths GROUP BY repo_id")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.paths(spark, sf_dir).groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum(exprs.ignored(F.col("path")).cast("long")).alias("ignored"))


_EXAMPLE = "regexp_matches(lower(path), '^(docs|examples|tests|test)/|/docs/|/examples/')"
_LINES = "lines AS (SELECT repo_id, path, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS content FROM files)"
_RULES = "rules(rule_id, pattern, message) AS (VALUES " + ", ".join(f"({exprs.quoted(a)}, {exprs.quoted(b)}, {exprs.quoted(c)})" for a, b, c in rules.LINE_RULES) + ")"


@query(f"WITH {bind.FILES_SQL}, {_LINES}, {_RULES} SELECT repo_id, path, line, rule_id, CASE WHEN {_EXAMPLE} THEN 'low' WHEN rule_id = 'hardcoded-secret' THEN 'high' ELSE 'medium' END AS severity FROM lines, rules WHERE regexp_matches(content, pattern)")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.line_findings(bind.files(spark, sf_dir)).select("repo_id", "path", "line", "rule_id", "severity")


_ENTROPY = "-list_sum(list_transform(list_distinct(string_split(tok, '')), lambda c: ((length(tok) - length(replace(tok, c, ''))) / length(tok)) * log2((length(tok) - length(replace(tok, c, ''))) / length(tok))))"


@query(f"""WITH {bind.FILES_SQL}, {_LINES}, t AS (SELECT repo_id, path, line, unnest(regexp_extract_all(content, {exprs.quoted(rules.ENTROPY_TOKEN)}, 1)) AS tok, generate_subscripts(regexp_extract_all(content, {exprs.quoted(rules.ENTROPY_TOKEN)}, 1), 1) AS k FROM lines),
h AS (SELECT *, {exprs.dec_round_sql(_ENTROPY, 4)} AS h FROM t) SELECT repo_id, path, line, 'high-entropy-secret' AS rule_id, CASE WHEN {_EXAMPLE} THEN 'low' ELSE 'high' END AS severity, first(h ORDER BY k) AS entropy FROM h WHERE h >= 3.5 GROUP BY ALL""")
def entropy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.entropy_findings(bind.files(spark, sf_dir), least=3.5)


def _taxonomy_sql(i: int) -> str:
    low = "lower(rule_id)"
    whens = " ".join(f"WHEN {exprs.any_contains_sql(low, t)} THEN {exprs.quoted(v[i])}" for t, v in rules.TAXONOMY)
    starts = " ".join(f"WHEN starts_with({low}, '{p}') THEN {exprs.quoted(v[i])}" for p, v in rules.TAXONOMY_PREFIXES)
    return f"CASE {whens} {starts} ELSE {exprs.quoted(rules.TAXONOMY_ELSE[i])} END"


_SCANNER = "CASE " + " ".join(f"WHEN starts_with(lower(rule_id), '{p}') THEN '{n}'" for p, n in rules.SCANNERS) + " WHEN contains(lower(rule_id), 'secret') THEN 'secret-detection' ELSE 'custom-rules' END"


@query(f"""WITH {bind.FINDINGS_SQL} SELECT finding_id, rule_id, severity, {_taxonomy_sql(0)} AS owasp, {_taxonomy_sql(1)} AS cwe, {_taxonomy_sql(2)}::DOUBLE AS cvss, {_SCANNER} AS scanner,
CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN {exprs.any_contains_sql("lower(rule_id)", rules.EXPLOITABLE)} THEN 'medium' ELSE 'low' END AS exploitability,
{exprs.case_contains_sql("rule_id", rules.REMEDIATIONS, rules.REMEDIATION_ELSE)} AS remediation,
{exprs.case_contains_sql("rule_id", rules.IMPACTS, "=upper(severity[1]) || severity[2:] || ' finding: an engineer should look at it before a release.'")} AS impact FROM findings""")
def finding_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.enriched(bind.findings(spark, sf_dir)).select("finding_id", "rule_id", "severity", "owasp", "cwe", "cvss", "scanner", "exploitability", "remediation", "impact")


@query(f"""WITH {bind.FINDINGS_SQL}, d(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low')), r AS (SELECT DISTINCT repo_id FROM findings)
SELECT r.repo_id, d.severity, count(f.finding_id) AS findings FROM r CROSS JOIN d LEFT JOIN findings f ON f.repo_id = r.repo_id AND f.severity = d.severity GROUP BY ALL""")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.histogram(bind.findings(spark, sf_dir))


@query(f"""WITH {bind.FINDINGS_SQL}, c AS (SELECT repo_id, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS med, count(*) FILTER (severity = 'low') AS low FROM findings GROUP BY repo_id)
SELECT repo_id, {exprs.dec_round_sql("100 - least(80.0::DOUBLE, 20 * crit + 6 * high + least(35.0::DOUBLE, med / 40 * 220) + least(10.0::DOUBLE, low / 40 * 5))", 1)} AS security_score FROM c""")
def security_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository has the forty modules that findings lie in, whether they have one or not."""
    found = bind.findings(spark, sf_dir)
    files = found.select("repo_id").distinct().select("repo_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("mod"), i.cast("string"), F.lit(".py")))).alias("path"))
    return repository.security(files, found).select("repo_id", "security_score")


@query(f"WITH {bind.FINDINGS_SQL} SELECT repo_id, count(*) AS findings, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END)::BIGINT AS weighted, count(DISTINCT rule_id) AS rules FROM findings GROUP BY repo_id")
def posture_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.posture(bind.findings(spark, sf_dir))


@query(rf"""WITH {bind.FILES_SQL}, a AS (SELECT path, text, regexp_replace(text, {exprs.quoted(rules.REDACT_ASSIGNMENT)}, '\1\2\3[REDACTED]\4', 'g') AS t FROM files), b AS (SELECT path, text, regexp_replace(t, {exprs.quoted(rules.REDACT_BEARER)}, '\1 [REDACTED]', 'g') AS t FROM a),
s AS (SELECT path, text, t, list_filter(regexp_extract_all(t, {exprs.quoted(rules.REDACT_LONG)}), lambda tok: {_ENTROPY} >= 4.0) AS hot FROM b)
SELECT path, sha256(list_reduce([t] || hot, lambda x, y: replace(x, y, '[REDACTED]'))) AS redacted_sha256, t <> text OR len(hot) > 0 AS sensitive FROM s""")
def redaction_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = bind.files(spark, sf_dir).select("path", "text", exprs.redact(F.col("text")).alias("t"))
    return redacted.select("path", F.sha2("t", 256).alias("redacted_sha256"), (F.col("t") != F.col("text")).alias("sensitive"))


@query(f"WITH {sources.FILES_SQL} SELECT repo_id, path, 6 AS line, 'TODO' AS tag FROM src WHERE path LIKE 'src/api/%'")
def todo_like_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.tagged_lines(sources.files(spark, sf_dir)).select("repo_id", "path", "line", "tag")


_ROLE = exprs.case_contains_sql("name || ' ' || array_to_string(sample[1:20], ' ')", rules.DOMAIN_ROLES, "Product capability")


@query(f"""WITH {bind.PATHS_SQL}, d AS (SELECT repo_id, {_DOMAIN} AS name, path, size FROM paths), g AS (SELECT repo_id, name, count(*) AS file_count, sum(size)::BIGINT AS bytes, list(path ORDER BY path) AS sample FROM d GROUP BY ALL)
SELECT repo_id, name, file_count, bytes, {_ROLE} AS role, array_to_string(sample[1:8], ';') AS sample_files FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_count DESC, name) AS r FROM g) WHERE r <= 24""")
def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.domains(bind.paths(spark, sf_dir)).withColumn("sample_files", F.array_join("sample_files", ";"))
