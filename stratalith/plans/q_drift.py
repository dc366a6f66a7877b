"""Queries of drift between two states of the bound source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import code, drift, repository
from stratalith.plans import q_code
from stratalith.plans.register import query
from stratalith.sources import sources
from stratalith.sources.shared import written

#: The side that a file is on: by the number in its path; files without one are on both.
_SIDES = ("p % 10 < 8", "p % 10 >= 1")


def _side(df: DataFrame, which: int) -> DataFrame:
    return df.withColumn("p", F.coalesce(F.regexp_extract("path", "[0-9]+", 0).try_cast("int"), F.lit(5))).filter(_SIDES[which]).drop("p")


def _sides(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(facts, findings, scores) before and after."""
    out = []
    for which in (0, 1):
        files, symbols, findings = (_side(df, which) for df in q_code._given(spark, sf_dir))
        made = written(drift.facts(files, symbols, findings, code.env_variables(files), repository.stack(files)))
        scores = repository.security(files, findings).select("repo_id", F.lit("security").alias("name"), F.col("security_score").alias("value"))
        out.append((made, findings, scores))
    return out


def _facts_sql(which: int) -> str:
    """CTEs src, sym, found, then fact(repo_id, kind, key, payload), and score, weight, size of one side, named by the side."""
    on = _SIDES[which].replace("p %", "coalesce(try_cast(regexp_extract(path, '[0-9]+') AS INT), 5) %")
    owner = exprs.case_contains_sql("name", rules.OWNERS, "Core Engineering")
    env = "SELECT DISTINCT repo_id, 'PART_' || regexp_extract(path, '[0-9]+') || '_URL' AS name FROM src WHERE language = 'JavaScript'"
    severity = " + ".join(f"{w} * count(*) FILTER (severity = '{k}')" for k, w in rules.POSTURE_WEIGHT.items())
    return f"""(WITH src AS (SELECT * FROM src0 WHERE {on}), sym AS (SELECT * FROM sym0 WHERE {on}), found AS (SELECT * FROM found0 WHERE {on}), {q_code._HOT}, {q_code._SPACES}, {q_code._MARKED}, {q_code._SECURE}, {q_code._STACK},
deps AS (SELECT repo_id, unnest(list_concat(frameworks, package_managers)) AS name FROM stack UNION SELECT repo_id, lower(string_split(path, '/')[-1]) FROM src WHERE regexp_matches(lower(path), '(requirements[.]txt|package[.]json)$'))
SELECT repo_id, 'domain' AS kind, name AS key, role || '|' || file_count || '|' || routes || '|' || data_models AS payload, 0.0::DOUBLE AS v FROM spaces UNION ALL SELECT repo_id, 'owner', name, {owner}, 0 FROM spaces UNION ALL SELECT repo_id, 'dependency', name, NULL, 0 FROM deps
UNION ALL SELECT repo_id, 'integration', name, NULL, 0 FROM ({env}) UNION ALL SELECT DISTINCT repo_id, 'api', method || ' ' || name || ' ' || path, NULL, 0 FROM sym WHERE kind = 'route' UNION ALL SELECT repo_id, 'route file', path, NULL, 0 FROM marked WHERE routed
UNION ALL SELECT repo_id, 'model file', path, NULL, 0 FROM marked WHERE stored UNION ALL SELECT repo_id, 'hotspot', path, NULL, 0 FROM hot UNION ALL SELECT DISTINCT repo_id, 'finding', path || ':' || rule_id, NULL, 0 FROM found
UNION ALL SELECT repo_id, '*score', 'security', NULL, security_score FROM sec UNION ALL SELECT repo_id, '*weight', '', NULL, {severity} FROM found GROUP BY repo_id)"""


_BOTH = f"WITH {sources.ALL_SQL.replace('src AS (', 'src0 AS (', 1).replace('sym AS (', 'sym0 AS (', 1).replace('found AS (', 'found0 AS (', 1)}, fa AS {_facts_sql(0)}, fb AS {_facts_sql(1)}"
_CHANGES = """chg AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.payload AS was, b.payload AS now
FROM (SELECT * FROM fa WHERE kind NOT LIKE '*%') a FULL JOIN (SELECT * FROM fb WHERE kind NOT LIKE '*%') b ON a.repo_id = b.repo_id AND a.kind = b.kind AND a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.payload IS DISTINCT FROM b.payload)"""
_N = lambda kind, change: f"count(*) FILTER (kind = '{kind}' AND change = '{change}')"


@query(f"{_BOTH}, {_CHANGES} SELECT * FROM chg")
def drift_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, _, _), (b, _, _) = _sides(spark, sf_dir)
    return drift.changes(a, b)


@query(f"""{_BOTH}, {_CHANGES}, c AS (SELECT repo_id, {_N("domain", "added")} AS domains_added, {_N("domain", "removed")} AS domains_removed, {_N("domain", "changed")} AS domains_changed, {_N("dependency", "added")} AS dependencies_added, {_N("dependency", "removed")} AS dependencies_removed,
{_N("integration", "added")} AS integrations_added, {_N("api", "added")} AS api_added, {_N("api", "removed")} AS api_removed, count(*) FILTER (kind = 'owner' AND change = 'added' AND now = 'Core Engineering') AS orphaned_added FROM chg GROUP BY repo_id),
z AS (SELECT repo_id, sum(CASE WHEN kind = 'route file' THEN s ELSE 0 END) AS rd, sum(CASE WHEN kind = 'model file' THEN s ELSE 0 END) AS md, sum(CASE WHEN kind = '*weight' THEN v * s ELSE 0 END) AS wd, sum(CASE WHEN kind = '*score' THEN v * s ELSE 0 END) AS sd FROM (SELECT *, -1 AS s FROM fa UNION ALL SELECT *, 1 FROM fb) GROUP BY repo_id),
q AS (SELECT c.*, abs(rd)::BIGINT AS route_delta, abs(md)::BIGINT AS model_delta, greatest(0, wd)::BIGINT AS severity_delta, (sd <= -10)::BIGINT AS score_drops FROM c JOIN z USING (repo_id)),
w AS (SELECT *, least(100, {" + ".join(f"{k} * {v}" for k, v in rules.DRIFT_WEIGHTS.items())})::BIGINT AS drift_score FROM q) SELECT *, {exprs.level_sql("drift_score", rules.DRIFT_LEVELS, "stable")} AS drift_level FROM w""")
def drift_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, fa, sa), (b, fb, sb) = _sides(spark, sf_dir)
    return drift.drift(drift.changes(a, b), a, b, (fa, fb), (sa, sb))


@query(f"{_BOTH}, {_CHANGES} SELECT repo_id, kind || ':' || key AS node, kind, change FROM chg QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY kind, change, node) <= 80")
def drift_visual_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, _, _), (b, _, _) = _sides(spark, sf_dir)
    return drift.visual_diff(drift.changes(a, b))
