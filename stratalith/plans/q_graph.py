"""Queries over dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import graph
from stratalith.plans.register import query
from stratalith.sources import bind

_DEGREE = "g AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node)"


@query(f"WITH {bind.DEPENDENCIES_SQL}, e AS (SELECT * FROM dependencies), {_DEGREE} SELECT node, degree FROM g")
def multigraph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(bind.dependencies(spark, sf_dir))


@query(f"""WITH {bind.DEPENDENCIES_SQL}, e AS (SELECT DISTINCT source, target FROM dependencies), {_DEGREE}
SELECT node, degree, {exprs.dec_round_sql("degree / ((SELECT count(*) FROM g) - 1)", 6)} AS centrality FROM g ORDER BY degree DESC, node LIMIT 10""")
def dep_degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.centrality(bind.dependencies(spark, sf_dir))


def _sensitive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") > 25).alias("sensitive"))


@query(f"""WITH {bind.DEPENDENCIES_SQL}, e AS (SELECT * FROM dependencies), {_DEGREE}, t AS (SELECT * FROM g ORDER BY degree DESC, node LIMIT 200)
SELECT node AS path, degree AS connectivity, degree + CASE WHEN p_size > 25 THEN 8 ELSE 0 END AS risk_score FROM t JOIN part ON node = 'p' || p_partkey ORDER BY risk_score DESC, path LIMIT 20""")
def hotspots_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hotspots(bind.dependencies(spark, sf_dir), _sensitive_parts(spark, sf_dir), first=200)


@query(f"""WITH {bind.DEPENDENCIES_SQL}, n AS (SELECT count(*) AS nodes, count(*) FILTER (p_size > 25) AS risky FROM part), e AS (SELECT count(*) AS edges FROM (SELECT DISTINCT source, target FROM dependencies)),
c AS (SELECT count(DISTINCT x) AS connected FROM (SELECT source AS x FROM dependencies UNION ALL SELECT target FROM dependencies))
SELECT nodes, edges, {exprs.dec_round_sql("edges / (nodes * (nodes - 1))", 5)} AS density, {exprs.dec_round_sql("least(100, greatest(0, 100 - (1 - connected / nodes) * 45 - risky / nodes * 35))", 0)}::BIGINT AS health FROM n, e, c""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _sensitive_parts(spark, sf_dir).select(F.col("path").alias("id"), F.col("sensitive").alias("risky"))
    return graph.metrics(nodes, bind.dependencies(spark, sf_dir))


@query(f"""WITH {bind.HIERARCHY_SQL}, near AS (SELECT 'n3' AS node UNION SELECT target FROM hierarchy WHERE source = 'n3' UNION SELECT source FROM hierarchy WHERE target = 'n3')
SELECT source, target, relation FROM hierarchy WHERE source IN (SELECT node FROM near) OR target IN (SELECT node FROM near)""")
def blast_radius_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radius(bind.hierarchy(spark, sf_dir), spark.createDataFrame([("n3",)], "node string"), 2)


_ALLOWED = ", ".join(map(exprs.quoted, rules.RELATIONS))


@query(f"""WITH RECURSIVE {bind.HIERARCHY_SQL}, k AS (SELECT source, target FROM hierarchy WHERE relation IN ({_ALLOWED})),
w AS (SELECT 'r1' AS node, 0 AS distance UNION ALL SELECT k.target, w.distance + 1 FROM w JOIN k ON k.source = w.node WHERE w.distance < 3) SELECT node, min(distance)::INT AS distance FROM w GROUP BY node""")
def dependency_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_traversal(bind.hierarchy(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), rules.RELATIONS, 3)


@query(f"""WITH RECURSIVE {bind.HIERARCHY_SQL}, b AS (SELECT source AS a, target AS b FROM hierarchy UNION SELECT target, source FROM hierarchy),
w AS (SELECT 'c5' AS node, ['c5'] AS path UNION ALL SELECT b.b, list_append(path, b.b) FROM w JOIN b ON b.a = w.node WHERE len(path) < 8 AND NOT list_contains(path, b.b) AND b.b IN (SELECT source FROM hierarchy UNION SELECT 's1')),
p AS (SELECT path FROM w WHERE node = 's1' QUALIFY row_number() OVER (ORDER BY len(path), path) = 1), e AS (SELECT (len(path) - i)::INT AS step, path[i + 1] AS x, path[i] AS y FROM p, (SELECT unnest(range(1, 8)) AS i) WHERE i < len(path))
SELECT step, source, target FROM e JOIN hierarchy h ON (h.source = x AND h.target = y) OR (h.source = y AND h.target = x)""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(bind.hierarchy(spark, sf_dir), "s1", "c5")


@query("""WITH u AS (SELECT DISTINCT p_brand AS repo_id, l_suppkey AS dependency FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT dependency, count(*) AS repos FROM u GROUP BY dependency HAVING count(*) > 1 ORDER BY repos DESC, dependency LIMIT 160""")
def dependency_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bind.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    uses = bind.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return graph.dependency_overlap(uses.select(F.col("p_brand").alias("repo_id"), F.col("l_suppkey").alias("dependency")))


@query("SELECT l_orderkey AS source, l_linenumber AS line, coalesce(p_name, 'external') AS target, p_name IS NOT NULL AS resolved FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = bind.table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey", "p_name")
    imports = bind.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    found = imports.join(modules, F.col("l_partkey") == F.col("p_partkey"), "left")
    return found.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("line"), F.coalesce("p_name", F.lit("external")).alias("target"), F.col("p_name").isNotNull().alias("resolved"))
