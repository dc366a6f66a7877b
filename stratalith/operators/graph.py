"""Graph operators over edge tables (source, target): degrees, hotspots, health, traversal, shortest paths.

Traversals are level-synchronous: each level is one join of the frontier with the edges, written to the shared folder.
Only the number of frontier rows reaches the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.functions import exprs
from stratalith.sources.shared import written


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over all edges, repeated ones included; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def centrality(edges: DataFrame, most: int = 10) -> DataFrame:
    """node, degree, centrality = degree / (nodes - 1) of the simple graph, the `most` highest (ties by node)."""
    found = degrees(edges.select("source", "target").distinct())
    n = found.agg(F.count(F.lit(1)).alias("n"))
    score = F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0)
    return found.crossJoin(F.broadcast(n)).select("node", "degree", exprs.dec_round(score, 6).alias("centrality")).orderBy(F.desc("degree"), "node").limit(most)


def hotspots(edges: DataFrame, files: DataFrame, first: int = 40, most: int = 20, bonus: int = 8) -> DataFrame:
    """path, connectivity, risk_score: the `first` nodes by degree, of these the files (path, sensitive), the `most` by risk."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(first)
    held = files.join(F.broadcast(top), files["path"] == top["node"])
    risk = F.col("degree") + F.when(F.col("sensitive"), bonus).otherwise(0)
    return held.select("path", F.col("degree").alias("connectivity"), risk.alias("risk_score")).orderBy(F.desc("risk_score"), "path").limit(most)


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density (5 places) and health (0 to 100) of a graph; nodes has id and risky. An empty graph has 0 of all."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("risky").alias("risky"))
    b = edges.select("source", "target").distinct().agg(F.count(F.lit(1)).alias("edges"))
    c = ends.agg(F.count(F.lit(1)).alias("connected"))
    n = F.greatest(F.col("nodes"), F.lit(1))
    health = exprs.dec_round(exprs.clamp(100 - (1 - F.col("connected") / n) * 45 - F.col("risky") / n * 35, 0.0, 100.0), 0).cast("long")
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))
    density = F.when(F.col("nodes") > 1, exprs.dec_round(F.col("edges") / (n * F.greatest(n - 1, F.lit(1))), 5)).otherwise(0.0)
    return one.select("nodes", "edges", density.alias("density"), F.when(F.col("nodes") > 0, health).otherwise(0).alias("health"))


def _reached(edges: DataFrame, seeds: DataFrame, depth: int | None, until: str | None = None) -> DataFrame:
    """node, distance along the edges a -> b, up to `depth` (as far as they go without), or until a node is met."""
    seen = frontier = written(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    for d in count(1) if depth is None else range(1, depth + 1):
        step = edges.join(frontier, edges["a"] == frontier["node"]).select(F.col("b").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if until is not None and not frontier.filter(F.col("node") == until).isEmpty():
            break
    return seen


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Edges with an end within depth - 1 of a seed, either way; depth is held within 1 and 4."""
    depth = min(4, max(1, depth))
    near = _reached(_both_ways(edges), seeds, depth - 1).select("node")
    hit = lambda c: edges.join(near.withColumnRenamed("node", c), c, "left_semi").select(edges.columns)
    return hit("source").unionByName(hit("target")).distinct()


def dependency_traversal(edges: DataFrame, seeds: DataFrame, relations, depth: int = 3) -> DataFrame:
    """node, distance along directed edges of the given relations; depth is held within 1 and 5."""
    kept = edges.filter(F.col("relation").isin(*relations)).select(F.col("source").alias("a"), F.col("target").alias("b"))
    return _reached(kept, seeds, min(5, max(1, depth)))


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """step, source, target of the edges of one shortest undirected path, no row without one; unweighted, of any length.

    The search goes on from the end whose frontier has fewer rows, a level a time: one join with the edges, one with what
    is seen. A frontier row carries its path (the least of those that lead to it), so the first node in both frontiers
    gives the whole path; only row counts reach the driver.
    """
    both = written(_both_ways(edges).filter("a <> b").distinct())
    session = edges.sparkSession
    sides = [written(session.createDataFrame([(x, [x])], "node string, path array<string>")) for x in (start, end)]
    seen, sizes = [s.select("node") for s in sides], [1, 1]
    met = lambda: sides[0].join(sides[1].withColumnRenamed("path", "back"), "node")
    while min(sizes) and met().isEmpty():
        k = int(sizes[1] < sizes[0])
        longer = sides[k].join(both, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("path").alias("path"))
        sides[k] = written(longer.join(seen[k], "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path")))
        seen[k] = written(seen[k].unionByName(sides[k].select("node")))
        sizes[k] = sides[k].count()
    whole = met().select(F.concat("path", F.slice(F.reverse("back"), F.lit(2), F.size("back"))).alias("path")).agg(F.min("path").alias("path"))
    each = whole.select("path", F.explode(F.expr("CASE WHEN size(path) > 1 THEN sequence(1, size(path) - 1) END")).alias("step"))
    each = each.select("step", F.element_at("path", F.col("step")).alias("x"), F.element_at("path", F.col("step") + 1).alias("y"))
    along = edges.select(F.col("source").alias("x"), F.col("target").alias("y"), F.lit(True).alias("along")).distinct()
    turned = F.coalesce("along", F.lit(False))
    return each.join(along, ["x", "y"], "left").select("step", F.when(turned, F.col("x")).otherwise(F.col("y")).alias("source"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("target"))


def dependency_overlap(uses: DataFrame, most: int = 160) -> DataFrame:
    """dependency, repos: dependencies of more than one repository; uses has repo_id and dependency."""
    shared = uses.select("repo_id", "dependency").distinct().groupBy("dependency").agg(F.count(F.lit(1)).alias("repos"))
    return shared.filter("repos > 1").orderBy(F.desc("repos"), "dependency").limit(most)


def graph_query(nodes: DataFrame, edges: DataFrame, mode: str, source: str = "", target: str = "", depth: int = 2) -> DataFrame:
    """source, target, relation of the edges that a mode shows, of one projection (id, label, kind; source, target, relation).

    Modes: overview, hotspots (of the 50 nodes with most edges), ownership, shortest_path, dependency, blast_radius,
    security_propagation (from all findings). Nodes are named by id, or by a part of id or label.
    """
    slim = edges.select("source", "target", "relation")

    def named(query: str) -> DataFrame:
        low = query.lower()
        hit = nodes.filter((F.col("id") == query) | F.lower("id").contains(low) | F.lower("label").contains(low))
        return hit.orderBy(F.desc(F.col("id") == query), "id").limit(1).select(F.col("id").alias("node"))

    if mode == "overview":
        return slim.orderBy("source", "target", "relation").limit(200)
    if mode == "hotspots":
        top = degrees(slim).orderBy(F.desc("degree"), "node").limit(50)
        inside = slim.join(F.broadcast(top.select(F.col("node").alias("source"))), "source", "left_semi").join(F.broadcast(top.select(F.col("node").alias("target"))), "target", "left_semi")
        return inside.select("source", "target", "relation").orderBy("source", "target", "relation").limit(200)
    if mode == "ownership":
        return slim.filter("relation = 'OWNS'")
    if mode == "shortest_path":
        ends = [r[0] if r else None for r in (named(source).first(), named(target).first())]
        if None in ends:
            return slim.limit(0)
        steps = shortest_path(slim.select("source", "target").distinct(), *ends)
        return slim.join(steps.select("source", "target"), ["source", "target"], "left_semi").select("source", "target", "relation").distinct()
    if mode == "dependency":
        near = dependency_traversal(slim, named(source), ("DEPENDS_ON", "USES", "IMPORTS", "CALLS"), depth)
        inner = near.filter(F.col("distance") < min(5, max(1, depth))).select(F.col("node").alias("source"))
        return slim.filter(F.col("relation").isin("DEPENDS_ON", "USES", "IMPORTS", "CALLS")).join(inner, "source", "left_semi").select("source", "target", "relation")
    if mode == "blast_radius":
        return blast_radius(slim, named(source), depth)
    if mode == "security_propagation":
        return blast_radius(slim, nodes.filter("kind = 'security_finding'").select(F.col("id").alias("node")), depth)
    raise ValueError(f"unknown mode {mode}")
