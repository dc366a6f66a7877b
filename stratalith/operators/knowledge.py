"""Graphs of repositories from files and symbols: dependency graph, knowledge graph, projection, hotspots, clusters, insights.

Files have (repo_id, path, language, size), symbols are those of operators.code, findings have (repo_id, path, rule_id,
severity, line, message). Everything is keyed by repository, so many are built in one plan; ranks and limits hold within
each. Ties are broken by path or id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs, repo_rules, rules
from stratalith.sources.shared import dealt_join, small, written


def ranked(df: DataFrame, most: int, *order, group: str = "repo_id") -> DataFrame:
    """The first `most` rows of each repository."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def _drafts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, source, target, relation, kind, line, rank: every edge to a symbol or module, the later writer with the higher rank."""
    modules = files.groupBy("repo_id", _stem(F.col("path")).alias("module")).agg(F.max("path").alias("file"))
    imports = symbols.filter("kind = 'import'").select("repo_id", F.col("path").alias("source"), "name", F.replace("name", F.lit("."), F.lit("/")).alias("module"))
    # most files of a repository may import one module, so its row is copied to several tasks
    wanted = imports.groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("__uses"))
    imports = dealt_join(imports, written(modules.join(wanted, ["repo_id", "module"])), ["repo_id", "module"], "__uses", ["source"]).select("repo_id", "source", F.coalesce("file", "name").alias("target"), F.lit("imports").alias("relation"), F.when(F.col("file").isNull() | (F.col("file") == F.col("name")), "module").otherwise("file").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("rank"))
    kinds = {"function": ("defines", "function", 2), "method": ("defines", "method", 3), "class": ("defines", "class", 4), "route": ("exposes", "route", 5), "model": ("models", "database_model", 6)}
    name = F.when(F.col("kind") == "method", F.concat_ws(".", F.coalesce("owner", F.lit("module")), "name")).when(F.col("kind") == "route", F.concat_ws(" ", "method", "name")).otherwise(F.col("name"))
    of = lambda i: exprs.by_value(F.col("kind"), {k: v[i] for k, v in kinds.items()}, None)
    own = symbols.filter(F.col("kind").isin(*kinds)).select("repo_id", F.col("path").alias("source"), F.concat_ws("::", "path", name).alias("target"), of(0).alias("relation"), of(1).alias("kind"), "line", of(2).cast("int").alias("rank"))
    return imports.unionByName(own)


def dependency_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, source, target, relation: one edge for each pair; models win over exposes, defines and imports."""
    best = _drafts(files, symbols).groupBy("repo_id", "source", "target").agg(F.max("rank").alias("rank"))
    relation = F.element_at(F.array(*map(F.lit, ("imports", "defines", "defines", "defines", "exposes", "models"))), F.col("rank"))
    return best.select("repo_id", "source", "target", relation.alias("relation"))


def dependency_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, id, kind, line; a class that is a data model too is a database_model."""
    drafts = _drafts(files, symbols).select("repo_id", F.col("target").alias("id"), "kind", "line", "rank")
    every = drafts.unionByName(files.select("repo_id", F.col("path").alias("id"), F.lit("file").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(0).alias("rank")))
    return every.groupBy("repo_id", "id").agg(F.max(F.struct("rank", "kind", "line")).alias("x")).select("repo_id", "id", "x.kind", "x.line")


def central(edges: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """repo_id, id, centrality: degree over nodes - 1 in the simple graph, the highest of each repository."""
    ends = edges.select("repo_id", F.explode(F.array("source", "target")).alias("id")).groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    scored = ends.join(n, "repo_id").select("repo_id", "id", F.when(F.col("n") > 1, exprs.dec_round(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)), 6)).otherwise(1.0).alias("centrality"))
    return ranked(scored, most, F.desc("centrality"), "id")


def entities(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, id, label, kind, path, line, layer: files, routes, data models and symbols, the first of each id."""
    path = F.col("path")
    parts = [files.select("repo_id", path.alias("id"), exprs.file_name(path).alias("label"), F.lit("file").alias("kind"), "path", F.lit(None).cast("int").alias("line"), exprs.case_contains(path, rules.KNOWLEDGE_LAYERS, "application").alias("layer"))]
    label = F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    plural = exprs.by_value(F.col("kind"), {"class": "classes", "function": "functions", "method": "methods"}, None)
    named = {
        "route": (F.concat_ws(":", F.lit("route"), "path", "method", "name"), F.col("name"), "route"), "model": (F.concat_ws(":", F.lit("model"), "path", "name"), F.col("name"), "data_model"),
        "class": (F.concat_ws(":", F.lit("symbol"), "path", plural, label), label, "symbol"), "function": (F.concat_ws(":", F.lit("symbol"), "path", plural, label), label, "symbol"), "method": (F.concat_ws(":", F.lit("symbol"), "path", plural, label), label, "symbol"),
    }
    parts += [symbols.filter(F.col("kind") == k).select("repo_id", i.alias("id"), n.alias("label"), F.lit(kind).alias("kind"), "path", "line", F.lit(None).cast("string").alias("layer")) for k, (i, n, kind) in named.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("repo_id", "id").agg(F.min(F.struct("line", "label", "kind", "path", "layer")).alias("x")).select("repo_id", "id", "x.label", "x.kind", "x.path", "x.line", "x.layer")


def relations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, source, target, relation of the knowledge graph with repetitions: own relations, then those of the dependency graph."""
    label = F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    plural = exprs.by_value(F.col("kind"), {"class": "classes", "function": "functions", "method": "methods"}, None)
    target = F.when(F.col("kind") == "route", F.concat_ws(":", F.lit("route"), "path", "method", "name")).when(F.col("kind") == "model", F.concat_ws(":", F.lit("model"), "path", "name")).otherwise(F.concat_ws(":", F.lit("symbol"), "path", plural, label))
    relation = exprs.by_value(F.col("kind"), {"route": "exposes", "model": "persists"}, "defines")
    own = symbols.filter("kind IN ('route', 'model', 'class', 'function', 'method')").select("repo_id", F.col("path").alias("source"), target.alias("target"), relation.alias("relation"))
    return own.unionByName(dependency_edges(files, symbols))


def sensitive(findings: DataFrame) -> DataFrame:
    """repo_id, path of files with a finding above low."""
    return findings.filter("severity IN ('critical', 'high', 'medium')").select("repo_id", "path").distinct()


def hotspots(files: DataFrame, links: DataFrame, findings: DataFrame, first: int = 40, most: int = 20) -> DataFrame:
    """repo_id, path, connectivity, risk_score, sensitive: the `first` nodes by degree with repetitions, of these the files, by risk."""
    degree = links.select("repo_id", F.explode(F.array("source", "target")).alias("path")).groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("connectivity"))
    top = ranked(degree, first, F.desc("connectivity"), "path").join(files.select("repo_id", "path").distinct(), ["repo_id", "path"])
    flagged = top.join(sensitive(findings).withColumn("sensitive", F.lit(True)), ["repo_id", "path"], "left").withColumn("sensitive", F.coalesce("sensitive", F.lit(False)))
    return ranked(flagged.withColumn("risk_score", F.col("connectivity") + F.when(F.col("sensitive"), 8).otherwise(0)), most, F.desc("risk_score"), "path")


def domains(files: DataFrame, symbols: DataFrame, findings: DataFrame, most: int = 24) -> DataFrame:
    """repo_id, name, file_count, routes, data_models, security_findings, role, sample_files; the largest of each repository.

    Role and samples take the least 20 paths of a domain, ranked before they are gathered.
    """
    named = files.withColumn("name", exprs.domain(F.col("path"), stem=True)).join(sensitive(findings).withColumn("bad", F.lit(1)), ["repo_id", "path"], "left")
    sizes = named.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("file_count"), F.count("bad").alias("security_findings"))
    head = named.withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "name").orderBy("path"))).filter("r <= 20").groupBy("repo_id", "name").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    counted = symbols.filter("kind IN ('route', 'model')").groupBy("repo_id", exprs.domain(F.col("path"), stem=True).alias("name")).agg(F.count_if(F.col("kind") == "route").alias("routes"), F.count_if(F.col("kind") == "model").alias("data_models"))
    role = exprs.case_contains(F.concat_ws(" ", "name", F.array_join("paths", " ")), rules.DOMAIN_ROLES, "Product capability")
    every = ranked(sizes, most, F.desc("file_count"), "name").join(head, ["repo_id", "name"]).join(counted, ["repo_id", "name"], "left")
    return every.select("repo_id", "name", "file_count", F.coalesce("routes", F.lit(0)).alias("routes"), F.coalesce("data_models", F.lit(0)).alias("data_models"), "security_findings", role.alias("role"), F.slice("paths", 1, 8).alias("sample_files"))


def clusters(files: DataFrame, symbols: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, name, member_count, security_findings: a file may be in several; what is in none is Application."""
    routes = symbols.filter("kind = 'route'").select("repo_id", "path").distinct().withColumn("routed", F.lit(True))
    low = F.lower("path")
    names = F.array_compact(F.array(*(F.when(exprs.any_contains(low, tokens) | (F.coalesce("routed", F.lit(False)) if name == "API" else F.lit(False)), name) for name, tokens in repo_rules.CLUSTERS)))
    bad = sensitive(findings).withColumn("bad", F.lit(1))
    placed = files.join(routes, ["repo_id", "path"], "left").join(bad, ["repo_id", "path"], "left").withColumn("names", names)
    every = placed.withColumn("name", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("Application")))))
    return every.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("member_count"), F.count("bad").alias("security_findings"))


def insights(files: DataFrame, symbols: DataFrame, findings: DataFrame, links: DataFrame, most: int = 30) -> DataFrame:
    """repo_id, type, severity, entity: crowded files, bottlenecks, hotspots and sensitive files, in this order, 30 at most."""
    crowded = symbols.filter("kind IN ('class', 'function', 'method')").groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("n")).filter("n >= 18")
    parts = [crowded.select("repo_id", F.lit(1).alias("part"), F.lit("god_class_candidate").alias("type"), F.lit("medium").alias("severity"), F.col("path").alias("entity"), F.lit(0).alias("order"))]
    degree = links.select("repo_id", F.explode(F.array("source", "target")).alias("path")).groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("n"))
    busy = ranked(degree, 8, F.desc("n"), "path").filter("n >= 6").join(files.select("repo_id", "path").distinct(), ["repo_id", "path"])
    parts.append(busy.select("repo_id", F.lit(2).alias("part"), F.lit("dependency_bottleneck").alias("type"), F.when(F.col("n") >= 12, "high").otherwise("medium").alias("severity"), F.col("path").alias("entity"), (-F.col("n")).cast("int").alias("order")))
    hot = ranked(hotspots(files, links, findings), 8, F.desc("risk_score"), "path")
    parts.append(hot.select("repo_id", F.lit(3).alias("part"), F.lit("hotspot").alias("type"), F.when(F.col("sensitive"), "high").otherwise("medium").alias("severity"), F.col("path").alias("entity"), (-F.col("risk_score")).cast("int").alias("order")))
    parts.append(ranked(sensitive(findings), 8, "path").select("repo_id", F.lit(4).alias("part"), F.lit("security_hotspot").alias("type"), F.lit("high").alias("severity"), F.col("path").alias("entity"), F.lit(0).alias("order")))
    return ranked(reduce(DataFrame.unionByName, parts), most, "part", "order", "entity").select("repo_id", "type", "severity", "entity")


def on_cycles(links: DataFrame, rounds: int = 12) -> DataFrame:
    """repo_id, node: all nodes on a cycle, and some near one: what stays when ends without edges in or out are cut off, round by round."""
    edges = written(links.select("repo_id", "source", "target").filter("source <> target").distinct())
    n = edges.count()
    for _ in range(rounds):
        if not n:
            break
        has = lambda c, other, e=edges: e.select("repo_id", F.col(c).alias(other)).distinct()
        left = written(edges.join(has("target", "source"), ["repo_id", "source"], "left_semi").join(has("source", "target"), ["repo_id", "target"], "left_semi"))
        edges, before, n = left, n, left.count()
        if n == before:
            break
    return written(edges.select("repo_id", F.explode(F.array("source", "target")).alias("node")).distinct())


def longest_paths(links: DataFrame, starts: DataFrame, longest: int = 8, fan_out: int = 8) -> DataFrame:
    """repo_id, start, path: the longest simple path from each start along at most `fan_out` edges of each node.

    Ties go to the path that branches to the least targets first. A path can only come back to nodes on cycles. So of the
    paths of one start and length that end in one node, having passed the same nodes on cycles, only the first goes on:
    all others could go on as it does, and would come after it. Away from cycles a step has a row for each start and node
    at most, as the longest paths of an acyclic graph need no more.
    """
    steps = ranked(links.select("repo_id", "source", "target").withColumn("__key", F.struct("repo_id", "source")), fan_out, "target", group="__key").drop("__key").distinct()
    steps = written(steps)
    cyclic = on_cycles(steps).withColumn("cyclic", F.lit(True))
    marked = written(steps.join(cyclic.withColumnRenamed("node", "target"), ["repo_id", "target"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False))))
    none = F.array().cast("array<string>")
    first = starts.select("repo_id", F.col("start").alias("node"), "start").join(cyclic, ["repo_id", "node"], "left")
    paths = first.select("repo_id", "start", F.array("start").alias("path"), F.when(F.col("cyclic"), F.array("start")).otherwise(none).alias("met"))
    best = paths.select("repo_id", "start", "path")
    for _ in range(longest - 1):
        longer = paths.withColumn("source", F.element_at("path", -1)).join(marked, ["repo_id", "source"]).filter(~F.array_contains("met", F.col("target")) & (F.col("target") != F.col("source")))
        # away from cycles no passed node can be met again, so nothing needs to be remembered there
        met = F.when(F.col("cyclic"), F.array_sort(F.concat("met", F.array("target")))).otherwise(none)
        longer = longer.select("repo_id", "start", "target", met.alias("met"), F.concat("path", F.array("target")).alias("path"))
        paths = written(longer.groupBy("repo_id", "start", "target", "met").agg(F.min("path").alias("path")).drop("target"))
        if paths.isEmpty():
            break
        best = best.unionByName(paths.groupBy("repo_id", "start").agg(F.min("path").alias("path")))
    order = Window.partitionBy("repo_id", "start").orderBy(F.desc(F.size("path")))
    return best.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def critical_path(links: DataFrame, hot: DataFrame) -> DataFrame:
    """repo_id, path, risk_score from the first hotspot of each repository."""
    first = ranked(hot, 1, F.desc("risk_score"), "path").select("repo_id", F.col("path").alias("start"), "risk_score")
    return longest_paths(links, first).join(first, ["repo_id", "start"]).select("repo_id", "path", "risk_score")


def dependency_flows(links: DataFrame, most: int = 12, starters: int = 16, longest: int = 7) -> DataFrame:
    """repo_id, start, path: longest paths from the sources with most edges, those of two nodes or more, the longest first."""
    out = links.groupBy("repo_id", F.col("source").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    found = longest_paths(links, ranked(out, starters, F.desc("n"), "start"), longest).filter(F.size("path") > 1)
    return ranked(found, most, F.desc(F.size("path")), "start")


def reach(links: DataFrame, most: int = 10_000) -> DataFrame:
    """repo_id, node, forward, backward: how many nodes lie within two edges of each, along and against them; exact.

    Edges into a hub, a node with more than `most` of them, are dealt in parts, and its edges out are copied to each part;
    repeated pairs are dropped before the shuffle.
    """
    one = written(links.select("repo_id", "source", "target").distinct())
    hubs = one.groupBy("repo_id", F.col("target").alias("middle")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("repo_id", "middle", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    hubs = written(hubs)
    sent = small(hubs, hubs.count())
    parts = F.coalesce("parts", F.lit(1))
    into = one.select("repo_id", "source", F.col("target").alias("middle")).join(sent, ["repo_id", "middle"], "left").withColumn("part", F.pmod(F.xxhash64("source"), parts).cast("int")).drop("parts")
    out = one.select("repo_id", F.col("source").alias("middle"), "target").join(sent, ["repo_id", "middle"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    near = one.unionByName(into.join(out, ["repo_id", "middle", "part"]).select("repo_id", "source", "target")).distinct()
    forward = near.groupBy("repo_id", F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("forward"))
    backward = near.groupBy("repo_id", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("backward"))
    return _both_counts(forward, backward)


def _both_counts(forward: DataFrame, backward: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return forward.join(backward, ["repo_id", "node"], "full").select("repo_id", "node", zero("forward"), zero("backward"))


def reach_estimated(links: DataFrame, lg_k: int = 12) -> DataFrame:
    """reach() by sketches of distinct nodes: a row an edge is shuffled, however large the hubs; off by 1.6 % (standard error) at lg_k 12."""
    one = links.select("repo_id", "source", "target").distinct()

    def side(node: str, other: str, out: str) -> DataFrame:
        own = one.groupBy("repo_id", F.col(node).alias("node")).agg(F.hll_sketch_agg(other, lg_k).alias("sketch"))
        onward = one.select("repo_id", F.col(other).alias("node"), F.col(node).alias("far")).join(own, ["repo_id", "node"]).select("repo_id", F.col("far").alias("node"), "sketch")
        return own.unionByName(onward).groupBy("repo_id", "node").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))

    return _both_counts(side("source", "target", "forward"), side("target", "source", "backward"))


def team(scope: Column) -> Column:
    """struct(team, bus_factor, confidence) of a domain or a repository and domain."""
    name = exprs.case_contains(scope, rules.OWNERS, "Core Engineering")
    of = lambda i: exprs.by_value(name, {k: v[i] for k, v in repo_rules.TEAMS.items()}, None)
    return F.struct(name.alias("team"), of(0).alias("bus_factor"), of(1).alias("confidence"))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return low.startswith("tests/") | low.contains("/tests/") | low.rlike(r"(\.test\.tsx?|\.spec\.tsx?|_test\.py)$") | exprs.file_name(low).contains("test_")


def is_deployment(path: Column) -> Column:
    low = F.lower(path)
    return exprs.file_name(low).isin("dockerfile", "docker-compose.yml", "docker-compose.yaml", "fly.toml") | low.startswith(".github/workflows/") | low.startswith("deploy/") | low.rlike(r"(\.tf|\.tfvars|render\.yaml|railway\.toml)$")


def projection(files: DataFrame, symbols: DataFrame, findings: DataFrame, stack: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the property graph; edges keep repetitions, as each file adds an edge for each of its folders.

    Nodes: repo_id, id, label, kind. Edges: repo_id, source, target, relation. stack has repo_id and dependency.
    """
    path, repo = F.col("path"), F.concat(F.lit("repo:"), F.col("repo_id"))
    ident = lambda kind, *parts: F.concat_ws(":", F.lit(kind), "repo_id", *parts)
    node = lambda df, i, label, kind: df.select("repo_id", i.alias("id"), label.alias("label"), F.lit(kind).alias("kind"))
    edge = lambda df, a, b, relation: df.select("repo_id", a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"))
    parents = exprs.ancestors(path)
    folder = files.select("repo_id", "path", F.posexplode(parents).alias("i", "dir"), parents.alias("dirs"))
    above = F.when(F.col("i") == 0, repo).otherwise(ident("directory", F.get("dirs", F.col("i") - 1)))
    holder = F.when(F.size(parents) > 0, ident("directory", F.element_at(parents, -1))).otherwise(repo)
    known = files.select("repo_id", "path").distinct()
    inside = symbols.join(known, ["repo_id", "path"], "left_semi")
    classes, functions, routes = (inside.filter(F.col("kind") == k) for k in ("class", "function", "route"))
    verb = F.concat_ws(" ", "method", "name")
    spaces = domains(files, symbols, findings).withColumn("t", team(F.concat_ws("/", "repo_id", "name")))
    owner = F.concat(F.lit("owner:"), F.col("t.team"))
    tests, deployments = files.filter(is_test(path)), files.filter(is_deployment(path))
    risk = ident("risk", "rule_id", "path", F.col("line").cast("string"))
    links = dependency_edges(files, symbols)
    ends = links.join(known.withColumnRenamed("path", "source"), ["repo_id", "source"], "left_semi").join(known.withColumnRenamed("path", "target"), ["repo_id", "target"], "left_semi")
    dependency = F.concat(F.lit("dependency:"), F.col("dependency"))
    of_file = ident("file", "path")
    sampled = spaces.select("repo_id", "name", F.explode("sample_files").alias("path")).join(known, ["repo_id", "path"], "left_semi")
    nodes = [
        node(files.select("repo_id").distinct(), repo, F.col("repo_id"), "repository"), node(folder, ident("directory", "dir"), F.col("dir"), "directory"), node(files, of_file, path, "file"),
        node(tests, ident("test", "path"), path, "test"), node(deployments, ident("deployment", "path"), path, "deployment"),
        node(classes, ident("class", "path", "name"), F.col("name"), "class"), node(functions, ident("function", "path", "name"), F.col("name"), "function"), node(routes, ident("api", "path", verb), verb, "api"),
        node(spaces, ident("domain", "name"), F.col("name"), "domain"), node(spaces, ident("service", "name"), F.col("name"), "service"), node(spaces, owner, F.col("t.team"), "owner"),
        node(findings, risk, F.col("message"), "security_finding"), node(stack, dependency, F.col("dependency"), "dependency"),
    ]
    edges = [
        edge(folder, above, ident("directory", "dir"), "CONTAINS"), edge(files, holder, of_file, "CONTAINS"), edge(tests, ident("test", "path"), of_file, "AFFECTS"), edge(deployments, ident("deployment", "path"), repo, "AFFECTS"),
        edge(classes, of_file, ident("class", "path", "name"), "CONTAINS"), edge(functions, of_file, ident("function", "path", "name"), "CONTAINS"), edge(routes, of_file, ident("api", "path", verb), "EXPOSES"),
        edge(spaces, repo, ident("service", "name"), "CONTAINS"), edge(spaces, ident("service", "name"), ident("domain", "name"), "LINKED_TO"), edge(spaces, owner, ident("service", "name"), "OWNS"), edge(sampled, ident("service", "name"), of_file, "CONTAINS"),
        ends.select("repo_id", ident("file", "source").alias("source"), ident("file", "target").alias("target"), F.when(F.col("relation") == "imports", "IMPORTS").otherwise("CALLS").alias("relation")),
        edge(findings.join(known, ["repo_id", "path"], "left_semi"), risk, of_file, "AFFECTS"), edge(stack, repo, dependency, "DEPENDS_ON"), edge(stack, repo, dependency, "USES"),
    ]
    last = reduce(DataFrame.unionByName, nodes).groupBy("repo_id", "id").agg(F.max(F.struct("label", "kind")).alias("x")).select("repo_id", "id", "x.label", "x.kind")
    return last, reduce(DataFrame.unionByName, edges)


def relation_type(relation: Column) -> Column:
    """Relations that a property graph may hold; all others are links."""
    return F.when(F.upper(relation).isin(*repo_rules.GRAPH_RELATIONS), F.upper(relation)).otherwise("LINKED_TO")


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, node_count, edge_count, graph_density (5 places), graph_health (0 to 100) of each repository."""
    n = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("kind") == "security_finding").alias("risks"), F.count_if(F.col("kind") == "owner").alias("owner_count"))
    e = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edge_count"))
    c = edges.select("repo_id", F.explode(F.array("source", "target")).alias("id")).groupBy("repo_id").agg(F.countDistinct("id").alias("connected"))
    one = n.join(e, "repo_id", "left").join(c, "repo_id", "left").fillna(0, ["edge_count", "connected"])
    size = F.greatest(F.col("node_count"), F.lit(1))
    density = F.when(F.col("node_count") > 1, exprs.dec_round(F.col("edge_count") / (size * F.greatest(size - 1, F.lit(1))), 5)).otherwise(0.0)
    health = exprs.dec_round(exprs.clamp(100 - (1 - F.col("connected") / size) * 45 - F.col("risks") / size * 35, 0.0, 100.0), 0).cast("long")
    return one.select("repo_id", "node_count", "edge_count", "owner_count", density.alias("graph_density"), health.alias("graph_health"))


def resolved(nodes: DataFrame, query: str) -> DataFrame:
    """repo_id, id of the node that a query names: the exact id, else the first whose id or label contains it."""
    low = query.lower()
    hit = (F.col("id") == query) | F.lower("id").contains(low) | F.lower("label").contains(low)
    return ranked(nodes.filter(hit & F.lit(query != "")), 1, F.desc(F.col("id") == query), "id").select("repo_id", "id")
