"""Stack, debt, scores and architecture of repositories, from files, symbols, notes, metrics and findings.

Every function gives a row for each repository that has files, or rows keyed by repository; a repository without findings,
symbols or notes counts as having none of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions import exprs, repo_rules, rules
from stratalith.operators.knowledge import ranked


def stack(files: DataFrame) -> DataFrame:
    """repo_id, frameworks, package_managers, build_tools, ci_cd (sorted), docker; files have path and text.

    A file shows what its own manifest says, so only names and flags are gathered, never texts.
    """
    name, text = exprs.file_name(F.col("path")), F.lower(F.coalesce("text", F.lit("")))
    empty = F.array().cast("array<string>")
    managers, tools, frameworks = [], [], [F.when(exprs.suffix(F.col("path")) == ".sql", F.lit("SQL/database"))]
    for manifest, manager, tool, words in repo_rules.MANIFESTS:
        here = name.endswith(manifest[1:]) if manifest.startswith("*") else name == manifest
        read = here if manifest in repo_rules.NESTED_MANIFESTS else here & ~F.col("path").contains("/")
        managers += [F.when(here, F.lit(manager))] if manager else []
        tools += [F.when(here, F.lit(tool))] if tool else []
        frameworks += [F.when(read & text.contains(word), F.lit(framework)) for word, framework in words]
    managers, tools, frameworks = (F.array_compact(F.array(*x)) for x in (managers, tools, frameworks))
    rows = files.select("repo_id", managers.alias("m"), tools.alias("t"), frameworks.alias("f"), F.col("path").contains(".github/workflows/").alias("ci"))
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))  # noqa: E731  at most a few different arrays
    out = rows.groupBy("repo_id").agg(sets("f").alias("frameworks"), sets("m").alias("package_managers"), sets("t").alias("build_tools"), F.max("ci").alias("ci"))
    return out.select("repo_id", "frameworks", "package_managers", "build_tools", F.when(F.col("ci"), F.array(F.lit("GitHub Actions"))).otherwise(empty).alias("ci_cd"), F.array_contains("build_tools", "Docker").alias("docker"))


def low_value_debt(path: Column) -> Column:
    return exprs.low_value(path, ("docs_src/", "tests/", "test/"), ())


def debt(files: DataFrame, notes: DataFrame, metrics: DataFrame, large: int = 150_000) -> DataFrame:
    """repo_id, files, debt_items, todos, large_files, mean_maintainability (72 without), debt_score.

    metrics has path, maintainability and blocks of Python files; production files count, or all if there is none.
    """
    measured = metrics.withColumn("low", low_value_debt(F.col("path")))
    good = measured.groupBy("repo_id").agg(F.max((~F.col("low")).cast("int")).alias("good"))
    kept = measured.join(good, "repo_id").filter(~F.col("low") | (F.col("good") == 0))
    heavy = F.size(F.filter("blocks", lambda b: b["complexity"] >= 10))
    a = kept.groupBy("repo_id").agg(F.avg("maintainability").alias("mi"), F.sum(heavy).alias("debt_items"))
    b = notes.filter(~low_value_debt(F.col("path"))).groupBy("repo_id").agg(F.count(F.lit(1)).alias("todos"))
    c = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("size") > large).alias("large_files"))
    one = c.join(a, "repo_id", "left").join(b, "repo_id", "left").fillna(0, ["debt_items", "todos"]).withColumn("mean_maintainability", F.coalesce("mi", F.lit(72.0))).drop("mi")
    n = F.greatest(F.col("files"), F.lit(1))
    raw = F.col("mean_maintainability") - F.col("debt_items") / n * 180 - F.col("todos") / n * 45 - F.col("large_files") / n * 35
    return one.withColumn("debt_score", exprs.clamp(exprs.dec_round(raw, 1), 0.0, 100.0)).withColumn("mean_maintainability", exprs.dec_round(F.col("mean_maintainability"), 4))


def debt_items(metrics: DataFrame, least: int = 10, high: int = 15) -> DataFrame:
    """repo_id, path, line, name, complexity, severity of blocks with many decisions."""
    each = metrics.select("repo_id", "path", F.explode("blocks").alias("b")).select("repo_id", "path", "b.*").filter(F.col("complexity") >= least)
    return each.withColumn("severity", F.when(F.col("complexity") >= high, "high").otherwise("medium"))


def security(files: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, files, a column for each severity, security_score of each repository: losses relate to all its files, at least one."""
    total = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    found = findings.groupBy("repo_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in rules.RANK))
    one = total.join(found, "repo_id", "left").fillna(0, list(rules.RANK))
    n = F.greatest(F.col("files"), F.lit(1))
    loss = 20 * F.col("critical") + 6 * F.col("high") + F.least(F.lit(35.0), F.col("medium") / n * 220) + F.least(F.lit(10.0), F.col("low") / n * 5)
    return one.withColumn("security_score", exprs.dec_round(F.greatest(F.lit(0.0), 100 - F.least(F.lit(80.0), loss)), 1))


def scores(files: DataFrame, symbols: DataFrame, findings: DataFrame, found_stack: DataFrame, found_debt: DataFrame) -> DataFrame:
    """repo_id and all scores with what they come from: security, debt, tests, ci, container, dependency, docs, code, production, recruiter, cto, confidence, risk."""
    low = F.lower("path")
    marks = files.groupBy("repo_id").agg(F.max(low.contains("test") | low.contains("spec")).alias("tested"), F.max(exprs.file_name(low) == "readme.md").alias("documented"))
    counted = symbols.groupBy("repo_id").agg(F.count_if(F.col("kind") == "route").alias("routes"), F.count_if(F.col("kind").isin("function", "class")).alias("symbols"))
    one = security(files, findings).join(marks, "repo_id").join(counted, "repo_id", "left").join(found_stack, "repo_id").join(found_debt.select("repo_id", "debt_score"), "repo_id").fillna(0, ["routes", "symbols"])
    managed = F.size("package_managers") > 0
    one = one.select(
        "repo_id", "files", "routes", "symbols", F.col("security_score").alias("security"), F.col("debt_score").alias("debt"), F.when(F.col("tested"), 100).otherwise(35).alias("tests"), F.when(F.size("ci_cd") > 0, 100).otherwise(35).alias("ci"),
        F.when(F.col("docker"), 100).otherwise(45).alias("container"), F.when(managed, 90).otherwise(50).alias("dependency"), F.when(F.col("documented"), 100).otherwise(45).alias("docs"),
        F.least(F.lit(100.0), 45 + F.col("routes") * 8 + F.col("symbols") * 1.5).alias("code"),
        F.least(F.lit(95), 30 + F.least(F.col("files"), F.lit(40)) + F.when(F.col("symbols") + F.col("routes") > 0, 15).otherwise(0) + F.when(managed, 10).otherwise(0)).cast("long").alias("confidence"),
    )
    total = lambda weights: exprs.dec_round(sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.lit(0.0)), 1)
    one = one.withColumn("production", total(rules.PRODUCTION_WEIGHTS)).withColumn("recruiter", total(repo_rules.RECRUITER_WEIGHTS))
    return one.withColumn("cto", total(rules.CTO_WEIGHTS)).withColumn("risk", exprs.dec_round(100 - F.col("cto"), 1))


def score_gaps(given: DataFrame) -> DataFrame:
    """repo_id, score, gap: what lowers each score, a row for each; given are the scores."""
    gaps = {
        "production": (("tests", "tests < 100"), ("ci", "ci < 100"), ("container", "container < 100"), ("docs", "docs < 100")), "recruiter": (("docs", "docs < 100"), ("tests", "tests < 100"), ("debt", "debt < 80")),
        "cto": (("security", "security < 85"), ("debt", "debt < 80"), ("ci", "ci < 100")),
    }
    rows = F.array_compact(F.array(*(F.when(F.expr(test), F.struct(F.lit(score).alias("score"), F.lit(gap).alias("gap"))) for score, parts in gaps.items() for gap, test in parts)))
    return given.select("repo_id", F.explode(rows).alias("x")).select("repo_id", "x.*")


def components(files: DataFrame, most: int = 14) -> DataFrame:
    """repo_id, name, file_count, role: top folders, or the stems of root files, the largest of each repository."""
    top = F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise(F.regexp_replace("path", r"(?<=.)\.[^.]*$", ""))
    named = files.select("repo_id", top.alias("name"), "path")
    sizes = named.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("file_count"))
    head = named.withColumn("key", F.struct("repo_id", "name"))
    head = ranked(head, 20, "path", group="key").groupBy("repo_id", "name").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    role = exprs.case_contains(F.concat_ws(" ", "name", F.array_join("paths", " ")), repo_rules.COMPONENT_ROLES, "Application code")
    return ranked(sizes, most, F.desc("file_count"), "name").join(head, ["repo_id", "name"]).select("repo_id", "name", "file_count", role.alias("role"))


def style(files: DataFrame, found_stack: DataFrame) -> DataFrame:
    """repo_id, style, top_folders: the first rule that a repository meets."""
    starts = lambda *p: F.max(reduce(lambda a, b: a | b, (F.col("path").startswith(x) for x in p)))
    one = files.groupBy("repo_id").agg(starts("apps/", "packages/").alias("mono"), starts("frontend/").alias("front"), starts("backend/").alias("back"), F.countDistinct(F.when(F.col("path").contains("/"), F.split("path", "/")[0])).alias("top_folders"))
    one = one.join(found_stack.select("repo_id", "frameworks"), "repo_id")
    has = lambda x: F.array_contains("frameworks", x)
    chosen = (
        F.when(F.col("mono"), "Monorepo").when(has("Next.js"), "Frontend web application").when(has("FastAPI"), "API service").when(F.col("front") & F.col("back"), "Full-stack application")
        .when(F.col("top_folders") > 5, "Multi-component repository").otherwise("General software repository")
    )
    return one.select("repo_id", chosen.alias("style"), "top_folders")


def special_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, path, routed, stored: files with routes or data models, by their symbols or by their names outside tests and docs."""
    low = F.lower("path")
    plain = ~exprs.low_value(F.col("path"), endings=())
    known = symbols.filter("kind IN ('route', 'model')").groupBy("repo_id", "path").agg(F.max(F.col("kind") == "route").alias("r"), F.max(F.col("kind") == "model").alias("m"))
    rows = files.join(known, ["repo_id", "path"], "left")
    either = lambda c, tokens: F.coalesce(c, F.lit(False)) | (plain & exprs.any_contains(low, tokens))
    return rows.select("repo_id", "path", either("r", repo_rules.ROUTE_FILES).alias("routed"), either("m", repo_rules.DATA_FILES).alias("stored")).filter("routed OR stored")


def statistics(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, files, bytes and the number of functions, methods, classes, routes and data models."""
    a = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    kinds = {"functions": "function", "methods": "method", "classes": "class", "routes": "route", "models": "model"}
    b = symbols.groupBy("repo_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))
    return a.join(b, "repo_id", "left").fillna(0, list(kinds))


def facts(files: DataFrame, found: DataFrame, found_stack: DataFrame, hot: DataFrame, spaces: DataFrame, parts: DataFrame, flows: DataFrame, marked: DataFrame) -> DataFrame:
    """One wide row for each repository: what diligence, acquisition and architecture reviews are made of.

    found are the scores, hot the hotspots, spaces the domains, parts the components, flows the dependency flows, marked the
    special files.
    """
    low = F.lower("path")
    named = files.groupBy("repo_id").agg(F.count_if(low.contains("test") | low.contains("spec")).alias("test_files"), F.max(low.contains("docs/")).alias("has_docs"), F.max(low.startswith(".github/") | low.contains("gitlab-ci")).alias("has_ci_files"))
    spots = hot.groupBy("repo_id").agg(F.count(F.lit(1)).alias("hotspots"), F.max("connectivity").alias("most_connected"), F.count_if(F.col("risk_score") >= 20).alias("risky_hotspots"))
    inside = spaces.groupBy("repo_id").agg(F.count(F.lit(1)).alias("domains"), F.max("file_count").alias("largest"), F.count_if(F.col("role") == "API boundary").alias("api_domains"))
    each = parts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("components"))
    long = flows.groupBy("repo_id").agg(F.max(F.size("path")).alias("longest_flow"))
    stored = marked.groupBy("repo_id").agg(F.count_if("stored").alias("stored_files"))
    one = found.join(named, "repo_id").join(found_stack.select("repo_id", "docker", (F.size("ci_cd") > 0).alias("has_ci"), F.size("frameworks").alias("n_frameworks")), "repo_id")
    for extra in (spots, inside, each, long, stored):
        one = one.join(extra, "repo_id", "left")
    return one.fillna(0, ["hotspots", "most_connected", "risky_hotspots", "domains", "largest", "api_domains", "components", "longest_flow", "stored_files"])


def _if(condition, points) -> Column:
    return F.when(condition, points).otherwise(0)


# Labels that reports and screens compare with.
VERDICTS = (((78, "Strong Acquisition Candidate"), (62, "Moderate Risk Candidate")), "High Risk Candidate")
ADVICE = ("do not approve without remediation", "approve only with enterprise hardening plan", "approve technical diligence with monitoring", "request remediation plan before approval")


def acquisition(about: DataFrame, critical: DataFrame) -> DataFrame:
    """repo_id, eight sub-scores, readiness and verdict; about are the facts, critical has repo_id of repositories with a critical finding."""
    c, files = F.col, F.greatest(F.col("files"), F.lit(1))
    keep = lambda x, low=0.0, high=100.0: exprs.clamp(x.cast("double"), low, high)
    one = about.join(critical.select("repo_id").distinct().withColumn("has_critical", F.lit(True)), "repo_id", "left")
    one = one.withColumns({
        "scalability": keep(45 + _if(c("docker"), 12) + _if(c("has_ci"), 10) + F.least(F.lit(14.0), c("components") * 1.5) + _if(c("routes") > 0, 10) - F.least(F.lit(18.0), c("hotspots") * 1.2)),
        "bus_factor": F.when(c("domains") == 0, 40.0).otherwise(exprs.dec_round(keep(100 - c("largest") / files * 120, 20.0, 95.0), 1)),
        "test_confidence": keep(35 + c("test_files") / files * 220, 0.0, 95.0),
        "ci_cd_maturity": keep(35 + _if(c("has_ci"), 35) + _if(c("docker"), 15)),
        "documentation": keep(35 + _if(c("docs") == 100, 35) + _if(c("has_docs"), 15) + 10),
    }).withColumn("operational", (c("production") + c("ci_cd_maturity") + c("documentation") + c("scalability")) / 4)
    weights = {"cto": 0.24, "security": 0.22, "production": 0.20, "debt": 0.18, "test_confidence": 0.08, "documentation": 0.08}
    ready = exprs.weighted_mean([(c(n), w) for n, w in weights.items()])
    verdict = F.when(c("has_critical"), VERDICTS[1]).otherwise(exprs.level(c("ready"), *VERDICTS))
    shown = [exprs.dec_round(c(n), 1).alias(n) for n in ("scalability", "bus_factor", "test_confidence", "ci_cd_maturity", "documentation", "operational")]
    return one.withColumn("ready", ready).select("repo_id", *shown, exprs.dec_round(c("ready"), 1).alias("readiness"), verdict.alias("verdict"))


def diligence(about: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, risks, critical_risks, gaps, investment_readiness, recommendation: risks are the first eight findings and five hotspots, ten at most."""
    first = ranked(findings, 8, "path", "line", "rule_id").groupBy("repo_id").agg(F.count(F.lit(1)).alias("f"), F.count_if(F.col("severity") == "critical").alias("critical_risks"))
    one = about.join(first, "repo_id", "left").fillna(0, ["f", "critical_risks"])
    c = F.col
    gaps = _if(c("tests") < 100, 1) + _if(~c("has_ci_files"), 1) + _if(c("docs") < 100, 1) + _if(c("security") < 80, 1) + _if(c("stored_files") == 0, 1)
    one = one.withColumn("risks", F.least(F.lit(10).cast("long"), c("f") + F.least(c("hotspots"), F.lit(5)))).withColumn("gaps", gaps.cast("long"))
    ready = F.when((c("cto") >= 80) & (c("risks") <= 2) & (c("gaps") <= 3), "strong").when((c("cto") >= 65) & (c("risks") <= 5), "moderate").when(c("cto") >= 50, "early").otherwise("high-risk")
    advice = F.when((c("security") < 55) | (c("critical_risks") > 0), ADVICE[0]).when(c("gaps") > 5, ADVICE[1]).when(c("cto") >= 75, ADVICE[2]).otherwise(ADVICE[3])
    return one.select("repo_id", "risks", "critical_risks", "gaps", ready.alias("investment_readiness"), advice.alias("recommendation"))


REVIEW_STEPS = ((80, "strong"), (65, "moderate"), (45, "elevated"))


def architecture_review(about: DataFrame) -> DataFrame:
    """repo_id, coupling, scalability, boundaries, modularity, maintainability, review: 0 to 100 each, review their weighted sum."""
    c = F.col
    keep = lambda x: exprs.dec_round(exprs.clamp(x.cast("double"), 0.0, 100.0), 1)
    one = about.select(
        "repo_id", keep(100 - c("longest_flow") * 5 - c("most_connected") * 4 - c("hotspots") * 2).alias("coupling"),
        keep(45 + _if(c("docker"), 15) + _if(c("has_ci"), 20) + F.least(F.lit(15), c("routes") * 3) - F.least(F.lit(18), c("hotspots") * 2)).alias("scalability"),
        keep(45 + c("domains") * 5 + c("api_domains") * 8 - c("api_domains") * 3).alias("boundaries"),
        keep(85 - c("largest") / F.greatest(c("files"), F.lit(1)) * 75 + F.least(F.lit(15), c("domains") * 2)).alias("modularity"), exprs.dec_round(c("debt"), 1).alias("maintainability"),
    )
    total = c("coupling") * 0.25 + c("scalability") * 0.20 + c("boundaries") * 0.20 + c("modularity") * 0.20 + c("maintainability") * 0.15
    return one.withColumn("review", exprs.dec_round(total, 1))


def external_integrations(env: DataFrame, found_stack: DataFrame) -> DataFrame:
    """repo_id, name of outside services, by variables of the environment and by dependencies."""
    by_env = env.filter(exprs.any_contains(F.lower("name"), repo_rules.INTEGRATIONS)).select("repo_id", "name")
    deps = found_stack.select("repo_id", F.explode(F.concat("frameworks", "package_managers")).alias("name"))
    return by_env.unionByName(deps.filter(exprs.any_contains(F.lower("name"), repo_rules.DEPENDENCY_INTEGRATIONS))).distinct()


def path_risk(files: DataFrame, findings: DataFrame, hot: DataFrame, items: DataFrame) -> DataFrame:
    """repo_id, path, risk: severities of a file, three for each connection of a hotspot, eight for each debt item, 100 at most."""
    of = lambda df, c: df.groupBy("repo_id", "path").agg(c)
    a = of(findings, F.sum(exprs.by_value(F.col("severity"), repo_rules.PATH_RISK, 6)).alias("a"))
    b, c = of(hot, (3 * F.max("connectivity")).alias("b")), of(items, (8 * F.count(F.lit(1))).alias("c"))
    keys = ["repo_id", "path"]
    one = files.select(*keys).join(a, keys, "left").join(b, keys, "left").join(c, keys, "left").fillna(0, ["a", "b", "c"])
    return one.select(*keys, F.least(F.lit(100), F.col("a") + F.col("b") + F.col("c")).cast("long").alias("risk")).filter("risk > 0")
