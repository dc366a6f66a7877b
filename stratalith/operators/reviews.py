"""Pull-request reviews: tests, dependencies, interfaces and security that a change touches, and what follows for it.

changed has (pr, path, additions, deletions); risks are those of history.review_risk (pr, path, layer, risk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators.containment import contained
from stratalith.sources.shared import written

# Files and words that make a change special.
DEPENDENCY_FILES = ("requirements.txt", "pyproject.toml", "poetry.lock", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "pom.xml", "build.gradle", "Dockerfile", "docker-compose.yml")
SENSITIVE = ("auth", "session", "jwt", "oauth", "password", "secret", "token", "permission", "policy", "cors", ".env", "settings", "config", "migration", "schema")
MOST_SENSITIVE = ("auth", "secret", "token", "password")
# Labels of release gates, the strictest first.
GATES = ("block until staff/security approval", "staff review required", "targeted owner review", "standard review")


def dependency_changes(changed: DataFrame) -> DataFrame:
    """pr, path, surface, risk of changed dependency and deployment files."""
    name = exprs.file_name(F.col("path"))
    deployed = name.isin("Dockerfile", "docker-compose.yml")
    return changed.filter(name.isin(*DEPENDENCY_FILES)).select("pr", "path", F.when(deployed, "deployment dependency").otherwise("runtime dependency").alias("surface"), F.when(deployed | name.endswith(".lock"), "high").otherwise("medium").alias("risk"))


def api_changes(changed: DataFrame, routed: DataFrame) -> DataFrame:
    """pr, path, routes, risk of changed files with routes (path, routes: their number) or in the interface layer."""
    rows = changed.join(routed, "path", "left").withColumn("routes", F.coalesce("routes", F.lit(0)).cast("long"))
    layer = exprs.case_contains(F.col("path"), rules.REVIEW_LAYERS, "application")
    return rows.filter((F.col("routes") > 0) | (layer == "interface")).select("pr", "path", "routes", F.when(F.col("routes") > 0, "high").otherwise("medium").alias("risk"))


def sensitive_changes(changed: DataFrame) -> DataFrame:
    """pr, path, signals (six at most), risk of changed files whose names speak of security."""
    low = F.lower("path")
    signals = F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in SENSITIVE)))
    return changed.withColumn("signals", signals).filter(F.size("signals") > 0).select("pr", "path", F.slice("signals", 1, 6).alias("signals"), F.when(exprs.any_contains(low, MOST_SENSITIVE), "high").otherwise("medium").alias("risk"))


def related_tests(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """pr, test: tests (path) whose path holds the stem of a changed file, in small letters; one automaton looks for all stems."""
    stem = F.lower(F.split(exprs.file_name(F.col("path")), r"\.")[0])
    stems = written(changed.select("pr", stem.alias("needle")).filter("needle <> ''").distinct())
    found = contained(tests.select(F.col("path").alias("test")).distinct(), stems, "test", "needle", ["test"])
    return found.join(stems, "needle").select("pr", "test").distinct()


def assessment(scores: DataFrame, changed: DataFrame, risks: DataFrame, related: DataFrame, any_tests: bool, deps: DataFrame, apis: DataFrame, commits: DataFrame) -> DataFrame:
    """pr, risk_score and what follows: deployment, release gate, test confidence, regression and review complexity, with their levels.

    scores has pr, risk_score; commits has pr and commits (their number).
    """
    level = lambda c: exprs.level(c, rules.REVIEW_LEVELS, "low")
    per = lambda df, name: df.groupBy("pr").agg(F.count(F.lit(1)).alias(name))
    sizes = changed.groupBy("pr").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"), F.countDistinct(exprs.domain(F.col("path"))).alias("domains"))
    layers = risks.groupBy("pr").agg(F.max(F.col("layer").isin("security", "data")).alias("deep"))
    one = scores.select("pr", "risk_score").join(sizes, "pr").join(layers, "pr").join(commits, "pr", "left")
    for df, name in ((related, "related_tests"), (deps, "dependency_changes"), (apis, "api_changes")):
        one = one.join(per(df, name), "pr", "left")
    one = one.fillna(0, ["related_tests", "dependency_changes", "api_changes", "commits", "lines"])
    deployment = F.least(F.lit(100).cast("long"), F.col("risk_score") + F.when(F.col("deep"), 12).otherwise(0) + F.when(F.col("domains") >= 3, 10).otherwise(0))
    confidence = F.when(F.col("related_tests") > 0, "high").otherwise("medium" if any_tests else "low")
    one = one.withColumns({"deployment_score": deployment, "test_confidence": confidence})
    moved = exprs.by_value(F.col("test_confidence"), {"low": 14, "high": -10}, 0)
    regression = exprs.clamp(F.col("risk_score") + moved + F.col("dependency_changes") * 6 + F.col("api_changes") * 7, 0, 100).cast("long")
    effort = F.least(F.lit(100).cast("long"), F.col("risk_score") + F.col("files") * 2 + F.floor(F.col("lines") / 45) + F.col("commits") * 3)
    one = one.withColumns({"regression_score": regression, "complexity_score": effort, "deployment_level": level(F.col("deployment_score"))})
    score, deployed = F.col("risk_score"), F.col("deployment_level")
    gate = F.when((score >= 75) | (deployed == "critical"), GATES[0]).when((score >= 55) | (deployed == "high"), GATES[1]).when(score >= 35, GATES[2]).otherwise(GATES[3])
    return one.select("pr", "risk_score", "files", "lines", "domains", "related_tests", "dependency_changes", "api_changes", "test_confidence", "deployment_score", "deployment_level", gate.alias("release_gate"), "regression_score", level(F.col("regression_score")).alias("regression_level"), "complexity_score", level(F.col("complexity_score")).alias("complexity_level"))


def touched_by_message(commits: DataFrame, changed: DataFrame, most: int = 8) -> DataFrame:
    """pr, sha, files: changed paths that hold one of the first six words of a commit's message, the first of each commit."""
    paths = changed.groupBy("pr").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # a pull request's own files
    words = F.slice(F.filter(F.split(F.lower(F.trim("message")), r"\s+"), lambda x: x != ""), 1, 6)
    hit = F.filter("paths", lambda p: F.exists("words", lambda w: F.contains(F.lower(p), w)))
    return commits.withColumn("words", words).join(paths, "pr").select("pr", "sha", F.slice(hit, 1, most).alias("files"))
