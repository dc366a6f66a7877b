"""Drift between two states of repositories: facts of both sides as one long table, joined once, weighed by kind.

A fact is (repo_id, kind, key, payload): a domain with its role and counts, a dependency, an outside service, a route, a
file with routes or data models, a hotspot, a finding, an owner. So every set difference, change of payload and count is an
aggregate over one full join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators import history, knowledge, repository


def facts(files: DataFrame, symbols: DataFrame, findings: DataFrame, env: DataFrame, stack: DataFrame) -> DataFrame:
    """repo_id, kind, key, payload of one side; stack is repository.stack of the files, env code.env_variables."""
    none = F.lit(None).cast("string")
    of = lambda df, kind, key, payload=none: df.select("repo_id", F.lit(kind).alias("kind"), key.alias("key"), payload.alias("payload")).distinct()
    spaces = knowledge.domains(files, symbols, findings)
    special = repository.special_files(files, symbols)
    dependencies = stack.select("repo_id", F.explode(F.concat("frameworks", "package_managers")).alias("name"))
    manifests = files.filter(F.lower("path").rlike(r"(requirements\.txt|pyproject\.toml|package\.json|package-lock\.json)$")).select("repo_id", F.element_at(F.split(F.lower("path"), "/"), -1).alias("name"))
    owner = knowledge.team(F.col("name"))
    hot = knowledge.hotspots(files, knowledge.relations(files, symbols), findings)
    routes = symbols.filter("kind = 'route'")
    parts = [
        of(spaces, "domain", F.col("name"), F.concat_ws("|", "role", "file_count", "routes", "data_models")), of(spaces, "owner", F.col("name"), owner["team"]), of(dependencies.unionByName(manifests), "dependency", F.col("name")),
        of(repository.external_integrations(env, stack), "integration", F.col("name")), of(routes, "api", F.concat_ws(" ", "method", "name", "path")), of(special.filter("routed"), "route file", F.col("path")),
        of(special.filter("stored"), "model file", F.col("path")), of(hot, "hotspot", F.col("path")), of(findings, "finding", F.concat_ws(":", "path", "rule_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """repo_id, kind, key, change (added, removed, changed), was, now of all facts that differ."""
    key = ["repo_id", "kind", "key"]
    a, b = before.select(*key, F.col("payload").alias("was"), F.lit(1).alias("a")), after.select(*key, F.col("payload").alias("now"), F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, key, "full").withColumn("change", change).filter("change IS NOT NULL").select(*key, "change", "was", "now")


def posture(findings: DataFrame) -> DataFrame:
    """repo_id, weight of all findings."""
    return findings.groupBy("repo_id").agg(F.sum(exprs.by_value(F.col("severity"), rules.POSTURE_WEIGHT, 0)).alias("weight"))


def drift(found: DataFrame, before: DataFrame, after: DataFrame, findings: tuple[DataFrame, DataFrame], scores: tuple[DataFrame, DataFrame]) -> DataFrame:
    """repo_id, the counts that drift is made of, drift_score, drift_level; scores have repo_id, name, value."""
    n = lambda kind, change, name: F.count_if((F.col("kind") == kind) & (F.col("change") == change)).alias(name)
    counted = found.groupBy("repo_id").agg(
        n("domain", "added", "domains_added"), n("domain", "removed", "domains_removed"), n("domain", "changed", "domains_changed"), n("dependency", "added", "dependencies_added"), n("dependency", "removed", "dependencies_removed"),
        n("integration", "added", "integrations_added"), n("api", "added", "api_added"), n("api", "removed", "api_removed"), F.count_if((F.col("kind") == "owner") & (F.col("change") == "added") & (F.col("now") == "Core Engineering")).alias("orphaned_added"),
    )
    sizes = lambda df, side: df.groupBy("repo_id").agg(*(F.count_if(F.col("kind") == f"{k} file").alias(f"{k}_{side}") for k in ("route", "model")))
    both = sizes(before, "a").join(sizes(after, "b"), "repo_id", "full").fillna(0).select("repo_id", *(F.abs(F.col(f"{k}_b") - F.col(f"{k}_a")).alias(f"{k}_delta") for k in ("route", "model")))
    weight = posture(findings[0]).withColumnRenamed("weight", "a").join(posture(findings[1]).withColumnRenamed("weight", "b"), "repo_id", "full").fillna(0)
    a, b = (s.select("repo_id", "name", F.col("value").alias(c)) for s, c in zip(scores, "ab", strict=True))
    drops = a.join(b, ["repo_id", "name"], "full").fillna(0).groupBy("repo_id").agg(F.count_if(F.col("b") - F.col("a") <= -10).alias("score_drops"))
    one = counted.join(both, "repo_id", "left").join(weight.select("repo_id", F.greatest(F.lit(0).cast("long"), F.col("b") - F.col("a")).alias("severity_delta")), "repo_id", "left").join(drops, "repo_id", "left")
    return history.drift_score(one.fillna(0))


def visual_diff(found: DataFrame, most: int = 80) -> DataFrame:
    """repo_id, node, kind, change: what a picture of the drift shows, the first of each repository."""
    return knowledge.ranked(found.select("repo_id", F.concat_ws(":", "kind", "key").alias("node"), "kind", "change"), most, "kind", "change", "node")
