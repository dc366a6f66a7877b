"""Analyses over all repositories at once: shared dependencies, concentrations, teams, services, risks, remediation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs
from stratalith.operators.knowledge import ranked, team

# Roles that make a domain a service, names that say nothing, weights of findings.
SERVICE_ROLES = ("API boundary", "Data layer", "Trust boundary", "Product capability")
PLAIN_NAMES = ("src", "app", "backend", "frontend")
RISKS = {"critical": 40, "high": 30, "medium": 18, "low": 8}


def overlap_graph(uses: DataFrame, most: int = 160) -> DataFrame:
    """source (repository), target, relation: edges to dependencies that more than one repository has."""
    shared = uses.distinct().groupBy("dependency").agg(F.count(F.lit(1)).alias("repos")).filter("repos > 1")
    first = uses.join(shared, "dependency").orderBy("repo_id", "dependency").limit(most)
    return first.select(F.col("repo_id").alias("source"), F.concat(F.lit("dependency:"), "dependency").alias("target"), F.lit("uses").alias("relation"))


def framework_concentration(stacks: DataFrame) -> DataFrame:
    """framework, repos, portfolio_share (percent), severity."""
    total = F.broadcast(stacks.agg(F.count(F.lit(1)).alias("n")))  # one row
    counted = stacks.select(F.explode("frameworks").alias("framework")).groupBy("framework").agg(F.count(F.lit(1)).alias("repos")).crossJoin(total)
    share = F.col("repos") / F.greatest(F.col("n"), F.lit(1))
    return counted.select("framework", "repos", exprs.dec_round(share * 100, 1).alias("portfolio_share"), exprs.level(share, ((0.8, "high"), (0.5, "medium")), "low").alias("severity"))


def _with_files(spaces: DataFrame, files: DataFrame) -> DataFrame:
    return spaces.join(files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files")), "repo_id")


def ownership_concentration(spaces: DataFrame, files: DataFrame, least: float = 0.25) -> DataFrame:
    """repo_id, name, file_count, share (percent), risk of the six largest domains that hold a quarter of the files or more."""
    first = _with_files(ranked(spaces, 6, F.desc("file_count"), "name"), files)
    share = F.col("file_count") / F.greatest(F.col("files"), F.lit(1))
    kept = first.filter(share >= least)
    return kept.select("repo_id", "name", "file_count", exprs.dec_round(share * 100, 1).alias("share"), F.when(share >= 0.5, "critical ownership concentration").otherwise("ownership concentration").alias("risk"))


def service_risk(spaces: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, name, risk (100 at most) of each domain."""
    share = F.col("file_count") / F.greatest(F.col("files"), F.lit(1))
    total = share * 45 + F.col("security_findings") * 18 + F.when(F.col("routes") > 0, 10).otherwise(0) + F.when(F.col("data_models") > 0, 12).otherwise(0)
    return _with_files(spaces, files).select("repo_id", "name", exprs.dec_round(F.least(F.lit(100.0), total), 1).alias("risk"))


def duplicate_services(spaces: DataFrame, most: int = 20) -> DataFrame:
    """service, repos: services of one name in several repositories."""
    name = F.lower(F.element_at(F.split("name", "/"), -1))
    each = spaces.filter(F.col("role").isin(*SERVICE_ROLES)).select("repo_id", name.alias("service")).distinct().filter(~F.col("service").isin(*PLAIN_NAMES))
    return each.groupBy("service").agg(F.count(F.lit(1)).alias("repos")).filter("repos > 1").orderBy(F.desc("repos"), "service").limit(most)


def top_risks(findings: DataFrame, hot: DataFrame, most: int = 20) -> DataFrame:
    """repo_id, path, risk, risk_score: five findings and three hotspots of each repository, the highest of all."""
    a = ranked(findings, 5, "path", "line", "rule_id").select("repo_id", "path", F.col("message").alias("risk"), exprs.by_value(F.col("severity"), RISKS, 12).cast("long").alias("risk_score"))
    reason = F.when(F.col("sensitive"), "security finding and dependency centrality").otherwise("dependency centrality")
    b = ranked(hot, 3, F.desc("risk_score"), "path").select("repo_id", "path", reason.alias("risk"), F.col("risk_score").cast("long").alias("risk_score"))
    return a.unionByName(b).orderBy(F.desc("risk_score"), "repo_id", "path", "risk").limit(most)


def teams(spaces: DataFrame) -> DataFrame:
    """team, repos, services, critical_services, bus_factor, share (percent of all services), concentration."""
    owned = spaces.withColumn("t", team(F.concat_ws("/", "repo_id", "name")))
    out = owned.groupBy(F.col("t.team").alias("team")).agg(F.countDistinct("repo_id").alias("repos"), F.count(F.lit(1)).alias("services"), F.count_if(F.col("security_findings") > 0).alias("critical_services"), F.min("t.bus_factor").alias("bus_factor"))
    share = F.col("services") / F.sum("services").over(Window.partitionBy())  # five teams
    return out.withColumn("s", share).select("team", "repos", "services", "critical_services", "bus_factor", exprs.dec_round(F.col("s") * 100, 1).alias("share"), exprs.level(F.col("s"), ((0.5, "high"), (0.25, "medium")), "low").alias("concentration"))


def remediation(findings: DataFrame, most: int = 12) -> DataFrame:
    """action, impact (repositories), evidence (six paths) of each rule, the widest first."""
    head = ranked(findings, 6, "repo_id", "path", "line", group="rule_id")
    order = F.row_number().over(Window.partitionBy("rule_id").orderBy("repo_id", "path", "line"))
    shown = head.withColumn("k", order).groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("evidence"))
    wide = findings.groupBy("rule_id").agg(F.countDistinct("repo_id").alias("impact"))
    return wide.join(shown, "rule_id").select(F.concat(F.lit("Remediate "), "rule_id").alias("action"), "impact", "evidence").orderBy(F.desc("impact"), "action").limit(most)


def score(found: DataFrame) -> DataFrame:
    """repositories and mean scores of all."""
    mean = lambda c: exprs.dec_round(F.avg(c), 1).alias(c)
    return found.agg(F.count(F.lit(1)).alias("repositories"), mean("cto"), mean("security"), mean("production"))


