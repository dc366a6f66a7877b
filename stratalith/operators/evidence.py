"""Evidence of scores: signals from graphs and findings, and factors with value, weight and impact for each score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.functions import exprs

# Score -> (factor, weight, lower is better).
FACTORS = {
    "health": [("security", 0.30, False), ("production", 0.30, False), ("debt", 0.20, False), ("cto", 0.20, False)],
    "security": [("critical_signal", 0.35, False), ("high_signal", 0.25, False), ("density_signal", 0.25, False), ("coverage", 0.15, False)],
    "architecture": [("production", 0.40, False), ("graph_signal", 0.20, False), ("route_signal", 0.15, False), ("modularity_signal", 0.15, False), ("hotspot_signal", 0.10, True)],
    "investment": [("cto", 0.45, False), ("security", 0.25, False), ("debt", 0.20, False), ("confidence", 0.10, False)],
    "acquisition": [("cto", 0.24, False), ("security", 0.22, False), ("production", 0.20, False), ("debt", 0.18, False), ("test_confidence", 0.08, False), ("documentation", 0.08, False)],
    "risk": [("finding_risk", 0.34, False), ("hotspot_risk", 0.26, False), ("debt_risk", 0.20, False), ("flag_risk", 0.20, False)],
}


def signals(about: DataFrame, security: DataFrame, entities: DataFrame, relations: DataFrame, hot: DataFrame, acquired: DataFrame, debt: DataFrame) -> DataFrame:
    """One row for each repository with all that the factors name; about are repository.facts, acquired repository.acquisition."""
    per = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    spots = hot.groupBy("repo_id").agg(F.sum("risk_score").alias("hot_sum"))
    one = about.join(security.select("repo_id", "critical", "high", (F.col("critical") + F.col("high") + F.col("medium") + F.col("low")).alias("found")), "repo_id")
    one = one.join(per(entities, "entities"), "repo_id", "left").join(per(relations, "relations"), "repo_id", "left").join(spots, "repo_id", "left")
    one = one.join(acquired.select("repo_id", "test_confidence", "documentation", "readiness"), "repo_id").join(debt.select("repo_id", "debt_items"), "repo_id").fillna(0)
    c, top = F.col, lambda x: F.least(F.lit(100.0), x)
    flags = sum(F.when(c(n) < 55, 1).otherwise(0) for n in ("security", "debt", "production", "cto", "test_confidence", "documentation"))
    floor = lambda x: F.greatest(F.lit(0.0), x)
    return one.withColumns({
        "critical_signal": floor(100 - c("critical") * 25), "high_signal": floor(100 - c("high") * 12), "density_signal": floor(100 - c("found") / F.greatest(c("files"), F.lit(1)) * 120), "coverage": F.lit(100.0),
        "graph_signal": top(c("entities") * 2 + c("relations")), "route_signal": top(45 + c("routes") * 12), "modularity_signal": top(35 + c("domains") * 7 + c("components") * 4), "hotspot_signal": top(c("hotspots") * 12 + c("hot_sum")),
        "finding_risk": top(c("found") * 12), "hotspot_risk": top(c("hotspots") * 14), "debt_risk": top(c("debt_items") * 10), "flag_risk": top(flags * 18),
    })


def factors(given: DataFrame) -> DataFrame:
    """repo_id, score, factor, value, weight, impact, strong (70 or more) in rows."""
    rows = [F.struct(F.lit(score).alias("score"), F.lit(name).alias("factor"), F.col(name).cast("double").alias("value"), F.lit(weight).alias("weight"), F.lit(inverse).alias("inverse")) for score, parts in FACTORS.items() for name, weight, inverse in parts]
    each = given.select("repo_id", F.explode(F.array(*rows)).alias("x")).select("repo_id", "x.*")
    impact = F.when(F.col("inverse"), 100 - F.col("value")).otherwise(F.col("value")) * F.col("weight")
    return each.select("repo_id", "score", "factor", exprs.dec_round(F.col("value"), 1).alias("value"), "weight", exprs.dec_round(impact, 2).alias("impact"), (F.col("value") >= 70).alias("strong"))


def composite(found: DataFrame) -> DataFrame:
    """repo_id, score, value: the sum of impacts of each score, with the number of strong and weak factors."""
    return found.groupBy("repo_id", "score").agg(exprs.dec_round(F.sum(F.col("impact").cast("decimal(20,2)")).cast("double"), 1).alias("value"), F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"))
