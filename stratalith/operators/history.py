"""Repository evolution and comparisons: file history, timelines, coupling, drift, ownership, pull-request risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.sources.shared import dealt, written


def file_history(touched: DataFrame, commits: DataFrame) -> DataFrame:
    """touches, first_seen, last_seen, churn of each file; churn adds the whole commit's lines to each file it touches."""
    totals = touched.groupBy("sha").agg(F.sum(F.col("additions") + F.col("deletions")).alias("churn"))
    dated = touched.select("sha", "file").join(totals, "sha").join(commits.select("sha", "date"), "sha")
    return dated.groupBy("file").agg(F.count(F.lit(1)).alias("touches"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.sum("churn").alias("churn"))


def timeline(touched: DataFrame, commits: DataFrame, days: int = 30) -> DataFrame:
    """commit_count, files and capped risk of each day, the last `days` days."""
    dated = touched.select("sha", "file").join(commits.select("sha", "date"), "sha")
    daily = dated.groupBy("date").agg(F.countDistinct("sha").alias("commit_count"), F.countDistinct("file").alias("files"))
    last = daily.orderBy(F.desc("date")).limit(days)
    return last.withColumn("risk", F.least(F.lit(100).cast("long"), F.col("commit_count") * 4 + F.col("files") * 2))


def coupling(touched: DataFrame, most: int = 20, least_files: int = 2, most_files: int = 40) -> DataFrame:
    """Pairs of files of different domains that change together, by number of commits.

    Commits outside 2 .. 40 files don't count, so a commit makes 780 pairs at most. A commit's files are gathered once,
    the first of them up to one more than count, and paired in its row; commits are dealt in tasks of bounded rows.
    """
    rows = dealt(written(touched.select("sha", "file", "domain").filter("sha IS NOT NULL")), "sha", rows=200_000)
    first = rows.distinct().withColumn("__r", F.row_number().over(Window.partitionBy("sha").orderBy("file", "domain"))).filter(F.col("__r") <= most_files + 1)
    commits = first.groupBy("sha").agg(F.collect_list(F.struct("file", "domain")).alias("files")).filter(F.size("files").between(least_files, most_files))
    pairs = commits.select("files", F.explode("files").alias("a")).select("a", F.explode("files").alias("b")).filter("a.file < b.file AND a.domain <> b.domain")
    counted = pairs.groupBy(F.col("a.file").alias("source"), F.col("b.file").alias("target")).agg(F.count(F.lit(1)).alias("co_changes"))
    return counted.orderBy(F.desc("co_changes"), "source", "target").limit(most)


def hot_files(touched: DataFrame, most: int = 20) -> DataFrame:
    counted = touched.groupBy("file", "domain").agg(F.count(F.lit(1)).alias("touches"), F.sum("additions").alias("additions"))
    return counted.orderBy(F.desc("touches"), F.desc("additions"), "file").limit(most)


def set_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: added, removed or unchanged."""
    a, b = (df.select(key).distinct().withColumn(f"__{n}", F.lit(True)) for n, df in (("a", before), ("b", after)))
    both = a.join(b, key, "full")
    return both.select(key, F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("unchanged").alias("change"))


def changed_payload(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys on both sides whose other columns differ (null equals null), with both values."""
    rest = [c for c in before.columns if c != key]
    a = before.select(key, *(F.col(c).alias(f"before_{c}") for c in rest))
    b = after.select(key, *(F.col(c).alias(f"after_{c}") for c in rest))
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    return a.join(b, key).filter(~same)


def deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, delta with zeros where a side has none."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def ownership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """area, change: added, removed, owner_changed or orphaned (added without owner); unchanged areas have no row."""
    a, b = before.select("area", F.col("owner").alias("was"), F.lit(1).alias("__a")), after.select("area", F.col("owner").alias("now"), F.lit(1).alias("__b"))
    change = F.when(F.col("__a").isNull() & F.col("now").isNull(), "orphaned").when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "owner_changed")
    return a.join(b, "area", "full").withColumn("change", change).filter("change IS NOT NULL").select("area", "was", "now", "change")


def drift_score(counts: DataFrame, weights: dict[str, int] = rules.DRIFT_WEIGHTS) -> DataFrame:
    """counts with drift_score (weighted, 100 at most) and drift_level; a missing count column is zero."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items() if c in counts.columns), F.lit(0))
    return counts.withColumn("drift_score", F.least(F.lit(100).cast("long"), total.cast("long"))).withColumn("drift_level", exprs.level(F.col("drift_score"), rules.DRIFT_LEVELS, "stable"))


def review_risk(changed: DataFrame, hotspots: DataFrame, findings: DataFrame) -> DataFrame:
    """pr, path, layer, language, risk of each changed file: three left joins and an additive score.

    hotspots has path and risk_score, findings has path (a row for each serious finding); where they and changed have
    repo_id too, paths are those of one repository.
    """
    keys = lambda df: [c for c in ("repo_id", "path") if c in df.columns and c in changed.columns]
    serious = findings.select(keys(findings)).distinct().withColumn("__finding", F.lit(True))
    path, layer = F.col("path"), F.col("layer")
    score = (
        F.least(F.lit(30), F.coalesce("risk_score", F.lit(0))) + F.when(F.col("__finding"), 25).otherwise(0)
        + F.when(layer.isin("interface", "data", "security"), 16).otherwise(0)
        + F.when(F.col("language").isin("Dockerfile", "YAML", "JSON") | path.endswith("pyproject.toml") | path.endswith("package.json") | path.endswith("docker-compose.yml"), 12).otherwise(0)
        - F.when(F.lower(path).contains("test") | F.lower(path).contains("spec"), 10).otherwise(0)
    )
    rows = changed.withColumns({"layer": exprs.case_contains(path, rules.REVIEW_LAYERS, "application"), "language": exprs.language(path)})
    rows = rows.join(hotspots.select(*keys(hotspots), "risk_score"), keys(hotspots), "left").join(serious, keys(findings), "left")
    return rows.select("pr", "path", "layer", "language", F.greatest(F.lit(0), score).cast("long").alias("risk"))


def review_score(files: DataFrame) -> DataFrame:
    """pr, risk_score, risk_level: 15 and the files' risks and 8 for each domain, within 0 .. 100."""
    score = F.lit(15) + F.sum("risk") + F.countDistinct(exprs.domain(F.col("path"))) * 8
    return files.groupBy("pr").agg(F.least(F.lit(100).cast("long"), score).alias("risk_score")).withColumn("risk_level", exprs.level(F.col("risk_score"), rules.REVIEW_LEVELS, "low"))


def impacted_domains(domains: DataFrame, paths: DataFrame) -> DataFrame:
    """Domains named in a changed path, with their number of changed paths.

    The containment join is turned into an equi-join: a domain has one or two path parts, so each path offers its parts
    and neighbouring pairs of parts.
    """
    parts = F.split("path", "/")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(parts, i, F.lit(2))))
    offered = paths.select("path", F.explode(F.array_distinct(F.concat(parts, pairs))).alias("name"))
    return offered.join(domains.select("name"), "name").groupBy("name").agg(F.countDistinct("path").alias("changed_files"))


def ranked_within(df: DataFrame, group: str, *order, most: int) -> DataFrame:
    """The first `most` rows of each group with their rank r."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("r") <= most)


def as_of(points: DataFrame, snapshots: DataFrame, columns: list[str], key: str = "repo_id", at: str = "at", width: str = "month") -> DataFrame:
    """points (key, at) with the last non-null value of each column in snapshots (key, at, columns) at or before them.

    A key's time is split in ranges of `width`: within one, values are carried by a window; what the ranges before it leave
    comes from one row a range. So a key with very many rows is sorted in many tasks. Of snapshots at one time the greatest
    value counts.
    """
    part = F.date_trunc(width, F.col(at))
    one = snapshots.groupBy(key, at).agg(*(F.max(c).alias(c) for c in columns))
    both = points.select(key, at).distinct().withColumn("__asked", F.lit(True)).unionByName(one.withColumn("__asked", F.lit(False)), allowMissingColumns=True).withColumn("__part", part)
    inside = Window.partitionBy(key, "__part").orderBy(at, "__asked").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumns({c: F.last(c, True).over(inside) for c in columns}).filter("__asked").drop("__asked")
    ends = one.withColumn("__part", part).groupBy(key, "__part").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(at, c)))[c].alias(c) for c in columns))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.select(key, "__part").distinct().join(ends, [key, "__part"], "left")
    carried = ranges.select(key, "__part", *(F.last(c, True).over(before).alias(f"__{c}") for c in columns))
    return local.join(carried, [key, "__part"]).select(key, at, *(F.coalesce(c, f"__{c}").alias(c) for c in columns))
