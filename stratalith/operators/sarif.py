"""Findings in the exchange format of static analysis tools (SARIF 2.1.0), a row of JSON for each repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs

# Levels and security severities of the format.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SEVERITIES = {"critical": "9.5", "high": "8.0", "medium": "5.0", "low": "2.0"}


def results(findings: DataFrame) -> DataFrame:
    """repo_id and result (struct) of each finding: repo_id, rule_id, severity, message, path, line."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine")).alias("region")).alias("physicalLocation"))
    level = exprs.by_value(F.lower("severity"), LEVELS, "warning")
    severity = exprs.by_value(F.lower("severity"), SEVERITIES, "5.0")
    return findings.select("repo_id", F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(severity.alias("security-severity")).alias("properties")).alias("result"))


def rules_of(findings: DataFrame) -> DataFrame:
    """repo_id, rule_id, message of each rule; the last message by path and line wins."""
    last = F.max(F.struct("path", "line", "message"))["message"]
    return findings.groupBy("repo_id", "rule_id").agg(last.alias("message"))


def document_lines(findings: DataFrame, tool: str = "stratalith", version: str = "1.0") -> DataFrame:
    """repo_id, part, place, line: the lines of one document for each repository, in the order of part and place.

    Rules come before results, both by rule; only ranks are computed over a repository, no document is ever put together.
    """
    text = lambda c: F.to_json(c, {"ignoreNullFields": "true"})
    rank = lambda *order: F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    row = lambda part, place, line: [F.lit(part).alias("part"), place.cast("long").alias("place"), line.alias("line")]
    comma = lambda place: F.when(place > 1, F.lit(",")).otherwise(F.lit(""))
    known = findings.filter("repo_id IS NOT NULL")
    rules = rules_of(known).withColumn("n", rank("rule_id"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.coalesce("message", "rule_id").alias("text")).alias("shortDescription"))
    listed = results(known).withColumn("n", rank(F.col("result.ruleId"), F.col("result.locations")[0]["physicalLocation"]["artifactLocation"]["uri"], F.col("result.locations")[0]["physicalLocation"]["region"]["startLine"], F.xxhash64(text("result"))))
    repos = known.select("repo_id").distinct()
    head = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), F.regexp_replace(text(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"))), r"\}$", ""), F.lit(',"rules":['))
    zero = F.lit(0)
    parts = [
        repos.select("repo_id", *row(0, zero, head)), rules.select("repo_id", *row(1, F.col("n"), F.concat(comma(F.col("n")), text(rule)))),
        repos.select("repo_id", *row(2, zero, F.lit(']}},"results":['))), listed.select("repo_id", *row(3, F.col("n"), F.concat(comma(F.col("n")), text("result")))),
        repos.select("repo_id", *row(4, zero, F.lit("]}]}"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_documents(findings: DataFrame, folder: str) -> None:
    """One document for each repository, folder/repo_id=NAME/part-*: sorted lines are written one by one, whatever their number.

    Tasks commit their files, the driver the folder; a task that is lost is run again. Lines are dealt by a hash of the
    name: dealt by the name itself, as the parts of their union are, Spark takes this step for done and leaves it out, and
    the parts of a document end in several files once they are large enough not to be put into one task.
    """
    lines = document_lines(findings).repartition(F.xxhash64("repo_id")).sortWithinPartitions("repo_id", "part", "place")
    lines.select("repo_id", "line").write.option("maxRecordsPerFile", 0).partitionBy("repo_id").mode("overwrite").text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """repo_id, rule_id, level, message, path, line of the results in documents of write_documents, each a file of its own."""
    schema = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(folder)
    each = rows.select("repo_id", F.explode("runs").alias("run")).select("repo_id", F.explode("run.results").alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return each.select("repo_id", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"))


def export(findings: DataFrame, folder: str) -> None:
    """Writes results as JSON lines, partitioned by repository: no report is gathered in one task."""
    results(findings).select("repo_id", "result.*").write.partitionBy("repo_id").mode("overwrite").json(folder)
