"""JSON payloads as tables: pull requests (files, commits, comments, checks) and reports of scanners; nothing is fetched.

Texts are read by a given schema inside the JVM; a broken text gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PULL_FILE = "array<struct<filename:string,status:string,additions:int,deletions:int,changes:int,previous_filename:string,patch:string>>"
PULL_COMMIT = "array<struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>,author:struct<login:string>,html_url:string>>"
PULL_COMMENT = "array<struct<user:struct<login:string>,body:string,created_at:string,path:string,line:int,position:int>>"
PULL_CHECK = "array<struct<name:string,status:string,conclusion:string>>"
BANDIT = "struct<results:array<struct<filename:string,test_id:string,issue_severity:string,line_number:int,issue_text:string>>>"
SEMGREP = "struct<results:array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<impact:string>>>>>"
TRIVY = "struct<Results:array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,Severity:string,PkgName:string,Title:string>>>>>"
# Severities of a scanner that speaks of errors.
SEMGREP_SEVERITIES = {"error": "high", "warning": "medium", "info": "low"}


def _rows(df: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    return df.select(key, F.explode(F.from_json(text, schema)).alias("x"))


def pull_files(pulls: DataFrame) -> DataFrame:
    """pr, path, status, additions, deletions, changes of payloads (pr, files)."""
    zero = lambda c: F.coalesce(f"x.{c}", F.lit(0)).alias(c)
    return _rows(pulls, "pr", "files", PULL_FILE).select("pr", F.coalesce("x.filename", F.lit("")).alias("path"), F.coalesce("x.status", F.lit("")).alias("status"), zero("additions"), zero("deletions"), zero("changes"))


def pull_commits(pulls: DataFrame) -> DataFrame:
    """pr, sha, message (its first line), author, date of payloads (pr, commits)."""
    author = F.coalesce(F.nullif("x.commit.author.name", F.lit("")), "x.author.login", F.lit(""))
    return _rows(pulls, "pr", "commits", PULL_COMMIT).select("pr", "x.sha", F.split(F.coalesce("x.commit.message", F.lit("")), r"\r?\n")[0].alias("message"), author.alias("author"), F.coalesce("x.commit.author.date", F.lit("")).alias("date"))


def pull_comments(pulls: DataFrame, most: int = 1000) -> DataFrame:
    """pr, author, body (cut to `most` characters, as shown), path, line of payloads (pr, comments)."""
    return _rows(pulls, "pr", "comments", PULL_COMMENT).select("pr", F.coalesce("x.user.login", F.lit("")).alias("author"), F.substring(F.coalesce("x.body", F.lit("")), 1, most).alias("body"), F.coalesce("x.path", F.lit("")).alias("path"), F.coalesce("x.line", "x.position").alias("line"))


def pull_checks(pulls: DataFrame) -> DataFrame:
    """pr, name, status, conclusion of payloads (pr, checks)."""
    return _rows(pulls, "pr", "checks", PULL_CHECK).select("pr", "x.name", "x.status", "x.conclusion")


def _finding(repo: Column, path: Column, rule: Column, severity: Column, line: Column, message: Column) -> list[Column]:
    return [repo.alias("repo_id"), F.coalesce(path, F.lit("")).alias("path"), rule.alias("rule_id"), F.lower(severity).alias("severity"), F.coalesce(line, F.lit(1)).cast("int").alias("line"), message.alias("message")]


def scanner_findings(reports: DataFrame) -> DataFrame:
    """repo_id, path, rule_id, severity, line, message of reports (repo_id, scanner, text): bandit, semgrep, trivy; the union of all."""
    of = lambda name, schema: reports.filter(F.col("scanner") == name).select("repo_id", F.from_json("text", schema).alias("p"))
    c = F.col
    bandit = of("bandit", BANDIT).select("repo_id", F.explode("p.results").alias("x"))
    semgrep = of("semgrep", SEMGREP).select("repo_id", F.explode("p.results").alias("x"))
    trivy = of("trivy", TRIVY).select("repo_id", F.explode("p.Results").alias("r")).select("repo_id", "r.Target", F.explode("r.Vulnerabilities").alias("x"))
    said = F.lower(F.coalesce(c("x.extra.severity"), c("x.extra.metadata.impact"), F.lit("medium")))
    severity = reduce(lambda acc, kv: F.when(said == kv[0], kv[1]).otherwise(acc), SEMGREP_SEVERITIES.items(), said)
    return (
        bandit.select(*_finding(c("repo_id"), c("x.filename"), F.coalesce("x.test_id", F.lit("bandit")), F.coalesce("x.issue_severity", F.lit("medium")), c("x.line_number"), F.coalesce("x.issue_text", F.lit("Bandit finding"))))
        .unionByName(semgrep.select(*_finding(c("repo_id"), c("x.path"), F.coalesce("x.check_id", F.lit("semgrep")), severity, c("x.start.line"), F.coalesce("x.extra.message", F.lit("Semgrep finding")))))
        .unionByName(trivy.select(*_finding(c("repo_id"), c("Target"), F.concat(F.lit("trivy-"), F.coalesce("x.VulnerabilityID", F.lit("vulnerability"))), F.coalesce("x.Severity", F.lit("medium")), F.lit(1), F.concat_ws(" ", F.coalesce("x.PkgName", F.lit("dependency")), F.concat(F.coalesce("x.VulnerabilityID", F.lit("")), F.lit(":")), F.coalesce("x.Title", F.lit("Vulnerable dependency"))))))
    )
