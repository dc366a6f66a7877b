"""Captured output of version control as tables: logs with numbers of lines, name and status lists, unified diffs.

A log is one text of a repository. It is split at its marks, so each commit or file is a piece that is read on its own; no
running state is needed, and no order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, CUT = "__COMMIT__", "\x1f"


def safe_int(text: Column) -> Column:
    """Integer of a text, 0 where it is none (a dash for binary files)."""
    return F.coalesce(F.expr("try_cast(NULL AS int)") if text is None else text.try_cast("int"), F.lit(0))


def _pieces(logs: DataFrame) -> DataFrame:
    """repo_id, position, lines of each commit: a text is a list of pieces that begin with the mark."""
    cut = F.filter(F.split("text", f"(?m)^{MARK}"), lambda x: F.trim(x) != "")
    return logs.filter("text IS NOT NULL").select("repo_id", F.posexplode(cut).alias("position", "piece")).select("repo_id", "position", F.split("piece", "\n").alias("lines"))


def commits(logs: DataFrame, most: int | None = None) -> DataFrame:
    """repo_id, position, sha, date, subject, files, additions, deletions of logs (repo_id, text), the newest first."""
    head = F.split(F.col("lines")[0], CUT, 4)
    counted = F.filter(F.transform("lines", lambda x: F.split(x, "\t")), lambda x: F.size(x) == 3)
    total = lambda i: F.aggregate(counted, F.lit(0).cast("long"), lambda a, x: a + safe_int(x[i]))
    rows = _pieces(logs).select("repo_id", "position", head[1].alias("sha"), F.to_date(head[2]).alias("date"), head[3].alias("subject"), F.size(counted).cast("long").alias("files"), total(0).alias("additions"), total(1).alias("deletions"))
    return rows if most is None else rows.filter(F.col("position") < most)


def commit_files(logs: DataFrame) -> DataFrame:
    """repo_id, sha, path, additions, deletions: a row for each file of each commit."""
    counted = F.filter(F.transform("lines", lambda x: F.split(x, "\t")), lambda x: F.size(x) == 3)
    rows = _pieces(logs).select("repo_id", F.split(F.col("lines")[0], CUT, 4)[1].alias("sha"), F.explode(counted).alias("x"))
    return rows.select("repo_id", "sha", F.col("x")[2].alias("path"), safe_int(F.col("x")[0]).alias("additions"), safe_int(F.col("x")[1]).alias("deletions"))


def timeline(logs: DataFrame, most: int = 20) -> DataFrame:
    """repo_id, date, sha, subject, paths of logs whose commits begin with `date|sha|subject` and go on with names of files."""
    head = F.split(F.col("lines")[0], r"\|", 3)
    names = F.filter(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.trim(x) != "")
    return _pieces(logs).filter(F.col("position") < most).select("repo_id", F.to_date(head[0]).alias("date"), head[1].alias("sha"), head[2].alias("subject"), names.alias("paths"))


def status_changes(lists: DataFrame) -> DataFrame:
    """repo_id, status, path of name and status lists (repo_id, text)."""
    lines = lists.filter("text IS NOT NULL").select("repo_id", F.explode(F.split("text", "\n")).alias("line"))
    parts = F.split(F.trim("line"), r"\s+", 2)
    return lines.filter(F.size(parts) == 2).select("repo_id", parts[0].alias("status"), parts[1].alias("path"))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """repo_id, status (A, D, M), path of two snapshots of files (repo_id, path, sha256)."""
    a, b = before.select("repo_id", "path", F.col("sha256").alias("was")), after.select("repo_id", "path", F.col("sha256").alias("now"))
    status = F.when(F.col("was").isNull(), "A").when(F.col("now").isNull(), "D").when(F.col("was") != F.col("now"), "M")
    return a.join(b, ["repo_id", "path"], "full").select("repo_id", status.alias("status"), "path").filter("status IS NOT NULL")


def normal_path(path: Column) -> Column:
    """A path with / between its parts and without ./ before it."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/"), r"^(\./)+", "")


def diff_files(diffs: DataFrame) -> DataFrame:
    """pr, path, additions, deletions, hunks of unified diffs (pr, text)."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n\+\+\+ b/")
    pieces = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    lines = diffs.filter("text IS NOT NULL").select("pr", F.explode(pieces).alias("piece")).select("pr", F.split("piece", "\n").alias("lines"))
    begins = lambda mark, other=None: F.size(F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x.startswith(mark) & (~x.startswith(other) if other else F.lit(True)))).cast("long")
    path = normal_path(F.col("lines")[0])
    rows = lines.select("pr", path.alias("path"), begins("+", "+++").alias("additions"), begins("-", "---").alias("deletions"), begins("@@").alias("hunks"))
    return rows.filter("path NOT IN ('', '/dev/null')").groupBy("pr", "path").agg(*(F.sum(c).alias(c) for c in ("additions", "deletions", "hunks")))
