"""What screens and reports show of findings, graphs, reports and answers; and chunks that follow symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators.knowledge import ranked
from stratalith.operators.search import chunks, pieces

# Levels of an executive score, and labels of nodes by kind.
RISK_STEPS = ((85, "low"), (70, "moderate"), (50, "elevated"))
LABELS = {"repository": "Repository", "directory": "Directory", "file": "File", "class": "Class", "function": "Function", "dependency": "Dependency", "api": "API", "risk": "Risk", "security_finding": "SecurityFinding", "report": "Report", "owner": "Owner", "service": "Service", "domain": "Domain", "test": "Test", "deployment": "Deployment", "pr": "PR", "incident": "Incident"}


def executive_score(scores: list[Column]) -> Column:
    """Mean of the scores that are there, 0 to 100, as an integer; null without any."""
    there = F.array_compact(F.array(*(s.cast("double") for s in scores)))
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(there), F.lit(1))
    return F.when(F.size(there) > 0, exprs.dec_round(exprs.clamp(mean, 0.0, 100.0), 0).cast("long"))


def risk_level(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").otherwise(exprs.level(score, RISK_STEPS, "critical"))


def top_findings(findings: DataFrame, most: int = 5) -> DataFrame:
    """The most severe findings of each repository; ties by path, line and rule."""
    return ranked(findings, most, F.desc(exprs.by_value(F.lower("severity"), rules.RANK, 0)), "path", "line", "rule_id")


def sections(reports: DataFrame, most: int = 12) -> DataFrame:
    """report, position, title, body of the sections of Markdown texts (report, text): a heading and what follows it."""
    pieces = F.filter(F.split(F.concat(F.lit("\n"), "text"), r"\n#{1,3}\s+"), lambda x: F.trim(x) != "")
    rows = reports.filter("text IS NOT NULL").select("report", F.posexplode(F.slice(pieces, 1, most)).alias("position", "piece"))
    return rows.select("report", "position", F.trim(F.split("piece", "\n", 2)[0]).alias("title"), F.regexp_replace(F.coalesce(F.get(F.split("piece", "\n", 2), F.lit(1)), F.lit("")), r"^\s+|\s+$", "").alias("body"))


def changed_paths(text: Column) -> Column:
    """Paths of a list parted by lines or commas."""
    return F.filter(F.transform(F.split(text, r"[\n,]"), lambda x: F.trim(x)), lambda x: x != "")


def graph_score(nodes: Column, edges: Column, findings: Column) -> Column:
    return exprs.clamp(nodes * 4 + edges * 2 - findings * 6, 35, 100)


def nodes_like(nodes: DataFrame, group: str | None, text: str) -> DataFrame:
    """Nodes of a kind (all without one) whose id or label holds a text, in small letters."""
    low = text.lower()
    hit = F.lower("id").contains(low) | F.lower("label").contains(low)
    return nodes.filter(hit if group is None else hit & (F.col("kind") == group))


def node_labels(kind: Column) -> Column:
    return exprs.by_value(kind, LABELS, "Node")


def taxonomy_counts(findings: DataFrame) -> DataFrame:
    """kind (owasp or cwe), name, findings."""
    each = F.explode(F.array(F.struct(F.lit("owasp").alias("kind"), F.col("owasp").alias("name")), F.struct(F.lit("cwe").alias("kind"), F.col("cwe").alias("name")))).alias("x")
    return findings.select(each).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("findings"))


def slug(text: Column, most: int = 180) -> Column:
    """Small letters, digits and single dashes."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def safe_name(text: Column) -> Column:
    """A repository's name with letters, digits, dots, dashes and underscores alone."""
    out = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(out == "", "repository").otherwise(out)


def symbol_chunks(files: DataFrame, symbols: DataFrame, most: int | None = None) -> DataFrame:
    """path, line_start, line_end, kind, symbol, text: from each class or function to the next one; files without any in pieces of fixed size.

    symbols are those of operators.code; lines before the first symbol belong to no chunk of a symbol. A file is split into
    lines once for all its symbols. With `most`, a symbol of more characters comes in overlapping pieces of that size.
    """
    starts = symbols.filter("kind IN ('class', 'function') AND owner IS NULL").groupBy("repo_id", "path", "line").agg(F.min("name").alias("symbol"))
    bounds = starts.groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(F.struct("line", "symbol"))).alias("bounds"))  # of one file
    own = files.select("repo_id", "path", "text").join(bounds, ["repo_id", "path"])
    schema = own.select("repo_id", "path", F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("").alias("symbol"), "text").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (text, bound) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                lines = (text or "").split("\n")
                for this, following in zip(bound, [*bound[1:], None], strict=True):
                    first, last = this["line"], following["line"] - 1 if following else len(lines)
                    body = "\n".join(lines[first - 1 : last]).strip("\n")
                    if body and most and len(body) > most:
                        out += [(i, first + a - 1, first + z - 1, this["symbol"], piece) for _, piece, a, z in pieces(body, most, most // 8)]
                    elif body:
                        out.append((i, first, last, this["symbol"], body))
            row, first, last, symbol, text = map(list, zip(*out, strict=True)) if out else ([], [], [], [], [])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(symbol, pa.string()), pa.array(text, pa.string())], names=schema.names)

    found = own.mapInArrow(cut, schema).select("repo_id", "path", "line_start", "line_end", F.lit("symbol").alias("kind"), "symbol", "text")
    rest = files.join(starts.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    plain = chunks(rest.select(F.struct("repo_id", "path").alias("path"), "text"))
    return found.unionByName(plain.select("path.repo_id", "path.path", "line_start", "line_end", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("symbol"), "text"))


def series_by_date(*series: tuple[str, DataFrame]) -> DataFrame:
    """date and a column for each named series (date, value); dates of any of them, null where one has none."""
    out = None
    for name, df in series:
        one = df.select("date", F.col("value").alias(name))
        out = one if out is None else out.join(one, "date", "full")
    return out


def with_last(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """rows (repo_id, date, ..) with `column` replaced on the last date of each repository."""
    last = rows.groupBy("repo_id").agg(F.max("date").alias("__last"))
    return rows.join(last, "repo_id").withColumn(column, F.when(F.col("date") == F.col("__last"), value).otherwise(F.col(column))).drop("__last")


def purgeable(rows: DataFrame, now: str) -> DataFrame:
    """Finished repositories (status, deleted, updated_at, retention_minutes) whose retention is over."""
    over = F.col("updated_at") <= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.col("retention_minutes"))
    return rows.filter(F.col("status").isin("complete", "failed") & ~F.col("deleted") & over)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new put in: of each key the latest by `order`, new before old in a tie."""
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    rest = [c for c in old.columns if c not in (key, order)]
    best = both.groupBy(key).agg(F.max(F.struct(order, "__side", *rest)).alias("x"))
    return best.select(*(F.col(key) if c == key else F.col(f"x.{c}") for c in old.columns))
