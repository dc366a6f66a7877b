"""Reports as rows: diagrams, Markdown, retrieval texts, redacted records, services, states of jobs. Nothing is gathered whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators.knowledge import ranked, team

# Moves between the states of a job that count.
MOVES = {"queued": ("running", "cancelled"), "running": ("complete", "failed", "cancel_requested"), "cancel_requested": ("cancelled", "complete", "failed")}


def diagram(edges: DataFrame, most: int = 40) -> DataFrame:
    """repo_id, diagram: a flow chart of the first edges (source, target, relation) of each repository, in their order."""
    clean = lambda c: F.substring(F.translate(F.replace(c, F.lit('"'), F.lit("'")), "\n", " "), 1, 90)
    first = ranked(edges, most, "source", "target", "relation").withColumn("r", F.row_number().over(Window.partitionBy("repo_id").orderBy("source", "target", "relation")))
    line = F.concat(F.lit('  "'), clean(F.col("source")), F.lit('" -->|'), F.col("relation"), F.lit('| "'), clean(F.col("target")), F.lit('"'))
    return first.groupBy("repo_id").agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x["t"]), "\n")).alias("diagram"))


def markdown(found: DataFrame, titles: dict[str, str]) -> DataFrame:
    """repo_id, text: a table of a repository's scores, a line for each of the titled columns."""
    lines = [F.concat(F.lit(f"| {title} | "), F.format_number(F.col(c).cast("double"), 1), F.lit(" |")) for c, title in titles.items()]
    head = F.concat(F.lit("# "), F.col("repo_id"), F.lit("\n\n| Score | Value |\n| --- | --- |"))
    return found.select("repo_id", F.concat_ws("\n", head, *lines).alias("text"))


def retrieval_text(path: Column, first: Column, last: Column, text: Column) -> Column:
    """What is indexed of a chunk: where it stands, and its redacted text."""
    return F.concat(F.lit("File: "), path, F.lit("\nLines: "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n"), exprs.redact(text))


def redacted_map(record: Column) -> Column:
    """All values of a map of texts redacted."""
    return F.transform_values(record, lambda k, v: exprs.redact(v))


def services(symbols: DataFrame, most: int = 60) -> DataFrame:
    """repo_id, path, routes, symbols of files with either, the most routed first."""
    counted = symbols.groupBy("repo_id", "path").agg(F.count_if(F.col("kind") == "route").alias("routes"), F.count_if(F.col("kind").isin("class", "function", "method")).alias("symbols"))
    return ranked(counted.filter("routes > 0 OR symbols > 0"), most, F.desc("routes"), F.desc("symbols"), "path")


def owners(spaces: DataFrame, found: DataFrame, risks: DataFrame) -> DataFrame:
    """team, domains, routes, symbols, worst: what each team's domains hold; found are services, risks path risks."""
    inside = found.withColumn("name", exprs.domain(F.col("path"), stem=True)).groupBy("repo_id", "name").agg(F.sum("routes").alias("r"), F.sum("symbols").alias("s"))
    worst = risks.withColumn("name", exprs.domain(F.col("path"), stem=True)).groupBy("repo_id", "name").agg(F.max("risk").alias("risk"))
    one = spaces.select("repo_id", "name", team(F.col("name"))["team"].alias("team")).join(inside, ["repo_id", "name"], "left").join(worst, ["repo_id", "name"], "left").fillna(0)
    return one.groupBy("team").agg(F.count(F.lit(1)).alias("domains"), F.sum("r").alias("routes"), F.sum("s").alias("symbols"), F.max("risk").alias("worst"))


def service_nodes(found: DataFrame, hot: DataFrame, risks: DataFrame, most: int | None = 120) -> DataFrame:
    """repo_id, path, domain, layer, routes, symbols, risk of the files that services (found) or hotspots name, the first by path."""
    named = found.select("repo_id", "path").unionByName(hot.select("repo_id", "path")).distinct()
    out = named.join(found.select("repo_id", "path", "routes", "symbols"), ["repo_id", "path"], "left").join(risks.select("repo_id", "path", "risk"), ["repo_id", "path"], "left").fillna(0, ["routes", "symbols", "risk"])
    out = out.select("repo_id", "path", exprs.domain(F.col("path"), stem=True).alias("domain"), exprs.case_contains(F.col("path"), rules.EXPLORER_LAYERS, "Application").alias("layer"), "routes", "symbols", "risk")
    return out if most is None else ranked(out, most, "path")


def service_edges(links: DataFrame, nodes: DataFrame, risks: DataFrame, most: int = 240) -> DataFrame:
    """repo_id, source, target, relation, risk (the higher of both ends) of the edges that touch a service node, the first by their ends."""
    touched = nodes.select("repo_id", "path").distinct()
    hit = lambda c: links.join(touched.withColumnRenamed("path", c), ["repo_id", c], "left_semi").select("repo_id", "source", "target", "relation")
    both = hit("source").unionByName(hit("target")).distinct()
    for c in ("source", "target"):
        both = both.join(risks.select("repo_id", F.col("path").alias(c), F.col("risk").alias(f"{c}_risk")), ["repo_id", c], "left")
    risk = F.greatest(F.coalesce("source_risk", F.lit(0)), F.coalesce("target_risk", F.lit(0)))
    return ranked(both.select("repo_id", "source", "target", "relation", risk.alias("risk")), most, "source", "target", "relation")


def job_states(moves: DataFrame) -> DataFrame:
    """job_id, state, moves, refused of events (job_id, position, wanted): moves that are not allowed change nothing.

    A job starts queued; its events are folded in order. A job has a handful of events.
    """
    events = moves.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("position", "wanted"))).alias("events"))
    start = F.struct(F.lit("queued").alias("state"), F.lit(0).alias("moves"), F.lit(0).alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        allowed = F.lit(False)
        for state, following in MOVES.items():
            allowed = allowed | ((acc["state"] == state) & e["wanted"].isin(*following))
        return F.when(allowed, F.struct(e["wanted"].alias("state"), (acc["moves"] + 1).alias("moves"), acc["refused"].alias("refused"))).otherwise(F.struct(acc["state"].alias("state"), acc["moves"].alias("moves"), (acc["refused"] + 1).alias("refused")))

    return events.select("job_id", F.aggregate("events", start, step).alias("x")).select("job_id", "x.*")
