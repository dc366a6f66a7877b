"""Containment joins: which texts hold which needles, by one automaton over all needles, and what is built on them.

All needles are searched at once while a text is read once; a pair of text and needle is a row only if the one holds the
other. Needles are counted in bytes first: as many parts as it takes to keep one part within `sent` bytes, each with an
automaton of its own that is sent to the tasks. The texts are read once a part, and neither they nor the needles are ever
gathered; a text that a third of all needles are in gives that many rows, which is the result's size.

Comparisons are in small letters. Defined cases: null or empty texts and needles match nothing; repeated needles count
once, repeated texts each; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs
from stratalith.operators.knowledge import ranked
from stratalith.sources.shared import written

# Words by which parts of a repository belong to a request flow; the first that fits is not enough, any is.
FLOW_INTENTS = {
    "authentication": ("auth", "login", "session", "jwt", "token", "user"),
    "login": ("login", "signin", "session", "auth", "token"),
    "signup": ("signup", "register", "registration", "user", "account"),
    "payment": ("payment", "checkout", "stripe", "billing", "invoice"),
    "file_upload": ("upload", "file", "zip", "multipart", "attachment"),
    "data_flow": ("data", "store", "repository", "database", "model", "schema"),
    "notification": ("notification", "email", "webhook", "message", "event"),
}
#: Rows of each kind that a flow's steps are made of, and of a flow whose intent is data and that matches nothing.
STEPS = {"route": 1, "service": 4, "model": 3, "external": 2}


def contained(texts: DataFrame, needles: DataFrame, text: str, needle: str, keep: list[str], sent: int = 32 << 20) -> DataFrame:
    """The keep columns of texts with each needle (in small letters) that the text holds."""
    low = needles.select(F.lower(F.col(needle)).alias("needle")).filter("needle <> ''").distinct()
    low = written(low)
    size = low.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()[0]
    parts = max(1, -(-size // sent))
    given = texts.filter(F.col(text) != "").select(*keep, F.lower(F.col(text)).alias("__text"))
    schema = given.withColumnRenamed("__text", "needle").schema
    context = texts.sparkSession.sparkContext

    def searched(part: int) -> DataFrame:
        mine = low.filter(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part) if parts > 1 else low
        words = context.broadcast([r["needle"] for r in mine.collect()])  # about `sent` bytes

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in words.value:
                automaton.add_word(w, w)
            if not len(automaton):
                return
            automaton.make_automaton()
            for frame in frames:
                found = [sorted({w for _, w in automaton.iter(t)}) for t in frame["__text"]]
                out = frame[keep].assign(needle=found).explode("needle")
                yield out[out["needle"].notna()]

        return given.mapInPandas(search, schema)

    return reduce(DataFrame.unionByName, (searched(i) for i in range(parts)))


def impacted(domains: DataFrame, paths: DataFrame) -> DataFrame:
    """repo_id, name, changed_files: domains (name, samples) of which a changed path (repo_id, path) is a sample, or whose name it holds."""
    named = contained(paths, domains, "path", "name", ["repo_id", "path"])
    by_name = named.join(domains.select("repo_id", "name", F.lower("name").alias("needle")), ["repo_id", "needle"]).select("repo_id", "name", "path")
    samples = domains.select("repo_id", "name", F.explode("samples").alias("path"))
    return by_name.unionByName(samples.join(paths.select("repo_id", "path"), ["repo_id", "path"]).select("repo_id", "name", "path")).groupBy("repo_id", "name").agg(F.countDistinct("path").alias("changed_files"))


def affected_services(questions: DataFrame, chunks: DataFrame, domains: DataFrame, most: int = 8) -> DataFrame:
    """question_id, repo_id, service, role, risk: domains that a question (question_id, text) names, or of whose samples one holds or lies in the path of one of its chunks (question_id, repo_id, path)."""
    asked = contained(questions, domains, "text", "name", ["question_id"])
    low = domains.select("repo_id", "name", F.lower("name").alias("needle"))
    by_name = asked.join(low, "needle").select("question_id", "repo_id", "name")
    samples = written(domains.select("repo_id", "name", F.explode(F.transform("samples", F.lower)).alias("sample")).filter("sample <> ''"))
    wanted = written(chunks.select("question_id", "repo_id", F.lower("path").alias("path")).filter("path <> ''").distinct())
    paths, held = wanted.select("repo_id", "path").distinct(), samples.select("repo_id", "sample").distinct()
    inside = contained(paths, held, "path", "sample", ["repo_id", "path"]).withColumnRenamed("needle", "sample")
    around = contained(held, paths, "sample", "path", ["repo_id", "sample"]).withColumnRenamed("needle", "path")
    pairs = inside.unionByName(around).distinct()
    by_path = wanted.join(pairs, ["repo_id", "path"]).join(samples, ["repo_id", "sample"]).select("question_id", "repo_id", "name")
    risk = F.when(F.col("security_findings") > 0, "high").when(F.col("routes") > 0, "medium").otherwise("low")
    found = by_name.unionByName(by_path).distinct().join(domains.select("repo_id", "name", "role", risk.alias("risk"), "file_count"), ["repo_id", "name"])
    first = ranked(found.withColumn("__q", F.struct("question_id", "repo_id")), most, F.desc("file_count"), "name", group="__q")
    return first.select("question_id", "repo_id", F.col("name").alias("service"), "role", "risk")


def flow_members(parts: DataFrame) -> DataFrame:
    """repo_id, intent, kind, path, name, detail, rank of what belongs to each request flow.

    parts (repo_id, kind: route, service, model or external, path, name, detail, about) are matched by the words of their
    `about`; ranks run by path and name within an intent and kind. If nothing of a repository's routes or models speaks of
    data, the first six stand for them.
    """
    words = [(t, i) for i, ts in FLOW_INTENTS.items() for t in ts]
    intents = parts.sparkSession.createDataFrame(words, "needle string, intent string")
    columns = ["repo_id", "kind", "path", "name", "detail"]
    met = contained(parts, intents, "about", "needle", columns)
    every = written(met.join(F.broadcast(intents), "needle").select(*columns, "intent").distinct())
    stand_in = parts.filter("kind IN ('route', 'model')").select(*columns, F.lit("data_flow").alias("intent"))
    has = every.filter("intent = 'data_flow'").select("repo_id", "kind").distinct()
    first = ranked(stand_in.join(has, ["repo_id", "kind"], "left_anti").withColumn("__k", F.struct("repo_id", "kind")), 6, "path", "name", "detail", group="__k").drop("__k")
    number = F.row_number().over(Window.partitionBy("repo_id", "intent", "kind").orderBy("path", "name", "detail"))
    return every.unionByName(first).withColumn("rank", number)


def flow_steps(members: DataFrame, layer: Column, most: int = 10) -> DataFrame:
    """repo_id, intent, step, layer, component, detail: the steps of each flow in order, repeated (layer, component) dropped.

    A flow begins with its client and route, or else with its first service; then come services, models and what is outside.
    layer is what the path of a service belongs to.
    """
    row = lambda order, name, component, detail: F.struct(F.lit(order).alias("part"), F.col("rank").alias("rank"), name.alias("layer"), component.alias("component"), detail.alias("detail"))
    chosen = members.filter(reduce(lambda a, b: a | b, ((F.col("kind") == k) & (F.col("rank") <= n) for k, n in STEPS.items())))
    routed = members.filter("kind = 'route'").select("repo_id", "intent").distinct().withColumn("routed", F.lit(True))
    text = lambda x: F.lit(x)
    rows = chosen.join(routed, ["repo_id", "intent"], "left").withColumn("routed", F.coalesce("routed", F.lit(False)))
    of = (
        F.when(F.col("kind") == "route", F.array(row(0, text("Frontend"), text("Client"), F.concat(F.lit("Calls "), F.col("name"))), row(1, text("API"), F.col("path"), F.col("detail"))))
        .when((F.col("kind") == "service") & (F.col("rank") == 1) & ~F.col("routed"), F.array(row(0, text("Entry"), F.col("path"), F.col("detail")), row(2, layer, F.col("path"), F.col("detail"))))
        .when(F.col("kind") == "service", F.array(row(2, layer, F.col("path"), F.col("detail"))))
        .when(F.col("kind") == "model", F.array(row(3, text("Database"), F.coalesce("name", "path"), F.concat(F.lit("Persistence evidence in "), F.col("path")))))
        .otherwise(F.array(row(4, text("External"), F.col("name"), F.col("detail"))))
    )
    each = rows.select("repo_id", "intent", F.explode(of).alias("x")).select("repo_id", "intent", "x.*")
    unique = each.groupBy("repo_id", "intent", "layer", "component").agg(F.min(F.struct("part", "rank", "detail")).alias("x")).select("repo_id", "intent", "layer", "component", "x.*")
    ordered = unique.withColumn("step", F.row_number().over(Window.partitionBy("repo_id", "intent").orderBy("part", "rank", "layer", "component")))
    return ordered.filter(F.col("step") <= most).select("repo_id", "intent", "step", "layer", "component", "detail")


def request_flows(members: DataFrame, steps: DataFrame, repositories: DataFrame) -> DataFrame:
    """repo_id, intent, confidence, steps, routes, services, models, external, diagram of every intent for each repository."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind}s" if kind != "external" else kind)
    counted = members.groupBy("repo_id", "intent").agg(*map(count, STEPS))
    intents = F.array(*map(F.lit, FLOW_INTENTS))
    every = repositories.select("repo_id").distinct().withColumn("intent", F.explode(intents))
    drawn = steps.groupBy("repo_id", "intent").agg(F.array_sort(F.collect_list(F.struct("step", "layer", "detail"))).alias("x"))  # ten at most
    out = every.join(counted, ["repo_id", "intent"], "left").join(drawn, ["repo_id", "intent"], "left").fillna(0, ["routes", "services", "models", "external"])
    n = F.coalesce(F.size("x"), F.lit(0))
    clean = lambda c: F.substring(F.translate(F.replace(c, F.lit('"'), F.lit("'")), "\n:;", "   "), 1, 90)
    actors = F.concat(F.lit("sequenceDiagram\n"), F.array_join(F.transform(F.array_distinct(F.transform("x", lambda s: s["layer"])), lambda a: F.concat(F.lit("  participant "), F.replace(a, F.lit(" "), F.lit("")))), "\n"))
    arrow = lambda s, i: F.concat(F.lit("\n  "), F.replace(F.element_at("x", i)["layer"], F.lit(" "), F.lit("")), F.lit("->>"), F.replace(s["layer"], F.lit(" "), F.lit("")), F.lit(": "), clean(s["detail"]))
    arrows = F.array_join(F.transform(F.slice("x", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda s, i: arrow(s, i + 1)), "")
    alone = F.when(n == 1, F.concat(F.lit("\n  Analyst->>"), F.element_at("x", F.lit(1))["layer"], F.lit(": "), clean(F.element_at("x", F.lit(1))["detail"]))).otherwise("")
    none = F.concat(F.lit("sequenceDiagram\n  participant Analyst\n  participant Repository\n  Analyst->>Repository: No "), F.replace("intent", F.lit("_"), F.lit(" ")), F.lit(" flow detected"))
    confidence = F.when((F.col("routes") > 0) & ((F.col("services") > 0) | (F.col("models") > 0)), "high").when(n > 0, "medium").otherwise("low")
    return out.select("repo_id", "intent", confidence.alias("confidence"), n.cast("long").alias("steps"), "routes", "services", "models", "external", F.when(n > 0, F.concat(actors, arrows, alone)).otherwise(none).alias("diagram"))
