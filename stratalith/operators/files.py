"""File statistics, languages, duplicates, folders, domains and path classes, for all repositories in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.sources.shared import dealt_join, written


def statistics(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.countDistinct("language").alias("languages"), F.max("size").alias("largest"))


def primary_language(files: DataFrame) -> DataFrame:
    """The most frequent source language of a repository, or of all languages if it has no source; ties by name."""
    counts = files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files")).withColumn("is_source", ~F.col("language").isin(*rules.NON_SOURCE))
    order = Window.partitionBy("repo_id").orderBy(F.desc("is_source"), F.desc("files"), "language")
    ranked = counts.withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("repo_id")))
    return ranked.filter("r = 1").select("repo_id", F.col("language").alias("primary_language"), F.col("files").alias("primary_files"), F.col("n").alias("n_languages"))


def with_duplicates(files: DataFrame) -> DataFrame:
    """duplicate: the content was seen at an earlier path; files without content are none.

    Only hashes and paths are shuffled for the group minimum; contents that very many files share (the empty one) are
    joined back in parts.
    """
    known = files.filter("sha256 IS NOT NULL")
    first = written(known.groupBy("sha256").agg(F.min("path").alias("__first"), F.count(F.lit(1)).alias("__n")))
    out = dealt_join(known, first, ["sha256"], "__n", ["path"]).withColumn("duplicate", F.col("path") > F.col("__first")).drop("__first")
    return out.unionByName(files.filter("sha256 IS NULL").withColumn("duplicate", F.lit(False)))


def classified(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumns({
        "domain": exprs.domain(path), "knowledge_layer": exprs.case_contains(path, rules.KNOWLEDGE_LAYERS, "application"),
        "evolution_layer": exprs.case_contains(path, rules.EVOLUTION_LAYERS, "application"), "review_layer": exprs.case_contains(path, rules.REVIEW_LAYERS, "application"),
        "explorer_layer": exprs.case_contains(path, rules.EXPLORER_LAYERS, "Application"), "owner": exprs.case_contains(path, rules.OWNERS, "Core Engineering"),
        "service": exprs.case_contains(path, rules.SERVICE_TEXTS, "Behaviour of the application"),
    })


def folders(files: DataFrame) -> DataFrame:
    """Every ancestor folder with its depth and files."""
    each = files.select("repo_id", F.explode(exprs.ancestors(F.col("path"))).alias("folder"))
    return each.groupBy("repo_id", "folder").agg(F.count(F.lit(1)).alias("files")).withColumn("depth", F.size(F.split("folder", "/")).cast("long"))


def production_first(files: DataFrame) -> DataFrame:
    """Rows that aren't low value; a repository with none of them keeps all."""
    good = files.groupBy("repo_id").agg(F.max((~F.col("low")).cast("int")).alias("__good"))
    return files.join(good, "repo_id").filter(~F.col("low") | (F.col("__good") == 0)).drop("__good")


def lines(files: DataFrame) -> DataFrame:
    """line (from 1) and content of each text line."""
    return files.select("repo_id", "path", F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def tagged_lines(files: DataFrame, tags=("todo", "fixme", "hack", "xxx")) -> DataFrame:
    pattern = rf"(?i)\b({'|'.join(tags)})\b"
    return lines(files).filter(F.col("content").rlike(pattern)).withColumn("tag", F.upper(F.regexp_extract("content", pattern, 1)))


def domains(files: DataFrame, most: int = 24, samples: int = 8) -> DataFrame:
    """Domains of a repository with role and sample files, the largest `most`.

    The role and the samples need the least 20 paths only: they are ranked first, so no group is collected whole.
    """
    named = files.withColumn("name", exprs.domain(F.col("path")))
    order = Window.partitionBy("repo_id", "name").orderBy("path")
    head = named.withColumn("r", F.row_number().over(order)).filter("r <= 20").groupBy("repo_id", "name").agg(F.array_sort(F.collect_list("path")).alias("sample"))
    sizes = named.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("bytes"))
    role = exprs.case_contains(F.concat_ws(" ", "name", F.array_join("sample", " ")), rules.DOMAIN_ROLES, "Product capability")
    top = Window.partitionBy("repo_id").orderBy(F.desc("file_count"), "name")
    return sizes.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= most).join(head, ["repo_id", "name"]).select("repo_id", "name", "file_count", "bytes", role.alias("role"), F.slice("sample", 1, samples).alias("sample_files"))
