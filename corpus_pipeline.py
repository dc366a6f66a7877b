"""From raw documents to a training order: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all rows its predecessor kept; run() writes each result as Parquet in the shared folder and reads
it again. All stages but the last return the columns of documents; the last adds those of the mix to them, so the result
holds the pseudonymised text in training order.

Defined cases: without labels of both classes, or if no term tells them apart, nothing is known of toxicity and no row is
dropped for it; a null or empty text is not toxic, near no other, leaks nothing, has no personal data and is never taken
by the mix; a row with a null id is only dropped as toxic, as no other row can name it; of the rows with one id, and of
the ids of any near-duplicate group, one stays; empty tables give empty results; extra columns pass through, but for
those with a name of the mix's columns in the last stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm import jaccard, mixing, pii, templates, toxicity
from stratalith.llm.shared import small, written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows with these ids."""
    ids = written(ids.filter("doc_id IS NOT NULL").distinct())
    return docs.join(small(ids, ids.count()), "doc_id", "left_anti").select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or with a toxicity score below one half; all, if no term was learned."""
    machine = toxicity.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not machine.weight.any():
        return docs
    columns = docs.columns
    kept = docs.withColumnRenamed("score", "__score") if "score" in columns else docs
    out = toxicity.scored(kept, machine, "text", kept.columns)
    out = out.filter((F.col("score") < 0.5) | ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).drop("score")
    return (out.withColumnRenamed("__score", "score") if "score" in columns else out).select(columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8)."""
    found = written(jaccard.jaccard_components(docs, n=5, num=80, den=100))
    kept = _without(docs, found.filter("doc_id <> component_id").select("doc_id"))
    again = found.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return kept
    again = written(again)
    n = again.count()
    order = Window.partitionBy("doc_id").orderBy("text")
    first = kept.join(small(again, n), "doc_id", "left_semi").withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    return kept.join(small(again, n), "doc_id", "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other numbers and names."""
    return _without(docs, templates.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, and n_chars as the text now has them."""
    out = pii.pseudonymized(docs.withColumnsRenamed({c: f"__{c}" for c in ("kinds", "n_replaced") if c in docs.columns}), pii.key_of(spark)).drop("kinds", "n_replaced")
    out = out.withColumnsRenamed({f"__{c}": c for c in ("kinds", "n_replaced")})
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, which stays when it is read again: the place in its file, or for other tables a number that is written."""
    try:
        return docs.withColumn("__row", F.struct("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:  # not read from Parquet
        return written(docs.withColumn("__row", F.monotonically_increasing_id()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row with text and all for each copy that training takes, in the order of its position."""
    numbered = _numbered(docs)
    mixed = mixing.assigned(numbered, keep=("__row",))
    rest = numbered.drop(*(c for c in docs.columns if c.lower() in {*mixed.columns, "copy", "at"}))
    return mixing.range_sorted(mixed.filter("copies > 0").join(rest, "__row").drop("__row"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
]
#: The factorization machine and its training have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
