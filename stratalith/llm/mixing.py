"""Mixing sources to target weights by a curriculum that changes with time; DataFrame functions only.

Each source's target is its share by weight of the whole demand, stopped at a multiple of its size. Its weight over
training time runs linearly between two values; the integral of that schedule is the source's cumulative demand, and
its inverse gives each document's position in training. Documents of a source are taken in the order of a hash of
their id, whole, as often as the target needs. Running totals are two-level (hash bucket, then inside the bucket), so
a source with a third of all rows is spread over 4096 groups.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, the last; a
null id sorts first; repeated rows are documents of their own; an empty table gives an empty result; other columns of
the input pass through range_sorted() and never clash, as outputs are joined by name to (id, source, size) only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm.shared import WORD, word_count, written

WEIGHTS = (5, 2, 1)
#: Weight at the begin and end of training for each place in WEIGHTS.
SCHEDULES = ((3.0, 1.0), (1.0, 1.0), (1.0, 3.0))


def _cycle(index: F.Column, values) -> F.Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (index % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """sizes (source, source_size: a row for each source) with target, begin and end weight.

    Demand above cap times a size is reshared by weight until none is above: with sources in the order of cap by
    weight, the level is the first at which the next source stays below its cap. The one window runs over the table
    of sources, not of documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("__ratio", "__i")
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("source_size")
    level = (F.sum(size).over(whole) * share - F.coalesce(F.sum(size).over(before), F.lit(0)) * cap) / F.sum("__w").over(after)
    return (
        sizes.withColumn("__i", F.row_number().over(every) - 1)
        .withColumn("__w", _cycle(F.col("__i"), weights))
        .withColumn("__ratio", size * cap / F.col("__w"))
        .withColumn("__level", level)
        .withColumn("__found", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__i", "__level"))).over(whole))
        .select(
            "source", "source_size", F.least(F.col("__w") * F.coalesce("__found.__level", F.col("__ratio")), size * cap).alias("target"),
            _cycle(F.col("__i"), [a for a, _ in schedules]).alias("__a"), _cycle(F.col("__i"), [b for _, b in schedules]).alias("__b"),
        )
    )


def assigned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: the keep columns, doc_id, source, size, source_size, target, taken, copies, position.

    position is the array of training times (0 to 1) of the copies. keep may name a row number, to join them back by.
    """
    slim = written(docs.select(*keep, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = slim.withColumn("__key", order).withColumn("__bucket", F.substring("__key", 1, 3))
    buckets = keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("__n"))
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights, schedules)
    so_far = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("__before", F.coalesce(F.sum("__n").over(so_far), F.lit(0))).drop("__n")
    offsets = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.*", "source_size", "target", "__a", "__b")
    inside = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("__before") + F.col("__inner")
    passes = F.sequence(F.lit(0), F.lit(int(cap)))
    starts = F.filter(F.transform(passes, lambda p: begin + p * F.col("source_size")), lambda c: (c * 2 + F.col("size") <= F.col("target") * 2) & (F.col("size") > 0))
    a, b = F.col("__a"), F.col("__b")

    def when_due(c: F.Column) -> F.Column:
        """Time at which the integral of the schedule reaches the middle of the copy that begins at word c."""
        part = (c * 2 + F.col("size")) / (F.col("target") * 2)
        return F.when(a == b, part).otherwise((F.sqrt(a * a + (b * b - a * a) * part) - a) / (b - a))

    return (
        keyed.withColumn("__inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
        .join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.__bucket") == F.col("o.__bucket")))
        .select(*keep, "d.doc_id", "d.source", "size", "source_size", "target", "__a", "__b", starts.alias("__starts"))
        .select(*keep, "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("__starts")).alias("taken"), F.size("__starts").alias("copies"), F.transform("__starts", when_due).alias("position"))
    )


def range_sorted(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-partitioned and sorted by position: the order of training."""
    rows = mixed.filter("copies > 0").select("*", F.posexplode("position").alias("copy", "at")).drop("position", "copies")
    return rows.repartitionByRange("at", "doc_id", "copy").sortWithinPartitions("at", "doc_id", "copy")


#: Training time is counted in millionths; so many of them are one range of the sort.
TICKS, RANGE = 1_000_000, 250


def placed(mixed: DataFrame) -> DataFrame:
    """mixed with first_at_millionths and first_rank: when, and at which place (from 1), training first takes a document.

    Copies are sorted by time, id, size and copy: in ranges of time, each sorted by itself, with the number of copies in
    the ranges before it; the one window over ranges has as many rows as there are ranges.
    """
    mixed = written(mixed)
    copies = mixed.filter("copies > 0").select("*", F.posexplode("position").alias("copy", "at")).withColumn("first_at_millionths", F.floor(F.col("at") * TICKS).cast("long"))
    copies = copies.withColumn("__range", F.floor(F.col("first_at_millionths") / RANGE))
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = copies.groupBy("__range").count().select("__range", before.alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy("first_at_millionths", "doc_id", "size", "copy"))
    ranked = copies.join(F.broadcast(offsets), "__range").withColumn("first_rank", place).filter("copy = 0")  # TICKS / RANGE rows at most
    made = [*mixed.columns, "first_at_millionths", "first_rank"]
    none = F.lit(None).cast("long")
    return ranked.select(made).unionByName(mixed.filter("copies = 0").withColumns({"first_at_millionths": none, "first_rank": none}))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return placed(assigned(docs)).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_at_millionths", "first_rank")


SQL = {
    "op10_curriculum_mix": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][i % 3 + 1]::DOUBLE AS w, [3.0, 1.0, 1.0][i % 3 + 1]::DOUBLE AS a, [1.0, 1.0, 3.0][i % 3 + 1]::DOUBLE AS b FROM s),
r AS (SELECT *, source_size * 2::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2::DOUBLE)
    / sum(w) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
f AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, i LIMIT 1),
t AS (SELECT source, source_size, least(w * coalesce((SELECT lev FROM f), ratio), source_size * 2::DOUBLE) AS target, a, b FROM l),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM d),
j AS (
  SELECT doc_id, size, source_size, target, a, b, begins, (size > 0 AND begins * 2 + size <= target * 2)::INT + (size > 0 AND (begins + source_size) * 2 + size <= target * 2)::INT AS copies
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT doc_id, size, z AS copy, floor((CASE WHEN a = b THEN ((begins + z * source_size) * 2 + size)::DOUBLE / (target * 2)
    ELSE (sqrt(a * a + (b * b - a * a) * (((begins + z * source_size) * 2 + size)::DOUBLE / (target * 2))) - a) / (b - a) END) * 1000000)::BIGINT AS tick
  FROM j, range(0, 2) AS y(z) WHERE z < copies),
o AS (SELECT doc_id, copy, tick, row_number() OVER (ORDER BY tick, doc_id NULLS FIRST, size, copy) AS place FROM x)
SELECT j.doc_id, size, source_size, target, size * copies AS taken, copies, tick AS first_at_millionths, place AS first_rank FROM j LEFT JOIN o ON o.doc_id = j.doc_id AND o.copy = 0"""
}
QUERIES = {"op10_curriculum_mix": op10_curriculum_mix}
