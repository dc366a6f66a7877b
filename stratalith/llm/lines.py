"""Line dedup that can be undone: sharded cuckoo filters before an exact table of references.

A line's key is its stripped, lower-cased text (128-bit hash); a document refers to the keys of its lines that have
`least` code points or more. The index keeps, in a folder that all machines share,

* references: (h1, h2, doc_id, sign), a log of what documents added and took away; its sums are the exact counts, and
  the smallest document among them owns the line,
* filters: for each shard of the keys one cuckoo filter of the keys with a reference (`live`), and one of the keys that
  two documents or more refer to (`shared`). A key enters and leaves them as its exact count passes one and two.

Insertions look up only keys that `live` may hold, the dedup only keys that `shared` may hold; what a filter reports
wrongly the exact table corrects. Deleting documents gives their lines back to the next smallest holder, so the index
then equals one built without them. A version is one row of the table of versions, written last: a job that dies leaves
the version before it as it was. Lines of a key have no common task: counts are combined before the shuffle, and hot
keys are dealt in parts.

Defined cases: a null or empty text is one empty line; rows with one id are one document, and those with a null id are
one that comes after all others; inserting a document again changes nothing; ids that the index doesn't hold are deleted
without effect; empty tables change nothing; other columns pass through, but for those with a name of the result's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.cuckoo import Filter, Shards, buckets_for
from stratalith.llm.shared import dealt_join, shared_dir, small, written

_SPACE = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Keys that a shard should hold; a shard has one task. Filters are sent to all tasks up to so many bytes.
PER_SHARD, SENT = 400_000, 64 << 20
_VERSION = "version long, parts array<string>, filters string, shards int, keys long, id_type string"
_FILTER = "shard int, live binary, shared binary, n_live long, n_shared long"


@dataclass(frozen=True)
class LineIndex:
    """One version of an index below root: parts of the log of references, and the table of filters."""

    spark: SparkSession
    root: str
    version: int = 0
    parts: tuple[str, ...] = ()
    filters: str | None = None
    shards: int = 1
    keys: int = 0
    id_type: str = "bigint"

    def references(self) -> DataFrame:
        """(h1, h2, doc_id) of all references that are left."""
        schema = f"h1 long, h2 long, doc_id {self.id_type}, sign int"
        if not self.parts:
            return self.spark.createDataFrame([], schema).drop("sign")
        log = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in self.parts))
        if len(self.parts) == 1:  # as inserted
            return log.drop("sign")
        return log.groupBy(*KEY, "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")

    def filter_table(self) -> DataFrame:
        return self.spark.read.schema(_FILTER).parquet(f"{self.root}/{self.filters}") if self.filters else self.spark.createDataFrame([], _FILTER)


def created(spark: SparkSession, root: str | None = None) -> LineIndex:
    """An empty index below root (a new folder of the application if None)."""
    return LineIndex(spark, root or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}")


def opened(spark: SparkSession, root: str) -> LineIndex:
    """The last version of the index below root."""
    r = spark.read.schema(_VERSION).parquet(f"{root}/versions").orderBy(F.desc("version")).first()
    return LineIndex(spark, root, r["version"], tuple(r["parts"]), r["filters"], r["shards"], r["keys"], r["id_type"])


def _committed(index: LineIndex) -> LineIndex:
    row = (index.version, list(index.parts), index.filters, index.shards, index.keys, index.id_type)
    index.spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("append").parquet(f"{index.root}/versions")
    return index


def digests(text: bytes | None, least: int) -> list[bytes]:
    """The key of each line, or nothing for those that are too short."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(_SPACE).lower()
        long = len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)
        out.append(blake2b(key, digest_size=16).digest() if long else b"")
    return out


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def line_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 10, probe=None) -> DataFrame:
    """(doc_id, h1, h2) of the keys of each row, each once; only those that probe (a broadcast Shards) may hold."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = [], []
            for t in _bytes(b.column(1)):
                own = {*digests(t, least)} - {b""}
                keys.extend(own)
                n.append(len(own))
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            row = np.repeat(np.arange(len(n)), n)
            if probe is not None:
                hit = probe.value.may_hold(h[:, 0], h[:, 1])
                h, row = h[hit], row[hit]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", *KEY])

    return given.mapInArrow(emit, given.select("doc_id").schema.add("h1", "long").add("h2", "long"))


def _counts(references: DataFrame) -> DataFrame:
    """(h1, h2, n, owner): documents of each key and the smallest of them; combined before the shuffle."""
    return references.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))


def _shard(n: int) -> F.Column:
    return F.pmod("h1", F.lit(n)).cast("int").alias("shard")


def _probed(index: LineIndex, keys: DataFrame, which: str) -> DataFrame:
    """The distinct keys that the filters of this kind may hold; each shard's keys meet its filter in one task."""
    if not index.filters:
        return keys.limit(0)
    filters = index.filter_table().select("shard", F.col(which).alias("filter"))

    def probe(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(theirs) or not len(ours):
            return ours.iloc[:0][KEY]
        return ours[Shards({0: theirs["filter"].iloc[0]}, 1).may_hold(ours["h1"].to_numpy(), ours["h2"].to_numpy())][KEY]

    return keys.select(*KEY, _shard(index.shards)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "h1 long, h2 long")


def _rebuilt(counts: DataFrame, shards: int) -> DataFrame:
    """Filters of all shards from the exact counts."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame[KEY].to_numpy()
        row = [int(frame["shard"].iloc[0])]
        for kept in (h, h[frame["n"].to_numpy() > 1]):
            size = buckets_for(len(kept) + len(kept) // 4)
            while not (made := Filter(size)).add(kept[:, 0], kept[:, 1]):
                size *= 2
            row += [made.to_bytes(), len(kept)]
        return pd.DataFrame([row], columns=["shard", "live", "n_live", "shared", "n_shared"])[_FILTER.replace(",", "").split()[::2]]

    return counts.select(_shard(shards), *KEY, "n").groupBy("shard").applyInPandas(build, _FILTER)


def _changed(index: LineIndex, moves: DataFrame) -> DataFrame:
    """The filters after keys (h1, h2, before, after: exact counts) passed one or two; a filter that is full comes back null."""

    def change(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        row = {"shard": int((ours if len(ours) else theirs)["shard"].iloc[0])}
        h, before, after = ours[KEY].to_numpy(np.int64).reshape(-1, 2), ours["before"].to_numpy(), ours["after"].to_numpy()
        for kind, level in (("live", 1), ("shared", 2)):
            made = Filter.of(theirs[kind].iloc[0]) if len(theirs) else Filter(1)
            leave, enter = h[(before >= level) & (after < level)], h[(before < level) & (after >= level)]
            made.remove(leave[:, 0], leave[:, 1])
            fits = made.held + len(enter) <= 0.9 * made.slots.size and made.add(enter[:, 0], enter[:, 1])
            row |= {kind: made.to_bytes() if fits else None, f"n_{kind}": made.held}
        return pd.DataFrame([row])[_FILTER.replace(",", "").split()[::2]]

    return moves.select(_shard(index.shards), *KEY, "before", "after").groupBy("shard").cogroup(index.filter_table().groupBy("shard")).applyInPandas(change, _FILTER)


def _moved(index: LineIndex, log: DataFrame, moves: DataFrame) -> LineIndex:
    """The version after a written part of the log, whose keys go from `before` to `after` references."""
    part, filters = f"references-{uuid.uuid4().hex}", f"filters-{uuid.uuid4().hex}"
    log.write.parquet(f"{index.root}/{part}")
    new = replace(index, version=index.version + 1, parts=(*index.parts, part), filters=filters)
    step = F.when((F.col("before") == 0) & (F.col("after") > 0), 1).when((F.col("before") > 0) & (F.col("after") == 0), -1).otherwise(0)
    new = replace(new, keys=index.keys + (moves.agg(F.sum(step)).first()[0] or 0))
    wanted = 1 << max(0, (new.keys // PER_SHARD).bit_length())
    table = None
    if index.filters and wanted <= 2 * index.shards:
        table = written(_changed(index, moves))
        if not table.filter("live IS NULL OR shared IS NULL").isEmpty():
            table = None
    if table is None:
        new = replace(new, shards=max(wanted, index.shards))
        table = _rebuilt(_counts(new.references()), new.shards)
    table.write.parquet(f"{index.root}/{filters}")
    return _committed(new)


def inserted(index: LineIndex, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 10) -> LineIndex:
    """The version with the references of docs; documents that it holds already are left as they are."""
    kind = dict(docs.select(F.col(f"`{doc_id}`").alias("i")).dtypes)["i"]
    if not index.parts:
        index = replace(index, id_type=kind)
    new = written(line_keys(docs, text, doc_id, least).distinct())
    keys = new.select(*KEY).distinct()
    if index.parts:
        maybe = written(_probed(index, keys, "live"))
        old = written(index.references().join(small(maybe, maybe.count()), KEY, "left_semi"))
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*KEY, "doc_id")]
        known = index.references().select("doc_id").distinct().alias("y")
        new = written(new.alias("x").join(known, same[-1], "left_anti"))
        before = _counts(old).select(*KEY, F.col("n").alias("before"))
        moves = _counts(new).select(*KEY, "n").join(before, KEY, "left").select(*KEY, F.coalesce("before", F.lit(0)).alias("before"), (F.col("n") + F.coalesce("before", F.lit(0))).alias("after"))
    else:
        moves = _counts(new).select(*KEY, F.lit(0).cast("long").alias("before"), F.col("n").alias("after"))
    return _moved(index, new.withColumn("sign", F.lit(1)), written(moves))


def deleted(index: LineIndex, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
    """The version without the references of these documents."""
    ids = written(ids.select(F.col(f"`{doc_id}`").alias("doc_id")).distinct())
    gone = written(index.references().alias("x").join(small(ids, ids.count()).alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), "left_semi"))
    touched = _counts(gone).select(*KEY, F.col("n").alias("minus"))
    # a key of a deleted document is in the exact table, so no filter needs to be asked
    old = _counts(index.references()).select(*KEY, F.col("n").alias("before"))
    moves = touched.join(old, KEY).select(*KEY, "before", (F.col("before") - F.col("minus")).alias("after"))
    return _moved(index, gone.withColumn("sign", F.lit(-1)), written(moves))


def compacted(index: LineIndex) -> LineIndex:
    """The same index with a log of one part."""
    part = f"references-{uuid.uuid4().hex}"
    index.references().withColumn("sign", F.lit(1)).write.parquet(f"{index.root}/{part}")
    return _committed(replace(index, version=index.version + 1, parts=(part,)))


def _drops(index: LineIndex, docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(doc_id, drop): the keys of lines that a smaller document holds."""
    sizes = index.filter_table().agg(F.sum(F.length("shared"))).first()[0] or 0
    if sizes <= SENT:  # filters of all shards go to all tasks, and only keys that may be shared are moved
        filters = {r["shard"]: bytes(r["shared"]) for r in index.filter_table().select("shard", "shared").collect()}
        rows = line_keys(docs, text, doc_id, least, index.spark.sparkContext.broadcast(Shards(filters, index.shards)))
        asked = None
    else:
        rows = written(line_keys(docs, text, doc_id, least))
        asked = written(_probed(index, rows.select(*KEY).distinct(), "shared"))
    exact = _counts(index.references()).filter("n > 1")
    if asked is not None:
        exact = exact.join(asked, KEY, "left_semi")
    exact = written(exact)
    n = exact.count()
    rows = rows.distinct()
    if n <= 1_000_000:
        hits = rows.join(F.broadcast(exact.drop("n")), KEY)
    else:
        hits = dealt_join(rows, exact.withColumn("size", F.col("n")), KEY, "size", ["doc_id"]).filter("n IS NOT NULL")
    hits = hits.filter(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("doc_id")))
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("drop"))


def deduplicated(docs: DataFrame, index: LineIndex, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, least: int = 10) -> DataFrame:
    """The keep columns with the text less the lines that a smaller document of the index holds, n_lines (before) and n_dropped."""
    made = {text.lower(), "n_lines", "n_dropped", "__id", "__text", "drop"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    drops = _drops(index, docs, text, doc_id, least).withColumnRenamed("doc_id", "__drop_id")
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    joined = given.join(drops.hint("merge"), F.col("__id").eqNullSafe(F.col("__drop_id")), "left").drop("__id", "__drop_id")
    schema = joined.drop("__text", "drop").schema.add(text, "string").add("n_lines", "long").add("n_dropped", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            every = b.column(len(keep) + 1)
            part, at = every.flatten(), np.cumsum([0, *(0 if x is None else x for x in every.value_lengths().to_pylist())])
            keys = np.stack([part.field(c).to_numpy(zero_copy_only=False) for c in KEY], 1).astype("<i8").tobytes() if len(part) else b""
            for i, t in enumerate(_bytes(b.column(len(keep)))):
                t = t or b""
                n = t.count(b"\n") + 1
                n_lines.append(n)
                if at[i] == at[i + 1]:
                    kept.append(t)
                    n_dropped.append(0)
                    continue
                gone = {keys[j : j + 16] for j in range(16 * at[i], 16 * at[i + 1], 16)}
                left = [line for line, key in zip(t.split(b"\n"), digests(t, least), strict=True) if key not in gone]
                kept.append(b"\n".join(left))
                n_dropped.append(n - len(left))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def op11_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = inserted(created(spark), docs)
    return deduplicated(docs, index).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op11_cuckoo_lines": r"""
WITH l AS (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""
}
QUERIES = {"op11_cuckoo_lines": op11_cuckoo_lines}
