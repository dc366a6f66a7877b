"""Jaccard self-join of word n-gram sets by PartEnum signatures.

Two sets with |A & B| / |A | B| >= t differ in at most k = (|A| + |B|) (1 - t) / (1 + t) elements. Sets are put into
size bands; a band's k follows from its largest size. The element domain is cut into groups of three parts by hash,
with so many groups that sets which differ in k elements differ in at most one element in some group; then one of the
group's three pairs of parts agrees exactly. Each set emits a signature for every group and pair of parts, and, if it
may link upwards, for the next band. Signatures of empty projections say nothing: `spare` more groups than needed are
made, so that a set with no more than `spare` empty groups need not emit them, and no link is lost.

Exact copies share a set fingerprint and are one node. A bucket of nodes with one signature never makes all its pairs:
first each node is held against the bucket's smallest, and verified links are contracted to components. Only buckets
whose other nodes are still of several components are searched further, across components, by parity sketches whose
distance is a lower bound of the sets' difference, in blocks. What passes is held against longer sketches, with four bits
for each element, and then verified against the sets, which are made again from the texts of those pairs alone. So
no link is lost.

Defined cases: a null or empty text has an empty set and links with nothing; a text with fewer words than n has its
whole sequence as one element; repeated rows share a component; a null id keeps its row and takes the smallest other
id of its component, else null; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.components import components
from stratalith.llm.shared import WORD, dealt_join, small, written
from stratalith.llm.text import Words, mix, runs, signed

PARTS = 3
SKETCH_BITS = 1024
FINE, FINE_BITS = 4, 1 << 22
BLOCK = 512


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements sorted inside each text, bounds) of the distinct n-gram sets of a run of texts."""
    words = Words(data, at, lower=True)
    gram, ok = words.grams(n)
    counts = np.diff(words.first)
    few = np.nonzero((counts > 0) & (counts < n))[0]
    whole = words.spans(words.first[few], words.first[few + 1])
    element, doc = np.concatenate([gram[ok], whole]), np.concatenate([words.doc[ok], few])
    order = np.lexsort((element, doc))
    element, doc = element[order], doc[order]
    if len(doc):
        new = np.concatenate([[True], (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])])
        element, doc = element[new], doc[new]
    return element, np.searchsorted(doc, np.arange(len(at)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def nodes_of(element: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of each set."""
    return mix(_sums(mix(element ^ np.uint64(0xA0761D6478BD642F)), bounds) + np.diff(bounds).astype(np.uint64))


class Bands:
    """Size bands for a threshold num / den: band of a size, groups of a band, and whether a size reaches up."""

    def __init__(self, num: int, den: int, width: float = 1.25, most: int = 1 << 33):
        t = Fraction(num, den)
        lows = [1]
        while lows[-1] < most:
            lows.append(max(lows[-1] + 1, int(lows[-1] * width), int(lows[-1] / t) + 1))
        self.low = np.array(lows)
        high = self.low[1:] - 1
        self.k = np.array([int(2 * int(h) * (1 - t) / (1 + t)) for h in high] + [0])
        self.spare = np.where(self.k > 0, 1 + (self.k * float(1 - t) / 4).astype(np.int64), 0)
        self.groups = np.where(self.k > 0, self.k // 2 + 1 + self.spare, 0)
        self.num, self.den = num, den

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def reaches(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """May a set of this size link with one of the next band?"""
        return size * self.den >= self.low[band + 1] * self.num


def signatures(element: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of each set for its own band and the next."""
    size = np.diff(bounds)
    band = bands.of(np.maximum(size, 1))
    out_sig, out_set = [], []
    which = mix(element ^ np.uint64(0xE7037ED1A0B428DB))
    value = mix(element + np.uint64(0x8EBC6AF09C88C6E3))
    owner = np.repeat(np.arange(len(size)), size)
    for step in (0, 1):
        use = (size > 0) & ((step == 0) | bands.reaches(size, band))
        groups = np.where(use, bands.groups[band + step], 0)
        base = np.concatenate([[0], np.cumsum(groups * PARTS)])
        if not base[-1]:
            continue
        mine = groups[owner] > 0
        slot = base[:-1][owner[mine]] + (which[mine] % (groups[owner[mine]] * PARTS).astype(np.uint64)).astype(np.int64)
        part, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.int64)
        np.add.at(part, slot, value[mine])
        filled = np.bincount(slot, minlength=base[-1])
        part, filled = part.reshape(-1, PARTS), filled.reshape(-1, PARTS)
        left, full = part.sum(1, keepdims=True) - part, filled.sum(1, keepdims=True) - filled > 0
        set_of = np.repeat(np.arange(len(size)), groups)
        group = np.arange(len(set_of)) - np.repeat(base[:-1] // PARTS, groups)
        name = (((band + step)[set_of] << 40) + group * PARTS)[:, None] + np.arange(PARTS)
        empty_groups = np.bincount(set_of[~full.all(1)], minlength=len(size))
        keep = full | (empty_groups > bands.spare[band + step])[set_of][:, None]
        out_sig.append(mix(left + mix(name.astype(np.uint64)))[keep])
        out_set.append(np.broadcast_to(set_of[:, None], keep.shape)[keep])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def sketches(element: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each of SKETCH_BITS bits, as 64-bit words (a row for each set)."""
    bit = (mix(element ^ np.uint64(0x589965CC75374CC3)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    odd = np.bincount(owner * SKETCH_BITS + bit, minlength=(len(bounds) - 1) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(-1, SKETCH_BITS), axis=1).view(np.uint64)


def fine_sketch(element: np.ndarray) -> bytes | None:
    """Parity of a large set's elements on a power of two of bits, FINE for each element or more, up to FINE_BITS; None if its sketch has two for each."""
    if 2 * len(element) <= SKETCH_BITS:
        return None
    bits = min(FINE_BITS, 1 << (FINE * len(element) - 1).bit_length())
    odd = np.bincount((mix(element ^ np.uint64(0x589965CC75374CC3)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(x: np.ndarray, n: int) -> np.ndarray:
    """The sketch of the same set with n words, no more than x has: bits that are equal modulo n words add up."""
    return np.bitwise_xor.reduce(x.reshape(-1, n))


def described(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set) of each document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in runs(b.column(1)):
                element, bounds = shingle_sets(data, at, n)
                size = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(signed(nodes_of(element, bounds)), mask=size == 0)], names=["doc_id", "n_shingles", "node"])

    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return given.mapInArrow(describe, given.select("doc_id").schema.add("n_shingles", "long").add("node", "long"))


def signature_rows(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """(sig, node); a node that a task has seen already is left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for b in batches:
            for _, _, data, at in runs(b.column(0)):
                element, bounds = shingle_sets(data, at, n)
                node = nodes_of(element, bounds)
                sig, owner = signatures(element, bounds, bands)
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                use = fresh[owner]
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig[use])), pa.array(signed(node[owner[use]]))], names=["sig", "node"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(emit, "sig long, node long")


def node_rows(docs: DataFrame, text: str, n: int, wanted: DataFrame, texts: bool) -> DataFrame:
    """(node, t) or (node, sketch, fine, n) of the wanted nodes, once each; sets are made again from texts, which take fewer bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo, hi, data, at in runs(b.column(0)):
                element, bounds = shingle_sets(data, at, n)
                node, size = nodes_of(element, bounds), np.diff(bounds)
                fresh = np.array([not (x in seen or seen.add(x)) for x in node.tolist()], bool) & (size > 0)
                if texts:
                    batch = pa.RecordBatch.from_arrays([pa.array(signed(node)), b.column(0).slice(lo, hi - lo)], names=["node", "t"])
                else:
                    bits = pa.array([x.tobytes() for x in sketches(element, bounds)], pa.binary())
                    fine = pa.array([fine_sketch(element[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                    batch = pa.RecordBatch.from_arrays([pa.array(signed(node)), bits, fine, pa.array(size)], names=["node", "sketch", "fine", "n"])
                yield batch.filter(pa.array(fresh))

    rows = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(emit, "node long, t string" if texts else "node long, sketch binary, fine binary, n long")
    return rows.join(small(wanted, wanted.count()), "node", "left_semi").dropDuplicates(["node"])


def linked(edges: DataFrame, outlines: DataFrame, docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """The edges (a, b) whose sets reach the threshold: first by sketch, then by longer sketches, what is left by the sets of their texts."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(p), len(q))
                least.append(int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum()))
            keep = _may_link(np.asarray(b.column(4)), np.asarray(b.column(5)), np.array(least, np.int64), num, den)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            for _, _, data, at in runs(column):
                element, bounds = shingle_sets(data, at, n)
                yield from (element[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True))

        for b in batches:
            keep = []
            for p, q in zip(sets(b.column(2)), sets(b.column(3)), strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    close = edges
    for bits in (F.col("sketch"), F.coalesce("fine", "sketch")):
        slim = outlines.select("node", bits, "n")
        a, b = slim.toDF("a", "x", "n_a"), slim.toDF("b", "y", "n_b")
        close = written(close.join(a, "a").join(b, "b").select("a", "b", "x", "y", "n_a", "n_b").mapInArrow(near, "a long, b long"))
    ends = written(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    full = node_rows(docs, text, n, ends, texts=True)
    return close.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(same, "a long, b long")


def _may_link(s: np.ndarray, t: np.ndarray, least: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sizes and a lower bound of the difference allow the threshold: den * both >= num * (s + t - both)."""
    both = (s + t - least) // 2
    return den * both >= num * (s + t - both)


def across(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members (sig, node, label, sketch, n) of one bucket, of two labels, that sketches can't rule out.

    Buckets are cut into blocks of about BLOCK members by hash, and pairs of blocks are the units of work, so a large
    bucket is spread over tasks; a unit holds two blocks at most.
    """
    blocks = members.join(members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = blocks.select("*", other.alias("other")).select("sig", "node", "label", "sketch", "n", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def found(node: np.ndarray, label: np.ndarray, bits: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one unit; first: in the unit's first block."""
        i, j = (np.nonzero(x)[0] for x in (first, ~first)) if not first.all() else (np.arange(len(node)),) * 2
        least = np.bitwise_count(bits[i][:, None, :] ^ bits[j][None, :, :]).sum(2).astype(np.int64)
        x, y = np.nonzero((label[i][:, None] != label[j]) & _may_link(size[i][:, None], size[j], least, num, den))
        return node[i[x]], node[j[y]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            yield from within(table, unit_ends(table)[:-1])
            rest = table.slice(([0, *unit_ends(table)[:-1]])[-1])
        if rest is not None:
            yield from within(rest, unit_ends(rest))

    def unit_ends(table: pa.Table) -> list[int]:
        sig, lo, hi = (table[c].to_numpy() for c in ("sig", "lo", "hi"))
        return [*(np.nonzero((sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[0] + 1).tolist(), *[len(sig)] * (len(sig) > 0)]

    def within(table: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
        node, label, size, block, lo = (table[c].to_numpy() for c in ("node", "label", "n", "block", "lo"))
        bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(node), SKETCH_BITS // 64)
        for begin, end in zip([0, *ends], ends, strict=False):
            part = slice(begin, end)
            a, b = found(node[part], label[part], bits[part], size[part], block[part] == lo[part])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    columns = ["sig", "lo", "hi", "node", "label", "sketch", "n", "block"]
    pairs = units.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").select(columns).mapInArrow(search, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, label) of the buckets that hold several components beside their smallest node, which was held against all others."""
    known = members.filter("node <> pivot").select("sig", "node").join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sig")
    return known.join(mixed, "sig", "left_semi")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each document: components of links at a Jaccard of num / den or more."""
    every = written(described(docs, doc_id, text, n))
    by_sig = signature_rows(docs, text, n, num, den)
    whole = "PARTITION BY sig ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    members = by_sig.select("sig", "node", F.expr(f"min(node) OVER ({whole})").alias("pivot"), F.expr(f"max(node) OVER ({whole})").alias("last"))
    members = written(members.filter("pivot <> last").drop("last").distinct())
    outlines = written(node_rows(docs, text, n, written(members.select("node").distinct()), texts=False))
    stars = members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    links = written(linked(stars, outlines, docs, text, n, num, den))
    labels = components(links)
    left = apart(members, labels).join(outlines.drop("fine"), "node")
    more = written(linked(written(across(written(left), num, den)), outlines, docs, text, n, num, den))
    if not more.isEmpty():
        labels = components(links.union(more))
    return _named(every, labels)


def _named(every: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the smallest id of each document's component; groups of copies, and components, may be of any size."""
    copies = every.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"))
    grouped = written(copies.join(labels, "node", "left").filter("size > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node")))
    least = written(grouped.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.min("first").alias("component_id")))
    named = written(dealt_join(grouped.select("label", "node", "size"), least, ["label"], "nodes", ["node"]).select("node", "size", "component_id"))
    found = dealt_join(every.filter("node IS NOT NULL"), named, ["node"], "size", ["doc_id"])
    alone = every.filter("node IS NULL").withColumn("component_id", F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(alone.select("doc_id", "n_shingles", "component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


def components_sql(docs: str, n: int, num: int, den: int) -> str:
    """SQL for the components of a table expression with doc_id and text: CTEs that end in comp(doc_id, n_shingles, component_id)."""
    return rf"""
jw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM {docs}),
js AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END)) AS g FROM jw),
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jp AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM js a JOIN js b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
je AS (SELECT a, b FROM jp JOIN jn x ON a = x.doc_id JOIN jn y ON b = y.doc_id WHERE {den} * c >= {num} * (x.n + y.n - c)),
jr AS (SELECT doc_id AS a, doc_id AS b FROM jw UNION SELECT jr.a, je.b FROM jr JOIN je ON jr.b = je.a),
comp AS (SELECT jw.doc_id, coalesce(jn.n, 0)::BIGINT AS n_shingles, r.m AS component_id
  FROM jw JOIN (SELECT a, min(b) AS m FROM jr GROUP BY a) r ON r.a = jw.doc_id LEFT JOIN jn ON jn.doc_id = jw.doc_id)"""


SQL = {"op1_ngram_jaccard": f"WITH RECURSIVE {components_sql('documents', 3, 90, 100)} SELECT * FROM comp"}
QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
