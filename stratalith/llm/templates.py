"""Benchmark leaks by templates: numbers, names and units become typed placeholders, windows of templates are joined.

A token is a run of letters and digits. A token with a digit is a number, with points and commas between digits in it, so
5, 2.5 and 1,250 are one token each; one from a short list is a unit; one that begins with a capital letter is a name (so
the first word of a sentence is one, in the benchmark and in the document alike), and a run of names is one name; all
others stand for themselves in lower case. Windows of `window` tokens with at least `literals` plain ones are hashed;
document windows are held against the benchmark's by a hash join. Matches of one document and item on one diagonal
(document position minus item position) are a candidate: the values in the placeholders must map one to one, number to
number and name to name, all along the diagonal. So a question with other numbers or names is found, and a chance
likeness with mixed values is not. Words put in or left out shift what follows, so a diagonal is taken together with the
next `slack` ones, and the values must map one to one along all of them.

Beside templates the plain words are held against each other without their letters' case, in windows as long: texts in
capitals or in small letters have no names to make templates of. A document leaks an item if, in one of the two ways,
at least `share` of the item's windows match, or matching windows cover `cover` of what its windows cover at all.

An item that leaks matches one of the rarest of its windows (all but the fewest that can be enough), so only these make
candidates: a phrase that many items have brings no document together with all of them.

The benchmark's window hashes are sent to the tasks to drop windows without a partner before any shuffle, if its windows
take `bound` bytes at most; a larger benchmark is joined by a shuffle. Nothing else depends on its size.

Defined cases: null or empty texts have no windows; items with fewer tokens than a window are one window of their own
length; an item none of whose windows has `literals` plain tokens leaks where the same tokens stand (names as names), or, with
fewer than `literals` tokens, into a document that has no others; rows with a null id are not reported; repeated ids are
one document; an empty table on either side gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from stratalith.llm.shared import written
from stratalith.llm.text import _BASE, _INVERSE, Words, _power, mix, runs, signed

UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yd yard yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents pound pounds"
).split()
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), lower=True).hash


_UNIT_HASHES = np.sort(_hash_of(UNITS))
_MARK = mix(np.arange(11, 14, dtype=np.uint64))
#: Capital letters by code point, below those of four bytes.
_CAPITAL = np.array([unicodedata.category(chr(i)) == "Lu" for i in range(0x10000)])
_JOIN = np.array([chr(b) in ".," for b in range(256)])
TEMPLATE, VERBATIM, WHOLE, FOLDED = (np.uint64(x) for x in (0x11, 0x5C6F, 0x93D1, 0x2B57))
#: Sizes from here on are those of windows of plain words, less this number.
PLAIN = 1000


def _small_letters(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of two bytes from À to Þ made small; A to Z are left to Words."""
    out = data.copy()
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:][capital] += 0x20
    return out


def _first_points(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at start (0 for those of four bytes)."""
    at = lambda k: data[np.minimum(start + k, len(data) - 1)].astype(np.int64)
    a, b, c = at(0), at(1) & 63, at(2) & 63
    return np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, 0)))


class Tokens:
    """Tokens of a run of texts: doc, first (tokens before each text), kind (0 plain, 1 number, 2 unit, 3 name), shown, value and plain hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        if len(data):
            inner = np.zeros(len(data), bool)
            inner[1:-1] = _JOIN[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
            inner[at[at < len(data)]] = False
            inner[at[at > 0] - 1] = False
            data = np.where(inner, np.uint8(0xB7), data)  # no text has this byte alone
        words = Words(data, at, lower=True, space=_BREAK)
        self.word, self.word_first, self.word_doc = Words(_small_letters(data), at, lower=True, space=_BREAK).hash, words.first, words.doc
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = digits[words.end] > digits[words.start]
        name = _CAPITAL[_first_points(data, words.start)] if words.n else np.zeros(0, bool)
        kind = np.where(number, 1, np.where(name, 3, np.where(np.isin(words.hash, _UNIT_HASHES), 2, 0)))
        again = np.zeros(words.n, bool)
        again[1:] = (kind[1:] == 3) & (kind[:-1] == 3) & (words.doc[1:] == words.doc[:-1])
        lo = np.nonzero(~again)[0]
        self.plain = words.spans(lo, np.concatenate([lo[1:], [words.n]])) if words.n else np.zeros(0, np.uint64)
        self.n, self.doc, self.kind = len(lo), words.doc[lo], kind[lo]
        self.first = np.searchsorted(lo, words.first)
        self.shown = np.where(self.kind == 0, self.plain, _MARK[np.maximum(self.kind, 1) - 1])
        self.value = mix(self.plain ^ mix(self.kind.astype(np.uint64)))

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows with enough plain tokens."""
        begin, h = self._grams(self.shown, size, TEMPLATE)
        plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        ok = plain[begin + size] - plain[begin] >= literals
        return begin[ok], h[ok]

    def verbatim(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self._grams(self.plain, size, VERBATIM)

    def whole(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts with fewer tokens, for the text as a whole."""
        counts = np.diff(self.first)
        out = [(self.first[:-1][counts == n], self._at(self.plain, self.first[:-1][counts == n], n, WHOLE)) for n in range(1, below)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def folded(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of plain words."""
        n = len(self.word)
        begin = np.nonzero(np.arange(n) + size <= self.word_first[1:][self.word_doc])[0] if n else np.zeros(0, np.int64)
        return begin, self._at(self.word, begin, size, FOLDED)

    def _grams(self, of: np.ndarray, size: int, tag: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        begin = np.nonzero(np.arange(self.n) + size <= self.first[1:][self.doc])[0] if self.n else np.zeros(0, np.int64)
        return begin, self._at(of, begin, size, tag)

    @staticmethod
    def _at(of: np.ndarray, begin: np.ndarray, size: int, tag: np.uint64) -> np.ndarray:
        """Hash of `size` values from each begin on, by prefix sums."""
        total = np.zeros(len(of) + 1, np.uint64)
        np.cumsum(of * _power(_BASE, len(of))[: len(of)], out=total[1:])
        return mix((total[begin + size] - total[begin]) * _power(_INVERSE, len(of))[begin] + np.uint64(size) * tag)


def window_rows(texts: DataFrame, key: str, window: int, literals: int, sizes: list[int] | None = None, partners: np.ndarray | None = None) -> DataFrame:
    """(key, pos, size, h, slots) of the windows of texts (key, text).

    Without sizes (items) a text has windows of `window` or its own length, or one exact row. With sizes (documents) it has
    the windows of all sizes; a size below 0 is one of exact sequences, 0 stands for whole short texts, one above PLAIN for
    windows of plain words. With partners only
    rows whose hash is among them are given. slots: for each placeholder of the window a hash of its value with its kind.
    """
    sent = None if partners is None else texts.sparkSession.sparkContext.broadcast(np.sort(partners))

    def of_document(tokens: Tokens) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n in sizes:
            yield n, *(tokens.folded(n - PLAIN) if n > PLAIN else tokens.windows(n, literals) if n > 0 else tokens.verbatim(-n) if n else tokens.whole(literals))

    def of_item(tokens: Tokens) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        counts = np.diff(tokens.first)
        bare = counts > 0
        for n in np.unique(np.minimum(counts[bare], window)).tolist():
            begin, h = tokens.windows(n, literals)
            mine = np.minimum(counts[tokens.doc[begin]], window) == n
            bare[tokens.doc[begin[mine]]] = False
            yield n, begin[mine], h[mine]
        for n in np.unique(counts[bare]).tolist():
            begin, h = tokens.verbatim(n) if n >= literals else tokens.whole(literals)
            mine = bare[tokens.doc[begin]] & (counts[tokens.doc[begin]] == n)
            yield -n if n >= literals else 0, begin[mine], h[mine]
        yield PLAIN + window, *tokens.folded(window)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, at in runs(b.column(1)):
                tokens = Tokens(data, at)
                for size, begin, h in of_item(tokens) if sizes is None else of_document(tokens):
                    if sent is not None and len(begin):
                        place = np.minimum(np.searchsorted(sent.value, h), len(sent.value) - 1)
                        hit = sent.value[place] == h if len(sent.value) else np.zeros(len(h), bool)
                        begin, h = begin[hit], h[hit]
                    grid = begin[:, None] + np.arange(size if 0 < size < PLAIN else 0)
                    slot = tokens.kind[grid] > 0
                    bounds = np.concatenate([[0], np.cumsum(slot.sum(1))]).astype(np.int32)
                    slots = pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(tokens.value[grid][slot])))
                    doc, first = (tokens.word_doc[begin], tokens.word_first) if size > PLAIN else (tokens.doc[begin], tokens.first)
                    place = (begin - first[doc]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + lo)), pa.array(place), pa.array(np.full(len(begin), size, np.int32)), pa.array(signed(h)), slots], names=[key, "pos", "size", "h", "slots"])

    given = texts.select(key, "text").filter(f"{key} IS NOT NULL AND text IS NOT NULL")
    return given.mapInArrow(emit, given.select(key).schema.add("pos", "integer").add("size", "integer").add("h", "long").add("slots", ArrayType(LongType())))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 8, literals: int = 4, share: float = 0.5, cover: float = 0.8, slack: int = 3, bound: int = 64_000_000) -> DataFrame:
    """doc_id, item_id, windows, total, verbatim of each leaked item in each document: the diagonal (with the next ones) with most windows."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    item_rows = written(window_rows(items, "item_id", window, literals))
    size = item_rows.agg(F.coalesce(F.sum(40 + 8 * F.size("slots")), F.lit(0))).first()[0]
    sizes = sorted(r["size"] for r in item_rows.select("size").distinct().collect())
    few = size <= bound
    partners = item_rows.select("h").distinct().toArrow()["h"].to_numpy().view(np.uint64) if few else None
    hint = F.broadcast if few else lambda df: df
    found = written(window_rows(docs, "doc_id", window, literals, sizes, partners).select("doc_id", F.col("pos").alias("at"), "h", F.col("slots").alias("values")))

    # of an item's windows, the rarest that one of must match if as many match as can be enough
    way = (F.col("size") > PLAIN).alias("plain")
    item_rows = item_rows.withColumn("plain", way)
    common = item_rows.select("item_id", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    totals = item_rows.groupBy("item_id", "plain").agg(F.count(F.lit(1)).alias("total"), _covered().alias("reach"), F.max("size").alias("size"))
    enough = F.least(F.ceil(F.lit(share) * F.col("total")), F.ceil(F.lit(cover) * F.col("reach") / _width()))
    least = totals.select("item_id", "plain", "total", F.greatest(enough, F.lit(1)).alias("enough"))
    order = Window.partitionBy("item_id", "plain").orderBy("items", "h", "pos")
    ranked = item_rows.select("item_id", "plain", "h", "pos").join(common, "h").withColumn("r", F.row_number().over(order)).join(hint(least), ["item_id", "plain"])
    rare = ranked.filter(F.col("r") <= F.col("total") - F.col("enough") + 1).select("h", "item_id").distinct()
    candidates = written(found.select("doc_id", "h").join(hint(rare), "h").select("doc_id", "item_id").distinct())

    both = candidates.join(found, "doc_id").join(hint(item_rows), ["h", "item_id"])
    key = ["doc_id", "item_id", "plain", "diagonal"]
    zipped = F.arrays_zip(F.col("slots").alias("a"), F.col("values").alias("b")).alias("zip")
    pairs = both.select("doc_id", "item_id", "plain", F.explode(F.sequence(F.lit(0), F.lit(slack))).alias("s"), "at", "pos", "size", zipped)
    pairs = written(pairs.select("doc_id", "item_id", "plain", (F.col("at") - F.col("pos") - F.col("s")).alias("diagonal"), "pos", "size", "zip"))
    counts = pairs.groupBy(*key).agg(F.countDistinct("pos").alias("windows"), _covered().alias("covered"))
    values = pairs.select(*key, F.explode("zip").alias("z")).select(*key, "z.*").toDF(*key, "a", "b").distinct()
    one = values.groupBy(*key, "a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    back = one.groupBy(*key, "b").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"), F.max((F.col("a") != F.col("b")).cast("int")).alias("moved"))
    slots = back.groupBy(*key).agg(F.max(F.greatest("n", "m")).alias("worst"), F.max("moved").alias("moved"))
    joined = counts.join(slots, key, "left").filter("coalesce(worst, 1) = 1").join(hint(totals.drop("size")), ["item_id", "plain"])
    joined = joined.filter((F.col("windows") >= F.lit(share) * F.col("total")) | (F.col("covered") >= F.lit(cover) * F.col("reach")))
    best = F.max(F.struct("windows", (F.coalesce("moved", F.lit(0)) == 0).alias("verbatim"), "total")).alias("best")
    return joined.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.windows", "best.total", "best.verbatim")


def _width() -> F.Column:
    """Tokens of a window of this size."""
    return F.greatest(F.when(F.col("size") > PLAIN, F.col("size") - PLAIN).otherwise(F.abs("size")), F.lit(1))


def _covered() -> F.Column:
    """Tokens that windows cover: each those before the next begins; as many as an item has at most."""
    starts, width = F.array_sort(F.collect_set("pos")), F.first(_width())
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("end")), lambda acc, p: F.struct((acc["n"] + width - F.greatest(acc["end"] - p, F.lit(0))).cast("int").alias("n"), (p + width).cast("int").alias("end")), lambda acc: acc["n"])


def op8_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UNIT_SQL = ", ".join(f"'{u}'" for u in UNITS)


_CAPITALS = "".join(chr(c) for c in (*range(0x41, 0x5B), *(x for x in range(0xC0, 0xDF) if x != 0xD7)))
_SMALL = "".join(chr(ord(c) + 32) for c in _CAPITALS)


def _tokens_sql(name: str, key: str, table: str) -> str:
    """Items and documents of eight tokens or more; no item of the tables is shorter or without a usable window."""
    return rf"""
{name}k AS (SELECT {key} AS k, regexp_extract_all(regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1‧\2', 'g'), '([0-9])[.,]([0-9])', '\1‧\2', 'g'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table}),
{name}c AS (SELECT k, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN 1 WHEN regexp_matches(x, '^\p{{Lu}}') THEN 3 WHEN x IN ({_UNIT_SQL}) THEN 2 ELSE 0 END) AS c FROM {name}k),
{name}s AS (SELECT k, w, c, list_filter(range(1, len(w) + 1), lambda i: NOT (c[i] = 3 AND i > 1 AND coalesce(c[i - 1], 0) = 3)) AS s FROM {name}c),
{name}t AS (SELECT k, list_transform(range(1, len(s) + 1), lambda j: array_to_string(w[s[j]:coalesce(s[j + 1], len(w) + 1) - 1], ' ')) AS w, list_transform(s, lambda i: c[i]) AS c FROM {name}s WHERE len(s) >= 8),
{name}i AS (SELECT k, i, w[i:i + 7] AS w, c[i:i + 7] AS c FROM (SELECT k, w, c, unnest(range(1, len(w) - 6)) AS i FROM {name}t)),
{name} AS (SELECT k, false AS plain, i, array_to_string(list_transform(range(1, 9), lambda j: CASE c[j] WHEN 0 THEN w[j] ELSE '<' || c[j] || '>' END), ' ') AS h,
  list_transform(list_filter(range(1, 9), lambda j: c[j] > 0), lambda j: c[j] || translate(w[j], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM {name}i WHERE len(list_filter(c, lambda x: x = 0)) >= 4
UNION ALL SELECT k, true, i, translate(array_to_string(w[i:i + 7], ' '), '{_CAPITALS}', '{_SMALL}'), [] FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM {name}k WHERE len(w) >= 8))"""


def _covered_sql(places: str) -> str:
    return f"(8 + list_sum(list_transform(range(2, len({places}) + 1), lambda j: least(8, {places}[j] - {places}[j - 1])))::BIGINT)"


SQL = {
    "op8_template_leaks": f"""
WITH {_tokens_sql("d", "doc_id", "documents")}, {_tokens_sql("b", "item_id", "benchmark")},
p AS (SELECT d.k AS doc_id, b.k AS item_id, b.plain, d.i - b.i - z AS diagonal, b.i AS pos, b.s AS a, d.s AS z FROM d JOIN b ON d.h = b.h AND d.plain = b.plain, range(0, 4) AS y(z)),
n AS (SELECT doc_id, item_id, plain, diagonal, count(DISTINCT pos) AS windows, list_sort(list_distinct(list(pos))) AS places FROM p GROUP BY ALL),
v AS (SELECT DISTINCT doc_id, item_id, plain, diagonal, unnest(a) AS a, unnest(z) AS z FROM p),
s AS (SELECT doc_id, item_id, plain, diagonal, count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT z) AS fit, bool_and(a = z) AS same FROM v GROUP BY ALL),
t AS (SELECT k AS item_id, plain, count(*) AS total, list_sort(list(i)) AS places FROM b GROUP BY ALL),
r AS (SELECT n.doc_id, n.item_id, windows, total, coalesce(same, true) AS verbatim FROM n LEFT JOIN s USING (doc_id, item_id, plain, diagonal) JOIN t USING (item_id, plain)
  WHERE coalesce(fit, true) AND (windows >= 0.5 * total OR coalesce({_covered_sql("n.places")}, 8) >= 0.8 * coalesce({_covered_sql("t.places")}, 8)))
SELECT doc_id, item_id, (max((windows, verbatim, total)))[1] AS windows, (max((windows, verbatim, total)))[3] AS total, (max((windows, verbatim, total)))[2] AS verbatim FROM r GROUP BY doc_id, item_id"""
}
QUERIES = {"op8_template_leaks": op8_template_leaks}
