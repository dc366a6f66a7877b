"""Phrases whose words stand together more often than chance, mined by the SON partitioning.

1. Words are counted exactly for each language; a phrase as frequent as `support` has only words as frequent.
2. Each shard (a bounded run of whole texts in one task) is mined completely, level by level, for the phrases that it
   holds at least support * (its share of the language's words) times, rounded up. A phrase with that support overall
   reaches it in one shard at least.
3. The union of these, less those that can't reach the support even with the most that silent shards may hide, are the
   candidates; a second pass counts all of them in all texts exactly, and joins give the counts of their parts.

With `support` fixed while the corpus grows, the support of a shard falls to one, and every shard would name all its
phrases of frequent words. So from eight times shard_words on, all texts are first counted into hashed buckets, pairs
before longer phrases: a phrase has the support only if its bucket has, so only phrases of such buckets are mined. The
buckets grow with the words up to 2 ** 27, a byte each in a task; a bit each of them reaches the driver (16 MB).

Shards come from the input's splits; a shard that is full ends and the next begins, each with the support of its own
share, so neither memory nor completeness depends on how the input is split. Inside a shard phrases are told apart by
64-bit keys, across shards by their words.

Defined cases: a null or empty text has no words; a null language is `und`; repeated rows count each; an empty table
gives an empty result; ids and other columns aren't read. A total for each language and, if they are within `most`, the
64-bit keys of frequent words and of candidates reach the driver; beyond that words aren't used to prune, and candidates
are matched by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm.shared import dealt_join, small, written
from stratalith.llm.text import Words, mix, runs, signed

#: What parts pieces, and what parts words.
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK = _PIECE_END.copy()
_BREAK[[0x20, 0x09]] = True
LONGEST = 5
#: Words that are looked at at once, and of shards with texts.
_RUN, _COUNTED, _SUMMED = 1 << 20, 1_500_000, 1_000_000
_POWER = np.array([pow(0xD6E8FEB86659FD93, i, 2**64) for i in range(LONGEST)], np.uint64)


def _salt(language: str) -> np.uint64:
    return np.frombuffer(blake2b(language.encode(), digest_size=8).digest(), np.uint64)[0]


class Shard:
    """Words of a run of texts: key (with the language), language (a number of names), piece, start and end in data."""

    def __init__(self, names: list[str], parts: list[tuple]):
        """Takes the parts out of the list, column by column, so that they and their union aren't held twice."""
        self.names = names
        key, language, new, data, start, end = map(list, zip(*parts, strict=True))
        parts.clear()
        self.key, self.language = np.concatenate(key), np.concatenate(language)
        del key, language
        self.piece = np.cumsum(np.concatenate(new), dtype=np.int32)
        at = np.cumsum([0, *map(len, data)])
        kind = np.int32 if at[-1] < 2**31 else np.int64
        self.data = np.concatenate(data)
        self.start, self.end = (np.concatenate([x + a for x, a in zip(c, at[:-1], strict=True)]).astype(kind) for c in (start, end))

    def words(self) -> np.ndarray:
        """Number of words of each language."""
        return np.bincount(self.language, minlength=len(self.names))

    def text(self, first: int, k: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[first : first + k], self.end[first : first + k], strict=True)).decode("utf-8", "replace")


def _read(batches: Iterator[pa.RecordBatch], names: dict[str, int]) -> Iterator[tuple]:
    """(key, language, new, data, start, end) of the words of each run of whole texts (columns: language, text)."""
    for b in batches:
        code = np.array([names.setdefault(x, len(names)) for x in b.column(0).to_pylist()], np.int32)
        salts = np.array([_salt(x) for x in names], np.uint64)
        for lo, hi, data, at in runs(b.column(1)):
            low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            w = Words(low, at, space=_BREAK)
            if w.n:
                language = code[lo:hi][w.doc]
                ended = np.cumsum(_PIECE_END[low], dtype=np.int64)[w.start]
                new = np.ones(w.n, bool)
                new[1:] = (w.doc[1:] != w.doc[:-1]) | (ended[1:] != ended[:-1])
                yield mix(w.hash ^ salts[language]), language, new, low, w.start, w.end


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """Shards of whole texts that end with the text by which they reach `most` words."""
    names: dict[str, int] = {}
    parts: list[tuple] = []
    n = 0
    for part in _read(batches, names):
        parts.append(part)
        n += len(part[0])
        if n >= most:
            yield Shard(list(names), parts)
            n = 0
    if parts:
        yield Shard(list(names), parts)


class Buckets:
    """A bit for each hashed bucket of phrases, by number of words: whether the bucket has the support."""

    def __init__(self, bits: dict[int, np.ndarray], log: int):
        self.bits, self.log = bits, log

    def hold(self, k: int, key: np.ndarray) -> np.ndarray:
        """Which phrases of k words may have the support; all, if none were counted."""
        if k not in self.bits:
            return np.ones(len(key), bool)
        at = (key >> np.uint64(64 - self.log)).astype(np.int64)
        return (self.bits[k][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Keys:
    """A shard without its texts, for mining: 11 bytes a word, filled in place."""

    def __init__(self, most: int):
        self.n, self.names = 0, []
        self.key, self.language, self.new = np.empty(most, np.uint64), np.empty(most, np.int32), np.empty(most, bool)

    def add(self, key: np.ndarray, language: np.ndarray, new: np.ndarray) -> None:
        if self.n + len(key) > len(self.key):
            size = self.n + len(key)
            self.key, self.language, self.new = (np.concatenate([x[: self.n], np.empty(size - self.n, x.dtype)]) for x in (self.key, self.language, self.new))
        at = slice(self.n, self.n + len(key))
        self.key[at], self.language[at], self.new[at] = key, language, new
        self.n += len(key)

    def _phrases(self, ok: np.ndarray, code: int, k: int, likely: Buckets | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, keys) of a language's phrases of k words where ok and in a likely bucket, a bounded run at a time."""
        for lo in range(0, len(ok), _RUN):
            at = np.nonzero(ok[lo : lo + _RUN] & (self.language[lo : lo + _RUN][: len(ok) - lo] == code))[0] + lo
            raw = self.key[at]
            for j in range(1, k):
                raw += self.key[at + j] * _POWER[j]
            key = mix(raw + np.uint64(k))
            if likely:
                kept = likely.hold(k, key)
                at, key = at[kept], key[kept]
            yield at, key

    def frequent(self, allowed: np.ndarray | None, hidden: np.ndarray, longest: int = LONGEST, likely: Buckets | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(language, keys, counts) of the phrases that occur more often than hidden says for their language, level by level.

        A phrase is counted only if both its parts of one word less are frequent. A run of equal sorted keys is longer than
        `hidden` where a key equals the one `hidden` places on, so no table of all phrases is needed.
        """
        ok = np.ones(self.n, bool)
        if allowed is not None:
            for lo in range(0, self.n, _RUN):
                ok[lo : lo + _RUN] = held(self.key[lo : min(lo + _RUN, self.n)], allowed)
        seen = np.unique(self.language[: self.n])
        for k in range(2, longest + 1):
            both = ok[:-1] & ok[1:]
            if k == 2:
                both &= ~self.new[1 : self.n]  # longer phrases overlap in a word, so they lie in one piece if their parts do
            ok = np.zeros(len(both), bool)
            for code in seen:
                parts = [key for _, key in self._phrases(both, code, k, likely)]
                key = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                del parts
                key.sort()
                far = min(int(hidden[code]), len(key))
                known = np.unique(key[: len(key) - far][key[far:] == key[: len(key) - far]]) if far else np.unique(key)
                counts = np.searchsorted(key, known, "right") - np.searchsorted(key, known, "left")
                del key
                if not len(known):
                    continue
                yield code, known, counts
                for at, found in self._phrases(both, code, k, likely):
                    ok[at] = held(found, known)


def key_shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Keys]:
    """Shards without texts that end with the text by which they reach `most` words."""
    names: dict[str, int] = {}
    shard = Keys(most + _RUN)
    for key, language, new, *_ in _read(batches, names):
        shard.add(key, language, new)
        if shard.n >= most:
            shard.names = list(names)
            yield shard
            shard.n = 0
    if shard.n:
        shard.names = list(names)
        yield shard


def levels(shard: Shard, allowed: np.ndarray | None, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, key, at) for k = 2 .. longest: keys and first words of the phrases of k words whose two parts of k - 1 are kept.

    The caller sends back which of them (a mask) it keeps for the next level; allowed tells the words that may occur.
    """
    n = len(shard.key)
    ok = np.ones(n, bool) if allowed is None else allowed
    raw = shard.key
    for k in range(2, longest + 1):
        m = max(n - k + 1, 0)
        both = ok[:m] & ok[1 : m + 1] & (shard.piece[:m] == shard.piece[k - 1 :][:m])
        raw = raw[:m] + shard.key[k - 1 :][:m] * _POWER[k - 1]
        at = np.nonzero(both)[0]
        kept = yield k, mix(raw[at] + np.uint64(k)), at
        ok = np.zeros(m, bool)
        ok[at[kept]] = True


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrence, count, group of each) of equal keys."""
    order = np.argsort(key, kind="stable").astype(np.int32 if len(key) < 2**31 else np.int64)
    new = np.ones(len(key), bool)
    sorted_key = key[order]
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    del sorted_key
    begin = np.nonzero(new)[0]
    group = np.empty(len(key), np.int32)
    group[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[begin], np.diff(np.append(begin, len(key))), group


def held(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def local_support(support: int, words: int, total: int) -> int:
    """The least count that some shard must reach if the phrase reaches the support: its share, rounded up."""
    return max(1, -(-support * words // total))


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def word_counts(given: DataFrame, shard_words: int) -> DataFrame:
    """(language, word, key, count) of the words of (language, text); the row of a null word has the language's total."""
    kinds, names = [pa.string(), pa.string(), pa.int64(), pa.int64()], ["language", "word", "key", "count"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words):
            first, counts, _ = grouped(shard.key)
            totals = shard.words()
            seen = np.nonzero(totals)[0]
            yield _batch([[shard.names[i] for i in seen], [None] * len(seen), [None] * len(seen), totals[seen]], kinds, names)
            for lo in range(0, len(first), 100_000):
                part = first[lo : lo + 100_000]
                yield _batch([[shard.names[i] for i in shard.language[part]], [shard.text(i, 1) for i in part], signed(shard.key[part]), counts[lo : lo + 100_000]], kinds, names)

    found = given.mapInArrow(count, "language string, word string, key long, count long")
    return found.groupBy("language", "word", "key").agg(F.sum("count").alias("count"))


def bucketed(given: DataFrame, sizes: range, support: int, frequent, before: Buckets) -> Buckets:
    """before with the buckets of the phrases of these sizes: all words counted, in sums that stop at the support."""
    kind, log = (np.uint8 if support < 256 else np.int64), before.log
    width = 1 << min(log, 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << log, kind)
        for key, _, new, *_ in _read(batches, {}):
            ok = np.ones(len(key), bool) if frequent is None else held(key, frequent.value)
            for k in range(2, sizes.stop):
                both = ok[:-1] & ok[1:]
                if k == 2:
                    both &= ~new[1:]
                at = np.nonzero(both)[0]
                raw = key[at]
                for j in range(1, k):
                    raw += key[at + j] * _POWER[j]
                phrase = mix(raw + np.uint64(k))
                kept = before.hold(k, phrase)
                ok = np.zeros(len(both), bool)
                ok[at[kept]] = True
                if k in sizes:
                    place, counts = np.unique(phrase[kept] >> np.uint64(64 - log), return_counts=True)
                    place = place.astype(np.int64)
                    total[place] = np.minimum(total[place] + counts, support).astype(kind)
        for lo in range(0, len(total), width):
            if total[lo : lo + width].any():
                yield _batch([[lo // width], [total[lo : lo + width].tobytes()]], [pa.int32(), pa.binary()], ["block", "sums"])

    def enough(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind).astype(np.int64) for x in table["sums"].to_pylist())
        return pa.table({"block": pa.array(table["block"].to_pylist()[:1], pa.int32()), "bits": pa.array([np.packbits(total >= support, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros(1 << log - 3, np.uint8)
    found = given.mapInArrow(count, "block int, sums binary").groupBy("block").applyInArrow(enough, "block int, bits binary")
    for row in found.toLocalIterator():
        bits[row["block"] * width // 8 : (row["block"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return Buckets(before.bits | dict.fromkeys(sizes, bits), log)


def mined(given: DataFrame, totals: dict[str, int], support: int, shard_words: int, frequent, likely=None) -> DataFrame:
    """(language, key, over): how much each locally frequent phrase exceeds what a silent shard may hide; that, for a null key."""
    kinds, names = [pa.string(), pa.int64(), pa.int64()], ["language", "key", "over"]

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in key_shards(batches, shard_words + shard_words // 2):  # a task with a little more has no small rest
            words = np.bincount(shard.language[: shard.n], minlength=len(shard.names))
            hidden = np.array([local_support(support, int(w), totals[x]) - 1 if w else 0 for w, x in zip(words, shard.names, strict=True)], np.int64)
            seen = np.nonzero(words)[0]
            yield _batch([[shard.names[i] for i in seen], [None] * len(seen), hidden[seen]], kinds, names)
            for code, known, counts in shard.frequent(frequent.value if frequent else None, hidden, likely=likely.value if likely else None):
                for lo in range(0, len(known), 500_000):
                    part = slice(lo, lo + 500_000)
                    yield _batch([pa.repeat(shard.names[code], len(known[part])), signed(known[part]), counts[part] - hidden[code]], kinds, names)

    found = given.mapInArrow(mine, "language string, key long, over long")
    return found.groupBy("language", "key").agg(F.sum("over").alias("over"))


class _Sums:
    """Counts of candidates over all shards of a task, with the language and words of each that was seen."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.count, self.said = keys, np.zeros(len(keys), np.int64), {}

    def add(self, shard: Shard, k: int, key: np.ndarray, at: np.ndarray) -> None:
        first, counts, _ = grouped(key)
        place = np.searchsorted(self.keys, key[first])
        for i in np.nonzero(self.count[place] == 0)[0]:
            begin = int(at[first[i]])
            self.said[int(place[i])] = (shard.names[shard.language[begin]], shard.text(begin, k), k)
        self.count[place] += counts

    def rows(self) -> Iterator[tuple]:
        every = sorted(self.said)
        for lo in range(0, len(every), 100_000):
            part = every[lo : lo + 100_000]
            language, phrase, size = zip(*(self.said[i] for i in part), strict=True)
            yield language, signed(self.keys[part]), phrase, size, self.count[part]


def counted(given: DataFrame, shard_words: int, frequent, candidates, likely=None) -> DataFrame:
    """(language, key, phrase, size, count) of the candidates, summed in each task; of each shard's likely phrases if these are None."""
    kinds, names = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()], ["language", "key", "phrase", "size", "count"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(candidates.value) if candidates else None
        for shard in shards(batches, shard_words):
            steps = levels(shard, held(shard.key, frequent.value) if frequent else None)
            kept = None
            while True:
                try:
                    k, key, at = steps.send(kept)
                except StopIteration:
                    break
                if sums:
                    kept = held(key, candidates.value)
                    sums.add(shard, k, key[kept], at[kept])
                    continue
                kept = likely.value.hold(k, key) if likely else np.ones(len(key), bool)
                key, at = key[kept], at[kept]
                first, counts, _ = grouped(key)
                for lo in range(0, len(first), 100_000):
                    part = first[lo : lo + 100_000]
                    begin = at[part]
                    yield _batch([[shard.names[i] for i in shard.language[begin]], signed(key[part]), [shard.text(i, k) for i in begin], np.full(len(part), k, np.int32), counts[lo : lo + 100_000]], kinds, names)
        if sums:
            for columns in sums.rows():
                yield _batch(list(columns), kinds, names)

    return given.mapInArrow(count, "language string, key long, phrase string, size int, count long")


def _sent(keys: DataFrame, most: int):
    """The sorted 64-bit keys as a broadcast variable, or None if they are more than `most`."""
    if keys.count() > most:
        return None
    got = keys.toArrow().column(0).to_numpy().astype(np.int64)
    return keys.sparkSession.sparkContext.broadcast(np.sort(got.view(np.uint64)))


def _looked_up(cuts: DataFrame, known: DataFrame, part: str, out: str, rows: int, most: int) -> DataFrame:
    """cuts with the count of the phrase in column `part`; hot parts are dealt in several tasks where the join is shuffled."""
    keyed = known.select("language", F.col("phrase").alias(part), F.col("count").alias(out))
    if rows <= most:
        return cuts.join(F.broadcast(keyed), ["language", part])
    uses = cuts.groupBy("language", part).agg(F.count(F.lit(1)).alias("__uses"))
    return dealt_join(cuts, written(keyed.join(uses, ["language", part])), ["language", part], "__uses", ["phrase"])


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 100, shard_words: int = 20_000_000, most: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): (language, phrase, size, count) of all phrases of 2 to 5 words with the support; the frequent words likewise, with the language's total where phrase is null."""
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("language"), F.col(f"`{text}`").alias("text"))
    words = written(word_counts(given, min(shard_words, _COUNTED)).filter(F.col("word").isNull() | (F.col("count") >= support)))
    totals = {r["language"]: r["count"] for r in words.filter("word IS NULL").collect()}
    frequent = _sent(words.filter("word IS NOT NULL").select("key"), most)
    cores = spark.sparkContext.defaultParallelism
    # without buckets as few shards as memory and cores allow: the larger a shard, the higher its support
    n = sum(totals.values())
    size, likely = shard_words, None
    if n > 8 * shard_words:  # a shard has less than an eighth of the support
        buckets = Buckets({}, min(27, max(16, (n // 4).bit_length())))
        for sizes in (range(2, 3), range(3, LONGEST + 1)):
            buckets = bucketed(given.coalesce(cores), sizes, support, frequent, buckets)
        likely = spark.sparkContext.broadcast(buckets)
        size = max(1, shard_words // 2)  # low supports name few phrases now, so memory can be saved
    merged = given.coalesce(max(cores, -(-n // size)))
    found = written(mined(merged, totals, support, size, frequent, likely))
    hidden = found.filter("key IS NULL").select("language", F.col("over").alias("hidden"))
    keys = written(found.filter("key IS NOT NULL").join(small(hidden, len(totals)), "language").filter(F.col("over") + F.col("hidden") >= support).select("key"))
    candidates = _sent(keys, most)
    # a task sums all its texts, so each candidate is shuffled as often as there are tasks
    counts = counted(given.coalesce(2 * cores) if candidates else given, min(shard_words, _SUMMED), frequent, candidates, likely)
    if candidates is None:
        counts = counts.join(keys.distinct(), "key", "left_semi")
    phrases = counts.groupBy("language", "phrase", "size").agg(F.sum("count").alias("count")).filter(F.col("count") >= support)
    return written(phrases), words.select("language", F.col("word").alias("phrase"), F.lit(1).alias("size"), "count")


def scored(phrases: DataFrame, words: DataFrame, most: int = 1_000_000) -> DataFrame:
    """phrases with n, l, r and score of their lowest-scoring cut (ties: the shortest first part); 38-digit whole numbers."""
    known = phrases.unionByName(words.filter("phrase IS NOT NULL"))
    rows = known.count()
    w = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(w, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(w, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    cuts = _looked_up(_looked_up(cuts, known, "head", "l", rows, most), known, "rest", "r", rows, most)
    totals = words.filter("phrase IS NULL").select("language", F.col("count").alias("n"))
    cuts = cuts.join(small(totals, totals.count()), "language")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("count", "l", "r")}
    score = F.expr("div(top, bottom)")
    cuts = cuts.withColumns({"top": wide["count"] * (F.col("n") * 1000).cast("decimal(19,0)"), "bottom": wide["l"] * wide["r"]}).withColumn("score", score.cast("long"))
    best = cuts.groupBy("language", "phrase", "size", "count", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("language", "phrase", "size", "count", "n", "cut.score", "cut.k", "cut.l", "cut.r")


def maximal(phrases: DataFrame, share: int = 100) -> DataFrame:
    """(language, phrase) of those that no longer phrase with share percent of their count holds."""
    w = F.split("phrase", " ")
    inner = phrases.filter("size > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    inner = inner.select("language", F.array_join(F.slice(w, F.col("at"), F.col("k")), " ").alias("phrase"), F.col("count").alias("longer"))
    inner = inner.groupBy("language", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(inner, ["language", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("count"))).select("language", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 100, top: int | None = 2000, shard_words: int = 20_000_000, most: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` maximal phrases by score, count and phrase (None: all)."""
    phrases, words = frequent_phrases(docs, text, lang, support, shard_words, most)
    kept = scored(phrases, words).join(maximal(phrases), ["language", "phrase"], "left_semi")
    order = [F.desc("score"), F.desc("count"), F.asc("phrase")]
    if top is not None:  # first among the rows of one hash, then among those that stay
        part = Window.partitionBy("language", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        kept = kept.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select(F.col("language").alias("lang"), "rank", "phrase", F.col("count").alias("a"), "l", "r", "n", "score")


def op13_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op13_son_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
f AS (
  SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS x(k) WHERE len(w) >= k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, string_split(g, ' ') AS w, f FROM f WHERE k > 1 AND f >= 100),
s AS (
  SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN n USING (lang), range(1, 5) AS y(j)
  JOIN f AS l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:j], ' ') AND l.k = j
  JOIN f AS r ON r.lang = c.lang AND r.g = array_to_string(c.w[j + 1:], ' ') AND r.k = c.k - j WHERE j < c.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS (
  SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS g, max(f) AS longer
  FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS b FROM c, range(2, 5) AS z(m) WHERE m < k) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000"""
}
QUERIES = {"op13_son_collocations": op13_son_collocations}
