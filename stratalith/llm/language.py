"""Language by compression: each text is compressed with a raw-content dictionary of each language; the smallest wins.

Dictionaries are made of a bounded sample of labelled texts (`total` bytes over all languages, `per_language` bytes for one
at most). Whole texts are cut into pieces of `piece` characters or less, and a language's dictionary takes those with the
least hash, wherever they stand; so it holds many texts, and every language gets one. Texts are compressed whole. The
score is a softmax over the bits a character that each language costs; a prediction whose margin over the second is below
`least_margin` bits a character is marked as rejected, and open_set() turns it into `und`.

Defined cases: a text that is null or has no letter is `und` with score 0 and rejected; a text of a few letters gets a
prediction with a low score; ties go to the language first by name; without any labelled text everything is `und`;
lines that the sample has in two languages (licences, boilerplate) say nothing of either and are left out of both, unless
a language would have no other; repeated rows count each; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Matches of three bytes matter in short texts, so the encoder is told to look for them.
ENCODER = {"window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 3, "min_match": 3, "target_length": 16, "write_content_size": False, "write_dict_id": False}
#: The gain by a dictionary fades as the encoder learns the text itself; so long texts are compressed as blocks of this
#: many bytes, each with the dictionary, and the sizes summed. Every byte counts.
BLOCK = 8192
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words of letters with one space between."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def samples(labelled: DataFrame, per_language: int = 16384, total: int = 1 << 24, piece: int = 512) -> dict[str, bytes]:
    """language -> dictionary content, from labelled (key, text, lang): at most `total` bytes, `per_language` for each."""
    named = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 0").select("key", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes:
        return {}
    room = max(256, min(per_language, total // len(sizes)))
    lines = named.select("key", "lang", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("x"), F.lit(1)), F.lit(piece))
    cut = lines.select("key", "lang", "line", "x", F.explode(starts).alias("at")).select("lang", F.substring("x", F.col("at"), F.lit(piece)).alias("x"), F.xxhash64("key", "line", "at").alias("h"))
    # a first cut of the hash range, for about sixteen times what fits in characters; then by rank
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 16.0 * room / n)))), F.col("lang"))
    chosen = cut.filter((F.trim("x") != "") & (F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))).dropDuplicates(["lang", "x"])
    before = F.sum(F.length("x")).over(Window.partitionBy("lang").orderBy("h", "x").rowsBetween(Window.unboundedPreceding, -1))
    kept = chosen.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 2 * room).select("lang", "x", "h")
    found: dict[str, list[bytes]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["h"], r["x"])):
        if line := letters(r["x"]):
            found.setdefault(r["lang"], []).append(line)
    times = Counter(line for lines in found.values() for line in set(lines))
    out = {}
    for lang, mine in sorted(found.items()):
        own = [x for x in dict.fromkeys(mine) if times[x] == 1] or list(dict.fromkeys(mine))
        out[lang] = b" ".join(own)[:room]
    return out


def scored(docs: DataFrame, dictionaries: dict[str, bytes], text: str, keep: list[str], least_margin: float = 0.02) -> DataFrame:
    """The keep columns with lang_pred, score, margin and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        names = list(shared.value)
        packers = []
        for content in shared.value.values():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            packers.append(zstd.ZstdCompressor(dict_data=d, compression_params=zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_LAZY, **ENCODER)).compress)
        for b in batches:
            pred, score, margin = [], [], []
            for value in b.column(b.num_columns - 1).to_pylist():
                raw = letters(value or "")
                if not names or not raw or not any(map(str.isalpha, value)):
                    pred.append("und")
                    score.append(0.0)
                    margin.append(0.0)
                    continue
                size = np.array([sum(len(pack(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for pack in packers])
                bits = 8.0 * size / len(raw)
                best = int(bits.argmin())
                weight = np.exp(-20.0 * (bits - bits[best]))
                pred.append(names[best])
                score.append(float(1 / weight.sum()))
                margin.append(float(np.sort(bits)[1] - bits[best]) if len(bits) > 1 else 8.0)
            rejected = [m < least_margin for m in margin]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "margin", "rejected"])

    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    schema = given.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return given.mapInArrow(classify, schema)


def open_set(predicted: DataFrame) -> DataFrame:
    """Predictions with narrow margins become `und`."""
    return predicted.withColumn("lang_pred", F.when(F.col("rejected"), "und").otherwise(F.col("lang_pred")))


def op2_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.filter(~held_out("doc_id")).select(F.col("doc_id").alias("key"), "text", "lang")
    out = scored(docs, samples(learn), "text", ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


SQL: dict[str, str] = {}
QUERIES = {"op2_zstd_language": op2_zstd_language}
