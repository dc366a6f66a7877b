"""Quality rules by host: counts for each document, failure rates for each host, verdicts joined back.

One pass over whole texts counts what the rules need (numpy over Arrow buffers, a bounded run of texts at a time). The
failures of a host's documents are summed, the host's rate is shrunk towards the mean of all hosts by a beta prior
whose strength comes from the spread between hosts, and the verdict goes back to the host's documents.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; repeated
rows count each; an empty table gives an empty result; other columns pass through untouched unless an output column
has their name, then the output wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.shared import WORD, written
from stratalith.llm.text import IS_SPACE, Words, mix, runs

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTENT = ~IS_SPACE
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags between neighbouring offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur before, does it occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return before, many


def text_counts(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of each text of a column."""
    out = {k: [] for k in COUNTS}
    for _, _, data, at in runs(column):
        words, lines = Words(data, at), Words(data, at, space=_LINE_END)
        filled = _per_text(_CONTENT[data], np.concatenate([lines.start, [len(data)]])) > 0 if lines.n else np.zeros(0, bool)
        dup, _ = _earlier(mix(lines.hash ^ mix(lines.doc.astype(np.uint64))))
        gram, ok = words.grams(window)
        _, many = _earlier(mix(gram[ok] ^ mix(words.doc[ok].astype(np.uint64))))
        steps = np.zeros(words.n + window + 1, np.int64)
        begin = np.nonzero(ok)[0][many]
        steps[begin] += 1
        steps[begin + window] -= 1
        out["n_words"].append(np.diff(words.first))
        out["word_chars"].append(_per_text(_CONTENT[data] & ((data & 0xC0) != 0x80), at))
        out["n_symbols"].append(_per_text(_SYMBOL[data], at))
        out["n_dup_lines"].append(_per_text(dup & filled, lines.first))
        out["n_repeat_words"].append(_per_text(np.cumsum(steps)[: words.n] > 0, words.first))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The keep columns of docs with COUNTS of the text column."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = text_counts(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(got[k]) for k in COUNTS)], names=[*keep, *COUNTS])

    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    schema = given.drop("__text").schema
    for k in COUNTS:
        schema = schema.add(k, "long")
    return given.mapInArrow(count, schema)


def rules() -> dict[str, F.Column]:
    """Rule name to a condition that holds where the rule fails, over COUNTS."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 100 * F.col("n_symbols") > 10 * n,
        "dup_lines": F.col("n_dup_lines") * 100 > 10 * n,
        "word_length": (chars < 2 * n) | (chars > 12 * n),
    }


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta by moments from the rates of hosts with at least 20 documents (three sums reach the driver)."""
    rate = F.col("failed") / F.col("docs")
    m, v, noise = hosts.filter("docs >= 20").agg(F.avg(rate), F.var_pop(rate), F.avg(rate * (1 - rate) / F.col("docs"))).first()
    if m is None or not 0 < m < 1:
        return 1.0, 1.0
    spread = max(v - noise, 1e-6)
    strength = min(max(m * (1 - m) / spread - 1, 2.0), 1000.0)
    return m * strength, (1 - m) * strength


def quality(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, reject_rate: float = 0.5) -> DataFrame:
    """docs with COUNTS, base_failed, n_failed (rules), host_rate (shrunk share of failing documents), host_kept, kept.

    A document is kept if its host is kept and it fails no rule; in a host whose rate is below half the mean, one failed
    rule that isn't a base rule is forgiven. A host is kept while its shrunk failure rate is at most reject_rate.
    """
    keep = list(dict.fromkeys([*(docs.columns if keep is None else keep), host]))
    failed = rules()
    counted = written(with_counts(docs, text, [c for c in keep if c != text]))
    n_failed = sum((c.cast("int") for c in failed.values()), F.lit(0))
    scored = counted.withColumns({"base_failed": failed["short"] | failed["repeats"], "n_failed": n_failed})
    hosts = written(scored.groupBy(F.col(f"`{host}`").alias("__host")).agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("n_failed") > 0).cast("long")).alias("failed")))
    a, b = beta_prior(hosts)
    verdicts = hosts.select("__host", ((F.col("failed") + a) / (F.col("docs") + a + b)).alias("host_rate")).withColumn("host_kept", F.col("host_rate") <= reject_rate)
    allowed = F.when(F.col("host_rate") < 0.5 * a / (a + b), 1).otherwise(0)
    return (
        scored.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left").drop("__host")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_kept") & (F.col("n_failed") <= allowed))
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, keep=["doc_id", "source"]).select("doc_id", *COUNTS, "base_failed", "kept", "n_failed", "host_kept")


SQL = {
    "op7_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM d, range(0, 8) AS x(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY ALL),
dl AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup FROM l GROUP BY doc_id),
c AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    (n_words < 20)::INT + (100 * n_repeat_words > 30 * n_words)::INT + (100 * n_symbols > 10 * n_words)::INT
    + (100 * n_dup_lines > 10 * n_words)::INT + (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT AS n_failed
  FROM c),
s AS (SELECT source, count(*) AS docs, sum((n_failed > 0)::INT) AS failed FROM f GROUP BY source),
p AS (
  SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v, avg(failed / docs * (1 - failed / docs) / docs) AS noise FROM s WHERE docs >= 20),
q AS (
  SELECT CASE WHEN m > 0 AND m < 1 THEN m ELSE 0.5 END AS m,
    CASE WHEN m > 0 AND m < 1 THEN least(greatest(m * (1 - m) / greatest(v - noise, 1e-6) - 1, 2.0), 1000.0) ELSE 2.0 END AS k FROM p),
hv AS (SELECT source, (failed + m * k) / (docs + k) AS host_rate, m FROM s, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate <= 0.5 AND n_failed <= CASE WHEN host_rate < 0.5 * m THEN 1 ELSE 0 END AS kept, n_failed, host_rate <= 0.5 AS host_kept
FROM f JOIN hv ON f.source IS NOT DISTINCT FROM hv.source"""
}
QUERIES = {"op7_quality_rules": op7_quality_rules}
