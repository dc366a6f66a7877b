"""Fill-in-the-middle at line boundaries, cut through a learned index of each text's boundaries.

The byte offsets of a text's boundaries (before its first line, after each line) grow with their rank. They are fitted by
straight segments of bounded error, each as long as a line through its first point allows; what the prediction is off
stays as a 16-bit residual, so any rank gives its offset exactly without a look at the text. rank_index() keeps the
index as a table: cuts() then takes as many pairs of cuts as wanted from it. filled() indexes, cuts and composes the
training text in one pass without a shuffle; restored() is its inverse.

Defined cases: a null text is an empty one, has no line and stays plain; so does a text that holds a mark; a null id
draws its numbers from the seed alone; repeated rows give equal results; an empty table gives an empty result; other
columns pass through, but for those with a name of the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalith.llm.text import runs

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Offsets that a prediction may be off; a residual has to fit 16 bits.
ERROR = 1024
_INDEX = "n_lines long, first_rank array<int>, first_offset array<long>, slope array<double>, residual binary"


@dataclass
class RankIndex:
    """Rank to offset: the first rank, its offset and the slope of each segment, and what each prediction is off."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @property
    def lines(self) -> int:
        return len(self.residual) - 1

    def _predicted(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, "right") - 1
        return self.base[at] + np.rint(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offset(self, rank) -> np.ndarray:
        """Exact offsets of these ranks."""
        rank = np.asarray(rank, np.int64)
        return self._predicted(rank) + self.residual[rank]


def fitted(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index of rising offsets: a segment ends where no slope from its first point keeps all offsets within error."""
    if not 0 <= error <= 32_000:
        raise ValueError("residuals have 16 bits")
    first, slope, at, n = [], [], 0, len(offsets)
    while at < n:
        low, high, end, step = -np.inf, np.inf, at + 1, 32
        while end < n:
            stop = min(n, end + step)
            run, rise = np.arange(end - at, stop - at), offsets[end:stop] - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            beyond = np.nonzero(lows > highs)[0]
            fit = int(beyond[0]) if len(beyond) else stop - end
            if fit:
                low, high = lows[fit - 1], highs[fit - 1]
            end, step = end + fit, 2 * step
            if len(beyond):
                break
        first.append(at)
        slope.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    first = np.array(first, np.int64)
    index = RankIndex(first, offsets[first], np.array(slope), np.zeros(n, np.int16))
    index.residual = (offsets - index._predicted(np.arange(n))).astype(np.int16)
    return index


def boundaries(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text's bytes with the offsets of its boundaries: 0 and the end of each line."""
    for _, _, data, at in runs(column):
        ends = np.nonzero(data == 10)[0] + 1
        cut, whole = np.searchsorted(ends, at, "right"), data.tobytes()
        for i in range(len(at) - 1):
            a, b = at[i], at[i + 1]
            own = ends[cut[i] : cut[i + 1]] - a
            tail = [b - a] if b > a and data[b - 1] != 10 else []
            yield whole[a:b], np.concatenate([[0], own, tail]).astype(np.int64)


def draws(seed: int, doc_id, copy: int = 0) -> list[int]:
    """Four unsigned 32-bit numbers from the sha256 of seed and id; further copies add their number."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}{f':{copy}' if copy else ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def _kept(docs: DataFrame, keep: list[str] | None, made: set[str]) -> list[str]:
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]


def rank_index(docs: DataFrame, text: str = "text", keep: list[str] | None = None, error: int = ERROR) -> DataFrame:
    """The keep columns (all but the text) with n_lines and the index's segments and residuals (16-bit, little endian)."""
    keep = _kept(docs.drop(text), keep, {"n_lines", "first_rank", "first_offset", "slope", "residual"})
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fitted(at, error) for _, at in boundaries(b.column(b.num_columns - 1))]
            made = [
                pa.array([x.lines for x in got], pa.int64()),
                pa.array([x.first.astype(np.int32) for x in got], pa.list_(pa.int32())),
                pa.array([x.base for x in got], pa.list_(pa.int64())),
                pa.array([x.slope for x in got], pa.list_(pa.float64())),
                pa.array([x.residual.astype("<i2").tobytes() for x in got], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keep, *_INDEX.replace(",", "").split()[::2]])

    return given.mapInArrow(index, _with(given.drop("__text"), _INDEX))


def _with(df: DataFrame, columns: str) -> StructType:
    """The schema of df and further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])


def cuts(index: DataFrame, doc_id: str = "doc_id", seed: int = 7, copies: int = 1) -> DataFrame:
    """(doc_id, copy, prefix_end, middle_end) in bytes, for each copy of each indexed text; the texts aren't read."""
    given = index.select(F.col(f"`{doc_id}`").alias("doc_id"), "first_rank", "first_offset", "slope", "residual")
    schema = _with(given.select("doc_id"), "copy int, prefix_end long, middle_end long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for key, first, base, slope, residual in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = RankIndex(np.array(first), np.array(base), np.array(slope), np.frombuffer(residual, "<i2"))
                for copy in range(copies):
                    a, c = draws(seed, key, copy)[:2]
                    ends = x.offset(sorted((a % (x.lines + 1), c % (x.lines + 1))))
                    for column, v in zip(out, (key, copy, int(ends[0]), int(ends[1])), strict=True):
                        column.append(v)
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=schema.names)

    return given.mapInArrow(cut, schema)


def _chars(piece: bytes) -> int:
    return len(piece) if piece.isascii() else len(piece.decode("utf-8", "surrogatepass"))


def composed(text: bytes, offsets: np.ndarray, drawn: list[int], rate: int, spm: int, error: int = ERROR) -> tuple:
    """(lines, form, characters of prefix and of middle, output) of one text."""
    lines = len(offsets) - 1
    if not text or drawn[2] % 100 >= rate or any(mark in text for mark in (_P, _S, _M)):
        return lines, "plain", None, None, text
    a, b = fitted(offsets, error).offset(sorted((drawn[0] % (lines + 1), drawn[1] % (lines + 1))))
    head, inner, rest = text[:a], text[a:b], text[b:]
    form = "spm" if drawn[3] % 100 < spm else "psm"
    output = b"".join((_S, rest, _P, head, _M, inner) if form == "spm" else (_P, head, _S, rest, _M, inner))
    return lines, form, _chars(head), _chars(inner), output


def filled(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, seed: int = 7, rate: int = 100, spm: int = 50, error: int = ERROR) -> DataFrame:
    """The keep columns with n (lines), form (plain, psm or spm), prefix_chars, middle_chars and the output text.

    rate and spm are percentages: of the texts that are rearranged, and of those that put the suffix first.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = _kept(docs, keep, {*names, "__id", "__text"})
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            ids = b.column(len(keep)).to_pylist()
            got = [composed(t, at, draws(seed, key), rate, spm, error) for key, (t, at) in zip(ids, boundaries(b.column(len(keep) + 1)), strict=True)]
            made = [pa.array([x[i] for x in got], k) for i, k in enumerate(kinds)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, *names])

    return given.mapInArrow(fill, _with(given.drop("__id", "__text"), "n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(output=None, form=None) -> F.Column:
    """The text from which an output of filled() was made, from the output and its form alone."""
    output, form = (F.col("output") if output is None else output), (F.col("form") if form is None else form)
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    one, two = F.substring(output, F.lit(4), second - 4), F.substring(output, second + 3, third - second - 3)
    inner = F.substring(output, third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, inner, two)).otherwise(F.concat(two, inner, one))


def op12_learned_rank_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = filled(docs, keep=["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = {
    "op12_learned_rank_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[25:32])::BIGINT AS h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi FROM u),
p AS (
  SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS z,
    CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(a) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
}
QUERIES = {"op12_learned_rank_fim": op12_learned_rank_fim}
