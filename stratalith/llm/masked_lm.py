"""Masked pseudo-likelihood of texts: a window network predicts every token from the two tokens on each side.

Words are hashed to 2 ** bits buckets, and every bucket is a token of its own; bits follows the number of distinct words
of the corpus (`most_bits` at most, 2 ** 20 tokens). Tokens are ranked by their counts over the whole corpus. A token is
predicted by steps: first the power of two that its rank lies between, by a softmax, then its bits inside that class, by
a logistic node each. All steps start from the counts, so an untrained network is the model of single words; the
nodes of a level have vectors of their own, and hear the neighbours, if `support` words of the corpus or more pass each on
average. So the vocabulary, the counts and the weights grow with the corpus.

The network adds an embedding for each of the four neighbours (tokens past `inputs` share one for each class). It is
trained in numpy on the executors: in each of `rounds` rounds the texts whose hash falls on the round give all their
words as targets, so every word of the corpus is predicted once in training; gradients at the same weights are summed
over all tasks and one Adagrad step follows. So the result does not depend on how rows are dealt to tasks, but for the
last digits of sums. Tasks send only those blocks of the gradient that they have touched.

A text's score is the sum of the log-probabilities of all its tokens, each given both sides, with the whole text read.

Defined cases: a null or empty text has no tokens, sum 0 and a null mean; a text of one word is predicted from borders
alone; repeated rows count each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.text import Words, runs

MOST_BITS = 20
WIDTH = 12
REACH = (-2, -1, 1, 2)
BLOCK = 4 * WIDTH  # weights that go together
WHOLE = 5  # levels below a class whose few nodes are multiplied with all words at once
PIECE = 1 << 17  # multiplications of a product
RUN = 1 << 19  # bytes of text at a time


class Vocabulary:
    """Ranks of buckets by count, and what follows from counts alone: classes, depths, log-probabilities of untrained steps."""

    def __init__(self, counts: np.ndarray, support: int = 1024, inputs: int = 2048):
        self.bits = max(1, int(len(counts) - 1).bit_length())
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.rank = np.empty(len(counts), np.int32)
        self.rank[order] = np.arange(len(counts))
        mass = np.maximum(counts[order], 0.5)  # an unseen bucket counts half
        place = np.arange(1, len(counts) + 1)
        self.kind = (np.frexp(place.astype(np.float64))[1] - 1).astype(np.int8)  # class of each rank: 2 ** class <= rank + 1
        classes = int(self.kind[-1]) + 1
        total = np.bincount(self.kind, mass, classes)
        self.class_log = np.log(total / total.sum())
        # the levels of a class whose nodes see `support` words on average are trained
        self.depth = np.array([min(c, max(0, int(np.log2(total[c] / support)) + 1 if total[c] >= support else 0)) for c in range(classes)])
        self.base = np.concatenate([[0], np.cumsum((1 << self.depth) - 1)])
        self.n_nodes, self.classes = int(self.base[-1]), classes
        self.lean, self.tail = np.zeros(2 << self.bits, np.float32), np.zeros(len(counts), np.float32)
        for c in range(1, classes):
            mine = np.arange((1 << c) - 1, min((2 << c) - 1, len(mass)))
            inside = np.concatenate([mass[mine], np.zeros((1 << c) - len(mine))])
            for k in range(c):  # nodes at level k: log odds of the right half against the left one
                halves = np.log(np.maximum(inside.reshape(1 << (k + 1), -1).sum(1).reshape(-1, 2), 1e-9))
                lean = self.lean[(1 << c) + (1 << k) : (1 << c) + (2 << k)] = halves[:, 1] - halves[:, 0]
                if k >= self.depth[c]:
                    node, bit = ((mine + 1) >> (c - k)) - (1 << k), ((mine + 1) >> (c - k - 1)) & 1
                    self.tail[mine] -= np.logaddexp(0, np.where(bit == 1, -1, 1) * lean[node])
        self.n_inputs = inputs + classes + 1  # tokens, classes of rarer tokens, the border of a text
        self.input_of = np.where(place <= inputs, place - 1, inputs + self.kind.astype(np.int64)).astype(np.int32)

    def tokens(self, words: Words) -> np.ndarray:
        return self.rank[(words.hash >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)

    def order(self, token: np.ndarray) -> np.ndarray:
        """Words by falling depth, then token: at each level those that have it come first, those of one node together."""
        return np.argsort(token + (int(self.depth.max()) - self.depth[self.kind[token]] << self.bits), kind="stable")

    def classes_of(self, token: np.ndarray) -> Iterator[tuple[int, slice, int]]:
        """(class, its words, levels that are taken as a whole) of the trained classes, for ordered tokens."""
        kind = self.kind[token]
        first = np.nonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))[0] if len(kind) else []
        for lo, hi in zip(first, [*first[1:], len(kind)], strict=True):
            c = int(kind[lo])
            if self.depth[c]:
                yield c, slice(lo, hi), min(WHOLE, int(self.depth[c]))

    def steps(self, token: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of words, their slots, leans and bits) of the other trained levels inside classes, for ordered tokens."""
        kind, place = self.kind[token].astype(np.int32), (token + 1).astype(np.int32)
        depth, base = self.depth[kind], self.base[kind].astype(np.int32)
        for k in range(WHOLE, int(depth.max(initial=0))):
            m = int(np.searchsorted(-depth, -k, "left"))
            heap = place[:m] >> (kind[:m] - k)
            yield m, base[:m] + heap - 1, self.lean[(1 << kind[:m]) + heap], (place[:m] >> (kind[:m] - k - 1)) & 1


class Network:
    """embed (4, inputs, d), cluster (d, classes), node (nodes, d) as views of one flat array."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        v = self.vocabulary = vocabulary
        shapes = (len(REACH), v.n_inputs, WIDTH), (WIDTH, v.classes), (v.n_nodes, WIDTH)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        if flat is None:
            flat = np.zeros(-(-int(ends[-1]) // BLOCK) * BLOCK, np.float32)
            flat[: ends[0]] = np.random.default_rng(11).normal(0, 0.3, ends[0])
        self.flat = flat
        self.embed, self.cluster, self.node = (x.reshape(s) for x, s in zip(np.split(flat[: ends[-1]], ends[:-1]), shapes, strict=True))

    def _sorted(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the words by token, their tokens, their hidden values), so that equal steps lie side by side."""
        v, token = self.vocabulary, self.vocabulary.tokens(words)
        order = v.order(token)
        near = neighbours(words, v.input_of[token], v.n_inputs - 1)[:, order]
        return order, token[order], np.tanh(sum(self.embed[j][near[j]] for j in range(len(REACH))))

    def _upper(self, c: int, token: np.ndarray, h: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors of the upper nodes of a class, log odds of all of them for each word, nodes on the words' ways, bits)."""
        v, n = self.vocabulary, (1 << levels) - 1
        vectors = self.node[v.base[c] : v.base[c] + n]
        odds = _times(h, vectors.T) + v.lean[(1 << c) + 1 : (1 << c) + 1 + n]
        place, k = (token + 1)[:, None], c - np.arange(levels)
        return vectors, odds, (place >> k) - 1, (place >> (k - 1)) & 1

    def log_probability(self, words: Words) -> np.ndarray:
        """Log-probability of each word given its neighbours."""
        v, out = self.vocabulary, np.zeros(words.n)
        order, token, h = self._sorted(words)
        z = _times(h, self.cluster) + v.class_log.astype(h.dtype)
        part = z[np.arange(words.n), v.kind[token]] - _log_sum(z) + v.tail[token]
        for c, mine, levels in v.classes_of(token):
            _, odds, node, bit = self._upper(c, token[mine], h[mine], levels)
            s = np.take_along_axis(odds, node, 1)
            part[mine] -= np.logaddexp(0, np.where(bit == 1, -s, s)).sum(1)
        for m, slot, lean, bit in v.steps(token):
            s = np.einsum("nd,nd->n", h[:m], self.node[slot]) + lean
            part[:m] -= np.logaddexp(0, np.where(bit == 1, -s, s))
        out[order] = part
        return out

    def gradient(self, words: Words, total: Network) -> None:
        """Adds the gradients of the negative log-probabilities of all words to total."""
        v = self.vocabulary
        order, token, h = self._sorted(words)
        z = _times(h, self.cluster) + v.class_log.astype(h.dtype)
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(words.n), v.kind[token]] -= 1
        total.cluster += _crossed(h, z)
        back = _times(z, self.cluster.T)
        for c, mine, levels in v.classes_of(token):
            vectors, odds, node, bit = self._upper(c, token[mine], h[mine], levels)
            g = np.zeros_like(odds)
            np.put_along_axis(g, node, (1 / (1 + np.exp(-np.take_along_axis(odds, node, 1))) - bit).astype(h.dtype), 1)
            back[mine] += _times(g, vectors)
            total.node[v.base[c] : v.base[c] + len(vectors)] += _crossed(g, h[mine])
        for m, slot, lean, bit in v.steps(token):
            vector = self.node[slot]
            g = (1 / (1 + np.exp(-(np.einsum("nd,nd->n", h[:m], vector) + lean))) - bit).astype(h.dtype)[:, None]
            back[:m] += g * vector
            _added(total.node, slot, g * h[:m])
        by_word = np.empty_like(back)
        by_word[order] = back * (1 - h**2)
        begin, end, inputs = words.first[:-1][words.doc[order]], words.first[1:][words.doc[order]], v.input_of[token]
        every = by_word.sum(0)
        for j, by in enumerate(REACH):  # the word at order[i] is the neighbour of the one `by` places before it
            centre = order - by
            ok = (centre >= begin) & (centre < end)
            values = by_word[centre[ok]]
            _added(total.embed[j], inputs[ok], values)
            total.embed[j, v.n_inputs - 1] += every - values.sum(0)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in pieces below the size from which the linear algebra library starts threads: tasks share the cores already."""
    step = max(1, PIECE // (a.shape[1] * b.shape[1]))
    out = np.empty((len(a), b.shape[1]), a.dtype)
    for i in range(0, len(a), step):
        np.matmul(a[i : i + step], b, out=out[i : i + step])
    return out


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b in such pieces, summed."""
    step = max(1, PIECE // (a.shape[1] * b.shape[1]))
    return sum((a[i : i + step].T @ b[i : i + step] for i in range(0, len(a), step)), np.zeros((a.shape[1], b.shape[1])))


def _added(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """target[rows] += values, for rows with equal ones side by side."""
    if len(rows):
        first = np.nonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))[0]
        target[rows[first]] += np.add.reduceat(values, first, axis=0)


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def bucket_counts(docs: DataFrame, text: str = "text", most_bits: int = MOST_BITS) -> np.ndarray:
    """How often each bucket occurs in the whole corpus, for as many buckets as there are distinct words (a power of two)."""
    wide = 1 << most_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(wide, np.int64)
        for b in batches:
            for _, _, data, at in runs(b.column(0)):
                have += np.bincount((Words(data, at, lower=True).hash >> np.uint64(64 - most_bits)).astype(np.int64), minlength=wide)
        some = np.nonzero(have)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(have[some])], names=["bucket", "n"])

    found = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(wide, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    seen = int((counts > 0).sum())
    distinct = wide if seen >= 0.99 * wide else -wide * np.log(1 - seen / wide)  # words that share a bucket count too
    bits = min(most_bits, max(8, int(np.ceil(np.log2(max(distinct, 2))))))
    return counts.reshape(1 << bits, -1).sum(1)


def _rows(block: np.ndarray, grid: np.ndarray) -> pa.RecordBatch:
    """Rows (block, bytes of its weights as float32)."""
    ends = np.arange(len(block) + 1, dtype=np.int32) * 4 * BLOCK
    data = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(grid.astype(np.float32).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), data], names=["block", "x"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a task's rows, with the sum."""
    block, total = np.zeros(0, np.int64), np.zeros((0, BLOCK))
    for b in batches:
        if b.num_rows:
            block = np.concatenate([block, b.column(0).to_numpy()])
            total = np.concatenate([total, np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, BLOCK)])
            order = np.argsort(block, kind="stable")
            first = np.nonzero(np.concatenate([[True], np.diff(block[order]) > 0]))[0]
            block, total = block[order][first], np.add.reduceat(total[order], first, axis=0)
    yield _rows(block, total)


def neighbours(words: Words, inputs: np.ndarray, border: int) -> np.ndarray:
    """Inputs around each word (4, n); beyond the text the border."""
    out = np.full((len(REACH), words.n), border)
    i = np.arange(words.n)
    begin, end = words.first[:-1][words.doc], words.first[1:][words.doc]
    for j, by in enumerate(REACH):
        ok = (i + by >= begin) & (i + by < end)
        out[j, ok] = inputs[i[ok] + by]
    return out


def trained(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", rounds: int = 8, rate: float = 0.2) -> Network:
    """The network after one Adagrad step a round; a round's targets are all words of the texts whose hash falls on it."""
    network, memory = Network(vocabulary), 0.0
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL")
    tasks = max(spark.sparkContext.defaultParallelism, given.rdd.getNumPartitions() // 4)  # a round has a part of the texts
    known = spark.sparkContext.broadcast(vocabulary)

    for number in range(rounds):
        sent = spark.sparkContext.broadcast(network.flat)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            net = total = None
            for b in batches:
                for _, _, data, at in runs(b.column(0), RUN):
                    if net is None:
                        net, total = Network(known.value, sent.value), Network(known.value, np.zeros(len(sent.value)))
                    words = Words(data, at, lower=True)
                    if words.n:
                        net.gradient(words, total)
            if net is not None:
                grid = total.flat.reshape(-1, BLOCK)
                some = np.nonzero(grid.any(1))[0]
                yield _rows(some, grid[some])

        chosen = given.filter(F.pmod(F.xxhash64("t"), F.lit(rounds)) == number).coalesce(tasks)
        found = chosen.mapInArrow(learn, "block long, x binary").repartition(tasks, "block").mapInArrow(_summed, "block long, x binary").toArrow()
        gradient = np.zeros(len(network.flat))
        if found.num_rows:
            gradient.reshape(-1, BLOCK)[found["block"].to_numpy()] = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, BLOCK)
        memory = memory + gradient**2
        network = Network(vocabulary, (network.flat - rate * gradient / np.sqrt(memory + 1e-12)).astype(np.float32))
        sent.unpersist()
    return network


def scored(docs: DataFrame, network: Network, keep: list[str], text: str = "text") -> DataFrame:
    """The keep columns with n_tokens, log_likelihood (sum) and mean_log_likelihood."""
    sent = docs.sparkSession.sparkContext.broadcast((network.vocabulary, network.flat))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*sent.value)
        for b in batches:
            n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, at in runs(b.column(b.num_columns - 1), RUN):
                words = Words(data, at, lower=True)
                logs = net.log_probability(words) if words.n else np.zeros(0)
                n.append(np.diff(words.first))
                total.append(np.bincount(words.doc, logs, len(at) - 1))
            n, total = np.concatenate(n), np.concatenate(total)
            mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), pa.array(total), mean], names=[*keep, "n_tokens", "log_likelihood", "mean_log_likelihood"])

    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    return given.mapInArrow(score, given.drop("__text").schema.add("n_tokens", "long").add("log_likelihood", "double").add("mean_log_likelihood", "double"))


def pseudo_likelihood(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Scores of docs by a network that is trained on them."""
    vocabulary = Vocabulary(bucket_counts(docs, text))
    return scored(docs, trained(docs, vocabulary, text), keep, text)


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


SQL: dict[str, str] = {}
QUERIES = {"op4_masked_lm": op4_masked_lm}
