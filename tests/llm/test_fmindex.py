"""The index against plain searches, and substring removal with hot minimizers forced through each path."""

import hashlib
import re

import numpy as np
import pytest

from stratalith.llm import fmindex, substrings


def test_minima_and_nearest_smaller():
    rng = np.random.default_rng(0)
    for n in (1, 2, 31, 32, 33, 64, 300, 2000):
        values = rng.integers(0, 9, n)
        lo = rng.integers(0, n, 400)
        hi = lo + 1 + (rng.random(400) * (n - lo)).astype(int)
        assert np.array_equal(fmindex.Minima(values).of(lo, hi), [values[a:b].min() for a, b in zip(lo, hi, strict=True)])
        values[0] = -1
        want = [max((j for j in range(i) if values[j] < values[i]), default=0) for i in range(n)]
        assert np.array_equal(fmindex.nearest_smaller(values), want)


@pytest.mark.parametrize("words", [2, 5, 50])
def test_matching_statistics(words):
    rng = np.random.default_rng(words)
    for _ in range(30):
        segments = [rng.integers(1, words + 1, rng.integers(1, 30)) for _ in range(rng.integers(1, 9))]
        segments += [s.copy() for s in segments[:2]]
        owner = rng.integers(0, 4, len(segments))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
        tokens = np.unique(np.concatenate(segments), return_inverse=True)[1] + 1
        query = rng.integers(0, len(segments), 6)
        below = rng.integers(0, 5, 6)
        size, at = fmindex.FMIndex(tokens, bounds, owner).matching_statistics(query, below)
        texts = [tuple(s) for s in segments]
        for q, (i, limit) in enumerate(zip(query, below, strict=True)):
            mine = texts[i]
            others = [t for t, o in zip(texts, owner, strict=True) if o < limit]
            for k in range(len(mine)):
                best = max((n for n in range(1, len(mine) - k + 1) if any(t[j : j + n] == mine[k : k + n] for t in others for j in range(len(t)))), default=0)
                assert size[at[q] + k] == best


def removed(texts, window):
    first = {}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), k)
    out = {}
    for k, w in words.items():
        cut = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        out[k] = (len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [1, 3, 2000])
def test_hot_minimizers_take_either_path(spark, most):
    """One passage in ever different surroundings, copies, overlaps and self-overlaps; hot from `most` runs on."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(60):
        before, after = ([f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 25))] for _ in range(2))
        cut = int(rng.integers(0, 15))
        texts.append((i, " ".join([*before, *passage[cut : 40 - int(rng.integers(0, 15))], *after])))
    texts += [(100 + i, texts[i][1]) for i in range(20)] + [(200 + i, " ".join(["again and"] * 30)) for i in range(3)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    given = docs.select(F.lit(1).alias("x"), "doc_id", F.xxhash64("text").alias("version"), "text")
    spans = substrings.covered_windows(given, 12, most).collect()
    want = removed(texts, 12)
    cut = {k: set() for k, _ in texts}
    for s in spans:
        cut[s["doc_id"]] |= set(range(s["lo"], s["hi"] + 11))
    assert {k: len(v) for k, v in cut.items()} == {k: v[1] for k, v in want.items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substrings.without_repeats(docs, window=12).collect()}
    assert got == want
