"""Near duplicates: sketches of any length bound the difference, no link is lost, and tried buckets are not searched again."""

import numpy as np
from test_queries_llm import near_duplicates

from stratalith.llm import jaccard


def texts(seed, rows, words, vocabulary=1 << 40):
    """Texts of random words; every fourth is another with words left out or changed, every tenth holds a common passage."""
    rng, out = np.random.default_rng(seed), []
    passage = [f"same{i}" for i in range(25)]
    for i in range(rows):
        w = [f"{x:x}" for x in rng.integers(0, vocabulary, int(rng.integers(*words)))]
        if i % 4 == 3:
            w = list(out[int(rng.integers(len(out)))])
            for at in rng.integers(0, len(w), int(rng.integers(0, max(2, len(w) // 25)))):
                w[at] = f"x{i}"
        out.append([*w, *passage] if i % 10 == 9 else w)
    return [" ".join(w) for w in out]


def test_sketches_of_any_length_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (513, 2000, 9000):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(1, 2**63, n * 3).astype(np.uint64)])
        x, y = (np.frombuffer(jaccard.fine_sketch(s), np.uint64) for s in (a, b))
        assert len(y) > len(x) and (jaccard.folded(x, 16) == jaccard.sketches(a, np.array([0, n]))[0]).all()
        differ = int(np.bitwise_count(x ^ jaccard.folded(y, len(x))).sum())
        assert len(x) * 64 >= 4 * n and n < differ <= n - n // 2 + n * 3
    assert jaccard.fine_sketch(a[:512]) is None


def test_near_duplicates_are_all_pairs(spark):
    for seed, rows, words, vocabulary in ((1, 240, (1, 60), 1 << 40), (2, 60, (500, 900), 1 << 40), (3, 300, (5, 40), 3)):
        given = dict(enumerate(texts(seed, rows, words, vocabulary)))
        docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
        stay = {r["doc_id"] for r in jaccard.jaccard_components(docs).collect() if r["doc_id"] == r["component_id"]}
        assert stay == near_duplicates(given) and len(stay) < rows


def test_buckets_whose_pairs_were_all_tried_are_not_searched_again(spark):
    members = spark.createDataFrame([(1, 5, 5), (1, 6, 5), (2, 5, 5), (2, 6, 5), (2, 7, 5)], "sig long, node long, pivot long")
    labels = spark.createDataFrame([], "node long, label long")
    assert sorted(map(tuple, jaccard.apart(members, labels).collect())) == [(2, 6, 6), (2, 7, 7)]
