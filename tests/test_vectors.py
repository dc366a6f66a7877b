"""The stored vector index against a full comparison: exact search, recall, what is read, upserts, filters, edge cases."""

import numpy as np
import pytest

from stratalith.operators import vectors


def rows(n, dim=16, seed=1, centres=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, [float(np.float32(v)) for v in middle[i % centres] + 0.35 * rng.normal(size=dim)], i % 3) for i in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def full(data, asked, k, keep=lambda r: True):
    have = [r for r in data if r[1] is not None and keep(r)]
    x = np.array([r[1] for r in have])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = {}
    for q, v, _ in asked:
        v = np.array(v)
        s = np.floor(x @ (v / max(np.linalg.norm(v), 1e-300)) * 1e4 + 0.5) / 1e4
        out[q] = sorted((-a, r[0]) for a, r in zip(s, have, strict=True))[:k]
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["place"]] = (-r["similarity"], r["vec_id"])
    return {q: [v for _, v in sorted(x.items())] for q, x in out.items()}


def questions(spark, asked):
    return spark.createDataFrame([(q, v) for q, v, _ in asked], "query_id long, embedding array<float>")


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for _, i in a[q]] == [i for _, i in b[q]] and np.allclose([s for s, _ in a[q]], [s for s, _ in b[q]])


@pytest.fixture(scope="module")
def built(spark):
    data = rows(3000)
    t = table(spark, data)
    return data, vectors.store(t, vectors.fit(t))


def test_exact_search_is_a_full_comparison(spark, built):
    data, index = built
    asked = [data[i] for i in range(0, 3000, 150)]
    same(got(vectors.search(index, questions(spark, asked), 72, probe=2, exact=True)), full(data, asked, 72))


def test_probing_reads_little_and_finds_most(spark, built):
    """Recall at 72 of 0.95 or more with a part of the rows compared."""
    data, index = built
    asked = [data[i] for i in range(0, 3000, 60)]
    lists = vectors._bounds(index, questions(spark, asked)).filter("place < 8").select("list", "query_id").collect()
    share = np.mean([index.lists[r["list"]][0] for r in lists]) * 8 / len(data)
    want, have = full(data, asked, 72), got(vectors.search(index, questions(spark, asked), 72, probe=8))
    recall = np.mean([len({i for _, i in want[q]} & {i for _, i in have[q]}) / 72 for q in want])
    assert recall >= 0.95 and share < 0.35, (recall, share)


def test_only_probed_partitions_are_read(spark, built):
    data, index = built
    plan = index.rows().filter("list IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:80]
    files = {f for f in index.rows().filter("list = 1").inputFiles()}
    assert files and all("list=1/" in f for f in files) if len(files) < len(index.rows().inputFiles()) else True


def test_upserts_filters_and_reopening(spark, built):
    data, index = built
    changed = [(i, data[(i + 1) % 3000][1], 9) for i in range(0, 3000, 5)]
    gone = [(i, None, None) for i in range(1, 3000, 100)]
    new = [(5000 + i, v, 1) for i, v, _ in rows(40, seed=8)]
    later = vectors.upsert(index, table(spark, changed + gone + new))
    now = {r[0]: r for r in data} | {r[0]: r for r in changed + new}
    for r in gone:
        del now[r[0]]
    now = list(now.values())
    asked = [now[i] for i in range(0, len(now), 200)]
    for x in (later, vectors.opened(spark, index.root), vectors.compacted(later)):
        assert x.rows().count() == len(now)
        same(got(vectors.search(x, questions(spark, asked), 20, probe=3, exact=True)), full(now, asked, 20))
    keep = lambda r: r[2] == 9
    same(got(vectors.search(later, questions(spark, asked), 20, probe=1, exact=True, where="label = 9")), full(now, asked, 20, keep))
    same(got(vectors.search(index, questions(spark, asked), 5, probe=3, exact=True)), full(data, asked, 5))


def test_one_hot_list_is_dealt_in_parts(spark, monkeypatch):
    """Two thirds of the rows are one vector; parts and blocks are small, so both are split."""
    monkeypatch.setattr(vectors, "PART_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    data = [(i, [1.0, 0.0] if i % 3 else [float(i), 1.0], 0) for i in range(600)]
    index = vectors.store(table(spark, data), vectors.fit(table(spark, data), lists=4))
    asked = data[:40]
    same(got(vectors.search(index, questions(spark, asked), 30, probe=1, exact=True)), full(data, asked, 30))


def test_edge_cases(spark):
    none = table(spark, [])
    index = vectors.store(none, vectors.fit(none))
    assert vectors.search(index, questions(spark, [(1, [1.0, 0.0], 0)]), 5).count() == 0
    data = [(1, [0.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, None, 0), (2, [3.0, 4.0], 0), (None, [1.0, 0.0], 0)]
    index = vectors.store(table(spark, data), vectors.fit(table(spark, data)))
    out = got(vectors.search(index, spark.createDataFrame([(7, [6.0, 8.0]), (8, None), (None, [1.0, 1.0]), (7, [6.0, 8.0])], "query_id long, embedding array<float>"), 5, exact=True))
    assert out == {7: [(-1.0, 2), (0.0, 1)]}


def test_tasks_grow_with_the_rows_compared():
    """A task takes TASK_ROWS rows, copies for parts and blocks included, however many there are; ties go to the first."""
    asked, rows = {i: 20_000 for i in range(100)}, {i: 60_000 for i in range(100)}
    assert vectors.compare_tasks(asked, rows, 200) == (100 * (2 * 20_000 + 3 * 60_000)) // vectors.TASK_ROWS
    assert vectors.compare_tasks({0: 5}, {0: 10}, 8) == 8
    value = np.random.default_rng(1).integers(-3, 4, (50, 40)).astype(float)
    for k in (1, 7, 40, 60):
        assert (vectors._first(value, k) == np.argsort(-value, axis=1, kind="stable")[:, :k]).all()
