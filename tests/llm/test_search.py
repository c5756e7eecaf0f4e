import random

import numpy as np
import pytest

from touchline.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v string, id int"


def brute(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        x = next(v for i, v in good if i == q)
        scored = sorted(((-float(np.cumsum(x * v)[-1]), i) for i, v in good if i != q and len(v) == len(x)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    out += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(300, 420)]  # equal vectors: ties
    out += [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0, None] + [0.0] * 6), (505, [float("inf")] * 8), (None, [1.0] * 8), (520, [1.0] * 3), (540, [3.0] + [0.0] * 7)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", 1) for i, v in rows], SCHEMA)


def test_factor_one_is_exact_over_many_shards_and_query_blocks(spark, rows):
    got = vptree.nearest(frame(spark, rows), k=20, shard_rows=40, query_rows=4, sample_rows=128, leaf=8)
    got = sorted(map(tuple, got.collect()))
    want = brute(rows, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] for w in want]


def test_vectors_of_many_queries_and_neighbours_of_all(spark, monkeypatch):
    """Half the queries share one vector, and one long vector is near to all: their rows stay where they are, and none is lost."""
    from touchline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(8)
    out = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(i, [1.0, -0.0, 3.0, 4.0, 0.0, 6.0, 7.0, 8.0]) for i in range(400, 800)]
    out += [(801, [1.0, 0.0, 3.0, 4.0, -0.0, 6.0, 7.0, 8.0]), (820, [1.0, 0.0, 3.0, 4.0, -0.0, 6.0, 7.0, 8.0]), (802, [90.0] * 8), (803, [-90.0] * 8)]
    got = sorted(map(tuple, vptree.nearest(frame(spark, out), k=20, shard_rows=80, query_rows=8, sample_rows=128, leaf=8).collect()))
    assert got == brute(out, 20)


def test_fewer_candidates_than_k(spark, rows):
    few = rows[:5]
    assert [tuple(r)[:3] for r in vptree.nearest(frame(spark, few)).orderBy("rank").collect()] == [w[:3] for w in brute(few, 20)]


def test_empty_and_all_bad(spark, rows):
    assert vptree.nearest(frame(spark, [])).count() == 0
    assert vptree.nearest(frame(spark, [(0, None), (20, [0.0] * 8)])).count() == 0


@pytest.mark.parametrize("form", ["outlier", "decades", "one-hot", "tiny"])
def test_exact_whatever_the_norms_and_ties(spark, form):
    r = random.Random(5)
    out = []
    for i in range(400):
        v = [r.gauss(0, 1) for _ in range(8)]
        if form == "outlier" and i == 7:
            v = [x * 1e9 for x in v]
        if form == "decades":
            v = [x * 10 ** r.uniform(-10, 10) for x in [10 ** r.uniform(-10, 10) * y for y in v]]
        if form == "one-hot":  # products of many different vectors tie at zero
            v = [0.0] * 8
            v[i % 8] = 1.0 + i // 8
        if form == "tiny":
            v = [x * 1e-30 for x in v]
        out.append((i, v))
    got = sorted(map(tuple, vptree.nearest(frame(spark, out), k=20, shard_rows=60, query_rows=8, sample_rows=64, leaf=8).collect()))
    assert got == brute(out, 20)


def test_scaling_is_exact_at_any_magnitude():
    """Scaling is exact and bands hold norms within a factor of two, at any magnitude that doubles have."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 5)) * 10.0 ** r.uniform(-300, 300, (300, 1))
    y, e = vptree.scaled(x)
    norm = np.sqrt((y * y).sum(1))
    assert np.array_equal(np.ldexp(y, e[:, None]), x) and norm.min() >= 0.5 and norm.max() < 1.0 + 1e-12


def test_smaller_factors_prune_more_and_keep_recall():
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16))
    x = centres[r.integers(0, 30, 3000)] + 0.1 * r.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vptree.VPTree(x, leaf=32)
    q, ids = x[::50], np.arange(len(x))
    score = lambda a, b: ((q[a] * x[b]).sum(1),) * 2

    def found(factor):
        at, rows, _, pairs = tree.search(q, 10, factor, np.full(len(q), -np.inf), score, ids)
        return rows.reshape(len(q), 10), pairs

    exact, all_pairs = found(1.0)
    part, pairs = found(0.6)
    assert all(set(np.argsort(-x @ q[i])[:10]) == set(exact[i]) for i in range(len(q)))
    assert pairs <= all_pairs < len(q) * len(x)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, part, strict=True)]) >= 0.9
