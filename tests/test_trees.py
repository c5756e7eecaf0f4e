"""Trees against plain versions that look at every row, on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    r = random.Random(4)
    out = []
    for i in range(200):
        label = r.choice([0, 1, 2, 2])
        a = None if r.random() < 0.15 else round(label + r.gauss(0, 0.8), 2)
        out.append((i, label, a, float(r.randint(0, 5)), round(r.gauss(0, 1), 1)))
    return out


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame(table, "match_id long, label int, a double, b double, c double").repartition(3).cache()


def plain_cuts(table, bins):
    out = []
    for j in range(2, 5):
        v = sorted(x[j] for x in table if x[j] is not None)
        out.append(sorted({v[max(0, math.ceil(i * len(v) / bins) - 1)] for i in range(1, bins)}))
    return out


def plain_newton(rows, g, h, cuts, depth, l2, least, step):
    """A tree as nested tuples: (feature, cut, nulls left, left, right) or a value."""
    G, H = sum(g[i] for i, _ in rows), sum(h[i] for i, _ in rows)
    best = (trees.LEAST_GAIN, None)
    if depth:
        for side in (True, False):
            for f in range(3):
                for cut in [*cuts[f], math.inf]:
                    left = [x for x in rows if (side if x[1][f] is None else x[1][f] <= cut)]
                    right = [x for x in rows if x not in left]
                    gl, hl = sum(g[i] for i, _ in left), sum(h[i] for i, _ in left)
                    if left and right and hl >= least and H - hl >= least:
                        gain = round(gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2), trees.PLACES)
                        if gain > best[0]:
                            best = (gain, (f, cut, side, left, right))
    if best[1] is None:
        return -step * G / (H + l2)
    f, cut, side, left, right = best[1]
    return (f, cut, side, plain_newton(left, g, h, cuts, depth - 1, l2, least, step), plain_newton(right, g, h, cuts, depth - 1, l2, least, step))


def value_of(tree, x):
    while isinstance(tree, tuple):
        f, cut, side, left, right = tree
        tree = left if (side if x[f] is None else x[f] <= cut) else right
    return tree


def plain_boosted(table, rounds, depth, bins):
    x = [r[2:] for r in table]
    m = [[0.0] * 3 for _ in table]
    cuts, losses = plain_cuts(table, bins), []
    for _ in range(rounds):
        p = [[math.exp(v) / sum(map(math.exp, row)) for v in row] for row in m]
        losses.append(-sum(math.log(p[i][r[1]]) for i, r in enumerate(table)) / len(table))
        new = []
        for k in range(3):
            g = [p[i][k] - (r[1] == k) for i, r in enumerate(table)]
            h = [2 * p[i][k] * (1 - p[i][k]) for i in range(len(table))]
            new.append(plain_newton(list(enumerate(x)), g, h, cuts, depth, 1.0, 1.0, 0.3))
        m = [[v + value_of(new[k], x[i]) for k, v in enumerate(row)] for i, row in enumerate(m)]
    p = [[math.exp(v) / sum(map(math.exp, row)) for v in row] for row in m]
    losses.append(-sum(math.log(p[i][r[1]]) for i, r in enumerate(table)) / len(table))
    return p, losses


def test_boosting_equals_brute_force(spark, rows, table):
    """Probabilities, a loss that falls each round, the table of nodes there and back, and the walk by joins."""
    model = trees.fit_boosted(rows, NAMES, rounds=3, depth=3, bins=16)
    assert model.cuts == plain_cuts(table, 16)
    want, losses = plain_boosted(table, 3, 3, 16)
    got = {r["match_id"]: r["p"] for r in rows.select("match_id", model.scores().alias("p")).collect()}
    assert all(got[i] == pytest.approx(p, abs=1e-9) for i, p in enumerate(want))
    assert all(a > b for a, b in zip(losses, losses[1:], strict=False))
    nodes = model.nodes(spark)
    again = trees.TreeModel.of(nodes, NAMES, "sum", 3)
    assert {r["match_id"]: r["p"] for r in rows.select("match_id", again.scores().alias("p")).collect()} == got
    walked = {r["match_id"]: trees.softmax(np.array([r["scores"]]))[0].tolist() for r in model.walked(rows).collect()}
    assert all(walked[i] == pytest.approx(p, abs=1e-9) for i, p in got.items()) and len(walked) == 200
    parts = nodes.filter("left is not null").alias("x").join(nodes.alias("y"), F.expr("x.tree = y.tree and y.node in (x.left, x.right)"))
    assert parts.groupBy("x.tree", "x.node").agg((F.sum("y.n") == F.first("x.n")).alias("same")).filter("not same").isEmpty()


def test_margins_kept_between_rounds_change_nothing(rows, monkeypatch):
    once = trees.fit_boosted(rows, NAMES, rounds=5, depth=2, bins=8)
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 2)
    again = trees.fit_boosted(rows, NAMES, rounds=5, depth=2, bins=8)
    assert [t.feature for t in once.trees] == [t.feature for t in again.trees] and len(again.trees) == 15
    assert np.allclose(sum((t.values for t in once.trees), []), sum((t.values for t in again.trees), []))


def test_symmetric_trees_have_one_split_a_level(rows):
    model = trees.fit_boosted(rows, NAMES, rounds=2, depth=3, bins=16, symmetric=True)
    for t in model.trees:
        for d in range(max(t.depth)):
            assert len({(t.feature[i], t.bin[i], t.nulls_left[i]) for i in range(len(t.feature)) if t.depth[i] == d and t.feature[i] >= 0}) == 1
    got = rows.select("label", model.scores().alias("p")).collect()
    assert -sum(math.log(r["p"][r["label"]]) for r in got) / len(got) < 1.0


def plain_gini(rows, cuts, names, depth, least_split, least_leaf, pick, path=1):
    """(feature, cut, nulls left, left, right), or the classes' shares. rows: (label, copies, features)."""
    sums = [sum(w for y, w, _ in rows if y == k) for k in range(3)]
    score = lambda part: sum(sum(w for y, w, _ in part if y == k) ** 2 for k in range(3)) / sum(w for _, w, _ in part)
    best = (trees.LEAST_GAIN, None)
    if depth and len(rows) >= least_split and sum(s > 0 for s in sums) > 1:
        bin_of = lambda f, v: None if v is None else sum(c < v for c in cuts[f])
        varies = np.array([len({bin_of(f, x[f]) for _, _, x in rows}) > 1 for f in range(names)])
        allowed = pick(path, varies)
        for side in (True, False):
            for f in range(names):
                for cut in [*cuts[f], math.inf] if allowed[f] else []:
                    left = [r for r in rows if (side if r[2][f] is None else r[2][f] <= cut)]
                    right = [r for r in rows if not (side if r[2][f] is None else r[2][f] <= cut)]
                    if len(left) >= least_leaf and len(right) >= least_leaf and left and right:
                        gain = round(score(left) + score(right) - score(rows), trees.PLACES)
                        if gain > best[0]:
                            best = (gain, (f, cut, side, left, right))
    if best[1] is None:
        return [s / sum(sums) for s in sums]
    f, cut, side, left, right = best[1]
    down = [plain_gini(part, cuts, names, depth - 1, least_split, least_leaf, pick, 2 * path + i) for i, part in enumerate((left, right))]
    return (f, cut, side, *down)


@pytest.mark.parametrize("options", [{"least_split": 12, "least_leaf": 3}, {"depth": 3}])
def test_forest_equals_brute_force(spark, rows, table, options, monkeypatch):
    """Bootstrap copies and drawn features are the model's own, the rest is not; small passes give the same trees, and no smaller node is split."""
    if "depth" not in options:
        monkeypatch.setattr(trees, "MOST_SUMS", 2000)
    model = trees.fit_forest(rows, NAMES, trees=3, bins=16, **options)
    ids = {r["match_id"]: r["h"] for r in rows.select("match_id", F.xxhash64("match_id").alias("h")).collect()}
    cuts, want = plain_cuts(table, 16), [[0.0] * 3 for _ in table]
    for t in range(3):
        w = trees.copies(np.array([ids[r[0]] for r in table]), t, 42)
        assert 0.5 < w.mean() < 1.5
        own = [(r[1], int(c), r[2:]) for r, c in zip(table, w, strict=True) if c]
        pick = lambda path, varies, t=t: trees.drawn_features(42, t, path, varies, 1)
        tree = plain_gini(own, cuts, 3, options.get("depth", 99), options.get("least_split", 2), options.get("least_leaf", 1), pick)
        want = [[a + b / 3 for a, b in zip(x, value_of(tree, r[2:]), strict=True)] for x, r in zip(want, table, strict=True)]
    got = {r["match_id"]: r["p"] for r in rows.select("match_id", model.scores().alias("p")).collect()}
    assert all(got[i] == pytest.approx(p, abs=1e-9) for i, p in enumerate(want))
    nodes = model.nodes(spark)
    assert nodes.filter("left is not null").filter(F.col("n") < options.get("least_split", 2)).isEmpty()
    assert nodes.filter(F.col("n") < options.get("least_leaf", 1)).isEmpty()
    walked = {r["match_id"]: r["scores"] for r in model.walked(rows).collect()}
    assert all(walked[i] == pytest.approx(p, abs=1e-9) for i, p in got.items())
    assert sum(model.importance()) == pytest.approx(1)


def test_no_rows_and_only_nulls(spark, rows):
    for fit in (lambda df: trees.fit_boosted(df, NAMES, rounds=1, depth=2), lambda df: trees.fit_forest(df, NAMES, trees=2)):
        for df in (rows.limit(0), rows.withColumns({c: F.lit(None).cast("double") for c in NAMES})):
            p = fit(df).scores()
            got = rows.limit(3).select(p.alias("p")).collect()
            assert all(sum(r["p"]) == pytest.approx(1) for r in got)


def test_cuts_are_exact_on_large_tables(spark):
    r = random.Random(8)
    table = [(i, 0, r.gauss(0, 1), float(r.randint(0, 40)), r.choice([None, math.nan, 1.5, r.random()])) for i in range(40_000)]
    rows = spark.createDataFrame(table, "match_id long, label int, a double, b double, c double").repartition(5)
    known = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in x) for x in table]
    for bins in (32, 10):
        assert trees.find_cuts(rows, NAMES, bins) == plain_cuts(known, bins)


def sorted_nodes(model, spark):
    """Each tree by the paths of its nodes: numbers may differ."""
    rows = {(r["tree"], r["node"]): r for r in model.nodes(spark).collect()}
    out = {}

    def walk(t, i, path):
        r = rows[t, i]
        out[t, path] = (r["feature"], r["cut"], r["nulls_left"], r["n"], round(r["weight"], 6), round(r["gain"], 6), tuple(round(v, 9) for v in r["values"]))
        for side, child in enumerate((r["left"], r["right"])):
            if child is not None:
                walk(t, child, 2 * path + side)

    for t in {t for t, _ in rows}:
        walk(t, 0, 1)
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("fit", [
    lambda df: trees.fit_forest(df, NAMES, trees=3, bins=16, least_leaf=2), lambda df: trees.fit_forest(df, NAMES, trees=3, bins=16, depth=5, least_split=9),
    lambda df: trees.fit_boosted(df, NAMES, rounds=3, depth=4, bins=16), lambda df: trees.fit_boosted(df, NAMES, rounds=3, depth=4, bins=16, symmetric=True),
])
def test_parts_grown_apart_are_those_of_passes(spark, rows, fit, monkeypatch):
    """By passes alone, by groups alone, by groups of a few nodes at a time, and by passes down to nodes of 60 rows: the same trees."""
    whole = sorted_nodes(fit(rows), spark)
    monkeypatch.setattr(trees, "MOST_CELLS", 500)
    assert sorted_nodes(fit(rows), spark) == whole
    for small in (0, 60):
        monkeypatch.setattr(trees, "SMALL", small)
        assert sorted_nodes(fit(rows), spark) == whole


@pytest.mark.parametrize("small", [trees.SMALL, 60])
def test_forests_too_large_for_the_driver_stay_tables(spark, rows, small, monkeypatch):
    """Probabilities, nodes, the walk by joins and importances of a model whose parts stay a written table; rows in several blocks."""
    from touchline.operators import models

    held = models.MatchPredictor("random_forest", NAMES, {"trees": 4, "bins": 16, "least_leaf": 2}).fit(rows)
    monkeypatch.setattr(trees, "MOST_NODES", 10)
    monkeypatch.setattr(trees, "SMALL", small)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 70)
    own = models.MatchPredictor("random_forest", NAMES, {"trees": 4, "bins": 16, "least_leaf": 2}).fit(rows)
    assert held.tree_model.below is None and own.tree_model.below is not None
    assert sorted_nodes(own.tree_model, spark) == sorted_nodes(held.tree_model, spark)
    p = lambda m: {r["match_id"]: [r["p_0"], r["p_1"], r["p_2"]] for r in m.predict(rows).collect()}
    want, got = p(held), p(own)
    assert len(got) == 200 and all(got[i] == pytest.approx(x, abs=1e-12) for i, x in want.items())
    assert all(r["scores"] == pytest.approx(want[r["match_id"]], abs=1e-9) for r in own.tree_model.walked(rows).collect())
    assert own.tree_model.importance() == pytest.approx(held.tree_model.importance())


def test_growing_a_forest_takes_few_jobs(spark, rows):
    """Its many nodes far down took passes of their own: a job and more a level."""
    group = "few jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        trees.fit_forest(rows, NAMES, trees=20, bins=16)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 12
