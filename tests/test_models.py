import random
import threading

import pytest
from pyspark.sql import functions as F

from touchline.operators import isotonic, models

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for i in range(150):
        label = i % 3
        out.append((i, label, label + r.gauss(0, 0.4), r.gauss(0, 1)))
    return spark.createDataFrame(out, "match_id long, label int, a double, b double").repartition(1).cache()


@pytest.mark.parametrize("kind", models.MODEL_TYPES)
def test_fit_save_load_predict(spark, rows, kind, tmp_path):
    options = {"random_forest": {"trees": 10}, "xgboost": {"rounds": 2, "depth": 2}, "catboost": {"rounds": 3, "depth": 2}}.get(kind, {})
    own = models.MatchPredictor(kind, FEATURES, options).fit(rows)
    own.save(spark, str(tmp_path / "m"))
    again = models.MatchPredictor.load(spark, str(tmp_path / "m"))
    got = again.predict(rows)
    assert got.filter(F.abs(F.col("p_0") + F.col("p_1") + F.col("p_2") - 1) > 1e-9).count() == 0
    assert [tuple(r) for r in got.orderBy("match_id").collect()] == [tuple(r) for r in own.predict(rows).orderBy("match_id").collect()]
    scores = models.evaluate(got).first()
    assert scores["accuracy"] > 0.7 and scores["log_loss"] < 1.0986
    top = again.importance(spark).collect()
    assert top[0]["Feature"] == "a" and {r["Feature"] for r in top} == set(FEATURES)
    if kind == "random_forest":
        assert sum(r["Importance"] for r in top) == pytest.approx(1)
    match = again.predict_match(rows.limit(1)).first()
    assert match["home"] + match["draw"] + match["away"] == pytest.approx(1) and match["home_percent"].endswith("%")


def test_unknown_type():
    with pytest.raises(ValueError):
        models.MatchPredictor("oracle", FEATURES)


def test_no_rows(rows):
    with pytest.raises(ValueError):
        models.MatchPredictor("random_forest", FEATURES).fit(rows.limit(0))


def test_calibrated_probabilities(rows):
    got = models.Calibrated.fit("logistic_regression", FEATURES, rows, folds=2).predict(rows)
    assert got.filter(F.abs(F.col("p_0") + F.col("p_1") + F.col("p_2") - 1) > 1e-9).count() == 0
    assert models.evaluate(got).first()["log_loss"] < 1.0986


def test_grid_of_the_search():
    """All 81 combinations can be drawn, ten are, and a depth without a limit is among them."""
    every = models.draws(81, models.FOREST_GRID)
    assert len({tuple(x.items()) for x in every}) == 81 and any(x["depth"] is None for x in every) and {x["least_split"] for x in every} == {2, 5, 10}
    assert len(models.draws(10, models.FOREST_GRID)) == 10 and models.draws(10, models.FOREST_GRID) == models.draws(10, models.FOREST_GRID)


def test_forest_search(rows):
    grid = {"trees": (9,), "depth": (3, 4), "least_split": (2, 20)}
    scores = models.search_forest(FEATURES, rows, 2, 2, grid)
    own = models.MatchPredictor("random_forest", FEATURES).fit(rows, combinations=2, folds=2, grid=grid)
    assert own.options == min(scores, key=lambda x: x[0])[1] and all(0 < s < 1.2 for s, _ in scores)
    assert models.evaluate(own.predict(rows)).first()["accuracy"] > 0.7


def test_text_features_are_categories(spark, rows):
    named = rows.select("match_id", "label", "b", F.concat(F.lit("team"), "label").alias("team"))
    own = models.MatchPredictor("catboost", ["b", "team"], {"rounds": 5, "depth": 2, "step": 0.3}).fit(named)
    assert models.evaluate(own.predict(named)).first()["accuracy"] == 1.0
    unseen = named.withColumn("team", F.when(F.col("match_id") % 2 == 0, "other"))  # unseen and null teams
    assert own.predict(unseen).count() == named.count()
    assert own.importance(spark).first()["Feature"] == "team"


def test_ordered_statistics_equal_a_plain_loop(spark, rows):
    """In the order of the hash, each row has what came before it; changing its own label changes nothing of its own. One category has most rows."""
    import hashlib

    from touchline.operators import encoding

    named = rows.withColumn("team", F.when(F.col("match_id") % 5 == 0, F.concat(F.lit("t"), F.col("match_id") % 3)).when(F.col("match_id") % 7 > 0, "hot"))
    table = sorted(named.collect(), key=lambda r: hashlib.md5(f"{r['match_id']}|42".encode()).hexdigest())
    seen, want = {}, {}
    for r in table:
        n = seen.setdefault(r["team"], [0, 0, 0])
        want[r["match_id"]] = [(n[k] + 1 / 3) / (sum(n) + 1) for k in range(3)]
        n[r["label"]] += 1
    got = {r["match_id"]: [r[f"team_of_{k}"] for k in range(3)] for r in encoding.ordered(named, ["team"]).collect()}
    assert all(got[i] == pytest.approx(w) for i, w in want.items()) and len(got) == 150
    for i in (3, 77):
        other = encoding.ordered(named.withColumn("label", F.when(F.col("match_id") == i, 2 - F.col("label")).otherwise(F.col("label"))), ["team"])
        assert [other.filter(F.col("match_id") == i).first()[f"team_of_{k}"] for k in range(3)] == pytest.approx(want[i])
    assert {r["category"]: r["n"] for r in encoding.statistics(named, ["team"]).collect()} == {"" if t is None else f"={t}": sum(n) for t, n in seen.items()}


@pytest.mark.parametrize("few", [100_000, 3])
def test_isotonic_equals_brute_force(spark, few):
    """The largest, over starts before, of the least mean over ends behind; ties, weights and interpolation. Few blocks at a time: the same."""
    from touchline.operators import isotonic

    r = random.Random(few)
    points = [(round(r.random(), 2), float(r.random() < 0.5)) for _ in range(400)]
    model = isotonic.fit(spark.createDataFrame(points, "x double, y double").repartition(5), F.col("x"), F.col("y"), few)
    xs = sorted({x for x, _ in points})
    n, s = [0] * len(xs), [0.0] * len(xs)
    for x, y in points:
        n[xs.index(x)] += 1
        s[xs.index(x)] += y
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    got = [v[0] for v in spark.createDataFrame([(x,) for x in xs] + [(None,), (-1.0,), (2.0,)], "x double").select(model("x")).collect()]
    assert got[: len(xs)] == pytest.approx(want) and got[len(xs)] is None and got[-2:] == pytest.approx([want[0], want[-1]])


def test_calibration_averages_its_pairs(rows):
    own = models.Calibrated.fit("logistic_regression", FEATURES, rows, folds=2)
    assert len(own.pairs) == 2
    each = {r["match_id"]: r for r in own.each(rows).collect()}
    for r in own.predict(rows).collect():
        for k in range(3):
            assert r[f"p_{k}"] == pytest.approx((each[r["match_id"]][f"c_0_{k}"] + each[r["match_id"]][f"c_1_{k}"]) / 2)


def test_regression_is_at_its_optimum(rows):
    own = models.MatchPredictor("logistic_regression", FEATURES).fit(rows)
    assert all(r["largest"] < 1e-4 for r in models.regression_gradient(own, rows).collect())
    want = {r["match_id"]: r for r in own.predict(rows).collect()}
    assert all(r[f"p_{k}"] == pytest.approx(want[r["match_id"]][f"p_{k}"]) for r in models.regression_scores(own, rows, rows).collect() for k in range(3))


def test_logistic_regression_scales_by_population_deviation(rows):
    from touchline.operators import features

    own = models.MatchPredictor("logistic_regression", FEATURES).fit(rows)
    fitted = features.scaler(rows, FEATURES)
    scaled = own.pipeline.transform(rows.withColumn("label", F.col("label").cast("double"))).select("a", "b", "features").collect()
    for r in scaled:
        assert list(r["features"]) == pytest.approx([(r[c] - fitted[c][0]) / fitted[c][1] for c in FEATURES])


def test_calibrated_predictions_need_one_python_worker_a_task(rows):
    """Each function of its own had a worker of its own: folds times classes of them a task."""
    own = models.Calibrated.fit("logistic_regression", FEATURES, rows, folds=3)
    plan = own.predict(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_corrections_of_many_columns_equal_single_ones(spark):
    rising = [isotonic.Isotonic([0.0, 1.0], [2.0, 4.0]), isotonic.Isotonic([], []), isotonic.Isotonic([0.5], [7.0])]
    rows = spark.createDataFrame([(0.25, 0.5, None), (2.0, 1.0, 0.0), (float("nan"), 1.0, 1.0)], "a double, b double, c double")
    got = rows.select(isotonic.corrected(rising, [F.col(c) for c in "abc"])).collect()
    assert [r[0] for r in got] == [[2.5, None, None], [4.0, None, 7.0], [None, None, 7.0]]
    assert [r[0] for r in rows.select(rising[0]("a")).collect()] == [2.5, 4.0, None]


def test_compared_models_are_fitted_side_by_side(rows, monkeypatch):
    both, plain = threading.Barrier(2, timeout=60), models.evaluate
    monkeypatch.setattr(models, "evaluate", lambda predicted: both.wait() >= 0 and plain(predicted))
    got = models.compare_models(rows, rows, FEATURES, ("xgboost", "catboost"), options={k: {"rounds": 1, "depth": 1} for k in ("xgboost", "catboost")}).collect()
    assert [r["model"] for r in got] == ["xgboost", "catboost"] and all(r["log_loss"] < 1.0986 for r in got)


def test_registered_comparison_is_the_whole_one(spark, monkeypatch):
    """Nothing of the search, the folds or the boosters' rounds is set smaller than by default; those are the analysis's own."""
    from touchline.operators import trees
    from touchline.plans import catalog

    seen = {}
    monkeypatch.setattr(models, "compare_models", lambda *args, **more: seen.update(args=args[3:], more=more))
    catalog.model_comparison(spark, "/root/testdata/sf0.01")
    assert not seen["args"] and set(seen["more"]) == {"raw"}
    search = models.MatchPredictor.fit.__defaults__
    assert search == (None, 10, 5, None) and models.FOREST_GRID["trees"] == (100, 200, 500) and models.Calibrated.fit.__defaults__ == (5,)
    assert trees.fit_boosted.__kwdefaults__["rounds"] == 200 and {x["depth"] for x in models.BOOSTING.values()} == {6}
