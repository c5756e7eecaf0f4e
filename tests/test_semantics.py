"""Small frames for the cases in which SQL and data frames of other kinds differ."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions import scalar
from touchline.operators import enrich, features, lookups, rest
from touchline.sources import files

Q = lookups.QUALIFICATION
SCHEMA = "match_id long, date date, home_team string, away_team string, home_score int, away_score int, tournament string, city string, country string, neutral boolean"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def matches(spark):
    rows = [
        (1, day(0), "A", "B", 2, 1, Q), (2, day(5), "B", "A", 0, 0, Q), (3, day(11), "A", "C", None, None, Q), (4, day(11), "A", "B", 0, 3, Q),
        (5, day(20), "Ñandú", "A", 1, 4, Q), (6, day(21), "A", "B", 5, 5, "Friendly"),
    ]
    return spark.createDataFrame([(*r, "city", "land", False) for r in rows], SCHEMA).cache()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_recent_form_takes_the_last_and_sorts_ascending(matches):
    got = lookups.recent_form(matches, "A", 3)
    assert rows(got, "position", "date", "away_team") == [(1, day(11), "C"), (2, day(11), "B"), (3, day(20), "A")]
    assert lookups.recent_form(matches, "nobody").count() == 0


def test_recent_form_of_all_teams(matches):
    got = lookups.recent_form_all_teams(matches, 1)
    assert sorted(rows(got, "team", "rank")) == [("A", 1), ("B", 1), ("C", 1), ("Ñandú", 1)]


def test_summary_counts_unplayed_nowhere_and_empty_is_zero(matches):
    pair = matches.filter("home_team = 'A'")
    assert tuple(lookups.head_to_head_summary(pair).first()) == (1, 1, 1, 7, 9)
    assert tuple(lookups.head_to_head_summary(matches.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert lookups.head_to_head(matches, "A", "B").count() == 2


def test_scorer_history_counts_known_minutes(spark, matches):
    goals = [(day(0), "A", "B", "A", "x", 10), (day(0), "A", "B", "A", "x", None), (day(0), "A", "B", "B", None, 3), (day(9), "A", "B", "A", "x", 1)]
    goals = spark.createDataFrame(goals, S.GOALSCORERS)
    both = enrich.results_with_goals(matches, goals)
    assert both.count() == 3 and both.columns.count("home_team") == 1
    assert rows(lookups.scorer_history(both, "A", "B"), "scorer", "team", "goals") == [(None, "B", 1), ("x", "A", 1)]
    assert lookups.scorer_rows(both, "A", "B").count() == 3


def test_clashing_columns_get_suffixes(spark, matches):
    goals = spark.createDataFrame([(day(0), "A", "B", "elsewhere")], "date date, home_team string, away_team string, city string")
    assert {"city_x", "city_y"} <= set(enrich.results_with_goals(matches, goals).columns)


def test_confederations_are_null_for_unknown_countries(spark, matches):
    dim = spark.createDataFrame([("A", "X"), ("B", "Y")], S.COUNTRIES)
    got = dict(rows(enrich.with_confederations(matches, dim).filter("match_id in (3, 1)"), "match_id", "away_team_confederation"))
    assert got == {1: "Y", 3: None}


def test_current_names_within_their_period(spark, matches):
    former = spark.createDataFrame([("A", "C", day(0), day(15)), ("Z", "B", day(100), day(200))], S.FORMER_NAMES)
    got = dict(rows(enrich.with_current_names(matches, former), "match_id", "away_team"))
    assert got[3] == "A" and got[1] == "B"


def test_shootouts_and_schedules(spark, matches):
    won = spark.createDataFrame([(day(0), "A", "B", "B", None), (day(11), "A", "B", "elsewhere", None)], S.SHOOTOUTS)
    got = dict(rows(enrich.with_shootouts(matches, won), "match_id", "shootout_winner"))
    assert got[1] == "B" and got[4] is None and len(got) == 6
    wide = spark.createDataFrame([("Brasil", "Peru", None), ("Peru", "Brasil", "Chile")], "team string, fecha_13 string, fecha_14 string")
    got = sorted(rows(enrich.schedule(wide, {"Brasil": "Brazil"}), "team", "matchday", "opponent"))
    assert got == [("Brazil", "fecha_13", "Peru"), ("Peru", "fecha_13", "Brazil"), ("Peru", "fecha_14", "Chile")]


def test_outcomes(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (None, 1)], "home_score int, away_score int")
    got = df.select(scalar.outcome().alias("o"), scalar.home_win().alias("w"), scalar.team_result(F.lit(False)).alias("r"))
    assert rows(got, "o", "w", "r") == [(2, 1, -1), (0, 0, 1), (1, 0, 0), (1, 0, 0)]


def test_rest_days_first_match_second_match_of_a_day_and_edges(matches):
    got = {r["match_id"]: (r["home_days_rest"], r["away_days_rest"], r["rest_diff"]) for r in rest.with_rest_days(matches.filter(F.col("tournament") == Q)).collect()}
    assert got == {1: (None, None, None), 2: (5, 5, 0), 3: (6, None, None), 4: (0, 6, -6), 5: (None, 9, None)}
    view = rest.team_view(rest.with_rest_days(matches.filter(F.col("tournament") == Q)))
    groups = {(r["match_id"], r["team"]): r["rest_group"] for r in view.collect()}
    assert groups[1, "A"] == ">5" and groups[2, "A"] == "5" and groups[3, "A"] == ">5" and groups[4, "A"] == "0"


def test_relative_rest_leaves_out_unknown_and_groups_partition_the_rest(matches):
    view = rest.team_view(rest.with_rest_days(matches))
    known = view.filter("team_days_rest is not null and opponent_days_rest is not null").count()
    assert rest.relative_rest_win_rate(view).agg(F.sum("matches")).first()[0] == known
    fixed = rest.reindexed(rest.rest_group_win_rate(view.filter("team = 'A'")))
    assert rows(fixed.orderBy("position"), "rest_group") == [("4",), ("5",), (">5",)]
    assert fixed.filter("rest_group = '4'").first()["win_rate"] is None


def test_matchup_is_symmetric(spark):
    df = spark.createDataFrame([("Ñ", "Z"), ("Z", "Ñ")], "home_team string, away_team string")
    assert len(set(rows(df.select(scalar.matchup().alias("m")), "m"))) == 1


def test_head_to_head_forms_agree_and_prior_sees_no_later_match(matches):
    a = {r["match_id"]: r["head_to_head_goal_diff"] for r in features.with_head_to_head(matches).collect()}
    b = {r["match_id"]: r["head_to_head_goal_diff"] for r in features.with_head_to_head_joined(matches).collect()}
    prior = {r["match_id"]: r["head_to_head_goal_diff"] for r in features.with_head_to_head(matches, "prior").collect()}
    assert a == b and a[1] == pytest.approx((1 + 0 - 3 + 0) / 4) and a[3] == 0.0
    assert prior == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.5, 5: 0.0, 6: pytest.approx(-2 / 3)}


def test_rolling_averages_skip_nulls_and_only_see_earlier_rows(spark):
    n = 13
    rows_ = [(i, day(i), "A", "B", i if i != 2 else None, 0, Q, "c", "l", False) for i in range(n)]
    got = {r["match_id"]: r["home_team_avg_scored"] for r in features.with_rolling_averages(spark.createDataFrame(rows_, SCHEMA)).collect()}
    for i in range(n):
        seen = [x for x in range(max(0, i - 10), i) if x != 2]
        assert got[i] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def test_features_drop_incomplete_rows_but_keep_null_confederations(spark):
    rows_ = [(i, day(i), "A", "B", 1, i % 3, Q, "c", "l", False) for i in range(4)] + [(9, day(9), "A", "B", None, None, Q, "c", "l", False)]
    m = spark.createDataFrame(rows_, SCHEMA).withColumns({"home_team_confederation": F.lit(None).cast("string"), "away_team_confederation": F.lit("Y")})
    own = features.prepare(m, ("A", "B"))
    vocab = {c: features.vocabulary(own, c) for c in ("home_team", "away_team", "home_team_confederation", "away_team_confederation")}
    assert vocab["home_team_confederation"] == []
    got = features.build_features(own, vocab)
    assert sorted(r["match_id"] for r in got.collect()) == [1, 2, 3] and "home_team_A" in got.columns and "matchup_id" not in got.columns


def test_latest_form_and_inference_rows(matches):
    last = {r["team"]: r["home_team_avg_scored"] for r in features.latest_form(matches, "home").collect()}
    assert last["Ñandú"] == 0.0 and last["A"] == pytest.approx(1.0)
    names = [*features.NUMERIC, "home_team_A", "away_team_B"]
    zero = features.inference_row(matches, "A", "B", names).first()
    assert tuple(zero) == (0, 0, 0, 0, 0, 1, 1)
    full = features.inference_row(matches, "A", "B", names, mode="latest").first()
    assert full["home_team_avg_scored"] == pytest.approx(1.0) and full["head_to_head_goal_diff"] == pytest.approx(-0.5)
    assert tuple(features.inference_row(matches, "nobody", "B", names, mode="latest").first())[5:] == (0, 1)
    with pytest.raises(ValueError):
        features.inference_row(matches, "nobody", "B", names, strict=True)


def test_split_is_exact_and_repeats(spark):
    df = spark.range(503).withColumnRenamed("id", "match_id")
    a = features.split_test(df)
    assert a.filter("is_test").count() == 101
    assert rows(a.orderBy("match_id"), "is_test") == rows(features.split_test(df.repartition(7)).orderBy("match_id"), "is_test")


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    fitted = features.scaler(df, ["a", "b"])
    assert rows(df.select(features.standardized("a", fitted).alias("a"), features.standardized("b", fitted).alias("b")), "a", "b") == [(-1.0, 0.0), (1.0, 0.0)]


def test_csv_with_byte_order_mark_and_crlf(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes("﻿date,home_team,away_team,home_score,away_score,tournament,city,country,neutral\r\n2020-01-01,Perú,B,1,,T,c,l,TRUE".encode())
    df = files.read_results(spark, str(path))
    assert rows(df, "date", "home_team", "away_score", "neutral") == [(day(0), "Perú", None, True)]
    assert files.header(spark, str(path))[1:3] == ["home_team", "away_team"]
    files.write_csv(df, str(tmp_path / "out"))
    assert files.read_results(spark, str(tmp_path / "out")).collect() == df.collect()


def test_periods_that_overlap(spark):
    """Of periods that hold on a day the one that began last, then the smaller value; open ends; rows of a hot key, without a key or a date, never repeated."""
    import datetime as dt
    import random

    r = random.Random(3)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    periods = []
    for i in range(60):
        a = r.choice([None, r.randint(-200, 900)])
        b = r.choice([None, (a or 0) + r.randint(-5, 400)])
        periods.append((r.choice("abc"), None if a is None else day(a), None if b is None else day(b), f"v{r.randint(0, 30)}"))
    rows = [(i, "a" if i % 3 else r.choice(["b", "c", "none", None]), r.choice([None, day(r.randint(-300, 1300)), day(r.randint(0, 900))])) for i in range(400)]
    got = enrich.at_period(
        spark.createDataFrame(rows, "i int, k string, d date"), spark.createDataFrame(periods, "key string, s date, e date, v string"), "k", "d", "now", period_key="key", start="s", end="e", value="v", days=30
    ).collect()
    first = dt.date(1, 1, 1)

    def want(k, d):
        if d is None:
            return None
        held = [(-((s or first).toordinal()), v) for key, s, e, v in periods if key == k and (s or first) <= d and (e is None or d <= e) and (e is None or (s or first) <= e)]
        return min(held)[1] if held else None

    assert {x["i"]: x["now"] for x in got} == {i: want(k, d) for i, k, d in rows} and len(got) == len(rows)
    none = spark.createDataFrame([], "i int, k string, d date")
    assert enrich.at_period(none, spark.createDataFrame(periods, "key string, s date, e date, v string"), "k", "d", "now", period_key="key", start="s", end="e", value="v").count() == 0


def test_compressed_csv_comes_back_whole_from_bounded_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_ROWS", 40)
    df = spark.range(100).select(F.lit("France, a \"b\"").alias("country"), F.col("id").cast("string").alias("confederation")).coalesce(1)
    files.write_csv(df, str(tmp_path / "out"), compression="gzip")
    assert len(list((tmp_path / "out").glob("*.csv.gz"))) == 3
    assert sorted(map(tuple, files.read_countries(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
