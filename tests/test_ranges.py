"""Hot keys are dealt by ranges, and give the rows that one window a key gives."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import features, ranges, rest

COLUMNS = "match_id long, date date, home_team string, away_team string, home_score int, away_score int"


@pytest.fixture(scope="module")
def matches(spark):
    """A third of the rows on one team; null scores, dates and teams of one row; days with many matches."""
    r = random.Random(2)
    rows = []
    for i in range(1500):
        home = "hot" if i % 3 == 0 else r.choice("abcd")
        score = lambda: r.choice([None, 0, 1, 2, 3])
        rows.append((i, datetime.date(2000, 1, 1) + datetime.timedelta(days=r.choice([0, 1, 5, 1000, r.randint(0, 1500)])), home, r.choice("efgh"), score(), score()))
    rows += [(2000, None, "hot", "e", 1, 2), (2001, None, "hot", "e", 3, 0), (2002, datetime.date(2001, 1, 1), "once", "e", 1, 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


def same(got, want):
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_rolling_means(matches, days):
    over = {t: Window.partitionBy(t).orderBy("date", "match_id").rowsBetween(-10, -1) for t in ("home_team", "away_team")}
    want = matches.withColumns({name: F.avg(c).over(over[t]) for name, (t, c) in features.ROLLING.items()})
    same(features.with_rolling_averages(matches, range_days=days), want)


@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_previous_match(matches, days):
    own = rest.team_matches(matches)
    want = own.withColumn("previous_match_date", F.lag("match_date").over(Window.partitionBy("team").orderBy("match_date", "match_id", "side")))
    same(rest.previous_match(matches, range_days=days).drop("days_rest"), want)


@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_head_to_head(matches, days):
    by = Window.partitionBy("matchup_id")
    out = matches.withColumn("matchup_id", F.concat_ws("_", F.least("home_team", "away_team"), F.greatest("home_team", "away_team"))).withColumn("goal_diff", F.col("home_score") - F.col("away_score"))
    mean = lambda w: F.coalesce(F.avg("goal_diff").over(w), F.lit(0.0))
    same(features.with_head_to_head(matches, "prior", days), out.withColumn("head_to_head_goal_diff", mean(by.orderBy("date", "match_id").rowsBetween(Window.unboundedPreceding, -1))))
    same(features.with_head_to_head(matches), out.withColumn("head_to_head_goal_diff", mean(by)))


def test_hot_team_is_no_task(spark):
    """A third of the rows on one team over ten years: windows over rows are by team and range, none with a tenth of the team's rows; only ranges are ordered by team."""
    r = random.Random(6)
    rows = [(i, datetime.date(2000, 1, 1) + datetime.timedelta(days=r.randint(0, 3650)), "hot" if i % 3 == 0 else r.choice("abcd"), "e", 1, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS)
    fullest = df.groupBy("home_team", ranges.date_range()).count().agg(F.max("count")).first()[0]
    assert fullest < 1000 / 10
    for out in (features.with_rolling_averages(df), rest.previous_match(df), features.with_head_to_head(df, "prior")):
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        windows = [x for x in plan if x.lstrip(" :+-").startswith("Window [")]
        assert windows and all("__k#" in x.rpartition("], [")[0].rpartition("], [")[2] or "__k#" in x or any(c in x for c in ("__t#", "__last#", "__b_")) for x in windows)


def test_folds_differ_by_one_a_label(matches):
    rows = matches.withColumn("label", F.col("home_score"))
    got = features.with_folds(rows, 7).groupBy("label", "fold").count().collect()
    by = {}
    for r in got:
        by.setdefault(r["label"], {})[r["fold"]] = r["count"]
    assert all(len(v) == 7 and max(v.values()) - min(v.values()) <= 1 for v in by.values()) and sum(sum(v.values()) for v in by.values()) == rows.count()
    want = rows.withColumn("fold", (F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat(F.col("match_id").cast("string"), F.lit("|42")).cast("binary")), "match_id")) - 1) % 7)
    same(features.with_folds(rows, 7), want)
