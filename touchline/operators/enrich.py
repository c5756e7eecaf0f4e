"""Joins that enrich matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["date", "home_team", "away_team"]


def with_confederations(matches: DataFrame, countries: DataFrame) -> DataFrame:
    """Both teams' confederations; null where a country is unknown. The dimension is small: Spark broadcasts it by its size."""
    for side in ("home", "away"):
        names = countries.select(F.col("country").alias("__country"), F.col("confederation").alias(f"{side}_team_confederation"))
        matches = matches.join(names, F.col(f"{side}_team") == F.col("__country"), "left").drop("__country")
    return matches


def results_with_goals(results: DataFrame, goals: DataFrame) -> DataFrame:
    """A row a goal: the match's columns, then the goal's; other columns that both have get _x and _y."""
    shared = [c for c in goals.columns if c in results.columns and c not in KEYS]
    results = results.withColumnsRenamed({c: f"{c}_x" for c in shared})
    goals = goals.withColumnsRenamed({c: f"{c}_y" for c in shared})
    return results.join(goals, KEYS, "inner")


#: Days of a bucket in which rows and periods meet.
BUCKET_DAYS = 180


def disjoint_periods(periods: DataFrame, key: str, start: str, end: str, value: str) -> DataFrame:
    """Periods cut where any of their key begins or ends, one value a piece: of overlapping periods the one that began last holds, then that of the smaller value.

    Both ends belong to a period; null ends are open; a period that ends before it begins holds nowhere.
    """
    own = periods.select(
        F.col(key).alias("key"), F.coalesce(F.col(start), F.lit("0001-01-01").cast("date")).alias("lo"), F.coalesce(F.col(end), F.lit("9999-12-30").cast("date")).alias("hi"), F.col(value).alias("value")
    ).filter("lo <= hi")
    bounds = own.select("key", F.explode(F.array("lo", F.date_add("hi", 1))).alias("piece")).distinct()
    pieces = bounds.withColumn("until", F.date_sub(F.lead("piece").over(Window.partitionBy("key").orderBy("piece")), 1)).filter("until is not null")
    held = pieces.join(own, "key").filter("lo <= piece and hi >= until")
    order = F.struct(F.datediff(F.lit("9999-12-31").cast("date"), "lo"), "value")
    return held.groupBy("key", "piece", "until").agg(F.min_by("value", order).alias("value"))


def at_period(rows: DataFrame, periods: DataFrame, key: str, at: str, name: str, *, period_key: str, start: str, end: str, value: str, days: int = BUCKET_DAYS) -> DataFrame:
    """rows with the value of the period of their key that holds on their date, null without one: never more rows than before.

    Rows and pieces of periods meet by key and bucket of dates, an equi-join with a range condition, so a hot key is dealt by time. Pieces are taken once a bucket
    between the first and last date of the rows.
    """
    first, last = rows.agg(F.min(at), F.max(at)).first()
    if first is None:
        return rows.withColumn(name, F.lit(None).cast(periods.schema[value].dataType))
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    pieces = disjoint_periods(periods, period_key, start, end, value).filter((F.col("until") >= F.lit(first)) & (F.col("piece") <= F.lit(last)))
    within = F.sequence(bucket(F.greatest("piece", F.lit(first))), bucket(F.least("until", F.lit(last))))
    pieces = pieces.select(F.col("key").alias("__key"), "piece", "until", F.col("value").alias("__value"), F.explode(within).alias("__bucket"))
    on = (F.col(key) == F.col("__key")) & (bucket(F.col(at)) == F.col("__bucket")) & F.col(at).between(F.col("piece"), F.col("until"))
    return rows.join(pieces, on, "left").select(*rows.columns, F.col("__value").alias(name))


def with_current_names(matches: DataFrame, former: DataFrame) -> DataFrame:
    """Current team names on the match's date: a name is replaced where it was the former one within the stated period. Overlaps: see disjoint_periods."""
    for side in ("home_team", "away_team"):
        now = at_period(matches, former, side, "date", "__now", period_key="former", start="start_date", end="end_date", value="current")
        matches = now.withColumn(side, F.coalesce("__now", side)).drop("__now")
    return matches


def with_shootouts(matches: DataFrame, shootouts: DataFrame) -> DataFrame:
    """shootout_winner of each match; null where none was needed, or where the named winner is neither side."""
    won = shootouts.select(*KEYS, F.col("winner").alias("__winner"))
    out = matches.join(won, KEYS, "left")
    side = (F.col("__winner") == F.col("home_team")) | (F.col("__winner") == F.col("away_team"))
    return out.withColumn("shootout_winner", F.when(side, F.col("__winner"))).drop("__winner")


def schedule(wide: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """team, matchday and opponent from one column a matchday; names maps spellings to those of the results."""
    days = [c for c in wide.columns if c != "team"]
    out = wide.unpivot(["team"], days, "matchday", "opponent").filter("opponent is not null")
    for old, new in (names or {}).items():
        out = out.withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in ("team", "opponent")})
    return out
