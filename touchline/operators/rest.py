"""Days of rest before each match, and win rates by rest. All teams in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalar
from touchline.operators import ranges

#: The groups of the report, in order.
REPORTED = ("4", "5", ">5")


def team_matches(matches: DataFrame) -> DataFrame:
    """Two rows a match: team, side and date, from one scan."""
    sides = F.array(F.struct(F.col("home_team").alias("team"), F.lit("home").alias("side")), F.struct(F.col("away_team").alias("team"), F.lit("away").alias("side")))
    return matches.select("match_id", F.col("date").alias("match_date"), F.explode(sides).alias("s")).select("match_id", "s.team", "s.side", "match_date")


def previous_match(matches: DataFrame, range_days: int = ranges.RANGE_DAYS) -> DataFrame:
    """team_matches with the team's previous date and the days since; a second match on one day has 0. A team's rows are dealt by range of dates."""
    order = ["match_date", "match_id", "side"]
    out = ranges.previous_value(team_matches(matches), "team", "match_date", order, "previous_match_date", ranges.date_range("match_date", range_days))
    return out.withColumn("days_rest", F.datediff("match_date", "previous_match_date"))


def with_rest_days(matches: DataFrame) -> DataFrame:
    """matches with home_days_rest, away_days_rest and rest_diff."""
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("days_rest")))
    rest = previous_match(matches).groupBy("match_id").agg(pick("home").alias("home_days_rest"), pick("away").alias("away_days_rest"))
    return matches.join(rest, "match_id").withColumn("rest_diff", F.col("home_days_rest") - F.col("away_days_rest"))


def team_view(rested: DataFrame) -> DataFrame:
    """Two rows a match, from each team's side: rest, opponent's rest, result, venue and groups."""
    side = lambda team, own, other, home: F.struct(F.col(team).alias("team"), F.col(own).alias("team_days_rest"), F.col(other).alias("opponent_days_rest"), F.lit(home).alias("is_home"))
    both = F.array(side("home_team", "home_days_rest", "away_days_rest", True), side("away_team", "away_days_rest", "home_days_rest", False))
    out = rested.select("match_id", "home_score", "away_score", F.explode(both).alias("s")).select("match_id", "home_score", "away_score", "s.*")
    out = out.withColumn("team_result", scalar.team_result()).withColumn("rest_group", scalar.rest_group("team_days_rest"))
    return out.withColumn("relative_rest", scalar.relative_rest("team_days_rest", "opponent_days_rest"))


def win_rate(result: Column | str = "team_result") -> Column:
    return F.avg(F.when(scalar.col(result) == 1, 1.0).otherwise(0.0))


def rest_group_win_rate(view: DataFrame, *by: str) -> DataFrame:
    """Win rate and matches for each rest group."""
    return view.groupBy(*by, "rest_group").agg(win_rate().alias("win_rate"), F.count("*").alias("matches"))


def reindexed(rates: DataFrame, *by: str) -> DataFrame:
    """Only the reported groups, in their order, with nulls where one has no match."""
    groups = F.posexplode(F.lit(list(REPORTED)))
    every = rates.select(*by).distinct() if by else rates.sparkSession.range(1).select()
    every = every.select(*by, groups.alias("position", "rest_group"))
    return every.join(rates, [*by, "rest_group"], "left").select(*by, "position", "rest_group", "win_rate", "matches")


def relative_rest_win_rate(view: DataFrame, *by: str) -> DataFrame:
    """Win rate with more, less and the same rest as the opponent; matches with unknown rest count nowhere."""
    return view.filter("relative_rest is not null").groupBy(*by, "relative_rest").agg(win_rate().alias("win_rate"), F.count("*").alias("matches"))


def relative_rest_by_venue(view: DataFrame, *by: str) -> DataFrame:
    """relative_rest_win_rate split by home and away: the rows of the grouped bar chart."""
    return relative_rest_win_rate(view, *by, "is_home")
