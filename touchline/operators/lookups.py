"""Recent form, head to head and scorer history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.files import query

QUALIFICATION = "FIFA World Cup qualification"


def of_team(team: str) -> Column:
    return (F.col("home_team") == team) | (F.col("away_team") == team)


def recent_form(matches: DataFrame, team: str, n: int = 5, tournament: str = QUALIFICATION) -> DataFrame:
    """The team's last n matches in the tournament, numbered from the oldest. Same dates: the larger match_id is later."""
    last = matches.filter(of_team(team) & (F.col("tournament") == tournament)).orderBy(F.desc("date"), F.desc("match_id")).limit(n)
    number = F.row_number().over(Window.orderBy("date", "match_id"))  # of n rows
    return last.select(number.alias("position"), "date", "home_team", "home_score", "away_score", "away_team")


def recent_form_all_teams(matches: DataFrame, n: int = 5, tournament: str = QUALIFICATION) -> DataFrame:
    """recent_form of every team at once, the latest first; ranks are limited before the shuffle."""
    rows = matches.filter(F.col("tournament") == tournament).withColumn("team", F.explode(F.array("home_team", "away_team")))
    by = Window.partitionBy("team").orderBy(F.desc("date"), F.desc("match_id"))
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n).select("team", "rank", "date", "home_team", "home_score", "away_score", "away_team")


def head_to_head(matches: DataFrame, home: str, away: str, tournament: str = QUALIFICATION) -> DataFrame:
    """Matches of the two at this venue, by date."""
    rows = matches.filter((F.col("home_team") == home) & (F.col("away_team") == away) & (F.col("tournament") == tournament))
    return rows.orderBy("date", "match_id").select("date", "home_team", "home_score", "away_score", "away_team")


def head_to_head_summary(matches: DataFrame) -> DataFrame:
    """Wins, draws and goals in one row; zeros where there is no match, unplayed matches count nowhere."""
    h, a = F.col("home_score"), F.col("away_score")
    goals = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return matches.agg(
        F.count_if(h > a).alias("home_wins"), F.count_if(h < a).alias("away_wins"), F.count_if(h == a).alias("draws"), goals(h).alias("home_goals"), goals(a).alias("away_goals")
    )


def scorer_history(results_with_goals: DataFrame, home: str, away: str, tournament: str = QUALIFICATION) -> DataFrame:
    """Goals with a known minute by scorer and team, most first."""
    sql = """SELECT scorer, team, count(minute) AS goals FROM {results_with_goals}
             WHERE home_team = :home AND away_team = :away AND tournament = :tournament GROUP BY scorer, team ORDER BY goals DESC, scorer, team"""
    return query(results_with_goals, "results_with_goals", sql, {"home": home, "away": away, "tournament": tournament})


def scorer_rows(results_with_goals: DataFrame, home: str, away: str, tournament: str = QUALIFICATION) -> DataFrame:
    """The rows behind scorer_history."""
    sql = "SELECT * FROM {results_with_goals} WHERE home_team = :home AND away_team = :away AND tournament = :tournament"
    return query(results_with_goals, "results_with_goals", sql, {"home": home, "away": away, "tournament": tournament})
