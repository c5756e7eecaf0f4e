"""Features of a match for the outcome models."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalar
from touchline.operators import ranges

TOURNAMENTS = ("FIFA World Cup qualification", "Copa America", "FIFA World Cup", "Friendly")
SOUTH_AMERICA = ("Argentina", "Bolivia", "Brazil", "Chile", "Colombia", "Ecuador", "Paraguay", "Peru", "Uruguay", "Venezuela")
SINCE = datetime.date(2000, 1, 1)
ROLLING = {
    "home_team_avg_scored": ("home_team", "home_score"), "home_team_avg_conceded": ("home_team", "away_score"),
    "away_team_avg_scored": ("away_team", "away_score"), "away_team_avg_conceded": ("away_team", "home_score"),
}
NUMERIC = ["head_to_head_goal_diff", *ROLLING]
NOT_FEATURES = ("date", "home_score", "away_score", "tournament", "neutral", "city", "country", "matchup_id", "goal_diff")


def select_matches(matches: DataFrame, teams: tuple[str, ...] | None = SOUTH_AMERICA, tournaments: tuple[str, ...] = TOURNAMENTS, since: datetime.date = SINCE) -> DataFrame:
    """The matches that features are made from: also all history that they see."""
    out = matches.filter(F.col("tournament").isin(*tournaments) & (F.col("date") >= F.lit(since)))
    return out if teams is None else out.filter(F.col("home_team").isin(*teams) & F.col("away_team").isin(*teams))


def head_to_head_stats(matches: DataFrame) -> DataFrame:
    """Mean goal difference of each pairing, from the side of whoever is listed at home."""
    return matches.groupBy(scalar.matchup().alias("matchup_id")).agg(F.avg(scalar.goal_diff()).alias("head_to_head_goal_diff"))


def with_head_to_head(matches: DataFrame, mode: str = "all", range_days: int = ranges.RANGE_DAYS) -> DataFrame:
    """Head-to-head mean. mode all: every match of the pairing counts, the present one too; prior: only earlier ones; window: all, as a window.

    all sums partially and joins the few pairings back (broadcast, where Spark finds them small); prior adds sums of ranges of dates, so a pairing is no task;
    window has a task a pairing and no join.
    """
    out = matches.withColumn("matchup_id", scalar.matchup()).withColumn("goal_diff", scalar.goal_diff())
    if mode == "all":
        out = out.join(head_to_head_stats(matches), "matchup_id", "left")
        return out.withColumn("head_to_head_goal_diff", F.coalesce("head_to_head_goal_diff", F.lit(0.0)))
    if mode == "window":
        return out.withColumn("head_to_head_goal_diff", F.coalesce(F.avg("goal_diff").over(Window.partitionBy("matchup_id")), F.lit(0.0)))
    known = {"__sum": F.coalesce(F.col("goal_diff"), F.lit(0)), "__n": F.col("goal_diff").isNotNull().cast("int")}
    out = ranges.prefix_sums(out, ["matchup_id"], ranges.date_range("date", range_days), ["date", "match_id"], known)
    return out.withColumn("head_to_head_goal_diff", F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).otherwise(0.0)).drop("__sum", "__n")


def with_head_to_head_joined(matches: DataFrame) -> DataFrame:
    return with_head_to_head(matches)


def with_rolling_averages(matches: DataFrame, window: int = 10, only: tuple[str, ...] = tuple(ROLLING), range_days: int = ranges.RANGE_DAYS, history: DataFrame | None = None) -> DataFrame:
    """Mean of the previous ``window`` rows of the team at that venue, in order of date and match_id; null without one. history: as in ranges.rolling_means.

    A team's rows are dealt by range of dates, and each range gets the last rows of those before: a team with a third of all rows is no task.
    """
    history = matches if history is None else history
    for team in ("home_team", "away_team"):
        means = {name: c for name, (t, c) in ROLLING.items() if t == team and name in only}
        if means:
            matches = ranges.rolling_means(matches, team, ["date", "match_id"], means, window, ranges.date_range("date", range_days), history)
    return matches


def latest_form(matches: DataFrame, venue: str) -> DataFrame:
    """Each team's averages as of its last match at the venue (home or away); 0 where unknown."""
    team = f"{venue}_team"
    names = [n for n in ROLLING if n.startswith(venue)]
    rolled = with_rolling_averages(matches, only=tuple(names))
    last = rolled.groupBy(F.col(team).alias("team")).agg(F.max_by(F.struct(*names), F.struct("date", "match_id")).alias("f"))
    return last.select("team", *[F.coalesce(F.col(f"f.{n}"), F.lit(0.0)).alias(n) for n in names])


def vocabulary(matches: DataFrame, column: str) -> list[str]:
    """The distinct values of a team or confederation column, in binary order: a short list that a fitted model keeps."""
    return sorted(r[0] for r in matches.select(column).distinct().collect() if r[0] is not None)


def encode(matches: DataFrame, columns: list[str], vocabularies: dict[str, list[str]]) -> DataFrame:
    """Each column replaced by 0/1 columns of its frozen vocabulary."""
    hot = [h for c in columns for h in scalar.one_hot(c, vocabularies[c])]
    return matches.select(*[c for c in matches.columns if c not in columns], *hot)


def encoded_names(vocabularies: dict[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c, values in vocabularies.items() for v in sorted(values)]


def prepare(matches: DataFrame, teams: tuple[str, ...] | None = SOUTH_AMERICA, tournaments: tuple[str, ...] = TOURNAMENTS, since: datetime.date = SINCE, window: int = 10, mode: str = "all") -> DataFrame:
    """Selected matches with head-to-head and rolling averages, before encoding."""
    own = select_matches(matches, teams, tournaments, since)
    return with_rolling_averages(with_head_to_head(own, mode), window, history=own)


def build_features(prepared: DataFrame, vocabularies: dict[str, list[str]], keep: tuple[str, ...] = ("match_id", "date")) -> DataFrame:
    """Encoded features and the label of complete rows: rows with a null in any other column go, as a null confederation is all zeros by then."""
    out = encode(prepared, list(vocabularies), vocabularies).na.drop("any")
    label = scalar.outcome().alias("label")
    return out.select(*keep, *[c for c in out.columns if c not in NOT_FEATURES and c not in keep], label)


def inference_row(matches: DataFrame, home: str, away: str, features: list[str], mode: str = "zeros", strict: bool = False) -> DataFrame:
    """The one row to predict a match. mode zeros: all features 0 but the two teams'; latest: each team's latest averages too.

    An unknown team sets no feature, or raises if strict.
    """
    hot = {f"home_team_{home}", f"away_team_{away}"}
    if strict and not hot <= set(features):
        raise ValueError(f"unknown team: {sorted(hot - set(features))}")
    spark = matches.sparkSession
    row = spark.range(1).select(*[F.lit(1 if f in hot else 0).cast("double" if f in NUMERIC else "int").alias(f) for f in features])
    if mode == "zeros":
        return row
    for venue, team in (("home", home), ("away", away)):
        own = latest_form(matches, venue).filter(F.col("team") == team).drop("team")
        names = own.columns
        own = own.agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])  # one row, also for an unknown team
        row = row.drop(*names).join(own)
    pair = select_pair(matches, home, away).agg(F.coalesce(F.avg(scalar.goal_diff()), F.lit(0.0)).alias("head_to_head_goal_diff"))
    return row.drop("head_to_head_goal_diff").join(pair).select(*features)


def select_pair(matches: DataFrame, home: str, away: str) -> DataFrame:
    return matches.filter(scalar.matchup() == "_".join(sorted([home, away])))


def split_test(rows: DataFrame, id_col: str = "match_id", share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with is_test: the first ceil(share * n) in order of md5(id|seed), ranked by 4,096 ranges of the hash."""
    ranked = ranges.hash_ranked(rows, [], id_col, seed)
    return ranked.withColumn("is_test", F.col("__rank") <= F.ceil(F.lit(share) * F.col("__count"))).drop("__rank", "__count")


def with_folds(rows: DataFrame, folds: int = 5, id_col: str = "match_id", label_col: str = "label", seed: int = 42) -> DataFrame:
    """rows with fold: each label's rows in order of md5(id|seed) are dealt in turn, so sizes differ by one a label at most."""
    ranked = ranges.hash_ranked(rows, [label_col], id_col, seed)
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int")).drop("__rank", "__count")


def scaler(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one pass."""
    got = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (got[f"m_{c}"] or 0.0, got[f"s_{c}"] or 0.0) for c in columns}


def standardized(c: str, fitted: dict[str, tuple[float, float]]) -> Column:
    """The column's z-score; 0 where the fitted column is constant."""
    mean, deviation = fitted[c]
    return F.lit(0.0) if deviation == 0 else (F.col(c) - F.lit(mean)) / F.lit(deviation)
