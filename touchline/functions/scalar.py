"""Column expressions over matches. All are built-in expressions, so plans stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AWAY_WIN, DRAW, HOME_WIN = 0, 1, 2


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def goal_diff(home: Column | str = "home_score", away: Column | str = "away_score") -> Column:
    return col(home) - col(away)


def home_win(home: Column | str = "home_score", away: Column | str = "away_score") -> Column:
    """1 for a home win, 0 otherwise and for unplayed matches."""
    return F.when(col(home) > col(away), 1).otherwise(0)


def outcome(home: Column | str = "home_score", away: Column | str = "away_score") -> Column:
    """2 home win, 0 away win, 1 otherwise: draws and unplayed matches."""
    return F.when(col(home) > col(away), HOME_WIN).when(col(home) < col(away), AWAY_WIN).otherwise(DRAW)


def team_result(is_home: Column | str = "is_home", home: Column | str = "home_score", away: Column | str = "away_score") -> Column:
    """1 won, -1 lost, 0 drawn or unplayed, from a team's side."""
    sign = F.when(col(home) > col(away), 1).when(col(home) < col(away), -1).otherwise(0)
    return F.when(col(is_home), sign).otherwise(-sign)


def matchup(home: Column | str = "home_team", away: Column | str = "away_team") -> Column:
    """The same key for both venues: the two names in binary order."""
    return F.concat_ws("_", F.least(col(home), col(away)), F.greatest(col(home), col(away)))


def rest_group(days: Column | str) -> Column:
    """Days up to five as they are; more, and unknown rest, are '>5'."""
    return F.when(col(days) <= 5, col(days).cast("string")).otherwise(">5")


def rest_number(group: Column | str) -> Column:
    """A rest group as a number; null where it is not one, as for '>5'."""
    return col(group).try_cast("int")


def relative_rest(own: Column | str, other: Column | str) -> Column:
    """more, less or same; null where either is unknown."""
    return F.when(col(own) > col(other), "more").when(col(own) < col(other), "less").when(col(own) == col(other), "same")


def one_hot(column: str, values: list[str], prefix: str | None = None) -> list[Column]:
    """One 0/1 column a value, in binary order of the values; null is 0 in all."""
    return [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{prefix or column}_{v}") for v in sorted(values)]


def percent(share: Column | str) -> Column:
    return F.format_string("%.2f%%", col(share) * 100)
