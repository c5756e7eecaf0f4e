"""Ordered work within keys that may be hot: each key's rows are cut into ranges of the order, ranges are worked on apart, and what earlier ranges
hand on (sums, or their last rows) is one small row a key and range.

No task has more than one range of a key. What is ordered in one task a key is its ranges, never its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a range of dates.
RANGE_DAYS = 91
#: Hexadecimal digits of a hash that make a range: 4,096 ranges.
HASH_DIGITS = 3
RANGE = "__range"


def date_range(date: str = "date", days: int = RANGE_DAYS) -> Column:
    """The number of the range that a date is in; null dates are a range of their own, the first."""
    return F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / days).cast("int")


def _known(column: Column) -> Column:
    """A range as a key that equals itself where it is null, in the same order."""
    return F.coalesce(column.cast("string"), F.lit(""))


def prefix_sums(rows: DataFrame, by: list[str], part: Column, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with the sum of each value over the earlier rows of its keys, in order of ``part`` (which ``order`` has to follow) and ``order``; 0 for the first.

    Partial sums are combined before they are shuffled; rows are shuffled once, by keys and range. Keys are not null.
    """
    keyed = rows.withColumn(RANGE, part)
    own = keyed.withColumns({f"__v_{n}": v for n, v in values.items()}).groupBy(*by, RANGE).agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in values])
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(*by, _known(F.col(RANGE)).alias("__k"), *[F.coalesce(F.sum(f"__b_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in values])
    within = Window.partitionBy(*by, "__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn("__k", _known(F.col(RANGE)))
    out = out.withColumns({f"__w_{n}": F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in values.items()}).join(before, [*by, "__k"])
    out = out.withColumns({n: F.col(f"__w_{n}") + F.col(f"__b_{n}") for n in values})
    return out.select(*rows.columns, *[F.col(n) for n in values if n not in rows.columns])


def hash_ranked(rows: DataFrame, by: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """rows with __rank (from 1) in the order of md5(id|seed) within ``by``, and __count, the rows of ``by``."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    hashed = rows.withColumn("__h", digest).withColumn("__b", F.substring("__h", 1, HASH_DIGITS))
    sizes = hashed.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # of at most 4,096 rows
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).withColumn("__count", F.sum("__n").over(Window.partitionBy(*by))).drop("__n")
    ranked = hashed.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", id_col)))
    on = [ranked["__b"] == sizes["__b"], *[ranked[c].eqNullSafe(sizes[c]) for c in by]]
    out = ranked.join(sizes if by else F.broadcast(sizes), on)
    return out.select(*[ranked[c] for c in rows.columns], (F.col("__before") + F.col("__i")).alias("__rank"), "__count")


def previous_value(rows: DataFrame, by: str, value: str, order: list[str], name: str, part: Column) -> DataFrame:
    """rows with ``value`` of the row before, within ``by``, where ``value`` is the first of ``order``: that is the largest of the range before, where a range begins."""
    keyed = rows.withColumn("__k", _known(part)).withColumn(RANGE, part)
    last = keyed.groupBy(by, "__k", RANGE).agg(F.max(value).alias("__last"))
    last = last.select(by, "__k", F.lag("__last").over(Window.partitionBy(by).orderBy(RANGE)).alias("__last"))
    within = Window.partitionBy(by, "__k").orderBy(*order)
    out = keyed.withColumn("__own", F.lag(value).over(within)).withColumn("__i", F.row_number().over(within)).join(last, [by, "__k"], "left")
    return out.select(*rows.columns, F.when(F.col("__i") > 1, F.col("__own")).otherwise(F.col("__last")).alias(name))


def rolling_means(rows: DataFrame, by: str, order: list[str], means: dict[str, str], window: int, part: Column, history: DataFrame | None = None) -> DataFrame:
    """rows with the mean of each column over the ``window`` rows before within ``by`` (nulls don't count; null without any).

    history: the same rows before other columns were added, so that those are not made twice. A range's last ``window`` rows are handed on: as every range has a row, those of the ``window`` ranges before are enough.
    """
    columns = list(dict.fromkeys(means.values()))
    keyed = rows.withColumn("__k", _known(part))
    inside = Window.partitionBy(by, "__k")
    tail = (rows if history is None else history).select(by, _known(part).alias("__k"), part.alias(RANGE), *order, *columns).withColumn("__i", F.row_number().over(inside.orderBy(*[F.col(c).desc() for c in order])))
    tail = tail.filter(F.col("__i") <= window).groupBy(by, "__k", RANGE)
    tail = tail.agg(F.array_sort(F.collect_list(F.struct((-F.col("__i")).alias("i"), *columns))).alias("__t"))  # of ``window`` rows at most
    lists = F.collect_list("__t").over(Window.partitionBy(by).orderBy(RANGE).rowsBetween(-window, -1))
    carried = tail.select(by, "__k", F.flatten(lists).alias("__c"))
    within = inside.orderBy(*order).rowsBetween(-window, -1)
    sums = {f"__s_{c}": F.sum(F.col(c).cast("double")).over(within) for c in columns} | {f"__n_{c}": F.count(c).over(within) for c in columns}
    out = keyed.withColumns(sums | {"__i": F.row_number().over(inside.orderBy(*order))}).join(carried, [by, "__k"], "left")
    # A range's i-th row still sees this many rows of earlier ranges.
    n = F.greatest(F.lit(window + 1) - F.col("__i"), F.lit(0))
    out = out.withColumn("__c", F.slice("__c", F.greatest(F.size("__c") - n + 1, F.lit(1)), n))
    known = lambda c: F.filter(F.transform("__c", lambda x: x[c].cast("double")), lambda v: v.isNotNull())
    out = out.withColumns({f"__l_{c}": F.when(F.col("__i") <= window, known(c)) for c in columns})
    total = lambda c: F.coalesce(f"__s_{c}", F.lit(0.0)) + F.coalesce(F.aggregate(f"__l_{c}", F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
    count = lambda c: F.col(f"__n_{c}") + F.coalesce(F.when(F.col(f"__l_{c}").isNotNull(), F.size(f"__l_{c}")), F.lit(0))
    return out.select(*rows.columns, *[F.when(count(c) > 0, total(c) / count(c)).alias(n) for n, c in means.items()])
