"""Ordered target statistics: a category as how often each label has come with it, from other rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import ranges

CLASSES = 3
#: Weight of the prior, which is the same chance for each label.
PRIOR = 1.0
STATISTICS = "column string, category string, n long, counts array<long>"


def category(column: str) -> Column:
    """A value as a key that null has, too."""
    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def names(columns: list[str], classes: int = CLASSES) -> list[str]:
    return [f"{c}_of_{k}" for c in columns for k in range(classes)]


def _share(count: Column, n: Column, classes: int, prior: float) -> Column:
    return (count + F.lit(prior / classes)) / (n + F.lit(prior))


def ordered(rows: DataFrame, columns: list[str], *, classes: int = CLASSES, prior: float = PRIOR, id_col: str = "match_id", label_col: str = "label", seed: int = 42) -> DataFrame:
    """rows with names(columns): of the rows before in the order of md5(id|seed) with the same category, the share of each label, with a prior.

    No row sees its own label, so the statistics tell nothing that a new row's would not. Sums of 4,096 ranges of the hash stand for earlier rows, so a
    category that most rows have is no task. Rows without a label count nowhere.
    """
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    out = rows.withColumn("__h", digest)
    for c in columns:
        values = {"__n": F.col(label_col).isNotNull().cast("long")} | {f"__c{k}": F.coalesce((F.col(label_col) == k).cast("long"), F.lit(0)) for k in range(classes)}
        out = ranges.prefix_sums(out.withColumn("__category", category(c)), ["__category"], F.substring("__h", 1, ranges.HASH_DIGITS), ["__h", id_col], values)
        out = out.withColumns({n: _share(F.col(f"__c{k}"), F.col("__n"), classes, prior) for k, n in enumerate(names([c], classes))}).drop("__category", *values)
    return out.drop("__h")


def statistics(rows: DataFrame, columns: list[str], *, classes: int = CLASSES, label_col: str = "label") -> DataFrame:
    """column, category, n, counts of all labelled rows: what rows to predict are encoded by."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("category")) for c in columns]))
    each = rows.filter(F.col(label_col).isNotNull()).select(pairs.alias("p"), F.col(label_col).alias("label"))
    counts = F.array(*[F.count_if(F.col("label") == k) for k in range(classes)])
    return each.groupBy("p.column", "p.category").agg(F.count("*").alias("n"), counts.alias("counts"))


def encoded(rows: DataFrame, known: DataFrame, columns: list[str], *, classes: int = CLASSES, prior: float = PRIOR) -> DataFrame:
    """rows with names(columns) by the statistics of all training rows; an unseen category has the prior. One row a category: Spark broadcasts it by its size."""
    for c in columns:
        own = known.filter(F.col("column") == c).select(F.col("category").alias("__category"), F.col("n").alias("__n"), F.col("counts").alias("__counts"))
        out = rows.withColumn("__key", category(c)).join(own, F.col("__key") == F.col("__category"), "left")
        n = F.coalesce("__n", F.lit(0))
        share = {x: _share(F.coalesce(F.get("__counts", F.lit(k)), F.lit(0)), n, classes, prior) for k, x in enumerate(names([c], classes))}
        rows = out.withColumns(share).drop("__key", "__category", "__n", "__counts")
    return rows


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATISTICS)
