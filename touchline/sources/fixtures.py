"""Match-shaped views over order tables, for checks and timings where no match files exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for the away team of orders without line items.
NO_AWAY = "NATION_1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match an order: customer's nation against the nation of its smallest supplier key, line items with flag R and A as goals.

    Orders without line items are unplayed: null scores. Orders whose nations are equal are left out.
    """
    t = lambda name: _table(spark, sf_dir, name)
    goals = lambda flag: F.count_if(F.col("l_returnflag") == flag).cast("int")
    items = t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("suppkey"), goals("R").alias("home_score"), goals("A").alias("away_score"))
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    home = nation.join(t("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    home = home.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home_team"), F.col("r_name").alias("country"))
    away = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("away_nation"))
    out = t("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = out.join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(home, F.col("c_nationkey") == F.col("home_key")).join(away, F.col("suppkey") == F.col("s_suppkey"), "left")
    out = out.withColumn("away_team", F.coalesce("away_nation", F.lit(NO_AWAY))).filter("home_team <> away_team")
    return out.select(
        F.col("o_orderkey").cast("long").alias("match_id"), F.to_date("o_orderdate").alias("date"), "home_team", "away_team", "home_score", "away_score",
        F.col("o_orderpriority").alias("tournament"), F.col("c_mktsegment").alias("city"), "country", (F.col("o_orderstatus") == "P").alias("neutral"),
    )


def goals(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """One goal a line item with flag R (home team) or A (away team). of: the matches, where they are at hand."""
    m = (matches(spark, sf_dir) if of is None else of).select("match_id", "date", "home_team", "away_team")
    items = _table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    return m.join(items, F.col("match_id") == F.col("l_orderkey")).select(
        "date", "home_team", "away_team", F.when(F.col("l_returnflag") == "R", F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        F.col("l_partkey").cast("string").alias("scorer"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int")).alias("minute"),
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their regions as confederations."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("confederation"))


def former_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two periods a nation, the second from within the first, and one without an end: names that teams are called by instead."""
    nation, days = _table(spark, sf_dir, "nation"), lambda a, b: F.date_add(F.lit("1993-01-01").cast("date"), (F.col("n_nationkey") * a + F.col("i") * b).cast("int"))
    rows = nation.select("n_name", "n_nationkey", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i")).filter("i < 2 or n_nationkey % 5 = 0")
    end = F.when(F.col("i") < 2, F.date_add(days(40, 300), 500))
    return rows.select(F.concat_ws("_", "n_name", "i").alias("current"), F.col("n_name").alias("former"), days(40, 300).alias("start_date"), end.alias("end_date"))


#: The same views for the SQL side.
SQL = """
WITH items AS (
  SELECT l_orderkey, min(l_suppkey) AS suppkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INTEGER) AS home_score,
    CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS INTEGER) AS away_score FROM lineitem GROUP BY l_orderkey
), countries AS (
  SELECT n_name AS country, r_name AS confederation FROM nation JOIN region ON n_regionkey = r_regionkey
), matches AS (
  SELECT CAST(o_orderkey AS BIGINT) AS match_id, CAST(o_orderdate AS DATE) AS date, h.n_name AS home_team, coalesce(a.n_name, 'NATION_1') AS away_team,
    i.home_score, i.away_score, o_orderpriority AS tournament, c_mktsegment AS city, r_name AS country, o_orderstatus = 'P' AS neutral
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey JOIN region ON h.n_regionkey = r_regionkey
    LEFT JOIN items i ON o_orderkey = i.l_orderkey LEFT JOIN supplier ON i.suppkey = s_suppkey LEFT JOIN nation a ON s_nationkey = a.n_nationkey
  WHERE h.n_name <> coalesce(a.n_name, 'NATION_1')
), goals AS (
  SELECT date, home_team, away_team, CASE WHEN l_returnflag = 'R' THEN home_team ELSE away_team END AS team, CAST(l_partkey AS VARCHAR) AS scorer,
    CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS INTEGER) END AS "minute"
  FROM matches JOIN lineitem ON match_id = l_orderkey WHERE l_returnflag IN ('R', 'A')
), former_names AS (
  SELECT n_name || '_' || i AS current, n_name AS former, DATE '1993-01-01' + CAST(n_nationkey * 40 + i * 300 AS INTEGER) AS start_date,
    CASE WHEN i < 2 THEN DATE '1993-01-01' + CAST(n_nationkey * 40 + i * 300 + 500 AS INTEGER) END AS end_date
  FROM nation, (VALUES (0), (1), (2)) v(i) WHERE i < 2 OR n_nationkey % 5 = 0
)
"""
