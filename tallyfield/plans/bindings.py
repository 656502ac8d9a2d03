"""How the tables at hand play the parts of matches, teams, trades and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.pricing import settle_profit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as team rows: a user is a team, an event type a league."""
    whole = F.floor("value").cast("long")
    result = F.element_at(F.array(F.lit("W"), F.lit("D"), F.lit("L")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", F.to_date("ts").alias("day"), F.pmod(whole, F.lit(5)).alias("goals"), F.pmod(whole, F.lit(20)).alias("shots"),
        F.pmod(whole, F.lit(11)).alias("corners"), F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("side"), result.alias("result"),
    )


TEAM_SQL = """team AS (
  SELECT event_id, user_id, ts, event_type, value, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) % 5 AS goals, CAST(floor(value) AS BIGINT) % 20 AS shots,
         CAST(floor(value) AS BIGINT) % 11 AS corners, CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side,
         CASE event_id % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END AS result
  FROM events)"""


def trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades of three strategies; markets are event types."""
    d = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("strategy"), F.col("event_type").alias("market"),
        F.concat(F.lit("l"), (F.col("user_id") % 7).cast("string")).alias("league"), F.round(1.2 + (F.col("event_id") % 170) / 100, 2).alias("odd"), F.lit(1.0).alias("stake"), (F.col("event_id") * 7 % 10 < 4).alias("is_win"),
    )
    return d.withColumn("profit", settle_profit(F.col("is_win"), F.col("stake"), F.col("odd")))


TRADE_SQL = """trade AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, 's' || CAST(user_id % 3 AS VARCHAR) AS strategy, event_type AS market, 'l' || CAST(user_id % 7 AS VARCHAR) AS league,
         round(1.2 + (event_id % 170) / 100.0, 2) AS odd, 1.0::DOUBLE AS stake, event_id * 7 % 10 < 4 AS is_win,
         round(CASE WHEN event_id * 7 % 10 < 4 THEN round(1.2 + (event_id % 170) / 100.0, 2) - 1 ELSE -1.0 END, 4)::DOUBLE AS profit
  FROM events)"""


def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as price snapshots: a part is a match, a supplier a bookmaker, a ship date a snapshot."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("match_id"), (F.col("l_suppkey") % 6).alias("bookmaker"), F.col("l_returnflag").alias("selection"), F.to_date("l_shipdate").alias("snapshot"),
        F.round(1 + F.col("l_discount") * 20 + F.col("l_linenumber") / 10, 2).alias("price"), F.col("l_orderkey").alias("l_orderkey"), F.col("l_linenumber").alias("l_linenumber"),
    )


PRICE_SQL = """price AS (
  SELECT l_partkey AS match_id, l_suppkey % 6 AS bookmaker, l_returnflag AS selection, CAST(l_shipdate AS DATE) AS snapshot,
         round(1 + l_discount * 20 + l_linenumber / 10.0, 2)::DOUBLE AS price, l_orderkey, l_linenumber FROM lineitem)"""


def probability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions with outcomes."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", ((F.col("event_id") * 37 % 1000) / 1000).alias("p"), (F.col("event_id") * 13 % 100 < F.col("event_id") * 37 % 100).cast("int").alias("y"))


PROBABILITY_SQL = """prob AS (SELECT event_id, event_type, ts, user_id, (event_id * 37 % 1000) / 1000.0::DOUBLE AS p, CAST(event_id * 13 % 100 < event_id * 37 % 100 AS INTEGER) AS y FROM events)"""
