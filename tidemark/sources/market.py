"""Market tables derived from the ``events`` table: each is a view that Spark and SQL state alike.

Times are also given as microseconds since the epoch (``us``), in which all window arithmetic is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tick_id, symbol, ts, us, price, k, bid, ask, bid_qty, ask_qty); some bids are null, some books inverted."""
    price, k = F.lit(100.0) + F.col("value") / 10.0, F.col("k")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("tick_id"),
        F.col("event_type").alias("symbol"),
        "ts",
        "us",
        price.alias("price"),
        "k",
        F.when(k % 25 != 7, price - 0.01 * (1 + k % 7)).alias("bid"),
        F.when(k % 20 == 0, price - 0.02 * (1 + k % 7)).otherwise(price + 0.01 * (1 + k % 7)).alias("ask"),
        (1 + F.col("user_id") % 17).cast("double").alias("bid_qty"),
        (1 + k % 13).cast("double").alias("ask_qty"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, symbol, ts, us): one event in twenty."""
    return events(spark, sf_dir).filter("event_id % 20 = 3").select(F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_type").alias("symbol"), "ts", "us")


def traded(id_: str) -> tuple[Column, Column]:
    """Quantity of the trade that an event is, and whether its maker buys."""
    return (1 + F.col("k") % 9).cast("double").alias("qty"), (F.col(id_) % 2 == 0).alias("is_buyer_maker")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("trade_id"), F.col("event_type").alias("symbol"), "ts", "us", (F.lit(100.0) + F.col("value") / 10.0).alias("price"), *traded("event_id")
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, n_trades, stage_pct, noise): features of candidates, some null."""
    e, k = events(spark, sf_dir).filter("event_id % 20 = 3"), F.col("k")
    return e.filter("event_id % 140 != 3").select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("event_id"), F.when(k % 17 != 0, k % 25).alias("n_trades"), F.when(k % 11 != 0, (k % 60) / 10.0).alias("stage_pct"), F.when(k % 5 != 0, F.col("value")).alias("noise")
    )


#: The same views for the SQL side.
SQL = """
ev AS (SELECT *, epoch_us(ts) AS us, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events),
ticks AS (
  SELECT event_id AS tick_id, event_type AS symbol, ts, us, price, k,
         CASE WHEN k % 25 != 7 THEN price - 0.01::DOUBLE * (1 + k % 7) END AS bid,
         CASE WHEN k % 20 = 0 THEN price - 0.02::DOUBLE * (1 + k % 7) ELSE price + 0.01::DOUBLE * (1 + k % 7) END AS ask,
         CAST(1 + user_id % 17 AS DOUBLE) AS bid_qty, CAST(1 + k % 13 AS DOUBLE) AS ask_qty
  FROM (SELECT *, 100::DOUBLE + value / 10::DOUBLE AS price FROM ev)),
candidates AS (SELECT 'ev_' || event_id AS event_id, event_type AS symbol, ts, us FROM ev WHERE event_id % 20 = 3),
trades AS (SELECT event_id AS trade_id, event_type AS symbol, ts, us, 100::DOUBLE + value / 10::DOUBLE AS price, CAST(1 + k % 9 AS DOUBLE) AS qty, event_id % 2 = 0 AS is_buyer_maker FROM ev),
features AS (SELECT 'ev_' || event_id AS event_id, CASE WHEN k % 17 != 0 THEN k % 25 END AS n_trades, CASE WHEN k % 11 != 0 THEN (k % 60) / 10::DOUBLE END AS stage_pct, CASE WHEN k % 5 != 0 THEN value END AS noise
             FROM ev WHERE event_id % 20 = 3 AND event_id % 140 != 3)"""
