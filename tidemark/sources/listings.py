"""Listings derived from ``part`` and ``lineitem``: instruments, day tickers and coins, for Spark and for SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, at = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    kind = F.when(at % 17 == 0, "UP").when(at % 17 == 5, "BULL").when(at % 17 == 9, "DOWN").otherwise("")
    base = F.when(at == 3, "USDC").when(at == 8, "DAI").otherwise(F.concat(F.when(at % 101 == 0, "Ñ").otherwise("P"), at.cast("string"), kind))
    quote = F.when(at % 13 == 1, "EUR").otherwise("USDT")
    status, contract = F.when(at % 11 == 2, "BREAK").otherwise("TRADING"), F.when(at % 7 == 4, "CURRENT_QUARTER").otherwise("PERPETUAL")
    venue = F.when(at % 3 == 0, "usd").when(at % 4 == 1, "coin").otherwise("spot")
    return p.select("p_partkey", F.concat(base, quote).alias("symbol"), base.alias("base_asset"), quote.alias("quote_asset"), status.alias("status"), contract.alias("contract_type"), venue.alias("venue"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, base_asset, quote_asset, status, contract_type, venue) of every part; some are leveraged, pegged or not in ASCII."""
    return _instruments(spark, sf_dir).drop("p_partkey")


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, quote_volume, trade_count): a part's sold value and number of sales; a part in nineteen has none."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"))
    named = _instruments(spark, sf_dir).filter("p_partkey % 19 <> 6").select("p_partkey", "symbol")
    return named.join(li, F.col("p_partkey") == F.col("l_partkey")).select("symbol", "quote_volume", "trade_count")


def coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coin_id, ticker, market_cap): one for each part and supplier; several share a ticker, some caps are null."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cap = F.when(F.col("l_suppkey") % 5 != 0, F.round(F.sum("l_extendedprice") * 20, 2))
    return li.filter("l_partkey % 6 <> 1").groupBy("l_partkey", "l_suppkey").agg(cap.alias("market_cap")).select(
        F.concat_ws("-", F.col("l_partkey"), F.col("l_suppkey")).alias("coin_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("ticker"), "market_cap"
    )


def listing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): one message of JSON for each status and contract type, holding its instruments under ``symbols``."""
    i = instruments(spark, sf_dir).withColumn("part_of", F.crc32("symbol") % 64)
    one = F.struct(F.col("symbol").alias("symbol"), F.col("quote_asset").alias("quoteAsset"), F.col("status").alias("status"))
    return i.groupBy("part_of").agg(F.to_json(F.struct(F.collect_list(one).alias("symbols"))).alias("body")).select("body")


#: The same views for the SQL side.
SQL = """
parts AS (SELECT *, CASE WHEN p_partkey = 3 THEN 'USDC' WHEN p_partkey = 8 THEN 'DAI' ELSE CASE WHEN p_partkey % 101 = 0 THEN 'Ñ' ELSE 'P' END || p_partkey || CASE p_partkey % 17 WHEN 0 THEN 'UP' WHEN 5 THEN 'BULL' WHEN 9 THEN 'DOWN' ELSE '' END END AS base_asset,
  CASE WHEN p_partkey % 13 = 1 THEN 'EUR' ELSE 'USDT' END AS quote_asset, CASE WHEN p_partkey % 11 = 2 THEN 'BREAK' ELSE 'TRADING' END AS status,
  CASE WHEN p_partkey % 7 = 4 THEN 'CURRENT_QUARTER' ELSE 'PERPETUAL' END AS contract_type, CASE WHEN p_partkey % 3 = 0 THEN 'usd' WHEN p_partkey % 4 = 1 THEN 'coin' ELSE 'spot' END AS venue FROM part),
instruments AS (SELECT *, base_asset || quote_asset AS symbol FROM parts),
tickers AS (SELECT symbol, quote_volume, trade_count FROM instruments JOIN (SELECT l_partkey, round(sum(l_extendedprice), 2) AS quote_volume, count(*) AS trade_count FROM lineitem GROUP BY ALL) ON l_partkey = p_partkey WHERE p_partkey % 19 <> 6),
coins AS (SELECT l_partkey || '-' || l_suppkey AS coin_id, 'p' || l_partkey AS ticker, CASE WHEN l_suppkey % 5 != 0 THEN round(sum(l_extendedprice) * 20, 2) END AS market_cap FROM lineitem WHERE l_partkey % 6 <> 1 GROUP BY l_partkey, l_suppkey)"""
