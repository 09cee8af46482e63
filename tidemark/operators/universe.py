"""Which symbols to watch: unions, exclusions, ranges of volume, best matching market caps, and the funnel of all that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import base_symbol

LEVERAGED = "(UP|DOWN|BULL|BEAR)USDT$"
#: Pairs of pegged assets.
PEGGED = ("USDCUSDT", "FDUSDUSDT", "TUSDUSDT", "USDPUSDT", "DAIUSDT", "BUSDUSDT", "EURUSDT", "GBPUSDT", "AUDUSDT", "USTUSDT", "USD1USDT", "RLUSDUSDT")


def listed(messages: DataFrame, quote: str = "USDT") -> DataFrame:
    """(symbol): what messages of JSON (body) list under ``symbols`` as trading against ``quote``; broken messages list nothing."""
    body = F.from_json("body", "symbols array<struct<symbol:string,quoteAsset:string,status:string>>")
    return messages.select(F.explode(body["symbols"]).alias("s")).select("s.*").filter((F.col("quoteAsset") == quote) & (F.col("status") == "TRADING")).select("symbol").distinct()


def trading(instruments: DataFrame, quote: str = "USDT") -> DataFrame:
    return instruments.filter((F.col("quote_asset") == quote) & (F.col("status") == "TRADING"))


def perp_union(usd: DataFrame, coin: DataFrame, quote: str = "USDT") -> DataFrame:
    """Symbols with a perpetual contract at either venue; the second lists base assets, which become pairs with ``quote``."""
    live = "contract_type = 'PERPETUAL' and status = 'TRADING'"
    second = coin.filter(live).filter("base_asset <> ''").select(F.concat("base_asset", F.lit(quote)).alias("symbol"))
    return usd.filter(live).select("symbol").union(second).distinct()


def judged(instruments: DataFrame, tickers: DataFrame, *, least_volume: float = 200_000.0, least_trades: int = 500, pegged: tuple[str, ...] = PEGGED) -> DataFrame:
    """Trading symbols with the first reason against each, or ``accepted``; without a ticker (or a number in it) that is ``no_ticker``."""
    t = trading(instruments).select("symbol").distinct().join(tickers.select("symbol", F.expr("try_cast(quote_volume as double)").alias("quote_volume"), F.expr("try_cast(trade_count as bigint)").alias("trade_count")), "symbol", "left")
    reason = (
        F.when(F.col("symbol").rlike(LEVERAGED), "leveraged")
        .when(F.col("symbol").isin(*pegged), "pegged")
        .when(F.col("quote_volume").isNull() | F.col("trade_count").isNull(), "no_ticker")
        .when(F.col("quote_volume") < least_volume, "low_volume")
        .when(F.col("trade_count") < least_trades, "low_trades")
        .when(~F.col("symbol").rlike("^[\\x00-\\x7F]*$"), "not_ascii")
        .otherwise("accepted")
    )
    return t.withColumn("reason", reason)


def coverage_universe(instruments: DataFrame, tickers: DataFrame, **limits) -> DataFrame:
    return judged(instruments, tickers, **limits).filter("reason = 'accepted'").drop("reason")


def universe_funnel(instruments: DataFrame, tickers: DataFrame, **limits) -> DataFrame:
    """How many trading symbols each reason takes."""
    return judged(instruments, tickers, **limits).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def mcap_best_match(symbols: DataFrame, coins: DataFrame, quote: str = "USDT") -> DataFrame:
    """(symbol, market_cap): the largest cap of the coins that share a symbol's base ticker; none without a positive one."""
    s = symbols.filter(F.col("symbol").endswith(quote)).select("symbol", base_symbol(F.col("symbol"), quote).alias("base"))
    caps = coins.groupBy(F.lower("ticker").alias("base")).agg(F.max("market_cap").alias("market_cap")).filter("market_cap > 0")
    return s.join(caps, "base").select("symbol", "market_cap")


def trading_universe(instruments: DataFrame, tickers: DataFrame, caps: DataFrame, *, low: float = 200_000.0, high: float = 5_000_000.0, most_cap: float = 50_000_000.0, without: DataFrame | None = None) -> DataFrame:
    """Trading symbols with a volume in [low, high] and a market cap below ``most_cap`` or unknown.

    ``without`` takes symbols out (say, those with perpetual contracts); by default none are.
    """
    found = trading(instruments).select("symbol").distinct().join(tickers.filter(F.col("quote_volume").between(low, high)).select("symbol", "quote_volume"), "symbol")
    if without is not None:
        found = found.join(without.select("symbol"), "symbol", "left_anti")
    return found.join(caps, "symbol", "left").filter(F.col("market_cap").isNull() | (F.col("market_cap") < most_cap))


def universe_semi_join(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose symbol is in the universe; an empty universe filters nothing."""
    return rows if universe.isEmpty() else rows.join(universe.select("symbol"), "symbol", "left_semi").select(*rows.columns)


def signature(universe: DataFrame, prefix: int = 3) -> DataFrame:
    """(prefixes, symbols, signature): a digest that tells two universes (symbol) apart.

    The sorted symbols of each prefix have a digest, and the sorted prefixes' digests have one, so no task holds more than a
    prefix's symbols or the digests of all prefixes.
    """
    joined = lambda c: F.sha2(F.array_join(c, ","), 256)
    parts = universe.groupBy(F.substring("symbol", 1, prefix).alias("p")).agg(joined(F.array_sort(F.collect_list("symbol"))).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = joined(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]))
    return parts.agg(F.count(F.lit(1)).alias("prefixes"), F.sum("n").alias("symbols"), whole.alias("signature"))
