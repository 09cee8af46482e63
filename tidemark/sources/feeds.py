"""Feeds as they come: messages of JSON to rows, with what is wrong told instead of failing, and symbol lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quotes import finite_or_null


def tick_snapshot(spark: SparkSession, path: str, schema: str, columns: list[str], since: Column | None = None, until: Column | None = None, at: str = "ts") -> DataFrame:
    """``columns`` of the Parquet table at ``path`` with ``since`` <= ``at`` < ``until``; the schema is given, and columns and times reach the scan."""
    rows = spark.read.schema(schema).parquet(path)
    if since is not None:
        rows = rows.filter(F.col(at) >= since)
    if until is not None:
        rows = rows.filter(F.col(at) < until)
    return rows.select(*columns)


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    return reduce(lambda c, x: c.when(x[0], x[1]), checks[1:], F.when(checks[0][0], checks[0][1]))


def parsed_trades(messages: DataFrame, body: str = "body") -> DataFrame:
    """``messages`` with trade_ms, price, qty, is_buyer_maker and ``rejected``: why a message is no trade, null where it is one.

    A message is JSON with T (milliseconds), p, q (numbers or text of one) and m. The first of these that is wrong is told; the
    values of a rejected message are null. A null message is not JSON.
    """
    m = F.from_json(body, "map<string,string>")
    # a body that breaks off gives an empty map or one without the rest
    got = messages.withColumn("_m", F.when(F.col(body).rlike(r"^\s*\{.*\}\s*$"), m))
    field = lambda k: F.element_at("_m", F.lit(k))
    number = lambda k: finite_or_null(field(k))
    checks = [(F.col("_m").isNull(), "not_json")]
    for k in "Tpq":
        checks += [(field(k).isNull(), f"missing_{k}"), (number(k).isNull(), f"bad_{k}")]
    checks += [(field("m").isNull(), "missing_m"), (field("m").try_cast("boolean").isNull(), "bad_m")]
    told = got.withColumn("rejected", first_reason(checks))
    good = F.col("rejected").isNull()
    values = {"trade_ms": number("T").cast("long"), "price": number("p"), "qty": number("q"), "is_buyer_maker": field("m").try_cast("boolean")}
    return told.select(*messages.columns, *(F.when(good, v).alias(n) for n, v in values.items()), "rejected")


def exploded_klines(messages: DataFrame, body: str = "body") -> DataFrame:
    """A row for each bar in ``messages`` (..., body): JSON arrays of open time, o, h, l, c, v and close time, numbers or text; what does not parse is null, broken messages have no bars."""
    bars = messages.select(*(c for c in messages.columns if c != body), F.posexplode(F.from_json(body, "array<array<string>>")).alias("nth", "b"))
    at = lambda i: F.get("b", F.lit(i))
    numbers = {n: finite_or_null(at(i)) for i, n in enumerate("ohlcv", 1)}
    return bars.select(*(c for c in messages.columns if c != body), "nth", at(0).try_cast("long").alias("open_ms"), *(v.alias(n) for n, v in numbers.items()), at(6).try_cast("long").alias("close_ms"))


#: The keys that a message must have.
CONTRACTS = {
    "signal": ("symbol", "side", "confidence", "rr_est", "reasons", "version", "ts", "ttl_min"),
    "watchlist": ("symbol", "score", "why", "ts", "ttl_min"),
}


def contract_violations(body: Column, contract: str) -> Column:
    """Names of the rules of a contract that a message of JSON breaks: missing keys, then values out of their range or kind. What is no JSON object breaks ``json`` alone."""
    m = F.when(body.rlike(r"^\s*\{.*\}\s*$"), F.from_json(body, "map<string,string>"))
    field = lambda k: F.element_at(m, F.lit(k))
    number = lambda k: finite_or_null(field(k))
    whole = lambda k: field(k).rlike("^-?[0-9]+$")
    lists = lambda k: F.from_json(field(k), "array<string>").isNotNull() & field(k).startswith("[")
    ok = {
        "side": field("side").isin("long", "short"),
        "confidence": F.coalesce(number("confidence").between(0, 1), F.lit(False)),
        "rr_est": F.coalesce(number("rr_est") >= 0, F.lit(False)),
        "reasons": F.coalesce(lists("reasons"), F.lit(False)),
        "why": F.coalesce(lists("why"), F.lit(False)),
        "score": whole("score") & F.coalesce(number("score").between(0, 100), F.lit(False)),
        "ts": field("ts").try_cast("timestamp").isNotNull(),
        "ttl_min": whole("ttl_min") & F.coalesce(number("ttl_min") >= 1, F.lit(False)),
    }
    keys = CONTRACTS[contract]
    found = [F.when(field(k).isNull(), f"missing_{k}") for k in keys] + [F.when(field(k).isNotNull() & ~ok[k], f"bad_{k}") for k in keys if k in ok]
    return F.when(m.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*found)))


def symbol_list(lines: DataFrame, *others: DataFrame, quote: str = "USDT") -> DataFrame:
    """(symbol): the trimmed lines (value) that end with ``quote``; if there are none, the first of ``others`` (symbol) that has rows."""
    found = lines.select(F.trim("value").alias("symbol")).filter(F.col("symbol").endswith(quote)).distinct()
    for other in others:
        if not found.isEmpty():
            break
        found = other.select("symbol").distinct()
    return found
