from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quotes as qf
from tidemark.operators import outcomes as oc
from tidemark.operators import universe as un

LISTED = "symbol string, base_asset string, quote_asset string, status string, contract_type string"


def listing(symbol, status="TRADING", quote="USDT", contract="PERPETUAL"):
    return (symbol, symbol.removesuffix(quote), quote, status, contract)


def test_first_reason_against_each_symbol(spark):
    want = {"BTCUPUSDT": "leveraged", "USDCUSDT": "pegged", "AUSDT": "no_ticker", "BUSDT": "low_volume", "CUSDT": "low_trades", "DÉUSDT": "not_ascii", "EUSDT": "accepted", "FUSDT": "no_ticker", "JUPUSDT": "leveraged"}
    df = spark.createDataFrame([*map(listing, want), listing("GUSDT", "BREAK"), listing("HEUR", quote="EUR"), (None, None, None, None, None)], LISTED)
    t = spark.createDataFrame([("BUSDT", "199999.99", 500), ("CUSDT", "200000", 499), ("DÉUSDT", "1e9", 9999), ("EUSDT", "200000", 500), ("FUSDT", "many", 500), ("BTCUPUSDT", "1e9", 9999)], "symbol string, quote_volume string, trade_count int")
    assert {r.symbol: r.reason for r in un.judged(df, t).collect()} == want
    assert [r.symbol for r in un.coverage_universe(df, t).collect()] == ["EUSDT"]
    assert {r.reason: r.n for r in un.universe_funnel(df, t).collect()}["no_ticker"] == 2
    assert un.judged(df.limit(0), t).collect() == []


def test_sets_of_symbols(spark):
    usd = spark.createDataFrame([listing("AUSDT"), listing("BUSDT", "BREAK"), listing("CUSDT", contract="QUARTER")], LISTED)
    coin = spark.createDataFrame([("AUSD_PERP", "A", "USD", "TRADING", "PERPETUAL"), ("DUSD_PERP", "D", "USD", "TRADING", "PERPETUAL"), ("X", "", "USD", "TRADING", "PERPETUAL")], LISTED)
    assert {r.symbol for r in un.perp_union(usd, coin).collect()} == {"AUSDT", "DUSDT"}
    body = spark.createDataFrame([('{"symbols":[{"symbol":"AUSDT","quoteAsset":"USDT","status":"TRADING"},{"symbol":"BEUR","quoteAsset":"EUR","status":"TRADING"}]}',), ("{broken",), (None,)], "body string")
    assert [r.symbol for r in un.listed(body).collect()] == ["AUSDT"]
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, x int")
    assert un.universe_semi_join(rows, rows.filter("false")).count() == 2
    assert [tuple(r) for r in un.universe_semi_join(rows, rows.filter("x = 2")).collect()] == [("B", 2)]


def test_market_caps(spark):
    s = spark.createDataFrame([listing(x) for x in ("AUSDT", "BUSDT", "CUSDT", "DUSDT")], LISTED)
    coins = spark.createDataFrame([("a1", "A", 5.0), ("a2", "a", 9.0), ("a3", "a", None), ("b", "b", None), ("d", "d", 99.0)], "coin_id string, ticker string, market_cap double")
    caps = un.mcap_best_match(s, coins)
    assert {r.symbol: r.market_cap for r in caps.collect()} == {"AUSDT": 9.0, "DUSDT": 99.0}
    t = spark.createDataFrame([("AUSDT", 10.0), ("BUSDT", 20.0), ("CUSDT", 20.1), ("DUSDT", 15.0)], "symbol string, quote_volume double")
    found = un.trading_universe(s, t, caps, low=10.0, high=20.0, most_cap=50.0)
    assert {r.symbol for r in found.collect()} == {"AUSDT", "BUSDT"}  # both ends of the range, an unknown cap, no large one
    assert {r.symbol for r in un.trading_universe(s, t, caps, low=10.0, high=20.0, most_cap=50.0, without=s.filter("symbol = 'AUSDT'")).collect()} == {"BUSDT"}


def test_each_side_falls_back_by_itself(spark):
    jobs = spark.createDataFrame([("j1", "a", 1000, 10.0), ("j2", "a", 3000, 10.0), ("j3", "b", 1000, 10.0), ("j4", "a", 2000, 0.0)], "job_id string, symbol string, due_us long, start_price double")
    ticks = spark.createDataFrame([(1, "a", 900, 11.0), (2, "a", 1000, 12.0), (3, "a", 1999, 5.0)], "tick_id long, symbol string, us long, price double")
    bars = spark.createDataFrame([("a", 3000, 20.0), ("a", 2900, 19.0)], "symbol string, open_us long, c double")
    got = {r.job_id: r for r in oc.resolved(jobs, ticks, bars, back_us=100, forward_us=50).collect()}
    assert [(got[j].asof_source, got[j].asof_price, got[j].next_source, got[j].next_price) for j in ("j1", "j2", "j3")] == [("ticks", 12.0, "ticks", 12.0), ("bars", 20.0, "bars", 20.0), ("none", None, "none", None)]
    assert (got["j1"].asof_pct, got["j1"].asof_lag_us, got["j3"].asof_status, got["j4"].asof_pct, got["j4"].next_status) == (20.0, 0, "error", None, "error")
    closed = {r.job_id: r.asof_price for r in oc.resolved(jobs, ticks, bars, back_us=100, forward_us=50, strict_us=100).collect()}
    assert closed["j2"] == 19.0


def test_status_of_signals(spark):
    sides = {"pending": [("pending", "done")], "partial": [("done", "done"), ("pending", "pending")], "error": [("error", "error")] * 2, "done_no_data": [("done", "error"), ("error", "error")], "done": [("done", "done"), ("error", "error")]}
    rows = [(k, a, b, "ticks", s) for k, v in sides.items() for (a, b), s in zip(v, ("bars", None), strict=False)]
    got = {r.signal_id: r for r in oc.signal_rollup(spark.createDataFrame(rows, "signal_id string, asof_status string, next_status string, asof_source string, next_source string")).collect()}
    assert {k: r.status for k, r in got.items()} == {k: k for k in sides} and got["done"].n_mixed == 1


def test_hours(spark):
    rows = [(h, datetime(2024, 1, 1, h)) for h in range(24)]
    got = {r.h: r for r in spark.createDataFrame(rows, "h int, ts timestamp").select("h", *(c.alias(n) for c, n in zip(qf.time_gate(F.col("ts")), "abcd", strict=True))).collect()}
    assert [h for h in range(24) if got[h].c] == [3, 4, 5, 6, 7, 8, 9, 10, 11]  # 23 to 7 where the operator is
    assert (got[14].a, got[13].a, got[18].a, got[22].a, got[23].a, got[0].b, got[11].d, got[12].d) == ("aggressive", "normal", "caution", "pause", "low_activity", "awake", "operator_sleep", "allowed_window")


@pytest.mark.parametrize(
    ("row", "want"),
    [(("A", 1.0, "alert", "sent", None), None), ((" ", 1.0, "alert", "sent", None), "symbol"), ((None, 1.0, "alert", "sent", None), "symbol"), (("A", 0.0, "alert", "sent", None), "price_alert"), (("A", float("nan"), "alert", "sent", None), "price_alert"), (("A", 1.0, None, "sent", None), "signal_kind"),
     (("A", 1.0, "alert", "x", None), "decision"), (("A", 1.0, "near_miss", "sent", None), "sent_needs_alert"), (("A", 1.0, "near_miss", "blocked", None), "blocked_needs_reason"), (("A", 1.0, "near_miss", "blocked", "r"), None), (("A", 1.0, "alert", "blocked", "r"), "alert_blocked")],
)
def test_contract_of_signals(spark, row, want):
    df = spark.createDataFrame([row], "s string, p double, k string, d string, r string")
    assert df.select(qf.signal_contract(*map(F.col, "spkdr"))).first()[0] == want
