"""Queries of rolling facts, gates, rules and streams over the market views, with the SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quotes as qf
from ..functions import records as rc
from ..operators import dataset as ds
from ..operators import rules as rl
from ..operators import windows as wn
from ..operators.cooldown import cooldown_filter as keep_distance
from ..operators.labels import HOUR
from ..operators.stage import kept_only
from ..sources import market
from ..streaming import jobs
from .labels import rounded

D6 = "6 hours"


def latest_per_symbol(s, d):
    return rounded(wn.latest_per_symbol(market.ticks(s, d)))


def latest_of_active(s, d):
    """Newest ticks of symbols that are not silent; half an hour stands for the ten seconds of a live feed."""
    t = market.ticks(s, d)
    now = t.agg(F.max("us")).first()[0] or 0
    return rounded(wn.latest_per_symbol(t, now, HOUR // 2))


def price_delta_pct(s, d):
    return rounded(wn.price_delta_pct(market.ticks(s, d)))


def rolling_returns(s, d):
    return rounded(wn.rolling_returns(market.ticks(s, d), {f"ret_{h}": h * HOUR for h in (1, 5, 15, 60)}))


def rolling_zscore(s, d):
    return rounded(wn.rolling_zscore(market.ticks(s, d), 60 * HOUR))


def trade_flow(s, d):
    return rounded(wn.trade_flow(market.trades(s, d), 6 * HOUR))


def bars_15m(s, d):
    return rounded(wn.bars(market.ticks(s, d), "15 minutes"))


def rule_pump_dump(s, d):
    pump, dump = {"delta_pct": 2.0, "vol_mult": 1.0, "min_notional": 1000.0}, {"delta_pct": -3.0, "vol_mult": 0.8, "min_notional": 4000.0}
    return rounded(rl.rule_pump_dump(wn.bars(market.ticks(s, d), D6), pump, dump), 3)


def grid_asof(s, d):
    return rounded(wn.grid_asof(market.ticks(s, d), HOUR, 6 * HOUR))


def state_transitions(s, d):
    return wn.state_transitions(market.ticks(s, d), F.when(F.col("bid").isNull(), F.lit(None)).when(F.col("price") >= 105, "hot").otherwise("cold"))


def volume_percentile(s, d):
    return rounded(wn.volume_percentile(market.trades(s, d).withColumn("v", F.col("price") * F.col("qty")), "v", 30))


def top_movers(s, d):
    """The five largest moves; a tick's quantities stand for the volumes of the day, some of which are null or zero."""
    t = market.ticks(s, d)
    volume = F.when(F.col("k") % 11 != 0, (F.col("ask_qty") - 1) * 10_000)
    told = wn.price_delta_pct(t).join(t.select("tick_id", volume.alias("vol_24h"), (F.col("bid_qty") * 5_000).alias("buy_vol")), "tick_id")
    return rounded(wn.top_movers(told))


def book_imbalance(s, d):
    return rounded(market.ticks(s, d).select("tick_id", qf.book_imbalance(F.col("bid_qty"), F.col("ask_qty")).alias("imbalance")))


def relative_volume(s, d):
    now, day = F.when(F.col("k") % 6 != 0, F.col("bid_qty") * 10), F.when(F.col("k") % 7 != 0, F.col("ask_qty") * 20000)
    rel, reason = qf.relative_volume(now, day)
    return rounded(market.ticks(s, d).select("tick_id", rel.alias("rel"), reason.alias("reason")))


def entry_gate(s, d):
    stage, reason = qf.entry_gate(F.col("price"), F.when(F.col("k") % 9 != 0, F.col("price") * (1 + (F.col("k") % 90) / 1000.0)).otherwise(0.0))
    return rounded(market.ticks(s, d).select("tick_id", stage.alias("stage_pct"), reason.alias("reason")), 3)


def outcome_pct(s, d):
    return rounded(market.ticks(s, d).select("tick_id", qf.outcome_pct(F.col("ask"), F.col("bid")).alias("pct")))


def feature_quality_mask(s, d):
    """The mask of all features, each of which some ticks lack."""
    lacking = {c: F.when(F.col("tick_id") % (7 + 2 * i) != i, F.lit(1.0)).alias(c) for i, c in enumerate((*qf.CRITICAL, *qf.OPTIONAL))}
    mask, missing, degraded = qf.feature_quality()
    f = market.ticks(s, d).select("tick_id", *lacking.values()).withColumns({"mask": mask, "missing": missing, "is_degraded": degraded})
    return f.select("tick_id", F.array_join(F.array_sort(F.transform(F.map_entries("mask"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("mask"), "missing", "is_degraded")


def signal_expand(s, d):
    c = market.candidates(s, d).withColumn("horizon_min", F.explode(F.array(*map(F.lit, (5, 15, 30, 60, 120)))))
    return c.select("event_id", "horizon_min", (F.col("us") + F.col("horizon_min").cast("long") * 60_000_000).alias("due_us"), F.lit("pending").alias("status"))


def event_id_hash(s, d):
    """Ids of all ticks taken as candidates; some have no trigger, some confirm on a whole second."""
    t = market.ticks(s, d)
    confirm = F.when(F.col("k") % 7 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    config = rc.config_hash(F.create_map(F.lit("k"), (F.col("k") % 3).cast("string")))
    return t.select("tick_id", qf.candidate_id(F.col("symbol"), F.when(F.col("k") % 5 != 0, F.col("ts")), confirm, F.lit("v1"), config).alias("hash"))


def attempt_sequence(s, d):
    """Attempts to label a user's events: the older half of the table is stored, the others are numbered on."""
    e = market.events(s, d).withColumn("owner", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    half = F.lit((e.agg(F.max("event_id")).first()[0] or 0) // 2)
    stored = e.filter(F.col("event_id") < half).groupBy(F.col("owner").alias("event_id")).agg(F.count(F.lit(1)).alias("attempt_n"))
    word = lambda n, x: F.when(F.col("k") % n == 0, F.concat(F.lit(x), F.repeat(F.lit("x"), F.col("k") * 7)))
    new = e.filter(F.col("event_id") >= half).select(
        F.col("owner").alias("event_id"), F.col("us").alias("started_us"), (F.col("us") + (F.col("k") - 10) * 100_000).alias("finished_us"), F.when(F.col("k") % 4 == 0, "ok").when(F.col("k") % 4 == 1, "bad").otherwise("who_knows").alias("result_quality"), word(2, "E").alias("error_class"), word(3, "m").alias("error_message")
    )
    return ds.numbered_attempts(new, stored)


def cooldown_filter(s, d):
    hot = market.ticks(s, d).filter("price >= 101").select("tick_id", "symbol", "us")
    return keep_distance(hot, ["symbol"], 12 * HOUR, block_us=60 * HOUR)


def ema(s, d):
    return rounded(wn.ema(market.ticks(s, d), "price", (20, 50)))


def rule_breakout(s, d):
    up, down = {"buffer_pct": 0.2, "vol_mult": 1.0, "ema_confirm": 1.0, "min_notional": 500.0}, {"buffer_pct": 0.0, "vol_mult": 0.5, "ema_confirm": 0.0, "min_notional": 300.0}
    return rounded(rl.rule_breakout(wn.bars(market.ticks(s, d), "1 hour"), up, down), 4)


def rule_ema_cross(s, d):
    return rounded(rl.rule_ema_cross(wn.bars(market.ticks(s, d), D6), {"vol_mult": 1.0, "min_notional": 2000.0}, rl.RuleParams(fast=9, slow=21)), 4)


#: Widths of bars that stand for the time frames: ticks are far apart here, and so is the notional of a bar.
FRAMES = {"15m": ("1 hour", HOUR), "30m": ("3 hours", 3 * HOUR), "1h": ("6 hours", 6 * HOUR)}
SCAN = rl.RuleParams().with_notional(0.01)


def _framed(s, d):
    t = market.ticks(s, d)
    return reduce(DataFrame.unionByName, (wn.bars(t, width).withColumn("timeframe", F.lit(f)) for f, (width, _) in FRAMES.items()))


def rule_scan(s, d):
    return rounded(rl.rule_scan(_framed(s, d), rl.params_overlay(s, SCAN), SCAN).select("timeframe", "symbol", "open_us", "rule", "price", "notional"), 4)


def params_overlay(s, d):
    """The thresholds that each bar of each time frame is held against."""
    p, bars = F.col("params"), _framed(s, d)
    names = ("pump.delta_pct", "dump.delta_pct", "bo_up.vol_mult", "bo_dn.buffer_pct", "cross.min_notional", "frame.late_filter_pct")
    return bars.join(rl.params_overlay(s, SCAN), "timeframe").groupBy("timeframe", "symbol").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.element_at(p, F.lit(n))).alias(n.replace(".", "_")) for n in names))


def bar_notional(s, d):
    return rounded(rl.bar_notional(wn.bars(market.ticks(s, d), D6), F.lit(5.0)).select("symbol", "open_us", "notional", "pct"))


def alert_format(s, d):
    t = market.ticks(s, d)
    extras = F.to_json(F.struct(F.col("k").alias("k"), (F.col("k") % 3 == 0).alias("early")))
    price = F.when(F.col("k") % 4 == 0, F.col("price") * 10000).when(F.col("k") % 4 == 1, F.col("k") / 1000000.0).otherwise(F.col("price"))
    return t.select("tick_id", rl.alert_format("TS", F.when(F.col("k") % 2 == 0, "pump").otherwise("dump"), F.col("symbol"), F.lit("15m"), price, extras).alias("line"))


def rolling_rv_range(s, d):
    return rounded(wn.rolling_rv_range(market.ticks(s, d), 6 * HOUR, 15 * HOUR, 60 * HOUR))


def stream_bars(s, d):
    return rounded(jobs.run_available(jobs.stream_bars(jobs.event_stream(s, d), D6, "1 hour")))


def stream_trade_flow(s, d):
    return rounded(jobs.run_available(jobs.stream_trade_flow(jobs.event_stream(s, d), "12 hours", D6, "1 hour")))


def candidate_sessions(s, d):
    return rounded(jobs.run_available(jobs.candidate_sessions(jobs.event_stream(s, d).filter("event_id % 20 = 3"), D6, "1 hour")))


_OVER = "OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {0} PRECEDING AND CURRENT ROW)"
_BAR = "SELECT symbol, us // {w} * {w} AS open_us, arg_min(price, us) AS o, max(price) AS h, min(price) AS l, arg_max(price, us) AS c, sum(bid_qty) AS v, avg(price) AS avg_price FROM ticks GROUP BY ALL"
_DELTA = "SELECT tick_id, symbol, us, price, (price - lag(price) OVER w) / lag(price) OVER w * 100 AS delta_pct FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY us, tick_id)"
_RET = ", ".join(f"round(CASE WHEN count(*) {_OVER.format(h * HOUR)} >= 2 THEN (price - first(price) {_OVER.format(h * HOUR)}) / first(price) {_OVER.format(h * HOUR)} END, 6) AS ret_{h}" for h in (1, 5, 15, 60))
_Z = _OVER.format(60 * HOUR)
_F = _OVER.format(6 * HOUR)
_M = _OVER.format(15 * HOUR)
_RV = "list_aggregate((list(ret) {0})[2:], 'stddev_samp')"
# a window is out once the last event less the delay has passed its end
_OUT = f"(SELECT max(us) - {HOUR} FROM ev)"
_ORDER = "(PARTITION BY symbol ORDER BY us, tick_id)"

ORACLES = {
    "latest_per_symbol": "SELECT symbol, arg_max(tick_id, us) AS tick_id, max(us) AS us, round(arg_max(price, us), 6) AS price FROM ticks GROUP BY ALL",
    "latest_of_active": "SELECT symbol, arg_max(tick_id, us) AS tick_id, max(us) AS us, round(arg_max(price, us), 6) AS price FROM ticks WHERE us >= (SELECT max(us) FROM ticks) - 1800000000 GROUP BY ALL",
    "price_delta_pct": f"SELECT tick_id, symbol, us, round(price, 6) AS price, round(delta_pct, 6) AS delta_pct FROM ({_DELTA})",
    "rolling_returns": f"SELECT tick_id, {_RET} FROM ticks",
    "rolling_zscore": f"""SELECT tick_id, round(z, 6) AS z, round(tanh(greatest(-3, least(3, z))) + CASE WHEN z IS NULL THEN NULL ELSE 0 END, 6) AS norm FROM (SELECT tick_id, CASE WHEN count(price) {_Z} >= 30 AND stddev_samp(price) {_Z} >= 1e-9 THEN (price - avg(price) {_Z}) / stddev_samp(price) {_Z} END AS z FROM ticks)""",
    "trade_flow": f"SELECT trade_id, symbol, count(*) {_F} AS n_trades, round(sum(price * qty) {_F}, 6) AS quote_vol, round(sum(CASE WHEN is_buyer_maker THEN -price * qty ELSE price * qty END) {_F}, 6) AS flow, round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) {_F} / sum(qty) {_F}, 6) AS buy_ratio, round(list_aggregate((list(gap) {_F})[2:], 'median'), 6) AS gap_ms, round(count(*) {_F} / 21600, 6) AS rate, round(count(*) {_OVER.format(12 * HOUR)} / 43200, 6) AS intensity FROM (SELECT *, (us - lag(us) OVER (PARTITION BY symbol ORDER BY us, trade_id)) / 1000.0 AS gap FROM trades)",
    "bars_15m": f"SELECT symbol, open_us, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v, round(avg_price, 6) AS avg_price FROM ({_BAR.format(w=HOUR // 4)})",
    "rule_pump_dump": f"""SELECT symbol, open_us, round(pct, 3) AS pct, CASE WHEN up THEN 'pump' ELSE 'dump' END AS rule, round(notional, 3) AS notional FROM (
        SELECT *, pct >= 2 AND v >= m AND notional >= 1000 AS up, pct <= -3 AND v >= 0.8 * m AND notional >= 4000 AS down FROM (SELECT *, (c - o) / o * 100 AS pct, v * (h + l + c) / 3 AS notional, CASE WHEN med = 0 THEN 1 ELSE med END AS m FROM b)) WHERE rn >= 37 AND (up OR down)""",
    "grid_asof": f"""SELECT symbol, tick_id, round(price, 6) AS price, grid_us, (grid_us - us) / 1000.0 AS age_ms FROM (SELECT g.symbol, grid_us, t.tick_id, t.price, t.us FROM (SELECT symbol, unnest(range(min(us) // {HOUR} * {HOUR}, max(us) + 1, {HOUR})) AS grid_us FROM ticks GROUP BY symbol) g
        ASOF JOIN ticks t ON t.symbol = g.symbol AND t.us <= g.grid_us) WHERE grid_us - us <= {6 * HOUR}""",
    "state_transitions": f"""SELECT symbol, tick_id, state, prev FROM (SELECT *, lag(state) OVER {_ORDER} AS prev, row_number() OVER {_ORDER} AS rn FROM (SELECT *, CASE WHEN bid IS NULL THEN NULL WHEN price >= 105 THEN 'hot' ELSE 'cold' END AS state FROM ticks)) WHERE rn = 1 OR state IS DISTINCT FROM prev""",
    "volume_percentile": "SELECT round(v, 6) AS cutoff, n FROM (SELECT price * qty AS v, row_number() OVER (ORDER BY price * qty) AS r, count(*) OVER () AS n FROM trades) WHERE r = greatest(1, floor(n * 30 / 100))",
    "top_movers": f"""SELECT tick_id, symbol, round(delta_pct, 6) AS delta_pct, round(ratio, 6) AS buy_ratio, CASE WHEN delta_pct > 0 THEN 'PUMP' ELSE 'DUMP' END AS side FROM (
        SELECT *, CASE WHEN vol > 0 THEN buy / vol ELSE 0.5 END AS ratio FROM ({_DELTA}) JOIN (SELECT tick_id, CASE WHEN k % 11 != 0 THEN (ask_qty - 1) * 10000 ELSE 0 END AS vol, bid_qty * 5000 AS buy FROM ticks) USING (tick_id))
      WHERE vol >= 50000 AND abs(delta_pct) >= 0.3 AND ratio >= 0.55 ORDER BY abs(delta_pct) DESC, tick_id LIMIT 5""",
    "book_imbalance": "SELECT tick_id, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 6) AS imbalance FROM ticks",
    "relative_volume": "SELECT tick_id, CASE WHEN now IS NOT NULL AND day IS NOT NULL THEN round(now / (day / 2880), 6) END AS rel, CASE WHEN now IS NULL THEN 'no_vol_now' WHEN day IS NULL THEN 'no_base' WHEN now / (day / 2880) < 1 THEN 'low_rel_volume' ELSE 'ok' END AS reason FROM (SELECT tick_id, CASE WHEN k % 6 != 0 THEN bid_qty * 10 END AS now, CASE WHEN k % 7 != 0 THEN ask_qty * 20000 END AS day FROM ticks)",
    "entry_gate": "SELECT tick_id, CASE WHEN k % 9 != 0 THEN round((price * (1 + (k % 90) / 1000.0::DOUBLE) - price) / price * 100, 3) END AS stage_pct, CASE WHEN k % 9 = 0 THEN 'invalid_confirm_price' WHEN round((price * (1 + (k % 90) / 1000.0::DOUBLE) - price) / price * 100, 3) > 4 THEN 'late_entry' END AS reason FROM ticks",
    "outcome_pct": "SELECT tick_id, round((ask - bid) / bid * 100, 6) AS pct FROM ticks",
    "feature_quality_mask": "SELECT tick_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN tick_id % {7 + 2 * i} = {i} THEN '{c}=missing_{'critical' if i < 3 else 'optional'}' END" for i, c in enumerate((*qf.CRITICAL, *qf.OPTIONAL))) + "], lambda x: x IS NOT NULL)), ',') AS mask, "
    + " + ".join(f"(tick_id % {7 + 2 * i} = {i})::INT" for i in range(11)) + " AS missing, tick_id % 7 = 0 OR tick_id % 9 = 1 OR tick_id % 11 = 2 AS is_degraded FROM ticks",
    "signal_expand": "SELECT event_id, h AS horizon_min, us + h * 60000000::BIGINT AS due_us, 'pending' AS status FROM candidates, (VALUES (5), (15), (30), (60), (120)) v(h)",
    "event_id_hash": """SELECT tick_id, 'ev_' || substr(sha256(symbol || '|' || CASE WHEN k % 5 != 0 THEN iso ELSE 'none' END || '|' || CASE WHEN k % 7 = 0 OR us % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE iso END || '|v1|' || substr(sha256('{"k": ' || k % 3 || '}'), 1, 16)), 1, 32) AS hash
        FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 > 0 THEN '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso FROM ticks)""",
    "attempt_sequence": """SELECT e.event_id, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY e.event_id ORDER BY us, id) AS INT) AS attempt_n, us AS started_us, greatest(0, (k - 10) * 100)::BIGINT AS duration_ms, CASE k % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad' END AS result_quality,
        CASE WHEN k % 2 = 0 THEN CASE WHEN k * 7 + 1 > 100 THEN 'E' || repeat('x', 96) || '...' ELSE 'E' || repeat('x', k * 7) END END AS error_class,
        CASE WHEN k % 3 = 0 THEN CASE WHEN k * 7 + 1 > 500 THEN 'm' || repeat('x', 496) || '...' ELSE 'm' || repeat('x', k * 7) END END AS error_message
      FROM (SELECT 'u' || user_id AS event_id, event_id AS id, us, k FROM ev WHERE event_id >= (SELECT max(event_id) // 2 FROM ev)) e LEFT JOIN (SELECT 'u' || user_id AS event_id, count(*) AS n FROM ev WHERE event_id < (SELECT max(event_id) // 2 FROM ev) GROUP BY ALL) USING (event_id)""",
    "cooldown_filter": f"""SELECT tick_id, symbol, us FROM c""",
    "ema": """SELECT tick_id, symbol, round(e1, 6) AS ema20, round(e2, 6) AS ema50 FROM (SELECT symbol, unnest(list(tick_id ORDER BY us, tick_id)) AS tick_id, unnest(list(price ORDER BY us, tick_id)) AS price, unnest(range(1, count(*) + 1)) AS rn FROM ticks GROUP BY symbol) JOIN e USING (symbol, rn)""",
    "rule_breakout": """SELECT symbol, open_us, rule, round(CASE WHEN rule = 'bo_up' THEN hi ELSE lo END, 4) AS level, round(e1, 4) AS ema FROM (SELECT *,
        CASE WHEN c > hi * 1.002::DOUBLE AND c > e1 AND v >= m AND notional >= 500 THEN 'bo_up' WHEN c < lo AND v >= 0.5 * m AND notional >= 300 THEN 'bo_dn' END AS rule
        FROM (SELECT *, CASE WHEN med = 0 THEN 1 ELSE med END AS m, v * (h + l + c) / 3 AS notional FROM b JOIN e USING (symbol, rn))) WHERE rn >= 37 AND rule IS NOT NULL""",
    "rule_ema_cross": f"""SELECT symbol, open_us, rule, round(e1, 4) AS ema_fast, round(e2, 4) AS ema_slow FROM (SELECT *, CASE WHEN before <= 0 AND e1 > e2 THEN 'cross_up' WHEN before >= 0 AND e1 < e2 THEN 'cross_dn' END AS rule
        FROM (SELECT *, lag(e1 - e2) OVER (PARTITION BY symbol ORDER BY rn) AS before FROM b JOIN e USING (symbol, rn))) WHERE rn >= 37 AND rule IS NOT NULL AND v >= CASE WHEN med = 0 THEN 1 ELSE med END AND v * (h + l + c) / 3 >= 2000""",
    "rule_scan": """SELECT timeframe, symbol, open_us, unnest(list_filter([
          CASE WHEN pct >= pump AND v >= pump_v * m AND notional >= pump_n THEN 'pump' END, CASE WHEN pct <= -pump AND v >= pump_v * m AND notional >= pump_n THEN 'dump' END,
          CASE WHEN c > hi * 1.002::DOUBLE AND c > e1 AND v >= bo_v * m AND notional >= bo_n THEN 'bo_up' END, CASE WHEN c < lo * 0.998::DOUBLE AND c < e1 AND v >= bo_v * m AND notional >= bo_n THEN 'bo_dn' END,
          CASE WHEN before <= 0 AND e2 > e1 AND v >= cr_v * m AND notional >= cr_n THEN 'cross_up' END, CASE WHEN before >= 0 AND e2 < e1 AND v >= cr_v * m AND notional >= cr_n THEN 'cross_dn' END,
          CASE WHEN early AND pct >= 2.5 AND v >= 1.8 * m AND notional >= 500 THEN 'pump_early' END, CASE WHEN early AND c > hi * 1.002::DOUBLE AND c > e1 AND v >= 1.8 * m AND notional >= 500 THEN 'bo_up_early' END], lambda x: x IS NOT NULL)) AS rule,
        round(c, 4) AS price, round(notional, 4) AS notional
      FROM (SELECT *, (c - o) / o * 100 AS pct, v * (h + l + c) / 3 AS notional, CASE WHEN med = 0 THEN 1 ELSE med END AS m, lag(e2 - e1) OVER (PARTITION BY timeframe, symbol ORDER BY rn) AS before FROM b JOIN e USING (timeframe, symbol, rn))
      JOIN (VALUES ('15m', 1.4, 2.6, 800, 2.2, 1200, 2.0, 1000, true, NULL), ('30m', 2.2, 2.2, 1200, 2.0, 1500, 1.8, 1500, true, NULL), ('1h', 3.2, 2.0, 1500, 1.8, 2000, 2.0, 1000, false, 5.0)) p(timeframe, pump, pump_v, pump_n, bo_v, bo_n, cr_v, cr_n, early, late) USING (timeframe)
      WHERE rn >= 37 AND (late IS NULL OR abs(pct) < late)""",
    "params_overlay": f"""SELECT b.timeframe, symbol, count(*) AS n, any_value(a) AS pump_delta_pct, any_value(-a) AS dump_delta_pct, any_value(v) AS bo_up_vol_mult, 0.2::DOUBLE AS bo_dn_buffer_pct, any_value(x) AS cross_min_notional, any_value(z) AS frame_late_filter_pct
      FROM (SELECT '15m' AS timeframe, symbol, us // {HOUR} AS w FROM ticks UNION SELECT '30m', symbol, us // {3 * HOUR} FROM ticks UNION SELECT '1h', symbol, us // {6 * HOUR} FROM ticks) b
      JOIN (VALUES ('15m', 1.4::DOUBLE, 2.2::DOUBLE, 1000::DOUBLE, NULL::DOUBLE), ('30m', 2.2, 2.0, 1500, NULL), ('1h', 3.2, 1.8, 1000, 5.0)) p(timeframe, a, v, x, z) ON p.timeframe = b.timeframe GROUP BY b.timeframe, symbol""",
    "bar_notional": f"SELECT symbol, open_us, round(v * (h + l + c) / 3, 6) AS notional, round((c - o) / o * 100, 6) AS pct FROM ({_BAR.format(w=6 * HOUR)}) WHERE abs((c - o) / o * 100) < 5",
    "alert_format": """SELECT tick_id, '[TS] ' || CASE WHEN k % 2 = 0 THEN 'PUMP' ELSE 'DUMP' END || ' | ' || symbol || ' 15m @ ' || printf('%.6g', CASE WHEN k % 4 = 0 THEN price * 10000 WHEN k % 4 = 1 THEN k / 1000000.0::DOUBLE ELSE price END) || ' | {"k":' || k || ',"early":' || CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END || '}' AS line FROM ticks""",
    "rolling_rv_range": f"""SELECT tick_id, round(a, 6) AS rv_short, round(b, 6) AS rv_mid, round(c, 6) AS rv_long, round(r, 6) AS price_range, round(CASE WHEN c > 0 THEN a / c END, 6) AS rv_ratio FROM (SELECT tick_id, {_RV.format(_F)} AS a, {_RV.format(_M)} AS b, {_RV.format(_Z)} AS c, CASE WHEN count(*) {_M} >= 2 THEN max(price) {_M} - min(price) {_M} END AS r
        FROM (SELECT *, CASE WHEN price > 0 AND lag(price) OVER {_ORDER} > 0 THEN ln(price / lag(price) OVER {_ORDER}) END AS ret FROM ticks))""",
    "stream_bars": f"SELECT symbol, open_us, round(avg(price), 6) AS avg_price, count(*) AS n FROM (SELECT *, us // {6 * HOUR} * {6 * HOUR} AS open_us FROM ticks) WHERE open_us + {6 * HOUR} <= {_OUT} GROUP BY ALL",
    "stream_trade_flow": f"SELECT symbol, open_us, count(*) AS n, round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) / sum(qty), 6) AS buy_ratio, count(*) >= 3 AND sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) / sum(qty) >= 0.55 AS confirmed FROM (SELECT *, unnest([us // {6 * HOUR} * {6 * HOUR}, us // {6 * HOUR} * {6 * HOUR} - {6 * HOUR}]) AS open_us FROM trades) WHERE open_us + {12 * HOUR} <= {_OUT} GROUP BY ALL",
    "candidate_sessions": f"""SELECT symbol, min(us) AS open_us, max(us) + {6 * HOUR} AS close_us, round(arg_min(price, us), 6) AS first_price, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY us) AS sid FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY symbol ORDER BY us) < {6 * HOUR} THEN 0 ELSE 1 END AS opens FROM ticks WHERE tick_id % 20 = 3))
        GROUP BY symbol, sid HAVING max(us) + {6 * HOUR} <= (SELECT max(us) - {HOUR} FROM ticks WHERE tick_id % 20 = 3)""",
}
_COOL = f"""WITH RECURSIVE {market.SQL}, hot AS (SELECT tick_id, symbol, us FROM ticks WHERE price >= 101),
c AS (SELECT * FROM hot QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY us, tick_id) = 1
  UNION ALL SELECT h.* FROM c, LATERAL (SELECT * FROM hot WHERE hot.symbol = c.symbol AND hot.us >= c.us + {12 * HOUR} ORDER BY us, tick_id LIMIT 1) h) """


def _averaged(width: int, first: int, second: int) -> str:
    """Numbered bars ``b`` and their recursive averages ``e``."""
    over = "OVER (PARTITION BY symbol ORDER BY open_us {})"
    step = ", ".join(f"e{i} + (b.c - e{i}) * 2 / {n + 1}::DOUBLE" for i, n in ((1, first), (2, second)))
    return f"""WITH RECURSIVE {market.SQL}, b AS (SELECT *, row_number() {over.format("")} AS rn, quantile_cont(v, 0.5) {over.format("ROWS BETWEEN 19 PRECEDING AND CURRENT ROW")} AS med, max(h) {over.format("ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING")} AS hi, min(l) {over.format("ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING")} AS lo
  FROM ({_BAR.format(w=width)})),
e AS (SELECT symbol, rn, c AS e1, c AS e2 FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {step} FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1) """


def _framed_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{f}' AS timeframe, * FROM ({_BAR.format(w=w)})" for f, (_, w) in FRAMES.items())
    over = "OVER (PARTITION BY timeframe, symbol ORDER BY open_us {})"
    return f"""WITH RECURSIVE {market.SQL}, b AS (SELECT *, row_number() {over.format("")} AS rn, quantile_cont(v, 0.5) {over.format("ROWS BETWEEN 19 PRECEDING AND CURRENT ROW")} AS med, max(h) {over.format("ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING")} AS hi, min(l) {over.format("ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING")} AS lo FROM ({rows})),
e AS (SELECT timeframe, symbol, rn, c AS e1, c AS e2 FROM b WHERE rn = 1 UNION ALL SELECT b.timeframe, b.symbol, b.rn, e1 + (b.c - e1) * 2 / 21::DOUBLE, e2 + (b.c - e2) * 2 / 10::DOUBLE FROM e JOIN b ON b.timeframe = e.timeframe AND b.symbol = e.symbol AND b.rn = e.rn + 1) """


_EMA = f"""WITH RECURSIVE {market.SQL}, b AS (SELECT symbol, price AS c, row_number() OVER (PARTITION BY symbol ORDER BY us, tick_id) AS rn FROM ticks),
e AS (SELECT symbol, rn, c AS e1, c AS e2 FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, e1 + (b.c - e1) * 2 / 21::DOUBLE, e2 + (b.c - e2) * 2 / 51::DOUBLE FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1) """
_BEFORE = {"ema": _EMA, "cooldown_filter": _COOL, "rule_pump_dump": _averaged(6 * HOUR, 20, 20), "rule_breakout": _averaged(HOUR, 20, 20), "rule_ema_cross": _averaged(6 * HOUR, 9, 21), "rule_scan": _framed_sql()}


def queries():
    writing = ("volume_percentile", "cooldown_filter", "stream_bars", "stream_trade_flow", "candidate_sessions")
    return {name: kept_only(globals()[name]) if name in writing else globals()[name] for name in ORACLES}


def oracle_sql():
    return {name: _BEFORE.get(name, f"WITH {market.SQL} ") + sql for name, sql in ORACLES.items() if sql}
