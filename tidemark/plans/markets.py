"""Queries of universes, signals, outcomes and moves, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quotes as qf
from ..operators import moves as mv
from ..operators import outcomes as oc
from ..operators import universe as un
from ..operators import windows as wn
from ..operators.labels import HOUR
from ..sources import listings, market
from .labels import rounded

LIMITS = {"least_volume": 1_300_000.0, "least_trades": 25}
DAY = 24 * HOUR
#: A minute of a horizon on the views, whose ticks are far apart.
MINUTE = 12 * HOUR // 60


def instrument_json_explode(s, d):
    return un.listed(listings.listing_messages(s, d))


def perp_union(s, d):
    i = listings.instruments(s, d)
    return un.perp_union(i.filter("venue = 'usd'"), i.filter("venue = 'coin'"))


def coverage_universe(s, d):
    return un.coverage_universe(listings.instruments(s, d), listings.tickers(s, d), **LIMITS)


def universe_funnel(s, d):
    return un.universe_funnel(listings.instruments(s, d), listings.tickers(s, d), **LIMITS)


def mcap_best_match(s, d):
    return un.mcap_best_match(un.trading(listings.instruments(s, d)), listings.coins(s, d))


def trading_universe(s, d):
    i = listings.instruments(s, d)
    return un.trading_universe(i, listings.tickers(s, d), un.mcap_best_match(un.trading(i), listings.coins(s, d)), low=1_200_000.0, high=1_900_000.0, most_cap=2_500_000.0)


def universe_semi_join(s, d):
    return un.universe_semi_join(listings.tickers(s, d), coverage_universe(s, d))


def time_gate(s, d):
    names = ("market_regime", "operator_window", "blocked", "reason")
    return market.events(s, d).select("event_id", *(c.alias(n) for c, n in zip(qf.time_gate(F.col("ts")), names, strict=True)))


def signal_contract(s, d):
    k = F.col("k")
    kind, decision = F.when(k % 11 == 0, "other").when(k % 3 == 0, "near_miss").otherwise("alert"), F.when(k % 13 == 0, "lost").when(k % 4 == 0, "blocked").otherwise("sent")
    broken = qf.signal_contract(F.when(k % 17 == 0, " ").otherwise(F.col("symbol")), F.when(k % 19 == 0, 0.0).otherwise(F.col("bid")), kind, decision, F.when(k % 5 != 0, "late"))
    return market.ticks(s, d).select("tick_id", broken.alias("broken"))


def _jobs(s, d):
    at = market.ticks(s, d).filter("tick_id % 20 = 3").withColumn("horizon_min", F.explode(F.array(*map(F.lit, (5, 15, 30, 60, 120)))))
    return at.select(F.concat_ws("-", "tick_id", "horizon_min").alias("job_id"), F.col("tick_id").alias("signal_id"), "symbol", F.col("price").alias("start_price"), "horizon_min", (F.col("us") + F.col("horizon_min").cast("long") * MINUTE).alias("due_us"), (F.col("k") % 3).alias("attempts"))


def _resolved(s, d):
    t = market.ticks(s, d)
    return oc.resolved(_jobs(s, d), t, wn.bars(t, "1 hour"), back_us=HOUR, forward_us=HOUR // 2)


def source_fallback(s, d):
    return rounded(_resolved(s, d).drop("symbol", "start_price", "attempts", "signal_id"))


def _now(s, d):
    return market.ticks(s, d).agg(F.max("us")).first()[0] or 0


def signal_rollup(s, d):
    later = F.col("due_us") > _now(s, d) - 2 * DAY
    seen = _resolved(s, d)
    return oc.signal_rollup(seen.withColumns({c: F.when(~later, F.col(c)).otherwise("pending") for c in ("asof_status", "next_status")} | {c: F.when(~later, F.col(c)) for c in ("asof_source", "next_source")}))


def outcome_maturation(s, d):
    state, again = oc.job_state(F.col("attempts"), F.when((F.col("asof_status") == "done") & (F.col("next_status") == "done"), "done").otherwise("error"), F.col("due_us"), F.lit(_now(s, d) - 2 * DAY))
    return _resolved(s, d).select("job_id", state.alias("state"), again.alias("next_due_us"))


def due_jobs_topk(s, d):
    return _jobs(s, d).filter(F.col("due_us") <= _now(s, d) - 2 * DAY).orderBy("due_us", "job_id").limit(20).select("job_id", "due_us")


def noise_seed(s, d):
    return rounded(mv.noise_seed(market.ticks(s, d), _now(s, d), 5 * DAY).select("symbol", "n", "seed"))


def downtrend(s, d):
    return wn.downtrend(wn.bars(market.ticks(s, d), "1 hour"), (_now(s, d) - 14 * DAY) // HOUR * HOUR)


def move_state_machine(s, d):
    return rounded(mv.move_states(market.ticks(s, d)))


_REASONS = f"""judged AS (SELECT symbol, quote_volume, trade_count, CASE WHEN regexp_matches(symbol, '(UP|DOWN|BULL|BEAR)USDT$') THEN 'leveraged' WHEN symbol IN ('USDCUSDT', 'DAIUSDT') THEN 'pegged' WHEN quote_volume IS NULL THEN 'no_ticker'
  WHEN quote_volume < {LIMITS["least_volume"]} THEN 'low_volume' WHEN trade_count < {LIMITS["least_trades"]} THEN 'low_trades' WHEN symbol LIKE '%Ñ%' THEN 'not_ascii' ELSE 'accepted' END AS reason
  FROM (SELECT symbol FROM instruments WHERE quote_asset = 'USDT' AND status = 'TRADING') LEFT JOIN tickers USING (symbol)),
caps AS (SELECT symbol, max(market_cap) AS market_cap FROM instruments JOIN coins ON ticker = lower(base_asset) WHERE quote_asset = 'USDT' AND status = 'TRADING' GROUP BY symbol HAVING max(market_cap) > 0)"""
_L = f"WITH {listings.SQL}, {_REASONS} "
_BARS = f"bars AS (SELECT symbol, us // {HOUR} * {HOUR} AS us, arg_max(price, us) AS price FROM ticks GROUP BY symbol, us // {HOUR})"
_JOBS = f"jobs AS (SELECT tick_id || '-' || h AS job_id, tick_id AS signal_id, symbol, price AS start_price, h AS horizon_min, us + h::BIGINT * {MINUTE} AS due_us, k % 3 AS attempts FROM ticks, (VALUES (5), (15), (30), (60), (120)) v(h) WHERE tick_id % 20 = 3)"


def _near(name: str, rows: str, forward: bool) -> str:
    pick, edge, span = ("arg_min", "min", f"due_us AND due_us + {HOUR // 2}") if forward else ("arg_max", "max", f"due_us - {HOUR} AND due_us")
    return f"{name} AS (SELECT job_id, {pick}(t.price, t.us) AS p, abs({edge}(t.us) - any_value(due_us)) AS lag FROM jobs j JOIN {rows} t ON t.symbol = j.symbol AND t.us BETWEEN {span} GROUP BY job_id)"


def _one(side: str, a: str, b: str) -> str:
    return f"coalesce({a}.p, {b}.p) AS {side}_price, round((coalesce({a}.p, {b}.p) - start_price) / start_price * 100, 6) AS {side}_pct, CASE WHEN {a}.p IS NOT NULL THEN 'ticks' WHEN {b}.p IS NOT NULL THEN 'bars' ELSE 'none' END AS {side}_source, CASE WHEN coalesce({a}.p, {b}.p) IS NULL THEN 'error' ELSE 'done' END AS {side}_status, coalesce({a}.lag, {b}.lag) AS {side}_lag_us"


_O = f"""WITH {market.SQL}, {_BARS}, {_JOBS}, {_near("tick_a", "ticks", False)}, {_near("bar_a", "bars", False)}, {_near("tick_n", "ticks", True)}, {_near("bar_n", "bars", True)},
res AS (SELECT jobs.*, {_one("asof", "tick_a", "bar_a")}, {_one("next", "tick_n", "bar_n")} FROM jobs LEFT JOIN tick_a USING (job_id) LEFT JOIN bar_a USING (job_id) LEFT JOIN tick_n USING (job_id) LEFT JOIN bar_n USING (job_id)),
clock AS (SELECT max(us) - {2 * DAY} AS now FROM ticks) """
_HOURS = "CASE " + " ".join(f"WHEN hour(ts) IN {hours} THEN '{name}'" for name, hours in qf.REGIME_HOURS.items()) + " ELSE 'low_activity' END"

ORACLES = {
    "instrument_json_explode": _L + "SELECT DISTINCT symbol FROM instruments WHERE quote_asset = 'USDT' AND status = 'TRADING'",
    "perp_union": _L + "SELECT symbol FROM instruments WHERE venue = 'usd' AND contract_type = 'PERPETUAL' AND status = 'TRADING' UNION SELECT base_asset || 'USDT' FROM instruments WHERE venue = 'coin' AND contract_type = 'PERPETUAL' AND status = 'TRADING'",
    "coverage_universe": _L + "SELECT symbol, quote_volume, trade_count FROM judged WHERE reason = 'accepted'",
    "universe_funnel": _L + "SELECT reason, count(*) AS n FROM judged GROUP BY ALL",
    "mcap_best_match": _L + "SELECT * FROM caps",
    "trading_universe": _L + "SELECT symbol, quote_volume, market_cap FROM instruments JOIN tickers USING (symbol) LEFT JOIN caps USING (symbol) WHERE quote_asset = 'USDT' AND status = 'TRADING' AND quote_volume BETWEEN 1200000 AND 1900000 AND (market_cap IS NULL OR market_cap < 2500000)",
    "universe_semi_join": _L + "SELECT * FROM tickers WHERE symbol IN (SELECT symbol FROM judged WHERE reason = 'accepted')",
    "time_gate": f"SELECT event_id, {_HOURS} AS market_regime, CASE WHEN asleep THEN 'sleep' ELSE 'awake' END AS operator_window, asleep AS blocked, CASE WHEN asleep THEN 'operator_sleep' ELSE 'allowed_window' END AS reason FROM (SELECT *, (hour(ts) + 20) % 24 < 8 OR (hour(ts) + 20) % 24 > 22 AS asleep FROM events)",
    "signal_contract": f"WITH {market.SQL} "
    + """SELECT tick_id, CASE WHEN k % 17 = 0 THEN 'symbol' WHEN k % 19 = 0 OR bid IS NULL OR bid <= 0 THEN 'price_alert' WHEN k % 11 = 0 THEN 'signal_kind' WHEN k % 13 = 0 THEN 'decision'
      WHEN k % 4 != 0 AND k % 3 = 0 THEN 'sent_needs_alert' WHEN k % 4 = 0 AND k % 5 = 0 THEN 'blocked_needs_reason' WHEN k % 4 = 0 AND k % 3 != 0 THEN 'alert_blocked' END AS broken FROM ticks""",
    "source_fallback": _O + "SELECT * EXCLUDE (symbol, start_price, attempts, signal_id, asof_price, next_price), round(asof_price, 6) AS asof_price, round(next_price, 6) AS next_price FROM res",
    "signal_rollup": _O
    + """SELECT signal_id, n, n_terminal, n_done, n_error, n_mixed, CASE WHEN n_terminal = 0 THEN 'pending' WHEN n_terminal < n THEN 'partial' WHEN n_error = n THEN 'error' WHEN n_done = 0 THEN 'done_no_data' ELSE 'done' END AS status
      FROM (SELECT signal_id, count(*) AS n, count(*) FILTER (NOT later) AS n_terminal, count(*) FILTER (NOT later AND asof_status = 'done' AND next_status = 'done') AS n_done, count(*) FILTER (NOT later AND asof_status = 'error' AND next_status = 'error') AS n_error,
        count(*) FILTER (NOT later AND asof_source <> 'none' AND next_source <> 'none' AND asof_source <> next_source) AS n_mixed FROM (SELECT *, due_us > now AS later FROM res, clock) GROUP BY signal_id)""",
    "outcome_maturation": _O
    + """SELECT job_id, CASE WHEN later THEN 'pending' WHEN NOT failed THEN 'done' WHEN attempts + 1 >= 3 THEN 'error' ELSE 'pending' END AS state, CASE WHEN NOT later AND failed AND attempts + 1 < 3 THEN now + (attempts + 1) * 60000000 ELSE due_us END AS next_due_us
      FROM (SELECT *, due_us > now AS later, NOT (asof_status = 'done' AND next_status = 'done') AS failed FROM res, clock)""",
    "due_jobs_topk": _O + "SELECT job_id, due_us FROM jobs, clock WHERE due_us <= now ORDER BY due_us, job_id LIMIT 20",
    "noise_seed": f"WITH {market.SQL}, "
    + f"""recent AS (SELECT *, abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY us, tick_id)) AS move FROM ticks WHERE us >= (SELECT max(us) FROM ticks) - {5 * DAY}),
      m AS (SELECT symbol, list(move ORDER BY us, tick_id) AS ms FROM recent WHERE move > 0 GROUP BY symbol), l AS (SELECT symbol, arg_max(price, us) AS price FROM recent GROUP BY symbol)
      SELECT symbol, coalesce(len(ms), 0) AS n, round(greatest(coalesce(CASE WHEN len(ms) >= 15 THEN list_reduce(ms, lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a) ELSE list_median(ms) END, price * 0.0001::DOUBLE), price * 0.0001::DOUBLE), 6) AS seed FROM l LEFT JOIN m USING (symbol)""",
    "downtrend": f"WITH {market.SQL}, {_BARS}, "
    + f"""b AS (SELECT symbol, list(price ORDER BY us) AS cs FROM bars WHERE us >= ((SELECT max(us) FROM ticks) - {14 * DAY}) // {HOUR} * {HOUR} GROUP BY symbol)
      SELECT symbol, len(cs) AS n, len(cs) >= 50 AND fast < slow AND cs[-1] < slow AS downtrend FROM (SELECT *, list_reduce(cs, lambda a, x: a + (x - a) * 2 / 21::DOUBLE) AS fast, list_reduce(cs, lambda a, x: a + (x - a) * 2 / 51::DOUBLE) AS slow FROM b)""",
    "move_state_machine": """SELECT tick_id, symbol, us, shown AS state, round(noise, 6) AS noise, round(nullif(o_start, 0), 6) AS start_price, round(nullif(o_peak, 0), 6) AS peak, round(o_cusum, 6) AS cusum, o_cusum >= 2 AS cusum_pass, o_build AS build_us, confirm AS confirm_us, round(o_price, 6) AS trigger_price, ended FROM m""",
}


#: The state of a symbol after each tick, from that after the tick before: gates, what the tick does to the move, what the jump does.
_MOVES = f"""WITH RECURSIVE {market.SQL}, t AS (SELECT tick_id, symbol, us, price AS p, row_number() OVER (PARTITION BY symbol ORDER BY us, tick_id) AS rn FROM ticks),
m AS (SELECT symbol, rn, tick_id, us, 'idle' AS shown, p * 0.0001::DOUBLE * 0.9::DOUBLE AS noise, NULL::VARCHAR AS ended, NULL::BIGINT AS confirm, 0::DOUBLE AS o_start, 0::DOUBLE AS o_peak, 0::DOUBLE AS o_cusum, NULL::BIGINT AS o_build, NULL::DOUBLE AS o_price,
    'idle' AS st, p AS last, p AS low, us AS low_us, 0::DOUBLE AS start, 0::BIGINT AS start_us, 0::DOUBLE AS peak, 0 AS stalled, 0::DOUBLE AS cusum, NULL::BIGINT AS trig_us, NULL::DOUBLE AS trig_price, NULL::BIGINT AS build FROM t WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, tick_id, us, CASE WHEN jump AND trig_us IS NOT NULL THEN 'confirming' WHEN jump THEN 'triggered' ELSE st2 END, n, CASE WHEN jump AND trig_us IS NOT NULL THEN 'done' ELSE ended2 END, CASE WHEN jump THEN us - trig_us END,
    start2, peak2, cusum2, CASE WHEN jump AND trig_us IS NULL THEN CASE WHEN st2 = 'building' THEN us - start_us2 END ELSE build END, CASE WHEN jump AND trig_us IS NULL THEN p ELSE trig_price END,
    CASE WHEN jump AND trig_us IS NOT NULL THEN 'idle' WHEN jump THEN 'triggered' ELSE st2 END, p, CASE WHEN jump AND trig_us IS NOT NULL THEN p ELSE low2 END, CASE WHEN jump AND trig_us IS NOT NULL THEN us ELSE low_us2 END,
    CASE WHEN jump AND trig_us IS NOT NULL THEN 0 ELSE start2 END, CASE WHEN jump AND trig_us IS NOT NULL THEN 0 ELSE start_us2 END, CASE WHEN jump AND trig_us IS NOT NULL THEN 0 ELSE peak2 END, CASE WHEN jump AND trig_us IS NOT NULL THEN 0 ELSE stalled2 END, CASE WHEN jump AND trig_us IS NOT NULL THEN 0 ELSE cusum2 END,
    CASE WHEN jump AND trig_us IS NULL THEN us WHEN jump THEN NULL ELSE trig_us END, CASE WHEN jump AND trig_us IS NULL THEN p WHEN jump THEN NULL ELSE trig_price END, CASE WHEN jump AND trig_us IS NULL AND st2 = 'building' THEN us - start_us2 WHEN jump THEN NULL ELSE build END
  FROM (SELECT *, CASE WHEN declares THEN 'building' WHEN ended2 IS NOT NULL THEN 'idle' ELSE st END AS st2, CASE WHEN ended2 IS NOT NULL THEN p ELSE lo END AS low2, CASE WHEN ended2 IS NOT NULL THEN us ELSE lo_us END AS low_us2,
      CASE WHEN declares THEN lo WHEN ended2 IS NOT NULL THEN 0 ELSE start END AS start2, CASE WHEN declares THEN lo_us WHEN ended2 IS NOT NULL THEN 0 ELSE start_us END AS start_us2, CASE WHEN declares THEN p WHEN ended2 IS NOT NULL THEN 0 WHEN st = 'building' THEN greatest(peak, p) ELSE peak END AS peak2,
      CASE WHEN declares OR ended2 IS NOT NULL THEN 0 WHEN st = 'building' THEN stalled + 1 ELSE stalled END AS stalled2, CASE WHEN declares OR ended2 IS NOT NULL THEN 0 WHEN st = 'building' THEN greatest(0, cusum + (p - start) / greatest(n, 1e-12) - 1) ELSE cusum END AS cusum2
    FROM (SELECT *, st = 'idle' AND 2.5::DOUBLE * n > 0 AND p - lo > 2.5::DOUBLE * n AS declares, CASE WHEN st = 'building' AND 1.5::DOUBLE * n > 0 AND greatest(peak, p) - p > 1.5::DOUBLE * n THEN 'retrace' WHEN st = 'building' AND stalled >= 3 THEN 'lateral' END AS ended2, (p - last) / last * 100 >= 2 AS jump
      FROM (SELECT t.*, m.noise + 0.1::DOUBLE * (abs(t.p - m.last) - m.noise) AS n, CASE WHEN st = 'idle' AND t.p <= low THEN t.p ELSE low END AS lo, CASE WHEN st = 'idle' AND t.p <= low THEN t.us ELSE low_us END AS lo_us, st, last, start, start_us, peak, stalled, cusum, trig_us, trig_price, build
        FROM m JOIN t ON t.symbol = m.symbol AND t.rn = m.rn + 1)))) """


def queries():
    return {name: globals()[name] for name in ORACLES}


def oracle_sql():
    return {name: (_MOVES if name == "move_state_machine" else "") + sql for name, sql in ORACLES.items()}
