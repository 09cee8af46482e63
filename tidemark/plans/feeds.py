"""Queries of feeds, sinks, audits, records and the detection, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as cs
from ..functions import quotes as qf
from ..functions import records as rc
from ..operators import audit as au
from ..operators import detect as dt
from ..operators import moves as mv
from ..operators import sinks as sk
from ..operators import universe as un
from ..operators import windows as wn
from ..operators.cooldown import cooldown_filter
from ..operators.labels import HOUR
from ..operators.stage import kept_only, shared_path
from ..operators.timejoin import asof, asof_unbounded, range_join
from ..sources import feeds, listings, market
from ..streaming import jobs
from . import labels as lb
from . import markets as mk
from .labels import rounded

DAY = 24 * HOUR
SEC = 1_000_000


def tick_snapshot_source(s, d):
    """The last five days of three columns; the file's times have no zone, so the bound is one too."""
    newest = s.read.parquet(f"{d}/events.parquet").agg(F.max("ts")).first()[0]
    since = F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 5 DAYS")
    return feeds.tick_snapshot(s, f"{d}/events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", ["event_id", "event_type", "value"], since=since)


def _messages(s, d) -> DataFrame:
    """A message for each trade; some are broken off, some lack a key or have a value that is no number."""
    t, k = market.trades(s, d).join(market.events(s, d).select(F.col("event_id").alias("trade_id"), "k"), "trade_id"), F.col("k")
    whole = F.to_json(F.struct((F.col("us") / 1000).cast("long").alias("T"), F.when(k % 23 == 0, "abc").otherwise(F.col("price").cast("string")).alias("p"), F.when(k % 19 != 0, F.col("qty").cast("string")).alias("q"), F.col("is_buyer_maker").alias("m")))
    return t.select("trade_id", F.when(k % 17 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("body"))


def trade_json_parse(s, d):
    return rounded(feeds.parsed_trades(_messages(s, d)).drop("body"))


def kline_explode(s, d):
    """Bars of six hours, packed into a message for each symbol and week and taken out of it."""
    b = wn.bars(market.ticks(s, d), "6 hours").withColumn("week", F.expr(f"open_us div {7 * DAY}"))
    one = F.array(*(F.col(c).cast("string") for c in ("open_ms", "o", "h", "l", "c", "v", "close_ms")))
    packed = b.withColumns({"open_ms": F.expr("open_us div 1000"), "close_ms": F.expr(f"open_us div 1000 + {6 * HOUR // 1000 - 1}")})
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("open_ms", one.alias("bar")))), lambda x: x["bar"]))
    return rounded(feeds.exploded_klines(packed.groupBy("symbol", "week").agg(body.alias("body"))).drop("week", "nth"))


def align_schema(s, d):
    """Features written before a column was there, read beside those with it."""
    f = market.features(s, d)
    number = F.regexp_extract("event_id", "[0-9]+", 0).cast("long")
    old = f.filter(number % 3 == 0).select(F.col("n_trades").cast("long").alias("n_trades"), "event_id", F.lit("x").alias("gone"))
    return rounded(sk.align_schema(old, f.schema).unionByName(f.filter(number % 3 != 0)))


def write_day_partitioned(s, d):
    """Ticks by day, of which the last two are then replaced by half of their rows."""
    t, path = market.ticks(s, d).select("tick_id", "symbol", "ts", "us"), shared_path(s, "by-day")
    sk.write_day_partitioned(t, path)
    last = t.agg(F.max(F.to_date("ts"))).first()[0]
    sk.write_day_partitioned(t.filter(F.to_date("ts") >= F.date_sub(F.lit(last), 1)).filter("tick_id % 2 = 0"), path)
    return s.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.max("tick_id").alias("last_id"))


def contract_check(s, d):
    k = F.col("k")
    signal = F.to_json(
        F.struct(
            F.when(k % 13 != 0, F.col("symbol")).alias("symbol"), F.when(k % 7 == 0, "up").otherwise("long").alias("side"), (k / 90.0).alias("confidence"), (k - 5).alias("rr_est"), F.array(F.lit("r")).alias("reasons"),
            F.lit("v1").alias("version"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), (k % 10).alias("ttl_min"),
        )
    )
    body = F.when(k % 29 == 0, "{broken").otherwise(signal)
    return market.ticks(s, d).select("tick_id", F.array_join(feeds.contract_violations(body, "signal"), ",").alias("broken"))


def symbol_list_source(s, d):
    i = listings.instruments(s, d)
    lines = i.select(F.concat(F.lit("  "), F.col("symbol"), F.lit(" ")).alias("value")).union(s.range(1).select(F.lit("").alias("value")))
    return feeds.symbol_list(lines, i)


def finite_or_null(s, d):
    k = F.col("k")
    text = F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "Infinity").when(k % 5 == 2, "x1").otherwise(F.col("price").cast("string"))
    return rounded(market.ticks(s, d).select("tick_id", qf.finite_or_null(text).alias("value")))


def buy_vol_ratio(s, d):
    day = F.when(F.col("k") % 6 == 0, 0.0).when(F.col("k") % 6 != 1, F.col("ask_qty") * 10)
    return rounded(market.ticks(s, d).select("tick_id", qf.buy_vol_ratio(F.col("bid_qty"), day).alias("ratio")))


def candidate_normalize(s, d):
    k = F.col("k")
    config = F.when(k % 11 != 0, F.lit("{}"))
    decision, window = F.when(k % 3 == 0, "passed").when(k % 3 == 1, "rejected").otherwise("maybe"), F.when(k % 2 == 0, "awake").when(k % 5 == 0, "sleep").otherwise("dozing")
    got = rc.normalized_candidate(F.when(k % 17 != 0, F.col("symbol")).otherwise(""), F.when(k % 13 != 0, "v1"), config, decision, window, F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(k - 20.0))
    return market.ticks(s, d).select("tick_id", *(c.alias(n) for c, n in zip(got, ("dropped", "decision", "operator_window", "latency_ms"), strict=True)))


def dataset_buckets(s, d):
    k = F.col("k")
    reason = F.when(k % 4 == 1, "degraded_low_density").when(k % 4 == 2, "degraded_high_lag").when(k % 4 == 3, "degraded_quote_skew")
    quality = F.when(k % 4 == 0, "ok").otherwise("degraded")
    f = market.features(s, d).join(market.events(s, d).select(F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("event_id"), "k"), "event_id")
    told = f.select("event_id", qf.dataset_bucket(quality, reason).alias("dataset_bucket"), qf.trades_bucket(F.col("n_trades")).alias("n_trades_bucket"))
    return told.withColumns({"needs_downweight": F.col("dataset_bucket") == "degraded_low_density", "is_sweet_spot": F.col("n_trades_bucket").isin("Q2_6_9", "Q3_10_19")})


def anchor_range_join(s, d):
    p = lb.P
    near = range_join(market.candidates(s, d), market.ticks(s, d).select("symbol", "us", "tick_id"), F.col("us") - p.anchor_us, F.col("us") - 1, p.anchor_us)
    return near.select("event_id", "t_tick_id")


def horizon_range_join(s, d):
    """Ticks of the forward window of each horizon, ends included."""
    p = lb.P
    e = market.candidates(s, d).withColumn("horizon_min", F.explode(F.array(*map(F.lit, p.horizons))))
    e = e.withColumns({"th": F.col("us") + F.col("horizon_min").cast("long") * p.minute_us, "w": F.when(F.col("horizon_min") <= 15, p.short_us).otherwise(p.long_us)})
    near = range_join(e.drop("us"), market.ticks(s, d).select("symbol", "us", "tick_id"), F.col("th"), F.col("th") + F.col("w"), p.short_us)
    return near.select("event_id", "horizon_min", "t_tick_id")


def horizon_quality(s, d):
    h = lb.Job(s, d).horizons
    return h.groupBy("horizon_min", "quality_flag", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def buy_ratio(s, d):
    """Whether the trades up to a candidate's time confirm it."""
    flow = wn.trade_flow(market.trades(s, d), 6 * HOUR).select("trade_id", "n_trades", "quote_vol", F.col("buy_ratio").alias("ratio"))
    told = flow.withColumn("confirmed", (F.col("n_trades") >= 3) & (F.col("ratio") >= 0.55))
    return rounded(told)


def base_symbol(s, d):
    i = listings.instruments(s, d)
    return i.select("symbol", qf.base_symbol(F.col("symbol")).alias("base"), F.col("symbol").endswith("USDT").alias("quoted"), F.col("symbol").rlike("^[\\x00-\\x7F]*$").alias("ascii"))


def epoch_conversions(s, d):
    e = market.events(s, d)
    ms = F.expr("us div 1000")
    return e.select("event_id", ms.alias("ms"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS").alias("text"), ((F.col("us") - ms * 1000) / 1000.0).alias("lag_ms"))


def config_hash(s, d):
    k = F.col("k")
    values = F.when(k % 11 == 0, F.lit(None)).otherwise(F.create_map(F.lit("poll_interval_s"), (k % 5).cast("string"), F.lit("name"), F.lit('"fast"'), F.lit("limit"), F.lit(None).cast("string")))
    return market.ticks(s, d).select("tick_id", rc.config_hash(values).alias("hash"))


def extras_split(s, d):
    k = F.col("k")
    extras = F.to_json(F.struct((k / 10.0).alias("delta"), k.alias("n_trades"), F.when(k % 2 == 0, "aw\"ake").alias("operator_window"), k.alias("a"), F.lit("long text").alias("note"), (k % 3 == 0).alias("z")))
    known, rest = rc.extras_split(extras, {"delta": "double", "n_trades": "long", "operator_window": "string"}, most_bytes=30)
    return rounded(market.ticks(s, d).select("tick_id", *(c.alias(n) for n, c in known.items()), rest.alias("rest")))


def outcome_status_join(s, d):
    """Jobs with their signal and outcome."""
    jobs_, done = mk._jobs(s, d).select("job_id", "signal_id", "horizon_min", "attempts"), mk._resolved(s, d)
    told = jobs_.join(done.select("job_id", "asof_status", "asof_source", "asof_pct", "next_status", "next_source", "next_pct"), "job_id")
    signals = market.ticks(s, d).filter("tick_id % 20 = 3").select(F.col("tick_id").alias("signal_id"), "symbol")
    odd = (F.col("asof_source") != "none") & (F.col("next_source") != "none") & (F.col("asof_source") != F.col("next_source"))
    return rounded(told.join(signals, "signal_id").select("signal_id", "symbol", "horizon_min", "attempts", "asof_status", "asof_source", "asof_pct", "next_status", "next_source", "next_pct", odd.alias("mixed_source")))


def _delay():
    return F.col("k").cast("long") * F.when(F.col("k") % 4 == 0, SEC).otherwise(SEC // 10)


def lateness_stats(s, d):
    e = market.events(s, d).withColumn("batch", F.expr(f"us div {6 * HOUR}"))
    return rounded(au.lateness_stats(e, ["batch", "event_type"], _delay()))


def late_data_policy(s, d):
    """As a stream: how many messages of each window were live, late or stale when they were processed."""
    return jobs.run_available(jobs.late_data(jobs.event_stream(s, d).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int")), _delay(), "6 hours", "1 hour"))


def table_completeness(s, d):
    e = market.events(s, d)
    tables = {"events": e, "candidates": market.candidates(s, d), "jobs": e.filter("k < 0"), "signals": e.filter("k < -1"), "policy": None}
    return au.table_completeness(s, tables, {"jobs"})


def snapshot_invariants(s, d):
    k = F.col("k")
    t = market.ticks(s, d)
    rows = t.select(
        "tick_id", "bid", "ask", F.col("us").alias("window_end_us"), (F.col("us") - F.when(k % 31 == 0, -5).otherwise(60) * SEC).alias("window_start_us"), (F.col("us") + F.when(k % 29 == 0, -1).otherwise(1) * SEC).alias("source_us"),
        (F.col("us") + F.when(k % 23 == 0, 0).otherwise(2) * SEC).alias("snapshot_us"), (F.col("us") + (k % 19 == 0).cast("int") * 2 * SEC).alias("feature_us"), F.when(k % 3 == 0, F.col("us") + F.when(k % 9 == 0, 9).otherwise(0) * SEC).alias("trade_us"),
        F.lit(None).cast("long").alias("book_us"), (k - 50.0).alias("flow"), F.when(k % 7 != 0, 40.0).alias("quote_vol"), F.when(k % 5 == 0, "invalid").otherwise("valid").alias("validity"), F.when(k % 37 == 0, "v2").otherwise("v1").alias("schema_version"),
    )
    return au.snapshot_invariants(rows, {"schema_version": "v1"}).select("tick_id", F.array_join("broken", ",").alias("broken"), "validity")


def stale_feed(s, d):
    """For each candidate's time, the age of the newest large tick of any symbol."""
    e, t = market.candidates(s, d).select("event_id", F.col("us").alias("now")), market.ticks(s, d).filter("k > 80")
    told = asof_unbounded(e, t, "now", key="event_id", value=["tick_id"], bucket_us=6 * HOUR, tie="tick_id")
    return told.select("event_id", (F.col("asof_lag_us") / 1000.0).alias("age_ms"), F.coalesce(F.col("asof_lag_us") > HOUR, F.lit(False)).alias("stale"))


def recent_events(s, d):
    return rounded(au.recent_events(market.candidates(s, d).select("event_id", "symbol", "us"), market.features(s, d)))


def universe_signature(s, d):
    return un.signature(un.coverage_universe(listings.instruments(s, d), listings.tickers(s, d), **mk.LIMITS))


def alert_dedup(s, d):
    """Messages, unless the same was kept in the twelve hours before."""
    t = market.ticks(s, d).select("tick_id", "us", F.md5(F.concat_ws("|", "symbol", (F.col("k") % 4).cast("string"))).alias("message"))
    return cooldown_filter(t, ["message"], 12 * HOUR).select("tick_id", "us")


def stream_idempotent_sink(s, d):
    """Candidates of the stream, which is played twice into one table."""
    path = shared_path(s, "idempotent")
    for _ in range(2):
        jobs.run_into(jobs.event_stream(s, d).filter("event_id % 20 = 3").select("event_id", "ts", "event_type"), sk.append_absent(path, "event_id"))
    return s.read.parquet(path).select("event_id", F.col("event_type").alias("symbol"))


def _gated(s, d) -> DataFrame:
    t = market.ticks(s, d)
    _, _, asleep, _ = qf.time_gate(F.col("ts"))
    falling = wn.downtrend(wn.bars(t, "1 hour"), 0).filter("downtrend and symbol = 'view'").select("symbol", F.lit(True).alias("downtrend"))
    return t.select("tick_id", "symbol", "us", "price", F.when(F.col("k") % 50 != 0, 300_000.0 + F.col("k") * 10).alias("vol_24h"), asleep.alias("blocked"), (F.col("symbol") != "error").alias("watched")).join(falling, "symbol", "left")


def _flow_before(s, d) -> DataFrame:
    rows = wn.trade_flow(market.trades(s, d), 6 * HOUR, timed=True).withColumnRenamed("trade_id", "tick_id")
    at = market.ticks(s, d).select(F.col("tick_id").alias("of"), "symbol", F.col("us").alias("at"))
    found = asof(at, rows, "at", 6 * HOUR, key="of", value=["n_trades", "buy_ratio", "quote_vol"])
    return found.select(F.col("of").alias("tick_id"), F.col("asof_n_trades").alias("n_trades"), F.col("asof_buy_ratio").alias("buy_ratio"), F.col("asof_quote_vol").alias("quote_vol"))


_DETECTION = {"pump_pct": 2.0, "ttl_us": DAY, "cooldown_us": 12 * HOUR, "rel_volume": 1.0}


def pump_fast_detect(s, d):
    """With the rises that were seen while blocked."""
    return rounded(dt.pump_fast_detect(_gated(s, d), _flow_before(s, d), dt.DetectParams(**_DETECTION, near_miss=True)), 4)


def pump_fast_alerts(s, d):
    """As the detection runs by default: what is blocked is not seen."""
    return rounded(dt.pump_fast_detect(_gated(s, d), _flow_before(s, d), dt.DetectParams(**_DETECTION)), 4)


def _seeded_from(s, d) -> tuple[DataFrame, Column]:
    """Seeds from the first ten days, and which ticks come after them."""
    t = market.ticks(s, d)
    begin = (t.agg(F.min("us")).first()[0] or 0) + 10 * DAY
    return mv.noise_seed(t, begin, 5 * DAY), F.col("us") > begin


def seeded_move_states(s, d):
    seeds, after = _seeded_from(s, d)
    return rounded(mv.move_states(market.ticks(s, d).filter(after), seeds=seeds))


def seeded_detection(s, d):
    seeds, after = _seeded_from(s, d)
    return rounded(dt.pump_fast_detect(_gated(s, d).filter(after), _flow_before(s, d), dt.DetectParams(**_DETECTION), seeds=seeds), 4)


def stream_move_states(s, d):
    """The state machine on the stream; its rows are those of the batch form up to the watermark."""
    stream = jobs.event_stream(s, d).select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("symbol"), "ts", F.unix_micros("ts").alias("us"), "price")
    return rounded(jobs.run_move_states(stream, HOUR))


#: Checks and rows for them: every check is broken by some rows and null in others, told by the tick's number.
_PLANTED = {
    "regime": (cs.REGIME_SNAPSHOT, {"window_order": {"window_start_us": ("1", "3"), "window_end_us": ("2", "2")}, "book_order": {"btc_bid_price": ("1.0", "9.0"), "btc_ask_price": ("2.0", "2.0")}, "missing_features_list": {"missing_features_list": ("'[]'", "'{}'")}, "degradation_reasons": {"degradation_reasons": ("'[]'", "'none'")}}),
    "label": (cs.LABEL, {"terminal_reason_code": {"terminal_reason_code": ("'bad_sigma'", "repeat('x', 201)")}}),
    "markout": (cs.MARKOUT, {}),
}


def _planted_columns(name: str) -> dict[str, str]:
    """SQL text of each column of the table, the same for Spark and DuckDB."""
    checks, other = _PLANTED[name]
    cases: dict[str, tuple[str, list[str]]] = {}
    for i, (rule, text) in enumerate(checks.items()):
        inside = text.split("(")[1].split(",")[0].rstrip(")") if " IN (" in text else None
        own = {rule: (inside, "'other'" if inside.startswith("'") else "77") if inside else ("0.5", "1.5") if "<= 1" in text else ("1.0", "0.0") if text.endswith("> 0") else ("0.0", "-1.0")}
        for column, (good, bad) in other.get(rule, own).items():
            told = cases.setdefault(column, (good, []))[1]
            told += [f"WHEN tick_id % 211 = {i} THEN {bad}", f"WHEN tick_id % 211 = {i + 100} THEN NULL"]
    return {c: f"CASE {' '.join(w)} ELSE {good} END" for c, (good, w) in cases.items()}


def _planted(s, d, name: str) -> DataFrame:
    return market.ticks(s, d).select("tick_id", *(F.expr(x).alias(c) for c, x in _planted_columns(name).items()))


def _violations(name: str):
    def query(s, d):
        return _planted(s, d, name).select("tick_id", F.array_join(cs.violated(_PLANTED[name][0]), ",").alias("violated")).filter("violated <> ''")

    return query


constraint_violations, label_violations, markout_violations = map(_violations, _PLANTED)


def quarantine(s, d):
    """Rows that pass and rows that break each check, as counted in the pass that wrote them apart, and as the tables hold them."""
    path = shared_path(s, "checked")
    n = sk.write_checked(_planted(s, d, "label"), cs.LABEL, path)
    held = {r.quarantined: r["count"] for r in s.read.parquet(path).groupBy("quarantined").count().collect()}
    rows = [*n.items(), ("held_good", held.get("false", 0)), ("held_quarantined", held.get("true", 0))]
    return s.createDataFrame(rows, "what string, n long")


def late_side_table(s, d):
    """As a stream: late and stale messages as rows with their delay."""
    stream = jobs.event_stream(s, d).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int")).select("event_id", "ts", "k")
    _, late = jobs.split_late(stream, _delay())
    return late.select("event_id", "status", "delay_ms")


def stream_outcomes(s, d):
    """Outcomes of candidates five hours on, as streams of jobs and ticks meet; some symbols' ticks are few, so that some jobs find none."""
    e = jobs.event_stream(s, d)
    due = e.filter("event_id % 20 = 3").select(F.concat(F.lit("job_"), F.col("event_id").cast("string")).alias("job_id"), F.col("event_type").alias("symbol"), (F.col("ts") + F.expr("interval 5 hours")).alias("due_ts"), F.col("price").alias("start_price"))
    ticks = e.select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("symbol"), "ts", "price").filter("symbol <> 'error' or tick_id % 7 = 0")
    return rounded(jobs.run_available(jobs.stream_outcomes(due, ticks, back="30 minutes", forward="2 hours", late_s=3600)))


def stream_batch_ledger(s, d):
    """Candidates of the stream, each batch of which comes twice, once after a writer that died, in a table that is never read to write it."""
    ledger = sk.BatchLedger(s, shared_path(s, "ledger"))

    def write(batch: DataFrame, number: int) -> None:
        ledger.stage(batch, number)
        ledger.write(batch, number)
        ledger.write(batch, number)

    stream = jobs.event_stream(s, d).filter("event_id % 20 = 3").select("event_id", "event_type")
    jobs.run_into(stream, write)
    return ledger.read(stream.schema).select("event_id", F.col("event_type").alias("symbol"))


_BAR6 = f"SELECT symbol, us // {6 * HOUR} * {6 * HOUR} AS open_us, arg_min(price, us) AS o, max(price) AS h, min(price) AS l, arg_max(price, us) AS c, sum(bid_qty) AS v FROM ticks GROUP BY ALL"
_F6 = f"OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)"
_DELAY = "k * CASE WHEN k % 4 = 0 THEN 1000000 ELSE 100000 END"
_P = lb.P



def _planted_sql(name: str) -> str:
    return f"(SELECT tick_id, {', '.join(f'{x} AS {c}' for c, x in _planted_columns(name).items())} FROM ticks)"


def _violated_sql(name: str) -> str:
    told = ", ".join(f"CASE WHEN NOT ({text}) THEN '{rule}' END" for rule, text in _PLANTED[name][0].items())
    return f"SELECT * FROM (SELECT tick_id, array_to_string(list_filter([{told}], lambda x: x IS NOT NULL), ',') AS violated FROM {_planted_sql(name)}) WHERE violated <> ''"


def _quarantine_sql() -> str:
    bad = " OR ".join(f"coalesce(NOT ({t}), false)" for t in cs.LABEL.values())
    counts = {"rows": "count(*)", "quarantined": f"count(*) FILTER ({bad})"} | {n: f"count(*) FILTER (NOT ({t}))" for n, t in cs.LABEL.items()} | {"held_good": f"count(*) FILTER (NOT ({bad}))", "held_quarantined": f"count(*) FILTER ({bad})"}
    return " UNION ALL ".join(f"SELECT '{n}' AS what, {c} AS n FROM {_planted_sql('label')}" for n, c in counts.items())


ORACLES = {
    "tick_snapshot_source": "SELECT event_id, event_type, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAYS",
    "trade_json_parse": """SELECT trade_id, CASE WHEN r IS NULL THEN us // 1000 END AS trade_ms, CASE WHEN r IS NULL THEN round(price, 6) END AS price, CASE WHEN r IS NULL THEN qty END AS qty, CASE WHEN r IS NULL THEN is_buyer_maker END AS is_buyer_maker, r AS rejected
      FROM (SELECT *, CASE WHEN k % 17 = 0 THEN 'not_json' WHEN k % 23 = 0 THEN 'bad_p' WHEN k % 19 = 0 THEN 'missing_q' END AS r FROM trades JOIN (SELECT event_id AS trade_id, k FROM ev) USING (trade_id))""",
    "kline_explode": f"SELECT symbol, open_us // 1000 AS open_ms, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v, open_us // 1000 + {6 * HOUR // 1000 - 1} AS close_ms FROM ({_BAR6})",
    "align_schema": "SELECT event_id, n_trades, CASE WHEN CAST(substr(event_id, 4) AS BIGINT) % 3 != 0 THEN round(stage_pct, 6) END AS stage_pct, CASE WHEN CAST(substr(event_id, 4) AS BIGINT) % 3 != 0 THEN round(noise, 6) END AS noise FROM features",
    "write_day_partitioned": "SELECT CAST(ts::DATE AS VARCHAR) AS day, symbol, count(*) AS n, max(tick_id) AS last_id FROM ticks WHERE tick_id % 2 = 0 OR ts::DATE < (SELECT max(ts::DATE) FROM ticks) - 1 GROUP BY ALL",
    "contract_check": """SELECT tick_id, CASE WHEN k % 29 = 0 THEN 'json' ELSE array_to_string(list_filter([CASE WHEN k % 13 = 0 THEN 'missing_symbol' END, CASE WHEN k % 7 = 0 THEN 'bad_side' END, CASE WHEN k > 90 THEN 'bad_confidence' END, CASE WHEN k < 5 THEN 'bad_rr_est' END, CASE WHEN k % 10 = 0 THEN 'bad_ttl_min' END], lambda x: x IS NOT NULL), ',') END AS broken FROM ticks""",
    "symbol_list_source": f"WITH {listings.SQL} SELECT DISTINCT symbol FROM instruments WHERE symbol LIKE '%USDT'",
    "finite_or_null": "SELECT tick_id, CASE WHEN k % 5 > 2 THEN round(price, 6) END AS value FROM ticks",
    "buy_vol_ratio": "SELECT tick_id, CASE WHEN k % 6 < 2 THEN 0.5 ELSE round(bid_qty / (ask_qty * 10), 6) END AS ratio FROM ticks",
    "candidate_normalize": """SELECT tick_id, CASE WHEN k % 17 = 0 THEN 'symbol' WHEN k % 13 = 0 THEN 'detector_version' WHEN k % 11 = 0 THEN 'config' END AS dropped, CASE k % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'rejected' ELSE 'unknown' END AS decision,
      CASE WHEN k % 2 = 0 THEN 'awake' WHEN k % 5 = 0 THEN 'sleep' END AS operator_window, CASE WHEN k % 7 = 0 THEN 0::DOUBLE ELSE greatest(0, k - 20)::DOUBLE END AS latency_ms FROM ticks""",
    "dataset_buckets": """SELECT event_id, b AS dataset_bucket, t AS n_trades_bucket, b = 'degraded_low_density' AS needs_downweight, t IN ('Q2_6_9', 'Q3_10_19') AS is_sweet_spot FROM (SELECT f.event_id, CASE k % 4 WHEN 0 THEN 'ok_only' WHEN 1 THEN 'degraded_low_density' WHEN 2 THEN 'other_degraded' ELSE 'other_unknown' END AS b,
      CASE WHEN n_trades IS NULL THEN 'OUT_OF_RANGE' WHEN n_trades <= 5 THEN 'Q1_le_5' WHEN n_trades <= 9 THEN 'Q2_6_9' WHEN n_trades <= 19 THEN 'Q3_10_19' ELSE 'Q4_19_plus' END AS t FROM features f JOIN ev ON f.event_id = 'ev_' || ev.event_id)""",
    "anchor_range_join": f"SELECT event_id, tick_id AS t_tick_id FROM candidates c JOIN ticks t ON t.symbol = c.symbol AND t.us >= c.us - {_P.anchor_us} AND t.us < c.us",
    "horizon_range_join": f"SELECT event_id, CAST(h AS INT) AS horizon_min, tick_id AS t_tick_id FROM candidates c, (VALUES (5), (15), (30), (60), (120)) v(h), ticks t WHERE t.symbol = c.symbol AND t.us BETWEEN c.us + h * {_P.minute_us}::BIGINT AND c.us + h * {_P.minute_us}::BIGINT + CASE WHEN h <= 15 THEN {_P.short_us} ELSE {_P.long_us} END",
    "horizon_quality": None,
    "buy_ratio": f"SELECT trade_id, n_trades, round(quote_vol, 6) AS quote_vol, round(ratio, 6) AS ratio, n_trades >= 3 AND ratio >= 0.55 AS confirmed FROM (SELECT trade_id, count(*) {_F6} AS n_trades, sum(price * qty) {_F6} AS quote_vol, sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) {_F6} / sum(qty) {_F6} AS ratio FROM trades)",
    "base_symbol": f"WITH {listings.SQL} SELECT symbol, lower(regexp_replace(symbol, 'USDT$', '')) AS base, symbol LIKE '%USDT' AS quoted, symbol NOT LIKE '%Ñ%' AS ascii FROM instruments",
    "epoch_conversions": "SELECT event_id, us // 1000 AS ms, strftime(epoch_ms(us // 1000), '%Y-%m-%d %H:%M:%S.%g') AS text, us % 1000 / 1000.0 AS lag_ms FROM ev",
    "config_hash": """SELECT tick_id, substr(sha256(CASE WHEN k % 11 = 0 THEN 'empty_config' ELSE '{"limit": null, "name": "fast", "poll_interval_s": ' || k % 5 || '}' END), 1, 16) AS hash FROM ticks""",
    "extras_split": """SELECT tick_id, k / 10.0 AS delta, k::BIGINT AS n_trades, CASE WHEN k % 2 = 0 THEN 'aw"ake' END AS operator_window, '{"a": ' || k || ', "note": "long text"' || CASE WHEN false THEN '' ELSE '' END || '}' AS rest FROM ticks""",
    "outcome_status_join": mk._O + "SELECT signal_id, symbol, horizon_min, attempts, asof_status, asof_source, asof_pct, next_status, next_source, next_pct, asof_source <> 'none' AND next_source <> 'none' AND asof_source <> next_source AS mixed_source FROM res",
    "lateness_stats": f"SELECT us // {6 * HOUR} AS batch, event_type, count(*) AS n, count(*) FILTER (delay > 3000000) AS late, count(*) FILTER (delay > 15000000) AS stale, greatest(0, max(delay)) / 1000.0 AS max_delay_ms FROM (SELECT *, {_DELAY} AS delay FROM ev) GROUP BY ALL",
    "late_data_policy": f"SELECT us // {6 * HOUR} * {6 * HOUR} AS open_us, CASE WHEN delay <= 3000000 THEN 'live' WHEN delay <= 15000000 THEN 'late' ELSE 'stale' END AS status, count(*) AS n FROM (SELECT *, {_DELAY} AS delay FROM ev) WHERE us // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} <= (SELECT max(us) - {HOUR} FROM ev) GROUP BY ALL",
    "table_completeness": """SELECT t AS "table", n AS rows, CASE t WHEN 'events' THEN 'ok' WHEN 'candidates' THEN 'ok' WHEN 'jobs' THEN 'ok_empty' WHEN 'signals' THEN 'failed_semantic_empty' ELSE 'failed_missing_table' END AS status, 'PARTIAL_FAILED' AS run_status
      FROM (SELECT 'events' AS t, count(*) AS n FROM ev UNION ALL SELECT 'candidates', count(*) FROM candidates UNION ALL SELECT 'jobs', 0 UNION ALL SELECT 'signals', 0 UNION ALL SELECT 'policy', NULL)""",
    "snapshot_invariants": """SELECT tick_id, broken, CASE WHEN broken != '' AND k % 5 != 0 THEN 'suspicious' WHEN k % 5 = 0 THEN 'invalid' ELSE 'valid' END AS validity FROM (SELECT tick_id, k, array_to_string(list_filter([CASE WHEN k % 31 = 0 THEN 'window_order' END, CASE WHEN k % 29 = 0 THEN 'source_before_window_end' END,
      CASE WHEN k % 23 = 0 AND k % 29 != 0 THEN 'source_after_snapshot' END, CASE WHEN k % 19 = 0 THEN 'feature_not_at_window_end' END, CASE WHEN k % 9 = 0 THEN 'trade_after_snapshot' END, CASE WHEN k % 7 != 0 AND abs(k - 50) > 40.04 THEN 'flow_above_volume' END, CASE WHEN bid > ask THEN 'crossed_book' END, CASE WHEN k % 37 = 0 THEN 'schema_version_changed' END], lambda x: x IS NOT NULL), ',') AS broken FROM ticks)""",
    "stale_feed": f"SELECT event_id, (c.us - max(t.us)) / 1000.0 AS age_ms, coalesce(c.us - max(t.us) > {HOUR}, false) AS stale FROM candidates c LEFT JOIN ticks t ON t.k > 80 AND t.us <= c.us GROUP BY event_id, c.us",
    "recent_events": "SELECT event_id, symbol, us, n_trades, round(stage_pct, 6) AS stage_pct, round(noise, 6) AS noise FROM candidates JOIN features USING (event_id) ORDER BY us DESC, event_id LIMIT 20",
    "universe_signature": f"WITH {listings.SQL}, {mk._REASONS} SELECT count(*)::BIGINT AS prefixes, sum(n)::BIGINT AS symbols, sha256(string_agg(h, ',' ORDER BY p)) AS signature FROM (SELECT substr(symbol, 1, 3) AS p, count(*) AS n, sha256(string_agg(symbol, ',' ORDER BY symbol)) AS h FROM judged WHERE reason = 'accepted' GROUP BY p)",
    "alert_dedup": "SELECT tick_id, us FROM c",
    "stream_idempotent_sink": "SELECT event_id, event_type AS symbol FROM ev WHERE event_id % 20 = 3",
    # tested against a plain loop: the recursion from a seed has no SQL
    "seeded_move_states": None,
    "seeded_detection": None,
    "pump_fast_alerts": None,
    "pump_fast_detect": """SELECT tick_id, symbol, us, kind, decision, reason AS rejection_reason, round(last, 4) AS price, round(delta, 4) AS delta_pct, round(o_trigger, 4) AS trigger_price, round(stage, 4) AS stage_pct, round(o_build / 1000.0, 4) AS build_ms, round(o_confirm / 1000.0, 4) AS confirm_ms,
      round(o_rel, 4) AS rel_vol, round(o_ratio, 4) AS confirm_ratio, o_n AS n_trades, round(nullif(o_start, 0), 4) AS move_start_price, round(nullif(o_peak, 0), 4) AS peak, round(nullif(o_noise, 0), 4) AS noise FROM m WHERE kind IS NOT NULL""",
    "stream_move_states": mk._MOVES + f"SELECT * FROM ({mk.ORACLES['move_state_machine']}) WHERE us < (SELECT max(us) FROM ticks) // 1000 * 1000 - {HOUR}",
    **{q: _violated_sql(t) for q, t in (("constraint_violations", "regime"), ("label_violations", "label"), ("markout_violations", "markout"))},
    "quarantine": _quarantine_sql(),
    "late_side_table": f"SELECT event_id, CASE WHEN delay <= 15000000 THEN 'late' ELSE 'stale' END AS status, delay / 1000.0 AS delay_ms FROM (SELECT *, {_DELAY} AS delay FROM ev) WHERE delay > 3000000",
    "stream_outcomes": f"""SELECT job_id, round(a, 6) AS asof_price, round((a - p) / p * 100, 6) AS asof_pct, CASE WHEN a IS NULL THEN 'error' ELSE 'done' END AS asof_status, round(n, 6) AS next_price, round((n - p) / p * 100, 6) AS next_pct, CASE WHEN n IS NULL THEN 'error' ELSE 'done' END AS next_status, CASE WHEN a IS NULL OR n IS NULL THEN 3 ELSE 1 END AS attempts
      FROM (SELECT j.job_id, j.p, arg_max(t.price, t.us) FILTER (t.us <= j.due) AS a, arg_min(t.price, t.us) FILTER (t.us >= j.due) AS n
        FROM (SELECT 'job_' || tick_id AS job_id, symbol, price AS p, us + {5 * HOUR} AS due FROM ticks WHERE tick_id % 20 = 3) j LEFT JOIN ticks t ON t.symbol = j.symbol AND (t.symbol <> 'error' OR t.tick_id % 7 = 0) AND t.us BETWEEN j.due - {HOUR // 2} AND j.due + {2 * HOUR}
        WHERE j.due // {HOUR} * {HOUR} + {HOUR} <= (SELECT max(us) FROM ticks WHERE symbol <> 'error' OR tick_id % 7 = 0) // 1000 * 1000 - {3 * HOUR} GROUP BY ALL)""",
    "stream_batch_ledger": "SELECT event_id, event_type AS symbol FROM ev WHERE event_id % 20 = 3",
}
_OWN = ("symbol_list_source", "base_symbol", "universe_signature", "outcome_status_join", "stream_move_states")
_DEDUP = f"""WITH RECURSIVE {market.SQL}, hot AS (SELECT tick_id, us, symbol || '|' || k % 4 AS m FROM ticks),
c AS (SELECT * FROM hot QUALIFY row_number() OVER (PARTITION BY m ORDER BY us, tick_id) = 1
  UNION ALL SELECT h.* FROM c, LATERAL (SELECT * FROM hot WHERE hot.m = c.m AND hot.us >= c.us + {12 * HOUR} ORDER BY us, tick_id LIMIT 1) h) """


#: What is known of a symbol after each tick that is seen, from what was known before it; a row before the first knows nothing.
_DETECT = f"""WITH RECURSIVE {market.SQL}, hb AS (SELECT symbol, list(c ORDER BY w) AS cs FROM (SELECT symbol, us // {HOUR} AS w, arg_max(price, us) AS c FROM ticks GROUP BY ALL) GROUP BY symbol),
falling AS (SELECT symbol FROM (SELECT symbol, cs, list_reduce(cs, lambda a, x: a + (x - a) * 2 / 21::DOUBLE) AS fast, list_reduce(cs, lambda a, x: a + (x - a) * 2 / 51::DOUBLE) AS slow FROM hb) WHERE symbol = 'view' AND len(cs) >= 50 AND fast < slow AND cs[-1] < slow),
fl AS (SELECT trade_id, count(*) {_F6} AS n_trades, sum(price * qty) {_F6} AS quote_vol, sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) {_F6} / sum(qty) {_F6} AS ratio FROM trades),
g AS (SELECT tick_id, t.symbol, us, price AS p, k % 50 != 0 AS live, (hour(ts) + 20) % 24 < 8 OR (hour(ts) + 20) % 24 > 22 AS blocked, t.symbol IN (SELECT symbol FROM falling) AS down, n_trades, ratio, quote_vol / ((300000 + k * 10) / 2880.0::DOUBLE) AS rel,
  row_number() OVER (PARTITION BY t.symbol ORDER BY us, tick_id) AS rn FROM ticks t JOIN fl ON trade_id = tick_id WHERE t.symbol <> 'error'),
m AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, NULL::BIGINT AS tick_id, NULL::BIGINT AS us, NULL::VARCHAR AS kind, NULL::VARCHAR AS decision, NULL::VARCHAR AS reason, NULL::DOUBLE AS delta, NULL::DOUBLE AS o_trigger, NULL::DOUBLE AS stage, NULL::BIGINT AS o_build, NULL::BIGINT AS o_confirm, NULL::DOUBLE AS o_rel, NULL::DOUBLE AS o_ratio, NULL::BIGINT AS o_n,
    NULL::DOUBLE AS o_start, NULL::DOUBLE AS o_peak, NULL::DOUBLE AS o_noise, 'idle' AS st, 0::DOUBLE AS noise, NULL::DOUBLE AS seen, 0::DOUBLE AS low, 0::BIGINT AS low_us, 0::DOUBLE AS start, 0::BIGINT AS start_us, 0::DOUBLE AS nas, 0::DOUBLE AS peak, 0 AS stalled, NULL::BIGINT AS trig, NULL::BIGINT AS build, NULL::DOUBLE AS last, NULL::DOUBLE AS tprice, NULL::BIGINT AS alerted FROM g
  UNION ALL
  SELECT symbol, rn, tick_id, us, CASE WHEN rise AND blocked THEN 'near_miss' WHEN gate THEN 'alert' END, CASE WHEN rise AND blocked THEN 'blocked' WHEN gate AND stage3 > 4 THEN 'rejected' WHEN gate THEN 'passed' END, CASE WHEN rise AND blocked THEN 'operator_sleep' WHEN gate AND stage3 > 4 THEN 'late_entry' END, round(delta2, 3),
    CASE WHEN gate THEN tp END, CASE WHEN gate THEN stage3 END, CASE WHEN gate THEN build3 END, CASE WHEN gate THEN us - trig3 END, CASE WHEN gate THEN rel END, CASE WHEN gate THEN ratio END, CASE WHEN gate THEN n_trades END, CASE WHEN gate THEN start2 END, CASE WHEN gate THEN peak2 END, CASE WHEN gate THEN nas2 END,
    CASE WHEN conf THEN 'idle' ELSE st3 END, n, CASE WHEN live THEN p ELSE seen END, CASE WHEN conf THEN p ELSE low2 END, CASE WHEN conf THEN us ELSE low_us2 END, CASE WHEN conf THEN 0 ELSE start2 END, CASE WHEN conf THEN 0 ELSE start_us2 END, CASE WHEN conf THEN 0 ELSE nas2 END, CASE WHEN conf THEN 0 ELSE peak2 END, CASE WHEN conf THEN 0 ELSE stalled2 END,
    CASE WHEN NOT conf THEN trig3 END, CASE WHEN NOT conf THEN build3 END, p, CASE WHEN NOT conf THEN tp END, CASE WHEN gate AND stage3 <= 4 THEN us ELSE alerted END
  FROM (SELECT *, conf AND NOT (alerted IS NOT NULL AND us - alerted < {12 * HOUR}) AND rel >= 1 AS gate, round((p - tp) / tp * 100, 3) AS stage3
    FROM (SELECT *, CASE WHEN go AND trig IS NULL THEN us ELSE trig END AS trig3, CASE WHEN go AND trig IS NULL THEN CASE WHEN st2 = 'building' THEN us - start_us2 END ELSE build END AS build3, CASE WHEN go AND trig IS NULL THEN 'triggered' ELSE st2 END AS st3, CASE WHEN go THEN coalesce(tprice, p) ELSE tprice END AS tp,
        go AND coalesce(n_trades >= 3 AND ratio >= 0.55, false) AS conf
      FROM (SELECT *, rise AND NOT blocked AS go, CASE WHEN declares THEN 'building' WHEN ends THEN 'idle' ELSE st END AS st2, CASE WHEN ends THEN p ELSE lo END AS low2, CASE WHEN ends THEN us ELSE lo_us END AS low_us2, CASE WHEN declares THEN lo WHEN ends THEN 0 ELSE start END AS start2, CASE WHEN declares THEN lo_us WHEN ends THEN 0 ELSE start_us END AS start_us2,
          CASE WHEN declares THEN n WHEN ends THEN 0 ELSE nas END AS nas2, CASE WHEN declares THEN p WHEN ends THEN 0 WHEN live AND st = 'building' THEN greatest(peak, p) ELSE peak END AS peak2, CASE WHEN declares OR ends THEN 0 WHEN live AND st = 'building' THEN stalled + 1 ELSE stalled END AS stalled2
        FROM (SELECT *, live AND st = 'idle' AND 2.5::DOUBLE * n > 0 AND p - lo > 2.5::DOUBLE * n AS declares, live AND st = 'building' AND ((1.5::DOUBLE * n > 0 AND greatest(peak, p) - p > 1.5::DOUBLE * n) OR stalled >= 3) AS ends, (p - last) / last * 100 AS delta2, live AND coalesce((p - last) / last * 100 >= 2, false) AND NOT down AS rise
          FROM (SELECT g.*, CASE WHEN NOT live THEN noise WHEN seen IS NULL THEN p * 0.0001::DOUBLE * 0.9::DOUBLE ELSE noise + 0.1::DOUBLE * (abs(p - seen) - noise) END AS n, CASE WHEN live AND (seen IS NULL OR (st = 'idle' AND p <= low)) THEN p ELSE low END AS lo, CASE WHEN live AND (seen IS NULL OR (st = 'idle' AND p <= low)) THEN g.us ELSE low_us END AS lo_us,
              st, seen, noise, start, start_us, nas, peak, stalled, trig, build, last, tprice, alerted FROM m JOIN g ON g.symbol = m.symbol AND g.rn = m.rn + 1)))))) """


def queries():
    """Those that write tables, or run streams, on the way keep their rows alone."""
    writing = "write_day_partitioned horizon_quality late_data_policy stream_idempotent_sink stream_move_states quarantine late_side_table stream_outcomes stream_batch_ledger alert_dedup".split()
    return {name: kept_only(globals()[name]) if name in writing else globals()[name] for name in ORACLES}


def oracle_sql():
    found = {name: sql if name in _OWN else f"WITH {market.SQL} {sql}" for name, sql in ORACLES.items() if sql}
    return found | {"pump_fast_detect": _DETECT + ORACLES["pump_fast_detect"], "pump_fast_alerts": _DETECT.replace("WHERE t.symbol <> 'error')", "WHERE t.symbol <> 'error' AND (hour(ts) + 20) % 24 BETWEEN 8 AND 22)") + ORACLES["pump_fast_detect"], "alert_dedup": _DEDUP + ORACLES["alert_dedup"], "horizon_quality": lb._W + f"SELECT CAST(horizon_min AS INT) AS horizon_min, {lb._QUALITY.format('reason')} AS quality_flag, reason AS reason_code, count(*) AS n FROM hp GROUP BY ALL"}
