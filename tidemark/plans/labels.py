"""Queries of the label job and the research dataset over the market views, with the SQL for the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quotes as qf
from ..operators import dataset as ds
from ..operators import labels as lb
from ..operators.stage import kept_only, staged
from ..operators.timejoin import asof
from ..sources import market

P = lb.FIXTURE
H = lb.HOUR


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles with so many digits; ``nudge`` moves shares off the exact halves that they often are."""
    return df.select(*(F.round(F.col(c) + nudge if nudge else c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


class Job:
    """The label job over the market views: each part is made and written once, whatever number of parts reads it."""

    def __init__(self, s: SparkSession, d: str):
        self.candidates, self.ticks, self.features = market.candidates(s, d), market.ticks(s, d), market.features(s, d)

    @cached_property
    def index(self) -> DataFrame:
        return staged(lb.label_index(self.ticks, P), "ticks")

    @cached_property
    def anchor(self) -> DataFrame:
        return staged(lb.anchor_price(self.candidates, self.index, P), "anchor")

    @cached_property
    def sigma(self) -> DataFrame:
        return staged(lb.sigma_event(self.candidates, self.index, P), "sigma")

    @cached_property
    def anchored(self) -> DataFrame:
        return self.anchor.filter("anchor_quality <> 'bad'").select("event_id", "symbol", "us", "p_anchor")

    @cached_property
    def horizons(self) -> DataFrame:
        priced = self.anchored.join(self.sigma.filter("sigma is not null").select("event_id"), "event_id")
        return staged(lb.horizon_price(priced, self.index, self.ticks, P), "horizons")

    @cached_property
    def labels(self) -> DataFrame:
        return staged(lb.label_quality(self.anchor, self.sigma, self.horizons), "labels")

    @cached_property
    def barrier(self) -> DataFrame:
        return lb.triple_barrier(self.anchored, self.sigma, self.horizons, self.index, P)

    def clean(self) -> DataFrame:
        facts = self.labels.join(self.sigma.select("event_id", "sigma"), "event_id").join(self.anchor.select("event_id", "anchor_lag_ms", "coverage_ms"), "event_id")
        return ds.clean_dataset(self.candidates, self.features, facts, self.horizons, self.barrier)


def _anchor(s, d):
    return Job(s, d).anchor


def _sigma(s, d):
    return Job(s, d).sigma


def _horizons(s, d):
    return Job(s, d).horizons


def book_clean(s: SparkSession, d: str) -> DataFrame:
    return rounded(lb.book_clean(market.ticks(s, d)))


def anchor_price(s: SparkSession, d: str) -> DataFrame:
    return rounded(_anchor(s, d).drop("symbol", "us"))


def sigma_event(s: SparkSession, d: str) -> DataFrame:
    return rounded(_sigma(s, d))


def horizon_price(s: SparkSession, d: str) -> DataFrame:
    return rounded(_horizons(s, d).drop("symbol", "us", "p_anchor", "ret_h", "mfe_h", "mae_h"))


def markouts(s: SparkSession, d: str) -> DataFrame:
    return rounded(_horizons(s, d).select("event_id", "horizon_min", "ret_h", "mfe_h", "mae_h"))


def triple_barrier(s: SparkSession, d: str) -> DataFrame:
    return Job(s, d).barrier


def _labels(s, d):
    return Job(s, d).labels


def label_quality(s: SparkSession, d: str) -> DataFrame:
    return _labels(s, d)


def _clean(s, d):
    return Job(s, d).clean()


CLEAN = "event_id symbol n_trades label_quality reason_code tb_label good_event sigma anchor_lag_ms coverage_ms ret_h mfe_h mae_h forward_lag_ratio points_used dataset_bucket n_trades_bucket needs_downweight is_n_trades_sweet_spot is_usable".split()


def clean_dataset(s: SparkSession, d: str) -> DataFrame:
    return rounded(_clean(s, d).select(*CLEAN))


def bucket_profile(s: SparkSession, d: str) -> DataFrame:
    return rounded(ds.bucket_profile(_clean(s, d)))


def trades_profile(s: SparkSession, d: str) -> DataFrame:
    return rounded(ds.trades_profile(_clean(s, d)))


def clean_view_asserts(s: SparkSession, d: str) -> DataFrame:
    return ds.clean_view_asserts(_clean(s, d))


def clean_view_asserts_broken(s: SparkSession, d: str) -> DataFrame:
    """The same counters over a copy with faults: an event twice, buckets, flags and labels that disagree."""
    c = Job(s, d).clean()
    k = F.substring("event_id", 4, 20).cast("long") % 7
    broken = c.withColumns({
        "needs_downweight": F.when(k == 0, ~F.col("needs_downweight")).otherwise(F.col("needs_downweight")), "is_n_trades_sweet_spot": F.when(k == 1, ~F.col("is_n_trades_sweet_spot")).otherwise(F.col("is_n_trades_sweet_spot")),
        "dataset_bucket": F.when(k == 2, "ok_only").when((k == 6) & (F.col("reason_code") == "degraded_low_density"), "other_degraded").when((k == 6) & (F.col("tb_label") == 1), "degraded_low_density").when(k == 6, "other_unknown").otherwise(F.col("dataset_bucket")), "is_usable": F.when(k != 4, F.col("is_usable")),
    })
    return ds.clean_view_asserts(broken.union(broken.filter(k == 5)))


def quality_ratio(s: SparkSession, d: str) -> DataFrame:
    return rounded(ds.quality_ratio(_labels(s, d)))


def orphan_audit(s: SparkSession, d: str) -> DataFrame:
    return ds.orphans(market.candidates(s, d), market.features(s, d), "event_id").select("event_id", "symbol")


def orphan_attempts(s: SparkSession, d: str) -> DataFrame:
    """Attempts at labels of events that have none."""
    attempts = market.events(s, d).filter("event_id % 10 = 3").select(F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("event_id"), "us")
    return ds.orphans(attempts, market.candidates(s, d), "event_id")


def overdue_retries(s: SparkSession, d: str) -> DataFrame:
    """The twenty retries that have waited longest beyond their time."""
    state = _state(s, d)
    got = ds.retry_classify(state, ds.retry_policy(s), F.col("us")).join(state.select("event_id", F.col("reason_code").alias("quality_reason_code")), "event_id")
    now = market.candidates(s, d).agg(F.max("us")).first()[0] or 0
    return ds.overdue_retries(got, ds.retry_policy(s), now)


def null_profile(s: SparkSession, d: str) -> DataFrame:
    h = _horizons(s, d)
    return h.groupBy("horizon_min").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ret_h").isNull()).alias("null_ret"), F.count_if(F.col("points_used") == 0).alias("no_points"), F.count_if(F.col("sampling_method") == "first_after").alias("first_after"))


def dup_check(s: SparkSession, d: str) -> DataFrame:
    job = Job(s, d)
    c, whole = job.clean(), job.labels.agg(F.count(F.lit(1)).alias("labelled"))
    n = c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))
    return n.crossJoin(whole).withColumn("duplicates", F.col("n") - F.col("ids"))


def asof_backward(s: SparkSession, d: str) -> DataFrame:
    e = market.candidates(s, d).withColumn("target", F.col("us") + H).select("event_id", "symbol", "target")
    return rounded(asof(e, market.ticks(s, d), "target", H, key="event_id", value=["price"]).select("event_id", "asof_price", "asof_lag_us"))


def asof_forward(s: SparkSession, d: str) -> DataFrame:
    e = market.candidates(s, d).withColumn("target", F.col("us") + H).select("event_id", "symbol", "target")
    return rounded(asof(e, market.ticks(s, d), "target", H // 2, key="event_id", value=["price"], forward=True).select("event_id", "asof_price", "asof_lag_us"))


def _state(s, d):
    e = market.candidates(s, d).join(market.events(s, d).select(F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("event_id"), "k"), "event_id")
    k = F.col("k")
    reason = F.element_at(F.array(*map(F.lit, [r for r, *_ in ds.RETRY_POLICY]), F.lit("bad_unknown"), F.lit(None)), k % 8 + 1)
    return e.withColumn("label_quality", F.when(k % 3 == 0, "ok").when(k % 3 == 1, "degraded").otherwise("bad")).withColumn("reason_code", F.when(F.col("label_quality") == "bad", reason)).withColumn("retry_count", k % 7)


def retry_classify(s: SparkSession, d: str) -> DataFrame:
    return ds.retry_classify(_state(s, d), ds.retry_policy(s), F.col("us"))


def _pending(s: SparkSession, d: str) -> DataFrame:
    state = _state(s, d)
    got = ds.retry_classify(state, ds.retry_policy(s), F.col("us")).join(state.select("event_id", F.col("reason_code").alias("quality_reason_code"), "k"), "event_id").filter("k % 4 <> 0")
    e = market.candidates(s, d)
    now = e.agg(F.max("us")).first()[0] or 0
    return ds.pending_events(e, got, ds.retry_policy(s), now, 24 * H)


def pending_events(s: SparkSession, d: str) -> DataFrame:
    return _pending(s, d).select("event_id", "symbol", "retry_count", "quality_reason_code")


def oldest_pending_topk(s: SparkSession, d: str) -> DataFrame:
    return ds.oldest_pending(_pending(s, d)).select("event_id", "us", "retry_count", "quality_reason_code")


def retry_health(s: SparkSession, d: str) -> DataFrame:
    r = ds.retry_classify(_state(s, d), ds.retry_policy(s), F.col("us"))
    return rounded(r.groupBy("worker_status").agg(F.count(F.lit(1)).alias("n"), F.avg("retry_count").alias("avg_retries")))


def _versions(s, d):
    f = market.features(s, d)
    number = F.regexp_extract("event_id", "[0-9]+", 0).cast("long")
    return f.filter(number % 3 != 0), f.filter(number % 2 == 0).withColumn("n_trades", F.lit(99)).withColumn("stage_pct", F.lit(-1.0))


def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    target, batch = _versions(s, d)
    return rounded(ds.upsert_latest(target, batch, "event_id", ["n_trades", "noise"]))


def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    target, batch = _versions(s, d)
    return rounded(ds.insert_if_absent(target, batch.union(batch), "event_id"))


def dataset_regression_diff(s: SparkSession, d: str) -> DataFrame:
    a, b = _versions(s, d)
    return ds.regression_diff(a.select("event_id", "n_trades"), b.select("event_id", "n_trades"), ["event_id"])


_RANK = """CASE r WHEN 'bad_invalid_book' THEN 0 WHEN 'bad_missing_quotes' THEN 1 WHEN 'bad_time_inconsistency' THEN 2 WHEN 'bad_stale_data' THEN 3 WHEN 'bad_sigma' THEN 4 WHEN 'bad_labeler_exception' THEN 5
  WHEN 'degraded_quote_skew' THEN 6 WHEN 'degraded_low_density' THEN 7 WHEN 'degraded_high_lag' THEN 8 WHEN 'degraded_wide_spread' THEN 9 WHEN 'degraded_unstable_window' THEN 10 END"""
_QUALITY = "CASE WHEN {0} IS NULL THEN 'ok' WHEN starts_with({0}, 'bad') THEN 'bad' ELSE 'degraded' END"
_POLICY = """policy(reason_code, retryable, is_terminal, max_retries, cooldown_seconds, priority) AS (VALUES ('bad_invalid_book', false, true, 0, 0, 10), ('bad_sigma', false, true, 0, 0, 10), ('bad_time_inconsistency', false, true, 0, 0, 10),
  ('bad_missing_quotes', true, false, 3, 300, 50), ('bad_stale_data', true, false, 5, 600, 50), ('bad_labeler_exception', true, false, 3, 900, 50))"""
_W = f"""WITH {market.SQL},
q AS (SELECT tick_id, symbol, us, CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN (bid + ask) / 2 END AS mid,
             CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN (ask - bid) / ((bid + ask) / 2) * 10000 END AS spread FROM ticks),
an AS (SELECT c.event_id, c.symbol, c.us, count(q.us) AS raw, count(mid) AS n, median(mid) AS p_anchor, (c.us - max(q.us) FILTER (mid IS NOT NULL)) / 1000.0 AS lag,
              (max(q.us) FILTER (mid IS NOT NULL) - min(q.us) FILTER (mid IS NOT NULL)) / 1000.0 AS cover, median(spread) AS spread,
              CASE WHEN stddev_samp(spread) > 0 THEN (median(spread) - avg(spread)) / stddev_samp(spread) END AS z
       FROM candidates c LEFT JOIN q ON c.symbol = q.symbol AND q.us >= c.us - {P.anchor_us} AND q.us < c.us GROUP BY c.event_id, c.symbol, c.us),
anchor AS (SELECT *, CASE WHEN raw = 0 THEN 'bad_missing_quotes' WHEN n = 0 THEN 'bad_invalid_book' WHEN lag > {P.anchor_lag_us * 3 / 1000} THEN 'bad_stale_data' WHEN n < 3 THEN 'degraded_low_density'
                  WHEN lag > {P.anchor_lag_us / 1000} THEN 'degraded_high_lag' WHEN cover < {P.anchor_coverage_us / 1000} THEN 'degraded_unstable_window' WHEN z > 3 THEN 'degraded_wide_spread' END AS reason FROM an),
sraw AS (SELECT c.event_id, count(q.us) AS raw FROM candidates c LEFT JOIN q ON c.symbol = q.symbol AND q.us >= c.us - {P.sigma_us} AND q.us < c.us GROUP BY ALL),
slots AS (SELECT c.event_id, (q.us - (c.us - {P.sigma_us})) // {P.sigma_step_us} AS slot, arg_max(mid, q.us) AS m FROM candidates c JOIN q ON c.symbol = q.symbol AND q.us >= c.us - {P.sigma_us} AND q.us < c.us WHERE mid IS NOT NULL GROUP BY ALL),
grid AS (SELECT event_id, unnest(range({P.sigma_us // P.sigma_step_us})) AS slot FROM (SELECT DISTINCT event_id FROM slots)),
filled AS (SELECT g.event_id, g.slot, coalesce(a.m, b.m) AS m FROM grid g LEFT JOIN slots a USING (event_id, slot) LEFT JOIN slots b ON b.event_id = g.event_id AND b.slot = g.slot - 1),
rets AS (SELECT event_id, ln(m / lag(m) OVER (PARTITION BY event_id ORDER BY slot)) AS r FROM filled),
sg AS (SELECT event_id, count(r) AS n, stddev_samp(r) AS sd FROM rets GROUP BY ALL),
sigma AS (SELECT sraw.event_id, CASE WHEN raw >= 2 AND sd > 1e-10 THEN sd END AS sigma, CASE WHEN raw >= 2 THEN coalesce(n, 0) ELSE 0 END AS obs,
                 CASE WHEN NOT coalesce(raw >= 2 AND sd > 1e-10, false) THEN 'bad_sigma' WHEN n < {P.sigma_obs} THEN 'degraded_low_density' END AS reason FROM sraw LEFT JOIN sg USING (event_id)),
eh AS (SELECT a.event_id, a.symbol, a.us, p_anchor, h AS horizon_min, a.us + h * {P.minute_us}::BIGINT AS th, CASE WHEN h <= 15 THEN {P.short_us} ELSE {P.long_us} END AS d
       FROM anchor a JOIN sigma s USING (event_id), (VALUES (5), (15), (30), (60), (120)) v(h) WHERE NOT coalesce(starts_with(a.reason, 'bad'), false) AND sigma IS NOT NULL),
hw AS (SELECT eh.*, w.kind, count(mid) AS n, median(mid) AS p, min(abs(q.us - th)) AS lag, max(q.us) - min(q.us) AS span, median(spread) AS spread,
              CASE WHEN stddev_samp(spread) > 0 THEN (median(spread) - avg(spread)) / stddev_samp(spread) END AS z, quantile_cont(mid, 0.75) - quantile_cont(mid, 0.25) AS iqr
       FROM eh, (VALUES (1), (2)) w(kind) JOIN q ON q.symbol = eh.symbol AND mid IS NOT NULL AND q.us BETWEEN th - CASE WHEN w.kind = 2 THEN d ELSE 0 END AND th + d GROUP BY ALL HAVING count(mid) >= 3),
best AS (SELECT * FROM hw QUALIFY row_number() OVER (PARTITION BY event_id, horizon_min ORDER BY kind) = 1),
nxt AS (SELECT eh.event_id, horizon_min, arg_min(q.us, q.us) AS nat, arg_min(coalesce(mid, -1), q.us) AS m, arg_min(coalesce(spread, -1), q.us) AS sp FROM eh JOIN q ON q.symbol = eh.symbol AND q.us >= th GROUP BY ALL),
scan AS (SELECT eh.event_id, horizon_min, max(mid) AS high, min(mid) AS low FROM eh JOIN q ON q.symbol = eh.symbol AND q.us BETWEEN eh.us AND th GROUP BY ALL),
hp0 AS (SELECT eh.*, b.kind, b.n AS bn, b.p AS bp, b.lag AS blag, b.span AS bspan, b.spread AS bspread, b.z, CASE WHEN b.n >= 4 THEN b.iqr / eh.p_anchor * 10000 END AS iqr,
               b.kind IS NULL AND coalesce(x.m, -1) >= 0 AS fa, x.nat, x.m, x.sp, high, low, CASE WHEN b.kind = 2 THEN 2 * eh.d ELSE eh.d END AS win
        FROM eh LEFT JOIN best b USING (event_id, horizon_min) LEFT JOIN nxt x USING (event_id, horizon_min) LEFT JOIN scan USING (event_id, horizon_min)),
hp1 AS (SELECT *, CASE WHEN fa THEN m ELSE bp END AS p_h, CASE WHEN fa THEN 1 ELSE coalesce(bn, 0) END AS points, CASE WHEN fa THEN nat - th ELSE blag END AS lag,
               CASE WHEN fa THEN 1.0::DOUBLE ELSE blag / win END AS ratio, CASE WHEN fa THEN nat - th ELSE bspan END AS span, CASE WHEN fa THEN sp ELSE bspread END AS spr FROM hp0),
hp AS (SELECT *, CASE WHEN points = 0 THEN 'bad_missing_quotes' WHEN fa THEN 'degraded_low_density' WHEN ratio > 0.5 THEN 'bad_stale_data' WHEN span < win * 0.5 THEN 'degraded_unstable_window'
              WHEN ratio > 0.1 THEN 'degraded_high_lag' WHEN z > 3 THEN 'degraded_wide_spread' WHEN iqr > {P.iqr_bps} THEN 'degraded_unstable_window' END AS reason FROM hp1),
ranked AS (SELECT event_id, reason AS r, 1 AS early FROM anchor UNION ALL SELECT event_id, reason, 1 FROM sigma UNION ALL SELECT event_id, reason, 0 FROM hp),
lab AS (SELECT event_id, arg_min(r, {_RANK}) FILTER (r IS NOT NULL) AS reason_code FROM ranked GROUP BY ALL),
labels AS (SELECT event_id, {_QUALITY.format("reason_code")} AS label_quality, reason_code FROM lab),
tb AS (SELECT eh.event_id, coalesce(any_value(side), 0) AS tb_label, coalesce(any_value(side), 0) = 1 AS good_event, CASE coalesce(any_value(side), 0) WHEN 1 THEN 'upper' WHEN -1 THEN 'lower' ELSE 'vertical' END AS first_touch, any_value(after) // 1000 AS time_to_barrier_ms
        FROM eh LEFT JOIN (SELECT eh.event_id, arg_min(CASE WHEN mid >= eh.p_anchor * (1 + sigma) THEN 1 ELSE -1 END, q.us) AS side, min(q.us) - any_value(eh.us) AS after FROM eh JOIN sigma USING (event_id) JOIN hp USING (event_id, horizon_min)
          JOIN q ON q.symbol = eh.symbol AND q.us BETWEEN eh.us AND eh.th WHERE horizon_min = 30 AND p_h IS NOT NULL AND (mid >= eh.p_anchor * (1 + sigma) OR mid <= eh.p_anchor * (1 - sigma)) GROUP BY ALL) USING (event_id) WHERE horizon_min = 30 GROUP BY eh.event_id),
cl AS (SELECT c.event_id, c.symbol, tb_label, good_event, sigma, anchor.lag AS anchor_lag_ms, anchor.cover AS coverage_ms, ratio AS forward_lag_ratio, points AS points_used, n_trades, label_quality, reason_code, (p_h - hp.p_anchor) / hp.p_anchor AS ret_h, CASE WHEN p_h IS NOT NULL THEN (high - hp.p_anchor) / hp.p_anchor END AS mfe_h, CASE WHEN p_h IS NOT NULL THEN (low - hp.p_anchor) / hp.p_anchor END AS mae_h
       FROM candidates c JOIN features USING (event_id) JOIN labels USING (event_id) JOIN hp USING (event_id) JOIN sigma USING (event_id) JOIN anchor USING (event_id) LEFT JOIN tb USING (event_id) WHERE horizon_min = 30 AND (label_quality = 'ok' OR reason_code IN ('degraded_low_density', 'degraded_high_lag', 'degraded_unstable_window'))),
clean AS (SELECT *, CASE WHEN label_quality = 'ok' THEN 'ok_only' WHEN reason_code = 'degraded_low_density' THEN 'degraded_low_density' ELSE 'other_degraded' END AS dataset_bucket,
                 CASE WHEN n_trades IS NULL THEN 'OUT_OF_RANGE' WHEN n_trades <= 5 THEN 'Q1_le_5' WHEN n_trades <= 9 THEN 'Q2_6_9' WHEN n_trades <= 19 THEN 'Q3_10_19' ELSE 'Q4_19_plus' END AS n_trades_bucket FROM cl),
{_POLICY},
st AS (SELECT c.*, k, CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' ELSE 'bad' END AS label_quality, k % 7 AS retry_count,
              CASE WHEN k % 3 = 2 THEN (['bad_invalid_book', 'bad_sigma', 'bad_time_inconsistency', 'bad_missing_quotes', 'bad_stale_data', 'bad_labeler_exception', 'bad_unknown', NULL])[k % 8 + 1] END AS reason_code FROM candidates c JOIN ev ON c.event_id = 'ev_' || ev.event_id),
rc AS (SELECT st.event_id, k, st.reason_code, label_quality != 'bad' AS done, coalesce(label_quality = 'bad' AND retryable AND retry_count + 1 <= max_retries, false) AS waits, retryable, retry_count, us, cooldown_seconds FROM st LEFT JOIN policy USING (reason_code)),
rcl AS (SELECT event_id, k, reason_code, CASE WHEN done THEN 'done' WHEN waits THEN 'retry_wait' ELSE 'terminal' END AS worker_status, NOT waits AS is_terminal, waits AS is_retryable, CASE WHEN done THEN retry_count ELSE retry_count + 1 END AS retry_count,
               CASE WHEN waits THEN us + cooldown_seconds * 1000000 END AS next_retry_us,
               CASE WHEN NOT done AND NOT waits THEN CASE WHEN reason_code IS NULL THEN 'bad_labeler_exception' WHEN coalesce(retryable, false) THEN 'retry_exhausted:' || reason_code ELSE reason_code END END AS terminal_reason_code FROM rc),
tgt AS (SELECT * FROM features WHERE CAST(substr(event_id, 4) AS BIGINT) % 3 != 0),
bat AS (SELECT event_id, 99 AS n_trades, -1.0::DOUBLE AS stage_pct, noise FROM features WHERE CAST(substr(event_id, 4) AS BIGINT) % 2 = 0)
"""

_ASOF = """SELECT c.event_id, round({arg}(price, t.us), 6) AS asof_price, CASE WHEN count(t.us) > 0 THEN {lag} END AS asof_lag_us
FROM candidates c LEFT JOIN ticks t ON c.symbol = t.symbol AND t.us BETWEEN {low} AND {high} GROUP BY c.event_id, c.us"""

_ASSERTS = """, flagged AS (SELECT *, dataset_bucket = 'degraded_low_density' AS dw, n_trades_bucket IN ('Q2_6_9', 'Q3_10_19') AS sweet, true AS usable, CAST(substr(event_id, 4) AS BIGINT) % 7 AS k FROM clean),
broken AS (SELECT * REPLACE (CASE WHEN k = 0 THEN NOT dw ELSE dw END AS dw, CASE WHEN k = 1 THEN NOT sweet ELSE sweet END AS sweet, CASE WHEN k = 2 THEN 'ok_only' WHEN k = 6 AND reason_code = 'degraded_low_density' THEN 'other_degraded' WHEN k = 6 AND tb_label = 1 THEN 'degraded_low_density' WHEN k = 6 THEN 'other_unknown' ELSE dataset_bucket END AS dataset_bucket, CASE WHEN k <> 4 THEN usable END AS usable) FROM flagged),
told AS (SELECT count(*) - count(DISTINCT event_id) AS duplicates, count(*) FILTER (dataset_bucket = 'other_unknown') AS "unknown",
  count(*) FILTER (dataset_bucket = 'degraded_low_density' AND NOT dw) AS low_not_downweight, count(*) FILTER (dataset_bucket <> 'degraded_low_density' AND dw) AS downweight_not_low,
  count(*) FILTER (n_trades_bucket IN ('Q2_6_9', 'Q3_10_19') AND NOT sweet) AS sweet_bucket_not_flag, count(*) FILTER (n_trades_bucket NOT IN ('Q2_6_9', 'Q3_10_19') AND sweet) AS sweet_flag_not_bucket,
  count(*) FILTER (usable IS DISTINCT FROM true) AS unusable, count(*) FILTER (dataset_bucket = 'ok_only' AND label_quality <> 'ok') AS ok_bucket_other_label,
  count(*) FILTER (dataset_bucket = 'degraded_low_density' AND reason_code <> 'degraded_low_density') AS low_bucket_other_reason,
  count(*) FILTER (dataset_bucket = 'other_degraded' AND reason_code NOT IN ('degraded_high_lag', 'degraded_unstable_window')) AS other_bucket_other_reason, count(*) FILTER (label_quality = 'ok') AS ok_rows FROM {rows})
SELECT *, duplicates + "unknown" + low_not_downweight + downweight_not_low + sweet_bucket_not_flag + sweet_flag_not_bucket + unusable + ok_bucket_other_label + low_bucket_other_reason + other_bucket_other_reason = 0 AND ok_rows > 0 AS passed FROM told"""

ORACLES = {
    "book_clean": "SELECT tick_id, symbol, us, round(mid, 6) AS mid, round(spread, 6) AS spread_bps FROM q WHERE mid IS NOT NULL",
    "anchor_price": f"SELECT event_id, round(p_anchor, 6) AS p_anchor, n AS anchor_points, round(lag, 6) AS anchor_lag_ms, round(cover, 6) AS coverage_ms, round(spread, 6) AS spread, round(z, 6) AS spread_z, {_QUALITY.format('reason')} AS anchor_quality, reason AS anchor_reason FROM anchor",
    "sigma_event": f"SELECT event_id, round(sigma, 6) AS sigma, obs AS sigma_obs, {_QUALITY.format('reason')} AS sigma_quality, reason AS sigma_reason FROM sigma",
    "horizon_price": f"""SELECT event_id, horizon_min, round(p_h, 6) AS p_h, CASE WHEN kind = 1 THEN 'median_forward' WHEN kind = 2 THEN 'median_symmetric' WHEN fa THEN 'first_after' END AS sampling_method, CAST(points AS INT) AS points_used,
        round(lag / 1000.0, 6) AS forward_lag_ms, round(ratio, 6) AS forward_lag_ratio, round(span / 1000.0, 6) AS window_span_ms, round(spr, 6) AS spread_bps, round(z, 6) AS spread_z, round(iqr, 6) AS mid_iqr_bps, {_QUALITY.format('reason')} AS quality_flag, reason AS reason_code FROM hp""",
    "markouts": "SELECT event_id, horizon_min, round((p_h - p_anchor) / p_anchor, 6) AS ret_h, round(CASE WHEN p_h IS NOT NULL THEN (high - p_anchor) / p_anchor END, 6) AS mfe_h, round(CASE WHEN p_h IS NOT NULL THEN (low - p_anchor) / p_anchor END, 6) AS mae_h FROM hp",
    "triple_barrier": "SELECT * FROM tb",
    "label_quality": "SELECT * FROM labels",
    "clean_dataset": """SELECT event_id, symbol, n_trades, label_quality, reason_code, tb_label, good_event, round(sigma, 6) AS sigma, round(anchor_lag_ms, 6) AS anchor_lag_ms, round(coverage_ms, 6) AS coverage_ms, round(ret_h, 6) AS ret_h, round(mfe_h, 6) AS mfe_h,
        round(mae_h, 6) AS mae_h, round(forward_lag_ratio, 6) AS forward_lag_ratio, CAST(points_used AS INT) AS points_used, dataset_bucket, n_trades_bucket, dataset_bucket = 'degraded_low_density' AS needs_downweight, n_trades_bucket IN ('Q2_6_9', 'Q3_10_19') AS is_n_trades_sweet_spot, true AS is_usable FROM clean""",
    "bucket_profile": """SELECT dataset_bucket, count(*) AS n, round(avg(CASE WHEN good_event IS TRUE THEN 1.0 ELSE 0.0 END), 6) AS good_rate, round(avg(ret_h), 6) AS avg_ret, round(avg(mfe_h), 6) AS avg_mfe, count(*) FILTER (dataset_bucket = 'degraded_low_density') AS n_downweight,
        count(*) FILTER (n_trades BETWEEN 6 AND 19) AS n_sweet, CASE dataset_bucket WHEN 'ok_only' THEN 1 WHEN 'other_degraded' THEN 2 WHEN 'degraded_low_density' THEN 3 ELSE 4 END AS place FROM clean GROUP BY ALL""",
    "trades_profile": """SELECT n_trades_bucket, count(*) AS n, round(avg(CASE WHEN good_event IS TRUE THEN 1.0 ELSE 0.0 END), 6) AS good_rate, round(avg(ret_h), 6) AS avg_ret,
        CASE n_trades_bucket WHEN 'Q1_le_5' THEN 1 WHEN 'Q2_6_9' THEN 2 WHEN 'Q3_10_19' THEN 3 WHEN 'Q4_19_plus' THEN 4 ELSE 5 END AS place FROM clean GROUP BY ALL""",
    "clean_view_asserts": _ASSERTS.format(rows="flagged"),
    "clean_view_asserts_broken": _ASSERTS.format(rows="(SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE k = 5)"),
    "quality_ratio": "SELECT label_quality, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS ratio FROM labels GROUP BY ALL",
    "orphan_audit": "SELECT event_id, symbol FROM candidates ANTI JOIN features USING (event_id)",
    "orphan_attempts": "SELECT 'ev_' || event_id AS event_id, us FROM ev WHERE event_id % 10 = 3 AND event_id % 20 <> 3",
    "overdue_retries": "SELECT event_id, reason_code AS quality_reason_code, retry_count, next_retry_us, max_retries FROM rcl JOIN policy USING (reason_code) WHERE worker_status = 'retry_wait' AND next_retry_us <= (SELECT max(us) FROM candidates) ORDER BY next_retry_us, event_id LIMIT 20",
    "null_profile": "SELECT horizon_min, count(*) AS n, count(*) FILTER (p_h IS NULL) AS null_ret, count(*) FILTER (points = 0) AS no_points, count(*) FILTER (fa) AS first_after FROM hp GROUP BY ALL",
    "dup_check": "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, (SELECT count(*) FROM labels) AS labelled, count(*) - count(DISTINCT event_id) AS duplicates FROM clean",
    "asof_backward": _ASOF.format(arg="arg_max", lag=f"c.us + {H} - max(t.us)", low="c.us", high=f"c.us + {H}"),
    "asof_forward": _ASOF.format(arg="arg_min", lag=f"min(t.us) - (c.us + {H})", low=f"c.us + {H}", high=f"c.us + {H + H // 2}"),
    "retry_classify": "SELECT * EXCLUDE (k, reason_code) FROM rcl",
    "pending_events": f"""SELECT c.event_id, c.symbol, coalesce(r.retry_count, 0) AS retry_count, r.reason_code AS quality_reason_code FROM candidates c LEFT JOIN (SELECT * FROM rcl WHERE k % 4 != 0) r USING (event_id) LEFT JOIN policy p ON p.reason_code = r.reason_code
        WHERE c.us < (SELECT max(us) FROM candidates) - {24 * H} AND (r.event_id IS NULL OR (worker_status = 'retry_wait' AND is_retryable AND next_retry_us <= (SELECT max(us) FROM candidates) AND r.retry_count < coalesce(max_retries, 0)))""",
    "oldest_pending_topk": f"""SELECT c.event_id, c.us, coalesce(r.retry_count, 0) AS retry_count, r.reason_code AS quality_reason_code FROM candidates c LEFT JOIN (SELECT * FROM rcl WHERE k % 4 != 0) r USING (event_id) LEFT JOIN policy p ON p.reason_code = r.reason_code
        WHERE c.us < (SELECT max(us) FROM candidates) - {24 * H} AND (r.event_id IS NULL OR (worker_status = 'retry_wait' AND is_retryable AND next_retry_us <= (SELECT max(us) FROM candidates) AND r.retry_count < coalesce(max_retries, 0))) ORDER BY c.us, c.event_id LIMIT 50""",
    "retry_health": "SELECT worker_status, count(*) AS n, round(avg(retry_count), 6) AS avg_retries FROM rcl GROUP BY ALL",
    "upsert_latest": "SELECT event_id, CASE WHEN b.event_id IS NOT NULL THEN b.n_trades ELSE t.n_trades END AS n_trades, CASE WHEN t.event_id IS NULL THEN b.stage_pct ELSE t.stage_pct END AS stage_pct, CASE WHEN b.event_id IS NOT NULL THEN b.noise ELSE t.noise END AS noise FROM tgt t FULL JOIN bat b USING (event_id)",
    "insert_if_absent": "SELECT * FROM tgt UNION ALL SELECT * FROM bat ANTI JOIN tgt USING (event_id)",
    "dataset_regression_diff": "SELECT event_id, n_trades, 1::BIGINT AS n, 'only_a' AS side FROM (SELECT event_id, n_trades FROM tgt EXCEPT ALL SELECT event_id, n_trades FROM bat) UNION ALL SELECT event_id, n_trades, 1, 'only_b' FROM (SELECT event_id, n_trades FROM bat EXCEPT ALL SELECT event_id, n_trades FROM tgt)",
}


def queries():
    """Those that the label job makes tables for keep their rows alone."""
    of_job = "anchor_price sigma_event horizon_price markouts triple_barrier label_quality clean_dataset bucket_profile trades_profile clean_view_asserts clean_view_asserts_broken quality_ratio null_profile dup_check".split()
    return {name: kept_only(globals()[name]) if name in of_job else globals()[name] for name in ORACLES}


def oracle_sql():
    return {name: _W + sql for name, sql in ORACLES.items()}
