"""Labels of candidate events from the ticks around them: anchor price, volatility, horizon prices, markouts, triple barrier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import mid, spread_bps, valid_book
from .intervals import interval_reach, interval_stats, step_returns, tick_index
from .timejoin import asof_unbounded

SECOND, MINUTE, HOUR = 1_000_000, 60_000_000, 3_600_000_000

#: Reasons in order of priority, worst first.
REASONS = (
    "bad_invalid_book bad_missing_quotes bad_time_inconsistency bad_stale_data bad_sigma bad_labeler_exception "
    "degraded_quote_skew degraded_low_density degraded_high_lag degraded_wide_spread degraded_unstable_window"
).split()


@dataclass(frozen=True)
class LabelParams:
    anchor_us: int = 3 * SECOND
    anchor_lag_us: int = 1 * SECOND
    anchor_coverage_us: int = SECOND // 2
    anchor_points: int = 3
    sigma_us: int = 10 * MINUTE
    sigma_step_us: int = 2 * SECOND
    sigma_obs: int = 20
    minute_us: int = MINUTE
    horizons: tuple[int, ...] = (5, 15, 30, 60, 120)
    short_us: int = 16 * SECOND
    long_us: int = 30 * SECOND
    points: int = 3
    lag_ratio: float = 0.1
    iqr_bps: float = 50.0
    barrier: float = 1.0
    barrier_horizon: int = 30
    bucket_us: int = 10 * MINUTE
    span_us: int = 40 * MINUTE

    @property
    def ahead_us(self) -> int:
        """The longest of the windows whose ticks are looked at together."""
        return max(self.anchor_us, self.sigma_us, 2 * self.short_us, 2 * self.long_us)


#: Scaled to a table with a tick every 20 minutes, whose prices differ by a tenth.
FIXTURE = LabelParams(2 * HOUR, 40 * MINUTE, 20 * MINUTE, 3, 24 * HOUR, 30 * MINUTE, 20, 12 * MINUTE, (5, 15, 30, 60, 120), HOUR, 4 * HOUR, 3, 0.1, 2000.0, 1.0, 30, 72 * HOUR, 24 * HOUR)


def quoted(ticks: DataFrame) -> DataFrame:
    """Ticks with mid and spread_bps, null where the book is not valid."""
    return ticks.select("tick_id", "symbol", "us", mid(F.col("bid"), F.col("ask")).alias("mid"), spread_bps(F.col("bid"), F.col("ask")).alias("spread"))


def book_clean(ticks: DataFrame) -> DataFrame:
    b, a = F.col("bid"), F.col("ask")
    return ticks.filter(valid_book(b, a)).select("tick_id", "symbol", "us", mid(b, a).alias("mid"), spread_bps(b, a).alias("spread_bps"))


def label_index(ticks: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """The index of ``ticks`` that all labels are answered from; write it where several are made."""
    return tick_index(quoted(ticks), p.span_us, p.ahead_us)


def anchor_price(events: DataFrame, index: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """(event_id, p_anchor, anchor_points, anchor_lag_ms, coverage_ms, spread, spread_z, anchor_quality, anchor_reason) from the quotes in [t - window, t)."""
    us = F.col("us")
    got = interval_stats(index, events.select("event_id", "symbol", F.col("symbol").alias("of"), "us"), us - p.anchor_us, us - 1, us, p.span_us)
    n, lag, cover = F.col("n"), (us - F.col("last_us")) / 1000.0, (F.col("last_us") - F.col("first_us")) / 1000.0
    z = F.when(F.col("spread_sd") > 0, (F.col("spread_q50") - F.col("spread_mean")) / F.col("spread_sd"))
    reason = (
        F.when(F.col("raw") == 0, "bad_missing_quotes")
        .when(n == 0, "bad_invalid_book")
        .when(lag > p.anchor_lag_us * 3 / 1000.0, "bad_stale_data")
        .when(n < p.anchor_points, "degraded_low_density")
        .when(lag > p.anchor_lag_us / 1000.0, "degraded_high_lag")
        .when(cover < p.anchor_coverage_us / 1000.0, "degraded_unstable_window")
        .when(z > 3, "degraded_wide_spread")
    )
    return got.select("event_id", F.col("of").alias("symbol"), "us", F.col("mid_q50").alias("p_anchor"), n.alias("anchor_points"), lag.alias("anchor_lag_ms"), cover.alias("coverage_ms"), F.col("spread_q50").alias("spread"), z.alias("spread_z"), quality_of(reason).alias("anchor_quality"), reason.alias("anchor_reason"))


def quality_of(reason: Column) -> Column:
    return F.when(reason.isNull(), "ok").when(reason.startswith("bad"), "bad").otherwise("degraded")


def sigma_event(events: DataFrame, index: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """(event_id, sigma, sigma_obs, sigma_quality, sigma_reason): deviation of log returns of mids on a grid before t; the last valid mid of a step counts, one missing step is filled."""
    got = step_returns(index, events.select("event_id", "symbol", "us"), F.col("us"), p.sigma_us, p.sigma_step_us, p.span_us)
    ok = F.coalesce((F.col("raw") >= 2) & (F.col("sd") > 1e-10), F.lit(False))
    reason = F.when(~ok, "bad_sigma").when(F.col("n") < p.sigma_obs, "degraded_low_density")
    return got.select("event_id", F.when(ok, F.col("sd")).alias("sigma"), F.when(F.col("raw") >= 2, F.col("n")).otherwise(F.lit(0)).alias("sigma_obs"), quality_of(reason).alias("sigma_quality"), reason.alias("sigma_reason"))


def horizon_price(anchored: DataFrame, index: DataFrame, ticks: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """One row for each event of ``anchored`` (event_id, symbol, us, p_anchor) and horizon, with price, method, statistics, quality, and the best and worst return up to it.

    Median of [t + h, t + h + d] if it has enough valid quotes, else of [t + h - d, t + h + d], else the very next tick of
    ``ticks`` if its book is valid. Both windows and the way to the horizon are questions to the index: a few rows for each event and horizon.
    """
    grid = anchored.withColumn("horizon_min", F.explode(F.array(*map(F.lit, p.horizons)))).withColumn("th", F.col("us") + F.col("horizon_min").cast("long") * p.minute_us).withColumn("d", F.when(F.col("horizon_min") <= 15, p.short_us).otherwise(p.long_us))
    key = ["event_id", "horizon_min"]
    windows = grid.select(*key, "symbol", "th", "d", F.explode(F.array(F.lit("f"), F.lit("s"))).alias("tag"))
    stats = interval_stats(index, windows, F.col("th") - F.when(F.col("tag") == "s", F.col("d")).otherwise(0), F.col("th") + F.col("d"), F.col("th"), p.span_us)
    parts = {"n": F.col("n"), "p": F.col("mid_q50"), "iqr": F.col("mid_q75") - F.col("mid_q25"), "lag": F.col("near_us"), "span": F.col("last_us") - F.col("first_us"), "spread": F.col("spread_q50"), "mean": F.col("spread_mean"), "sd": F.col("spread_sd")}
    got = stats.groupBy(*key).agg(*(F.max(F.when(F.col("tag") == tag, c)).alias(f"{tag}_{name}") for tag in "fs" for name, c in parts.items()))
    way = interval_reach(index, grid, key, F.col("us"), F.col("th"), F.lit(None).cast("double"), F.lit(None).cast("double"), p.span_us).select(*key, "high", "low")
    joined = grid.join(got, key).join(way, key)
    enough = lambda tag: F.col(f"{tag}_n") >= p.points
    # only events that need it look for the next tick
    open_ = joined.filter(~enough("f") & ~enough("s")).select("event_id", "horizon_min", "symbol", "th")
    after = asof_unbounded(open_, quoted(ticks), "th", key=["event_id", "horizon_min"], value=["mid", "spread"], bucket_us=p.bucket_us, by="symbol", forward=True, tie="tick_id")
    after = after.select("event_id", "horizon_min", F.struct((F.col("th") + F.col("asof_lag_us")).alias("t_us"), F.col("mid").alias("t_mid"), F.col("spread").alias("t_spread")).alias("next"))
    joined = joined.join(after, ["event_id", "horizon_min"], "left")

    pick = lambda name: F.when(enough("f"), F.col(f"f_{name}")).when(enough("s"), F.col(f"s_{name}"))
    nxt = ~enough("f") & ~enough("s") & F.col("next.t_mid").isNotNull()
    method = F.when(enough("f"), "median_forward").when(enough("s"), "median_symmetric").when(nxt, "first_after")
    window = F.when(enough("f"), F.col("d")).otherwise(2 * F.col("d"))
    lag = F.when(nxt, F.col("next.t_us") - F.col("th")).otherwise(pick("lag"))
    ratio = F.when(nxt, F.lit(1.0)).otherwise(pick("lag") / window)
    span = F.when(nxt, lag).otherwise(pick("span"))
    n = F.when(nxt, F.lit(1)).otherwise(F.coalesce(pick("n"), F.lit(0)))
    z = F.when(pick("sd") > 0, (pick("spread") - pick("mean")) / pick("sd"))
    iqr = F.when((pick("n") >= 4) & (F.col("p_anchor") > 0), pick("iqr") / F.col("p_anchor") * 10000)
    price = F.when(nxt, F.col("next.t_mid")).otherwise(pick("p"))
    reason = (
        F.when(n == 0, "bad_missing_quotes")
        .when(nxt, "degraded_low_density")
        .when(ratio > p.lag_ratio * 5, "bad_stale_data")
        .when(span < window * 0.5, "degraded_unstable_window")
        .when(n < p.points, "degraded_low_density")
        .when(ratio > p.lag_ratio, "degraded_high_lag")
        .when(z > 3, "degraded_wide_spread")
        .when(iqr > p.iqr_bps, "degraded_unstable_window")
    )
    p0 = F.col("p_anchor")
    held = price.isNotNull() & (p0 > 0)
    return joined.select(
        "event_id", "symbol", "us", "horizon_min", p0, price.alias("p_h"), method.alias("sampling_method"), n.cast("int").alias("points_used"), (lag / 1000.0).alias("forward_lag_ms"), ratio.alias("forward_lag_ratio"), (span / 1000.0).alias("window_span_ms"),
        F.when(nxt, F.col("next.t_spread")).otherwise(pick("spread")).alias("spread_bps"), z.alias("spread_z"), iqr.alias("mid_iqr_bps"), quality_of(reason).alias("quality_flag"), reason.alias("reason_code"),
        F.when(held, (price - p0) / p0).alias("ret_h"), F.when(held, (F.col("high") - p0) / p0).alias("mfe_h"), F.when(held, (F.col("low") - p0) / p0).alias("mae_h"),
    )


def triple_barrier(anchored: DataFrame, sigma: DataFrame, horizons: DataFrame, index: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """(event_id, tb_label, good_event, first_touch, time_to_barrier_ms): the first valid mid at or beyond p0 * (1 ± k sigma) within the barrier's horizon; the upper one is looked at first.

    An event is good if the upper barrier is touched first, and not good if the lower one is, or none; without a price at the horizon none is touched."""
    usable = horizons.filter(F.col("horizon_min") == p.barrier_horizon).select("event_id", F.col("p_h").isNotNull().alias("has"))
    e = anchored.join(sigma.select("event_id", "sigma"), "event_id").join(usable, "event_id", "left").filter("p_anchor > 0 and sigma is not null")
    up, down = F.col("p_anchor") * (1 + p.barrier * F.col("sigma")), F.col("p_anchor") * (1 - p.barrier * F.col("sigma"))
    touch = interval_reach(index, e.filter("has"), ["event_id", "us"], F.col("us"), F.col("us") + p.barrier_horizon * p.minute_us, up, down, p.span_us)
    label = F.coalesce("side", F.lit(0))
    told = e.select("event_id").join(touch, "event_id", "left")
    return told.select("event_id", label.alias("tb_label"), (label == 1).alias("good_event"), F.when(label == 1, "upper").when(label == -1, "lower").otherwise("vertical").alias("first_touch"), F.expr("(touch_us - us) div 1000").alias("time_to_barrier_ms"))


def label_quality(anchor: DataFrame, sigma: DataFrame, horizons: DataFrame) -> DataFrame:
    """(event_id, label_quality, reason_code): the worst of all parts and the reason of highest priority."""
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(REASONS) for x in (r, i)))
    worst = horizons.groupBy("event_id").agg(F.min(rank[F.col("reason_code")]).alias("h"))
    parts = anchor.select("event_id", "anchor_reason").join(sigma.select("event_id", "sigma_reason"), "event_id").join(worst, "event_id", "left")
    early = F.least(rank[F.col("anchor_reason")], rank[F.col("sigma_reason")])
    dead = F.coalesce(F.col("anchor_reason").startswith("bad"), F.lit(False)) | F.coalesce(F.col("sigma_reason").startswith("bad"), F.lit(False))
    # an event without anchor or sigma has no horizons
    reason = F.get(F.array(*map(F.lit, REASONS)), F.when(dead, early).otherwise(F.least(early, F.col("h"))))
    return parts.select("event_id", quality_of(reason).alias("label_quality"), reason.alias("reason_code"))
