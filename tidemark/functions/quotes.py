"""Row-level rules of quotes, gates and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(x: Column) -> Column:
    """Doubles that are NaN or infinite, and text that is no number, become null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def valid_book(bid: Column, ask: Column) -> Column:
    b, a = finite_or_null(bid), finite_or_null(ask)
    return F.coalesce((b > 0) & (a > 0) & (a >= b), F.lit(False))


def mid(bid: Column, ask: Column) -> Column:
    return F.when(valid_book(bid, ask), (bid + ask) / 2)


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when(valid_book(bid, ask), (ask - bid) / ((bid + ask) / 2) * 10000)


def book_imbalance(bid_qty: Column, ask_qty: Column) -> Column:
    total = bid_qty + ask_qty
    return F.when(total > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (bid_qty - ask_qty) / total)))


def relative_volume(now: Column, day: Column, least: float = 1.0, slots: float = 2880.0) -> tuple[Column, Column]:
    """(relative volume, reason): the volume of a slot against the day's mean slot."""
    base = day / slots
    rel = F.when(~F.coalesce(now <= 0, F.lit(True)) & ~F.coalesce(base <= 0, F.lit(True)), now / base)
    reason = F.when(F.coalesce(now <= 0, F.lit(True)), "no_vol_now").when(F.coalesce(base <= 0, F.lit(True)), "no_base").when(rel < least, "low_rel_volume").otherwise("ok")
    return rel, reason


def entry_gate(trigger: Column, confirm: Column, stage_max: float = 4.0) -> tuple[Column, Column]:
    """(stage_pct, reason) of an entry; the reason is null where it is allowed."""
    stage = F.when((trigger > 0) & (confirm > 0), F.round((confirm - trigger) / trigger * 100, 3))
    reason = F.when(F.coalesce(trigger <= 0, F.lit(True)), "error").when(F.coalesce(confirm <= 0, F.lit(True)), "invalid_confirm_price").when(stage > stage_max, "late_entry")
    return stage, reason


def outcome_pct(price: Column, start: Column) -> Column:
    p, p0 = finite_or_null(price), finite_or_null(start)
    return F.when(p0 > 0, F.round((p - p0) / p0 * 100, 6))


def buy_vol_ratio(buy: Column, day: Column) -> Column:
    return F.coalesce(F.when(day != 0, buy / day), F.lit(0.5))


def trades_bucket(n: Column) -> Column:
    return F.when(n.isNull(), "OUT_OF_RANGE").when(n <= 5, "Q1_le_5").when(n <= 9, "Q2_6_9").when(n <= 19, "Q3_10_19").otherwise("Q4_19_plus")


def dataset_bucket(quality: Column, reason: Column) -> Column:
    return F.when(quality == "ok", "ok_only").when(reason.isin("degraded_high_lag", "degraded_unstable_window"), "other_degraded").when(reason == "degraded_low_density", "degraded_low_density").otherwise("other_unknown")


def quality_mask(critical: list[str], optional: list[str]) -> Column:
    """Map of the names of null features to missing_critical or missing_optional."""
    parts = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("k"), F.lit(f"missing_{kind}").alias("v"))) for kind, names in (("critical", critical), ("optional", optional)) for c in names]
    return F.map_from_entries(F.array_compact(F.array(*parts)))


#: Features whose lack degrades an event, and those whose lack is only told.
CRITICAL = ("delta_pct", "rel_vol", "confirm_ratio")
OPTIONAL = ("stage_pct", "t_build_ms", "t_confirm_ms", "move_start_price", "n_trades", "utc_hour", "market_regime", "operator_window")


def feature_quality(critical: tuple[str, ...] = CRITICAL, optional: tuple[str, ...] = OPTIONAL) -> tuple[Column, Column, Column]:
    """(mask, number of missing features, whether the event is degraded)."""
    missing = lambda names: sum((F.col(c).isNull().cast("int") for c in names), F.lit(0))
    return quality_mask(list(critical), list(optional)), missing((*critical, *optional)), missing(critical) > 0


def iso_utc(ts: Column) -> Column:
    """A time as ISO text in UTC, with microseconds if it has any."""
    us = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.when(us > 0, F.concat(F.lit("."), F.lpad(us.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def candidate_id(symbol: Column, trigger: Column, confirm: Column, version: Column, config: Column) -> Column:
    """The id of a candidate: a hash of symbol, times in ISO text, version and configuration hash; no trigger is the word none."""
    return event_id_hash(symbol, iso_utc(trigger), iso_utc(confirm), version, config)


def base_symbol(symbol: Column, quote: str = "USDT") -> Column:
    return F.lower(F.regexp_replace(symbol, f"{quote}$", ""))


def event_id_hash(*parts: Column) -> Column:
    """ev_ and 32 hexadecimal digits of the parts joined by a pipe; a null part is the word none."""
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("none")) for p in parts)), 256), 1, 32))


#: Hours of the day (UTC) of each market regime; other hours are low_activity.
REGIME_HOURS = {"aggressive": (14, 15, 16, 17), "normal": (8, 9, 10, 11, 12, 13), "caution": (18, 19), "pause": (20, 21, 22)}


def time_gate(ts: Column, awake: tuple[int, int] = (8, 22), behind_hours: int = 4) -> tuple[Column, Column, Column, Column]:
    """(market regime, operator window, blocked, reason) by the hour in UTC and by the operator's hour, a fixed number of hours behind."""
    utc, local = F.hour(ts), F.pmod(F.hour(ts) - behind_hours, F.lit(24))
    regime = F.when(utc.isNull(), None)
    for name, hours in REGIME_HOURS.items():
        regime = regime.when(utc.isin(*hours), name)
    asleep = ~local.between(*awake)
    return regime.otherwise("low_activity"), F.when(asleep, "sleep").otherwise("awake"), asleep, F.when(asleep, "operator_sleep").otherwise("allowed_window")


def signal_contract(symbol: Column, price: Column, kind: Column, decision: Column, rejection: Column) -> Column:
    """The first rule that a signal breaks, null if none."""
    p = finite_or_null(price)
    return (
        F.when(F.coalesce(F.trim(symbol) == "", F.lit(True)), "symbol")
        .when(F.coalesce(p <= 0, F.lit(True)), "price_alert")
        .when(~F.coalesce(kind.isin("alert", "near_miss"), F.lit(False)), "signal_kind")
        .when(~F.coalesce(decision.isin("sent", "blocked"), F.lit(False)), "decision")
        .when((decision == "sent") & (kind != "alert"), "sent_needs_alert")
        .when((decision == "blocked") & rejection.isNull(), "blocked_needs_reason")
        .when((decision == "blocked") & (kind == "alert"), "alert_blocked")
    )
