"""The whole detection of fast rises: gates, move state, confirmation by trades, cooldown, volume and entry gate.

What a symbol's earlier ticks decide (the move, the candidate's lifetime, its trigger price, the cooldown) runs through a
state of fixed size over its sorted ticks; all else is columns that are joined before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import relative_volume
from .moves import in_order, Move, MoveRules, seeded, with_seeds


@dataclass(frozen=True)
class DetectParams:
    """Rise in percent that triggers, volume of a day, lifetime of a candidate, cooldown, trades and buy ratio that confirm, relative volume, and the latest stage of an entry."""

    pump_pct: float = 0.30
    min_vol_24h: float = 200_000.0
    ttl_us: int = 90_000_000
    cooldown_us: int = 300_000_000
    confirm_trades: int = 3
    confirm_ratio: float = 0.55
    rel_volume: float = 3.0
    slots: float = 2880.0
    stage_max: float = 4.0
    near_miss: bool = False


@dataclass
class Watch:
    """What is known of a symbol: its move, the price before, the candidate's end and trigger price, and its last alert."""

    move: Move = field(default_factory=Move)
    before: float | None = None
    expires: int | None = None
    trigger_price: float | None = None
    alerted: int | None = None

    def done(self, price: float, us: int, keep_candidate: bool = False) -> None:
        self.trigger_price = None
        self.expires = self.expires if keep_candidate else None
        self.move.rest(price, us)


_OUT = (
    "tick_id long, symbol string, us long, kind string, decision string, rejection_reason string, price double, delta_pct double, trigger_price double, stage_pct double, "
    "build_ms double, confirm_ms double, rel_vol double, confirm_ratio double, n_trades long, move_start_price double, peak double, noise double"
)


def pump_fast_detect(ticks: DataFrame, flow: DataFrame, p: DetectParams = DetectParams(), rules: MoveRules | None = None, seeds: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Candidates that were confirmed (kind alert; decision passed, or rejected with the reason of the entry gate) and, with ``near_miss``, rises while blocked.

    ``ticks`` (tick_id, symbol, us, price, vol_24h, blocked, watched, downtrend) has the gates of each tick: ``blocked`` by the
    hour, ``watched`` by the universe, ``downtrend`` at its time; null is false, for ``watched`` true. ``flow`` (tick_id, n_trades,
    buy_ratio, quote_vol) has the trades before it. Ticks that are blocked or not watched, or have no price above zero, are not
    seen at all; those below the day's volume only move the price before. A rise in a downtrend is passed over. A rise opens
    a candidate or prolongs it; it is confirmed by a rise with enough trades on the buyers' side, if not within the cooldown
    of the last alert and with enough relative volume. Trades count by their time alone, whether or not the candidate was
    open when they came, and a trigger price stays until a candidate is confirmed. ``seeds``, as ``move_states`` takes them, set the noise that a symbol begins with.
    """
    r = rules or MoveRules(jump_pct=p.pump_pct)

    def step(w: Watch, t) -> tuple | None:
        price, us = t.price, t.us
        if t.vol_24h != t.vol_24h or t.vol_24h < p.min_vol_24h:
            w.before = price
            return None
        w.move.tick(price, us, r)
        before, w.before = w.before, price
        if not before:
            return None
        delta = (price - before) / before * 100
        if w.expires is not None and us > w.expires:
            w.expires = None
        if delta < p.pump_pct or t.downtrend:
            return None
        m = w.move
        if t.blocked:
            return (t.tick_id, t.symbol, us, "near_miss", "blocked", "operator_sleep", price, round(delta, 3), *[None] * 10)
        if m.trigger_us is None:
            m.build_us = us - m.start_us if m.state == "building" else None
            m.state, m.trigger_us = "triggered", us
        w.expires = us + p.ttl_us
        w.trigger_price = price if w.trigger_price is None else w.trigger_price
        if not (t.n_trades >= p.confirm_trades and t.buy_ratio >= p.confirm_ratio):
            return None
        confirm = us - m.trigger_us
        if w.alerted is not None and us - w.alerted < p.cooldown_us:
            w.done(price, us, keep_candidate=True)
            return None
        if t.rel_reason != "ok":
            w.done(price, us)
            return None
        trigger = w.trigger_price
        stage = round((price - trigger) / trigger * 100, 3)
        late = stage > p.stage_max
        out = (
            t.tick_id, t.symbol, us, "alert", "rejected" if late else "passed", "late_entry" if late else None, price, round(delta, 3), trigger, stage, None if m.build_us is None else m.build_us / 1000,
            confirm / 1000, t.rel_vol, t.buy_ratio, int(t.n_trades), m.start or None, m.peak or None, m.noise_at_start or None,
        )
        if not late:
            w.alerted = us
        w.done(price, us)
        return out

    rel, reason = relative_volume(F.col("quote_vol"), F.col("vol_24h"), p.rel_volume, p.slots)
    seen = ticks.filter(F.coalesce("watched", F.lit(True)) & (F.col("price") > 0) & (F.lit(p.near_miss) | ~F.coalesce("blocked", F.lit(False))))
    rows = seen.join(flow.select("tick_id", F.col("n_trades").cast("double").alias("n_trades"), "buy_ratio", "quote_vol"), "tick_id", "left").withColumns({"rel_vol": rel, "rel_reason": reason})
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("blocked", "downtrend")}
    return in_order(with_seeds(rows.withColumns(flags).drop("watched"), seeds), "symbol", ["us", "tick_id"], lambda row: Watch(move=seeded(row)), step, _OUT)
