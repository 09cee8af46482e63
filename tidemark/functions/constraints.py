"""CHECK constraints of table schemas as columns, with SQL's rule that a check which is null passes.

A table's checks are SQL texts by name. They come from rules about columns, stated as lists, or from the text of a schema
(``checks_of_schema``); Spark's own parser turns each into a column.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def checks(*, at_least_zero: Sequence[str] = (), positive: Sequence[str] = (), share: Sequence[str] = (), signed_share: Sequence[str] = (), one_of: Mapping[str, Sequence] | None = None, other: Mapping[str, str] | None = None) -> dict[str, str]:
    """Check texts by name: a column's rule is named after it."""
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    made = {c: f"{c} >= 0" for c in at_least_zero} | {c: f"{c} > 0" for c in positive}
    made |= {c: f"{c} >= 0 AND {c} <= 1" for c in share} | {c: f"{c} >= -1 AND {c} <= 1" for c in signed_share}
    return made | {c: f"{c} IN ({', '.join(map(literal, vs))})" for c, vs in (one_of or {}).items()} | dict(other or {})


_DIMENSIONS = ("stress", "volatility", "liquidity", "activity")

#: The checks of a regime snapshot.
REGIME_SNAPSHOT = checks(
    at_least_zero=(
        "source_lag_ms compute_latency_ms trade_source_lag_ms book_source_lag_ms btc_spread_bps btc_rv_1m btc_rv_5m btc_realized_range_5m btc_n_trades_30s btc_quote_vol_30s btc_intertrade_gap_ms_p50 btc_aggtrade_msg_rate_30s "
        "btc_abs_signed_flow_30s btc_abs_r_1m btc_abs_r_5m btc_rv_ratio_1m_15m btc_trade_intensity_1m missing_feature_count late_event_count max_event_delay_ms"
    ).split(),
    positive=("btc_mid_price", "btc_bid_price", "btc_ask_price"),
    share=(
        *("btc_tobi_extreme btc_dir_persistence_15m btc_efficiency_ratio_15m btc_spread_stability_1m btc_spread_recovery_30s btc_tobi_non_extreme").split(),
        *(f"btc_{d}_{part}" for d in _DIMENSIONS for part in ("score", "anchor_component", "support_component")),
    ),
    signed_share=("btc_tobi", "btc_trend_score", "btc_trend_anchor_component", "btc_trend_support_component"),
    one_of={
        "btc_stress_state": ("low", "medium", "high"),
        "btc_trend_state": ("down", "neutral", "up"),
        "btc_volatility_state": ("compressed", "normal", "expanding"),
        "btc_liquidity_state": ("thin", "normal", "thick"),
        "btc_activity_state": ("low", "normal", "high"),
        "snapshot_health_status": ("fresh", "degraded", "stale"),
        "freshness_status": ("fresh", "delayed", "stale"),
        "completeness_status": ("complete", "partial", "insufficient"),
        "validity_status": ("valid", "suspicious", "invalid"),
        "trade_feed_status": ("live", "delayed", "frozen", "missing"),
        "book_feed_status": ("live", "delayed", "frozen", "missing"),
        "worker_status": ("warming_up", "live", "catching_up", "degraded", "stalled"),
        "regime_mode": ("shadow", "advisory", "active_gate"),
        "regime_validation_status": ("experimental", "observed", "validated_partial", "validated_operational"),
    },
    other={
        "window_order": "window_start_us <= window_end_us",
        "book_order": "btc_bid_price <= btc_ask_price",
        "missing_features_list": "missing_features_list LIKE '[%]'",
        "degradation_reasons": "degradation_reasons LIKE '[%]'",
    },
)

#: The checks of a label, of a markout and of the retry policy.
LABEL = checks(
    at_least_zero=("time_to_barrier_ms", "sigma_event", "anchor_points", "anchor_lag_ms", "anchor_window_coverage_ms", "quote_skew_ms", "retry_count"),
    positive=("p_anchor",),
    one_of={
        "tb_label": (-1, 0, 1),
        "label_quality": ("ok", "degraded", "bad"),
        "first_touch": ("upper", "lower", "vertical", "none"),
        "worker_status": ("pending", "done", "retry_wait", "terminal", "failed_internal"),
    },
    other={"terminal_reason_code": "length(terminal_reason_code) <= 200"},
)
MARKOUT = checks(
    at_least_zero=("points_used", "forward_lag_ms", "forward_lag_ratio", "window_span_ms", "point_density", "mid_iqr_bps"),
    positive=("p_h",),
    one_of={"horizon_min": (5, 15, 30, 60, 120), "sampling_method": ("median_forward", "median_symmetric", "first_after"), "quality_flag": ("ok", "degraded", "bad")},
)
POLICY = checks(
    at_least_zero=("max_retries", "cooldown_seconds"),
    other={
        "retryable_or_terminal": "retryable <> is_terminal",
        "retries_if_retryable": "retryable = (max_retries > 0)",
        "cooldown_if_retryable": "retryable = (cooldown_seconds > 0)",
    },
)


def checks_of_schema(ddl: str) -> dict[str, str]:
    """The check texts of a CREATE TABLE statement, by constraint name or else by the first word of the check; names that repeat are numbered.

    What PostgreSQL writes otherwise than Spark is put in Spark's words: ``~`` and ``jsonb_typeof``. Casts with ``::`` are left to the caller.
    """
    ddl = re.sub("--[^\n]*", "", ddl)
    made: dict[str, str] = {}
    for m in re.finditer(r"(?:CONSTRAINT\s+(\w+)\s+)?\bCHECK\s*\(", ddl, re.IGNORECASE):
        depth, at, quoted = 1, m.end(), False
        while depth:
            if ddl[at] == "'":
                quoted = not quoted
            elif not quoted:
                depth += {"(": 1, ")": -1}.get(ddl[at], 0)
            at += 1
        text = " ".join(ddl[m.end() : at - 1].split())
        name = m[1] or next(w for w in re.findall(r"[A-Za-z_]\w*", text) if w not in ("jsonb_typeof", "length", "NOT"))
        same = [n for n in made if re.fullmatch(rf"{name}(_\d+)?", n)]
        text = re.sub(r"jsonb_typeof\((\w+)\)", r"(CASE left(ltrim(\1), 1) WHEN '[' THEN 'array' WHEN '{' THEN 'object' ELSE 'scalar' END)", re.sub(r"\s~\s", " RLIKE ", text))
        made[f"{name}_{len(same) + 1}" if same else name] = text
    return made


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that are false, in their order; a rule that is null passes."""
    return F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))


def violated(texts: Mapping[str, str]) -> Column:
    """``violations`` of check texts."""
    return violations({name: F.expr(f"({text})") for name, text in texts.items()})
