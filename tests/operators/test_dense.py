"""Queries whose rows must grow with the tables, not with how dense they are in time: no join may pair both sides by time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.spans import over_spans
from tidemark.operators.timejoin import asof
from tidemark.plans import feeds as feed_plans
from tidemark.plans import labels as label_plans
from tidemark.plans import markets as market_plans
from tidemark.plans import regime as regime_plans

SF = "/root/testdata/sf0.001"


def time_joins(df) -> list[str]:
    """The joins of a plan that meet by a bucket of time, other than that of the table of buckets with its own."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Join" in line and "_bucket" in line and "FullOuter" not in line]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_of_a_dense_second_makes_no_pairs(spark, forward):
    n = 3000
    ticks = spark.range(n).select(F.col("id").alias("tick_id"), F.lit("a").alias("symbol"), F.expr("id div 3").alias("us"), F.col("id").cast("double").alias("price"))
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("symbol"), F.expr("id div 2").alias("us"))
    got = asof(events, ticks, "us", 100, key="event_id", value=["price"], forward=forward)
    assert not time_joins(got)
    last = n // 3 - 1
    for r in got.collect():
        at = r.event_id // 2
        if forward:
            assert (r.asof_price, r.asof_lag_us) == ((3.0 * at, 0) if at <= last else (None, None))
        else:
            assert (r.asof_price, r.asof_lag_us) == ((3.0 * min(at, last) + 2, max(0, at - last)) if at - last <= 100 else (None, None))


@pytest.mark.parametrize(
    "query",
    [
        feed_plans.pump_fast_alerts,
        feed_plans.pump_fast_detect,
        feed_plans.seeded_detection,
        market_plans.outcome_maturation,
        feed_plans.outcome_status_join,
        market_plans.signal_rollup,
        market_plans.source_fallback,
        feed_plans.stale_feed,
        label_plans.asof_backward,
        label_plans.asof_forward,
        regime_plans.pit_regime_join,
    ],
)
def test_queries_meet_by_time_without_pairs(spark, query):
    assert not time_joins(query(spark, SF))


@pytest.mark.parametrize(
    "query",
    [
        lambda s, d: regime_plans._healthy(s, d, "view"),
        regime_plans.regime_tags,
        regime_plans.regime_snapshots,
        regime_plans.regime_health,
        regime_plans.regime_scores,
        regime_plans.latest_scores,
    ],
)
def test_snapshots_are_not_joined_by_their_ids(spark, query):
    """One pass makes facts, ranks and lags; the only join is that of the edges of blocks."""
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "tick_id" in line]


def test_a_dense_span_passes_in_chunks(spark):
    """No chunk holds more than its window and a few rows, and what is made of what was made sees the whole window of it."""
    most, rows = spark.sparkContext.accumulator(0), [(i, "ab"[i % 2], i // 4, float(i * 7919 % 101)) for i in range(4000)]

    def total(t):
        most.add(int(len(t.us) > 200))
        return {"total": t.total(t["x"], 20)}

    got = over_spans(spark.createDataFrame(rows, "tick_id long, symbol string, us long, x double"), ["x"], 20, {"total": "double"}, total, span_us=5000, then=(["total"], {"least": "double"}, lambda t: {"least": np.array([t["total"][a:b].min() for a, b in zip(*t.bounds(20))])}), chunk_rows=50)
    told = {r.tick_id: (r.total, r.least) for r in got.collect()}
    want = {i: sum(y for j, s, v, y in rows[max(0, i - 100) : i + 5] if s == rows[i][1] and u - 20 <= v <= u) for i, _, u, _ in rows}
    assert most.value == 0 and len(told) == len(rows)
    for i, s, u, _ in rows:
        assert told[i] == (want[i], min(want[j] for j, t, v, _ in rows[max(0, i - 100) : i + 5] if t == s and u - 20 <= v <= u))
