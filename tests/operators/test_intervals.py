"""Answers about intervals against loops over the ticks."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv

QUOTE = "tick_id long, symbol string, us long, mid double, spread double"
Q = "id long, symbol string, lo long, hi long, at long, up double, down double"


def made(seed, n=250):
    rnd = random.Random(seed)
    quotes = [(i, rnd.choice("ab"), rnd.randrange(-500, 3000), *((None, None) if rnd.random() < 0.2 else (float(rnd.randrange(80, 120)), float(rnd.choice((1, 1, 1, 2, 5)))))) for i in range(n)]
    asked = []
    for i in range(80):
        lo = rnd.randrange(-700, 3200)
        hi = lo + rnd.randrange(0, 200)
        asked.append((i, rnd.choice("abc"), lo, hi, rnd.randrange(lo, hi + 1), rnd.choice((None, 110.0, 118.0, 500.0)), rnd.choice((None, 90.0, 82.0, 0.0))))
    return sorted(quotes, key=lambda q: (q[2], q[0])), asked


def quantile(x, p):
    return float(np.quantile(x, p)) if x else None


@pytest.mark.parametrize("span", [150, 700, 10_000])
def test_statistics_of_intervals(spark, span):
    quotes, asked = made(span)
    index = iv.tick_index(spark.createDataFrame(quotes, QUOTE), span, 200)
    got = {r.id: r for r in iv.interval_stats(index, spark.createDataFrame(asked, Q).select("id", "symbol", "lo", "hi", "at"), F.col("lo"), F.col("hi"), F.col("at"), span).collect()}
    assert len(got) == len(asked)
    for i, s, lo, hi, at, *_ in asked:
        near = [q for q in quotes if q[1] == s and lo <= q[2] <= hi]
        ok = [q for q in near if q[3] is not None]
        r = got[i]
        assert (r.raw, r.n) == (len(near), len(ok))
        assert (r.first_us, r.last_us, r.near_us) == ((ok[0][2], ok[-1][2], min(abs(q[2] - at) for q in ok)) if ok else (None, None, None))
        for name, share in (("mid_q25", 0.25), ("mid_q50", 0.5), ("mid_q75", 0.75)):
            assert r[name] == pytest.approx(quantile([q[3] for q in ok], share))
        spreads = [q[4] for q in ok]
        assert r.spread_q50 == pytest.approx(quantile(spreads, 0.5))
        assert r.spread_sd == (pytest.approx(statistics.stdev(spreads)) if len(ok) > 1 else None)
        if len(set(spreads)) == 1 and len(ok) > 1:
            assert r.spread_sd == 0.0


@pytest.mark.parametrize("span", [40, 150, 10_000])
def test_extremes_and_first_touch_over_many_spans(spark, span):
    quotes, asked = made(span + 1)
    asked = [(i, s, lo, hi + 1500 * (i % 2), at, up, down) for i, s, lo, hi, at, up, down in asked]
    index = iv.tick_index(spark.createDataFrame(quotes, QUOTE), span, 0)
    got = {r.id: r for r in iv.interval_reach(index, spark.createDataFrame(asked, Q), ["id"], F.col("lo"), F.col("hi"), F.col("up"), F.col("down"), span).collect()}
    for i, s, lo, hi, _, up, down in asked:
        ok = [q for q in quotes if q[1] == s and lo <= q[2] <= hi and q[3] is not None]
        touch = next(((q[2], 1 if up is not None and q[3] >= up else -1) for q in ok if (up is not None and q[3] >= up) or (down is not None and q[3] <= down)), (None, None))
        assert (got[i].touch_us, got[i].side) == touch
        assert (got[i].high, got[i].low) == ((max(q[3] for q in ok), min(q[3] for q in ok)) if ok else (None, None))


def test_one_row_for_each_span_touched(spark):
    quotes, _ = made(3, 2000)
    index = iv.tick_index(spark.createDataFrame(quotes, QUOTE), 500, 0)
    assert index.groupBy("symbol", "span").count().filter("count > 1").isEmpty()
    asked = spark.createDataFrame([(1, "a", 0, 1999, 0, None, None)], Q)
    plan = iv.interval_reach(index, asked, ["id"], F.col("lo"), F.col("hi"), F.col("up"), F.col("down"), 500)
    assert [tuple(r)[0] for r in plan.collect()] == [1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], QUOTE)
    asked = spark.createDataFrame([(1, "a", 0, 10, 5, 1.0, None)], Q)
    index = iv.tick_index(none, 100, 10)
    r = iv.interval_stats(index, asked, F.col("lo"), F.col("hi"), F.col("at"), 100).first()
    assert (r.raw, r.n, r.mid_q50, r.first_us) == (0, 0, None, None)
    assert iv.interval_reach(index, asked, ["id"], F.col("lo"), F.col("hi"), F.col("up"), F.col("down"), 100).first().side is None
    assert iv.step_returns(index, asked, F.col("hi"), 10, 2, 100).first().n == 0
    assert iv.interval_stats(index, asked.limit(0), F.col("lo"), F.col("hi"), F.col("at"), 100).collect() == []
