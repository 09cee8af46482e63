import random
import statistics

import numpy as np
import pytest

from tidemark.operators import regime as rg
from tidemark.operators import spans as sp
from tidemark.operators import windows as wn


def windows(n, seed):
    rng = np.random.default_rng(seed)
    us = np.sort(rng.integers(0, n, n))
    low, high = np.searchsorted(us, us - 9, "left"), np.searchsorted(us, us, "right")
    x = rng.choice([1.0, 2.0, 2.5, np.nan, 7.0, -3.0], n) if seed % 2 else rng.standard_normal(n)
    return x, low, high


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 300])
@pytest.mark.parametrize("seed", [0, 1])
def test_kernels_against_plain_loops(n, seed):
    x, low, high = windows(n, seed)
    bound = np.nan_to_num(x, nan=2.0)
    held = [[v for v in x[a:b] if v == v] for a, b in zip(low, high)]
    for equal in (True, False):
        got = sp.counts_below(x, low, high, bound, equal=equal)
        assert got.tolist() == [sum(v <= t if equal else v < t for v in h) for h, t in zip(held, bound)]
    for better, plain in ((np.fmax, max), (np.fmin, min)):
        got = sp.extremes(x, low, high, better)
        assert [None if v != v else v for v in got.tolist()] == [plain(h) if h else None for h in held]
    y = np.nan_to_num(x)
    got = sp.medians(y, low, high)
    assert got.tolist() == pytest.approx([statistics.median(y[a:b]) for a, b in zip(low, high)])
    assert np.isnan(sp.medians(y, low, low)).all()


@pytest.mark.parametrize("span", [None, 31])
def test_rolling_facts_as_by_hand(spark, span):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.randint(0, 300), rnd.choice([rnd.uniform(1, 9), rnd.uniform(1, 9), 0.0, None])) for i in range(250)]
    big = 1 << 60  # far beyond what a double holds
    df = spark.createDataFrame([(big + i, s, u, p) for i, s, u, p in rows], "tick_id long, symbol string, us long, price double").repartition(3)
    z = {r.tick_id - big: r.z for r in wn.rolling_zscore(df, 40, least=4).collect()}
    ret = {r.tick_id - big: r.r for r in wn.rolling_returns(df, {"r": 40}).collect()}
    assert len(z) == len(ret) == len(rows)
    for i, s, us, p in rows:
        inside = sorted((u, t, q) for t, ts, u, q in rows if ts == s and us - 40 <= u <= us)
        known = [q for *_, q in inside if q is not None]
        sd = statistics.stdev(known) if len(known) > 1 else 0.0
        want = (p - statistics.mean(known)) / sd if p is not None and len(known) >= 4 and sd >= 1e-9 else None
        assert (z[i] is None) == (want is None) and (want is None or abs(z[i] - want) < 1e-9)
        first = inside[0][2]
        want = (p - first) / first if p is not None and first and len(inside) >= 2 else None
        assert (ret[i] is None) == (want is None) and (want is None or abs(ret[i] - want) < 1e-12)


def test_facts_of_an_empty_and_a_null_table(spark):
    schema = "tick_id long, symbol string, us long, price double, spread double"
    assert rg.trend_shape(spark.createDataFrame([], schema), 10).collect() == []
    rows = spark.createDataFrame([(1, "a", None, 1.0, 1.0), (2, "a", 5, None, None), (3, None, 5, 2.0, 2.0)], schema)
    assert sorted(tuple(r) for r in rg.spread_dynamics(rows, 5, 10).collect()) == [(2, None, None), (3, None, None)]
