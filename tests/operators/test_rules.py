import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules as rl
from tidemark.operators import windows as wn


def averages(values, n):
    out = [values[0]]
    for v in values[1:]:
        out.append(out[-1] + (v - out[-1]) * 2 / (n + 1))
    return out


def some_bars(n=120, seed=3):
    rnd, out = random.Random(seed), []
    for s in "ab":
        c = 100.0
        for i in range(n):
            o, c = c, c * (1 + rnd.gauss(0, 0.01))
            out.append((s, i * 60, o, max(o, c) * 1.001, min(o, c) * 0.999, c, rnd.choice([0.0, 1.0, 2.0, 5.0])))
    return out


BAR = "symbol string, open_us long, o double, h double, l double, c double, v double"


def enough(bars, i):
    return bars[i][6] >= (statistics.median(b[6] for b in bars[max(0, i - 19) : i + 1]) or 1)


def test_breakouts_and_crosses_as_by_hand(spark):
    rows = some_bars()
    df = spark.createDataFrame(rows, BAR).repartition(3)
    broke, crossed = set(), set()
    for s in "ab":
        b = [r for r in rows if r[0] == s]
        c = [r[5] for r in b]
        e, f, g = averages(c, 10), averages(c, 3), averages(c, 9)
        for i in range(1, len(b)):
            if not enough(b, i) or i < 8 + 4:
                continue
            if c[i] > max(r[3] for r in b[i - 8 : i]) * 1.002 and c[i] > e[i]:
                broke.add((s, b[i][1], "bo_up"))
            if c[i] < min(r[4] for r in b[i - 8 : i]) * 0.998 and c[i] < e[i]:
                broke.add((s, b[i][1], "bo_dn"))
            if f[i - 1] <= g[i - 1] and f[i] > g[i]:
                crossed.add((s, b[i][1], "cross_up"))
            if f[i - 1] >= g[i - 1] and f[i] < g[i]:
                crossed.add((s, b[i][1], "cross_dn"))
    found = lambda d: {(r.symbol, r.open_us, r.rule) for r in d.collect()}
    p = rl.RuleParams(ema=10, fast=3, slow=9, lookback=8)
    way = {"buffer_pct": 0.2, "vol_mult": 1.0, "ema_confirm": 1.0, "min_notional": 0.0}
    assert len(broke) > 5 and found(rl.rule_breakout(df, way, way, p)) == broke
    assert len(crossed) > 5 and found(rl.rule_ema_cross(df, {"vol_mult": 1.0, "min_notional": 0.0}, p)) == crossed
    assert found(rl.rule_breakout(df.limit(0), way, way, p)) == set()


def test_frames_change_the_rules_key_by_key(spark):
    got = {r.timeframe: r.params for r in rl.params_overlay(spark).collect()}
    assert set(got) == {"15m", "30m", "1h"}
    assert (got["15m"]["pump.delta_pct"], got["30m"]["dump.delta_pct"], got["1h"]["bo_up.vol_mult"]) == (1.4, -2.2, 1.8)
    # what a frame does not name stays
    assert (got["1h"]["bo_up.buffer_pct"], got["1h"]["cross.vol_mult"], got["1h"]["cross.min_notional"]) == (0.2, 2.0, 100000.0)
    assert (got["1h"]["frame.late_filter_pct"], got["1h"]["frame.early_enabled"], "frame.late_filter_pct" in got["15m"]) == (5.0, 0.0, False)


def test_late_bars_and_early_rules(spark):
    flat = [(s, i * 60, 100.0, 100.0, 100.0, 100.0, 1000.0) for s in "ab" for i in range(12)]
    rows = [*flat, ("a", 720, 100.0, 107.0, 100.0, 106.0, 9000.0), ("b", 720, 100.0, 104.0, 100.0, 103.0, 9000.0)]
    p = rl.RuleParams(lookback=8, volumes=5)
    fired = {}
    for f in ("15m", "1h"):
        bars = spark.createDataFrame(rows, BAR).selectExpr(f"'{f}' AS timeframe", "*")
        fired[f] = {(r.symbol, r.rule) for r in rl.rule_scan(bars, rl.params_overlay(spark, p), p, last_only=True).collect()}
    up = {"pump", "bo_up", "pump_early", "bo_up_early", "cross_up"}
    assert fired["15m"] == {(s, r) for s in "ab" for r in up}
    assert fired["1h"] == {("b", "bo_up"), ("b", "cross_up")}


@pytest.mark.parametrize("block", [1, 300, 10**9])
def test_averages_do_not_depend_on_blocks(spark, block):
    rnd = random.Random(block)
    rows = [(i, rnd.choice("ab"), rnd.randint(-500, 5000), rnd.choice([None, rnd.uniform(50, 150), rnd.uniform(50, 150)])) for i in range(300)]
    df = spark.createDataFrame(rows, "tick_id long, symbol string, us long, price double").repartition(3)
    got = {r.tick_id: (r.ema4, r.ema9) for r in wn.with_ema(df, "price", (4, 9), block_us=block).collect()}
    for s in "ab":
        e = {4: None, 9: None}
        for i, _, _, p in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])):
            for n in e:
                e[n] = e[n] if p is None else p if e[n] is None else e[n] + (p - e[n]) * 2 / (n + 1)
            want = tuple(e.values())
            if want[0] is not None:
                assert got[i] == pytest.approx(want)


def test_numbers_as_percent_g(spark):
    values = [0.0, 1.0, 123456.0, 1234567.0, 0.0001, 0.00001234567, 100.5, -3.25, 1e20, 999999.5, 0.30000000001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rl.general(F.col("x"))).collect()]
    assert got == [f"{v:.6g}" for v in values]


def test_rv_leaves_out_the_return_that_enters_the_window(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), i * 10 // rnd.choice([10, 10, 9]), rnd.choice([rnd.uniform(90, 110), rnd.uniform(90, 110), 0.0])) for i in range(200)]
    got = {r.tick_id: r for r in wn.rolling_rv_range(spark.createDataFrame(rows, "tick_id long, symbol string, us long, price double"), 10, 20, 60).collect()}

    def rv(p):
        x = [math.log(b / a) for a, b in zip(p, p[1:], strict=False) if a > 0 and b > 0]
        return statistics.stdev(x) if len(x) >= 2 else None

    for i, s, us, _ in rows:
        inside = lambda w: [p for _, _, p in sorted((u, t, p) for t, ts, u, p in rows if ts == s and us - w <= u <= us)]  # noqa: E731, B023
        for name, w in (("rv_short", 10), ("rv_mid", 20), ("rv_long", 60)):
            want, have = rv(inside(w)), got[i][name]
            assert (want is None) == (have is None) and (want is None or abs(want - have) < 1e-9)
        mid = inside(20)
        assert got[i].price_range == (max(mid) - min(mid) if len(mid) >= 2 else None)
