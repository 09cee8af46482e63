"""Neighbours over blocks and the greedy choice in parallel, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cooldown import cooldown_filter
from tidemark.operators.edges import with_neighbours
from tidemark.operators.windows import grid_asof, price_delta_pct, state_transitions

TICK = "tick_id long, symbol string, us long, price double"


def made(seed, n=300, symbols=("a", "b", None)):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(symbols), rnd.choice((None, rnd.randrange(-200, 2000), rnd.randrange(0, 60))), rnd.choice((None, 0.0, float(rnd.randrange(90, 110))))) for i in range(n)]
    order = lambda r: (r[2] is not None, r[2] or 0, r[0])
    series = {s: sorted((r for r in rows if r[1] == s), key=order) for s in {r[1] for r in rows}}
    return rows, series


@pytest.mark.parametrize("block", [1, 70, 10**9])
@pytest.mark.parametrize("forward", [False, True])
def test_neighbours_whatever_the_blocks(spark, block, forward):
    rows, series = made(block)
    got = with_neighbours(spark.createDataFrame(rows, TICK).repartition(3), {"other": F.col("price"), "id": F.col("tick_id")}, known={} if forward else {"known": F.col("price")}, alone="alone", block_us=block, forward=forward)
    got = {r.tick_id: r for r in got.collect()}
    assert len(got) == len(rows)
    for line in series.values():
        for i, r in enumerate(line):
            k = i + 1 if forward else i - 1
            other = line[k] if 0 <= k < len(line) else None
            g = got[r[0]]
            assert (g.id, g.other, g.alone) == ((other[0], other[3], False) if other else (None, None, True))
            if not forward:
                assert g.known == next((x[3] for x in reversed(line[:i]) if x[3] is not None), None)


def test_one_symbol_is_many_tasks(spark):
    rows = spark.range(4000).selectExpr("id AS tick_id", "'a' AS symbol", "id * 10 AS us", "double(id % 7) AS price")
    for out in (price_delta_pct(rows, block_us=1000), state_transitions(rows, F.col("price") > 3, block_us=1000), grid_asof(rows, 7, 20, block_us=1000)):
        keyed = "Window" + out._jdf.queryExecution().optimizedPlan().toString()
        assert "_block" in keyed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        full = price_delta_pct(rows, block_us=1000).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert full > 2


def test_grid_holds_the_newest_tick_until_it_is_stale(spark):
    rows, series = made(4, symbols=("a", "b"))
    got = {(r.symbol, r.grid_us): (r.tick_id, r.age_ms) for r in grid_asof(spark.createDataFrame([r for r in rows if r[2] is not None], TICK), 50, 120, block_us=90).collect()}
    want = {}
    for s, line in series.items():
        line = [r for r in line if r[2] is not None]
        for point in range(line[0][2] // 50 * 50, line[-1][2] + 1, 50):
            before = [r for r in line if r[2] <= point]
            if before and point - before[-1][2] <= 120:
                want[s, point] = (before[-1][0], (point - before[-1][2]) / 1000)
    assert got == want


def greedy(rows, c):
    out, last = set(), {}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= c:
            last[k] = t
            out.add(i)
    return out


@pytest.mark.parametrize("cooldown, block", [(10, 10), (10, 3), (10, 35), (50, 7), (7, None), (1, None), (0, None), (5000, None)])
def test_cooldown_is_the_greedy_choice(spark, cooldown, block):
    for seed, symbols in ((1, "ab"), (2, "a")):
        rnd = random.Random(seed)
        rows = [(i, rnd.choice((*symbols, None)), rnd.choice((None, rnd.randrange(-300, 900), rnd.randrange(0, 30)))) for i in range(250)]
        df = spark.createDataFrame([(*r, "x") for r in rows], "tick_id long, symbol string, us long, extra string").repartition(3)
        got = cooldown_filter(df, ["symbol"], cooldown, block_us=block)
        assert got.columns == df.columns
        found = [r.tick_id for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == (greedy(rows, cooldown) if cooldown else {r[0] for r in rows if r[2] is not None})


def test_cooldown_counts_from_the_last_kept(spark):
    rows = [(i, "a", t) for i, t in enumerate([0, 5, 9, 10, 19, 20, 31])]
    df = spark.createDataFrame(rows, "tick_id int, symbol string, us long")
    assert sorted(r.us for r in cooldown_filter(df, ["symbol"], 10).collect()) == [0, 10, 20, 31]
    assert cooldown_filter(df.limit(0), ["symbol"], 10).collect() == []
