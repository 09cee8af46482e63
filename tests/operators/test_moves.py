import random

from pyspark.sql import functions as F

from tidemark.operators import moves as mv

TICK = "tick_id long, symbol string, us long, price double"


def states_by_hand(prices, jump=2.0):
    """(state, why it ended) after each of the prices, one a second."""
    out, state, noise, last = [], "idle", prices[0] * 0.0001, prices[0]
    low, peak, stalled, triggered = prices[0], 0.0, 0, False
    for i, p in enumerate(prices):
        rise = (p - last) / last * 100 if i else None
        noise, last, ended = 0.1 * abs(p - last) + 0.9 * noise, p, None
        if state == "idle":
            low = min(low, p)
            if p - low > 2.5 * noise > 0:
                state, peak, stalled = "building", p, 0
        elif state == "building":
            peak, stalled = max(peak, p), stalled + 1
            ended = "retrace" if peak - p > 1.5 * noise > 0 else "lateral" if stalled >= 4 else None
            if ended:
                state, low = "idle", p
        shown = state
        if rise is not None and rise >= jump:
            if triggered:
                shown, ended, state, low, triggered = "confirming", "done", "idle", p, False
            else:
                shown = state = "triggered"
                triggered = True
        out.append((shown, ended))
    return out


def test_move_states_as_by_hand(spark):
    rnd, rows, want = random.Random(4), [], {}
    for s in "abc":
        prices = [100.0]
        for _ in range(400):
            prices.append(max(1.0, prices[-1] * (1 + rnd.choice([0, 0, rnd.gauss(0, 0.001), rnd.gauss(0, 0.001), rnd.gauss(0.001, 0.02)]))))
        for i, (p, w) in enumerate(zip(prices, states_by_hand(prices), strict=True)):
            rows.append((len(rows), s, i, p))
            want[rows[-1][0]] = w
    rows.append((9999, "a", 7, None))
    rnd.shuffle(rows)
    got = mv.move_states(spark.createDataFrame(rows, TICK).repartition(5)).collect()
    assert {r.tick_id: (r.state, r.ended) for r in got} == want
    assert {w[0] for w in want.values()} == {"idle", "building", "triggered", "confirming"} and {w[1] for w in want.values()} == {None, "retrace", "lateral", "done"}
    assert mv.move_states(spark.createDataFrame([], TICK)).collect() == []


def test_a_jump_from_rest_has_no_time_of_building(spark):
    prices = [100.0, 100.0, 103.0, 103.0, 107.0, 107.0]
    got = mv.move_states(spark.createDataFrame([(i, "a", i, p) for i, p in enumerate(prices)], TICK)).orderBy("us").collect()
    # the first jump is seen as a move and as a trigger at once, its low being the tick before
    assert [r.state for r in got] == ["idle", "idle", "triggered", "triggered", "confirming", "idle"]
    assert (got[2].build_us, got[4].confirm_us, got[4].ended, got[4].trigger_price) == (1, 2, "done", 103.0)
    slow = mv.MoveRules(declare=1000.0)
    got = mv.move_states(spark.createDataFrame([(i, "a", i, p) for i, p in enumerate(prices)], TICK), slow).orderBy("us").collect()
    assert got[2].state == "triggered" and got[2].build_us is None


def test_noise_seed(spark):
    rows = [(i, "many", i, 100.0 + (i * 7) % 5) for i in range(40)] + [(100, "few", 1, 10.0), (101, "few", 2, 11.0), (102, "few", 3, 11.0), (103, "few", 4, 14.0)] + [(200, "one", 1, 50.0), (201, "flat", 1, 50.0), (202, "flat", 2, 50.0)]
    got = {r.symbol: (r.n, r.seed) for r in mv.noise_seed(spark.createDataFrame(rows, TICK), 40, 100).collect()}
    p = [r[3] for r in rows[:40]]
    moves = [abs(b - a) for a, b in zip(p, p[1:], strict=False) if a != b]
    mean = moves[0]
    for m in moves[1:]:
        mean = 0.1 * m + 0.9 * mean
    assert got["many"][0] == len(moves) and abs(got["many"][1] - mean) < 1e-9
    assert got["few"] == (2, 2.0) and got["one"] == (0, 0.005) and got["flat"] == (0, 0.005)


def test_rows_of_a_key_keep_their_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id"))

        def step(seen, row):
            seen.append(row.id)
            return (row.key, len(seen), seen[-2] if len(seen) > 1 else -1)

        got = sorted(map(tuple, mv.in_order(df, "key", ["id"], lambda _: [], step, "key long, n long, before long").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((i % 3, i // 3 + 1, i - 3 if i >= 3 else -1) for i in range(100))


def test_a_seed_sets_the_noise_that_a_symbol_begins_with(spark):
    rnd, rows = random.Random(9), []
    for i in range(200):
        rows.append((i, "abc"[i % 3], i * 1000, 100 + rnd.gauss(0, 1)))
    ticks = spark.createDataFrame(rows, "tick_id long, symbol string, us long, price double")
    cut = 90_000
    seeds = mv.noise_seed(ticks.filter("symbol <> 'c'"), cut, cut)
    got = {r.tick_id: r for r in mv.move_states(ticks.filter(f"us > {cut}"), seeds=seeds).collect()}
    held = {r.symbol: r for r in seeds.collect()}
    assert set(held) == {"a", "b"}
    for s in "abc":
        m = mv.Move(noise=held[s].seed, last=held[s].seed_price, low=held[s].seed_price, low_us=held[s].seed_us) if s in held else mv.Move()
        for i, symbol, us, price in rows:
            if symbol == s and us > cut:
                state = mv._step(m, mv.Tick(i, s, us, price), mv.MoveRules())
                assert (got[i].state, got[i].noise) == (state[3], state[4])
    # a seed below the floor is lifted to it
    assert mv.seeded(spark.createDataFrame([(1e-9, 100.0, 5)], "seed double, seed_price double, seed_us long").first()).noise == 100.0 * mv.FLOOR
