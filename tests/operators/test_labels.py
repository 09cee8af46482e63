import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quotes as qf
from tidemark.operators import dataset as ds
from tidemark.operators import labels as lb
from tidemark.operators.timejoin import asof_unbounded
from tidemark.operators import windows as wn
from tidemark.operators.timejoin import asof, range_join

TICK = "tick_id long, symbol string, us long, bid double, ask double, price double"
EVENT = "event_id string, symbol string, us long"


def series(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("ab"), rnd.randrange(10_000), rnd.uniform(90, 110), None, float(i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, TICK)


def test_book_rules(spark):
    rows = [(None, 1.0), (1.0, None), (float("nan"), 1.0), (float("inf"), 1.0), (0.0, 1.0), (-1.0, 1.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0)]
    got = spark.createDataFrame(rows, "bid double, ask double").select(qf.valid_book(F.col("bid"), F.col("ask"))).collect()
    assert [r[0] for r in got] == [False] * 7 + [True] * 2


@pytest.mark.parametrize("bucket", [1, 37, 5000])
def test_range_join_is_exact_for_any_bucket(spark, bucket):
    rows, ticks = series(spark)
    events = [(f"e{i}", "ab"[i % 2], i * 97) for i in range(100)]
    got = range_join(spark.createDataFrame(events, EVENT), ticks.select("tick_id", "symbol", "us"), F.col("us") - 100, F.col("us") + 50, bucket)
    want = {(e, t) for e, s, u in events for t, ts, tu, *_ in rows if s == ts and u - 100 <= tu <= u + 50}
    found = [(r.event_id, r.t_tick_id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("forward", [False, True])
def test_asof_edges_and_ties(spark, forward):
    ticks = spark.createDataFrame([(1, "a", 100, None, None, 1.0), (2, "a", 100, None, None, 2.0), (3, "a", 200, None, None, 3.0)], TICK)
    events = spark.createDataFrame([("x", "a", 100), ("y", "a", 150), ("z", "a", 151), ("w", "b", 100), ("v", "a", 99)], EVENT)
    got = {r.event_id: r.asof_price for r in asof(events, ticks, "us", 50, key="event_id", value=["price"], forward=forward).collect()}
    assert got == ({"x": 1.0, "y": 3.0, "z": 3.0, "w": None, "v": 1.0} if forward else {"x": 2.0, "y": 2.0, "z": None, "w": None, "v": None})


def test_anchor_window_is_half_open_and_reasons_are_ordered(spark):
    p = lb.LabelParams()
    s = 1_000_000
    ticks = [(1, "a", 7 * s, 1.0, 3.0, 0.0), (2, "a", 9 * s, 3.0, 5.0, 0.0), (3, "a", 9 * s + 500_000, 5.0, 7.0, 0.0), (4, "a", 10 * s, 90.0, 91.0, 0.0), (5, "b", 9 * s, 2.0, 1.0, 0.0)]
    events = spark.createDataFrame([("in", "a", 10 * s), ("bad", "b", 10 * s), ("none", "c", 10 * s), ("one", "a", 8 * s)], EVENT)
    got = {r.event_id: r for r in lb.anchor_price(events, lb.label_index(spark.createDataFrame(ticks, TICK), p), p).collect()}
    assert (got["in"].p_anchor, got["in"].anchor_points, got["in"].anchor_lag_ms, got["in"].anchor_quality) == (4.0, 3, 500.0, "ok")
    assert [got[e].anchor_reason for e in ("bad", "none", "one")] == ["bad_invalid_book", "bad_missing_quotes", "degraded_low_density"]


def test_label_keeps_the_worst_reason(spark):
    anchor = spark.createDataFrame([("a", None), ("b", "degraded_high_lag"), ("c", "bad_missing_quotes")], "event_id string, anchor_reason string")
    sigma = spark.createDataFrame([("a", None), ("b", "degraded_low_density"), ("c", "bad_sigma")], "event_id string, sigma_reason string")
    horizons = spark.createDataFrame([("a", None), ("b", "bad_stale_data")], "event_id string, reason_code string")
    got = {r.event_id: (r.label_quality, r.reason_code) for r in lb.label_quality(anchor, sigma, horizons).collect()}
    assert got == {"a": ("ok", None), "b": ("bad", "bad_stale_data"), "c": ("bad", "bad_missing_quotes")}


def test_retries_end_at_the_policy(spark):
    rows = [("a", "ok", None, 1), ("b", "bad", None, 1), ("c", "bad", "who_knows", 1), ("d", "bad", "bad_sigma", 1), ("e", "bad", "bad_stale_data", 2), ("f", "bad", "bad_stale_data", 5), ("g", "bad", "bad_time_inconsistency", 0)]
    df = spark.createDataFrame(rows, "event_id string, label_quality string, reason_code string, retry_count int")
    got = {r.event_id: (r.worker_status, r.retry_count, r.terminal_reason_code) for r in ds.retry_classify(df, ds.retry_policy(spark), F.lit(0).cast("long")).collect()}
    assert got == {"a": ("done", 1, None), "b": ("terminal", 2, "bad_labeler_exception"), "c": ("terminal", 2, "who_knows"), "d": ("terminal", 2, "bad_sigma"), "e": ("retry_wait", 3, None), "f": ("terminal", 6, "retry_exhausted:bad_stale_data"), "g": ("terminal", 1, "bad_time_inconsistency")}


def test_policy_is_the_table_of_six_reasons(spark):
    got = {r.reason_code: tuple(r)[1:] for r in ds.retry_policy(spark).collect()}
    terminal = (False, True, 0, 0, 10)
    assert got == {
        "bad_invalid_book": terminal,
        "bad_sigma": terminal,
        "bad_time_inconsistency": terminal,
        "bad_missing_quotes": (True, False, 3, 300, 50),
        "bad_stale_data": (True, False, 5, 600, 50),
        "bad_labeler_exception": (True, False, 3, 900, 50),
    }


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_unbounded_asof_both_ways(spark, bucket):
    rnd = random.Random(bucket)
    ticks = [(i, rnd.choice("ab"), rnd.randint(0, 60) * 9, float(i)) for i in range(40)]
    events = [(i, rnd.choice("abc"), rnd.randint(-20, 600)) for i in range(60)]
    t, e = spark.createDataFrame(ticks, "tick_id long, symbol string, us long, v double"), spark.createDataFrame(events, "id long, symbol string, at long")
    for forward in (False, True):
        got = {r.id: (r.v, r.asof_lag_us) for r in asof_unbounded(e, t, "at", key="id", value=["v"], bucket_us=bucket, by="symbol", forward=forward, tie="tick_id").collect()}
        for i, s, at in events:
            near = [(u, k, v) for k, ts, u, v in ticks if ts == s and (u >= at if forward else u <= at)]
            best = (min if forward else max)(near, default=None)
            assert got[i] == ((None, None) if best is None else (best[2], abs(best[0] - at)))


def test_whitelist_keeps_ok_and_drops_unknown(spark):
    ids = ["ok", "deg", "null", "bad"]
    events = spark.createDataFrame([(i, "a", 1) for i in ids], EVENT)
    features = spark.createDataFrame([(i, n) for i, n in zip(ids, (None, 6, 5, 20), strict=True)], "event_id string, n_trades int")
    labels = spark.createDataFrame([("ok", "ok", None), ("deg", "degraded", "degraded_low_density"), ("null", "degraded", None), ("bad", "bad", "bad_sigma")], "event_id string, label_quality string, reason_code string")
    labels = labels.selectExpr("*", "0.1d AS sigma", "1.0d AS anchor_lag_ms", "2.0d AS coverage_ms")
    marks = spark.createDataFrame([(i, h, 0.1, 0.2, -0.1, 0.0, 3) for i in ids for h in (5, 30)], "event_id string, horizon_min int, ret_h double, mfe_h double, mae_h double, forward_lag_ratio double, points_used int")
    barrier = spark.createDataFrame([("ok", -1, False)], "event_id string, tb_label int, good_event boolean")
    clean = ds.clean_dataset(events, features, labels, marks, barrier)
    got = {r.event_id: (r.dataset_bucket, r.n_trades_bucket, r.needs_downweight, r.is_n_trades_sweet_spot, r.good_event) for r in clean.collect()}
    assert got == {"ok": ("ok_only", "OUT_OF_RANGE", False, False, False), "deg": ("degraded_low_density", "Q2_6_9", True, True, None)}
    assert ds.clean_view_asserts(clean).first().passed
    # a positive return is no good event
    assert {r.dataset_bucket: (r.n, r.good_rate) for r in ds.bucket_profile(clean).collect()} == {"ok_only": (1, 0.0), "degraded_low_density": (1, 0.0)}


@pytest.mark.parametrize(
    "fault, counter",
    [
        ({"needs_downweight": "NOT needs_downweight"}, ("low_not_downweight", "downweight_not_low")), ({"is_n_trades_sweet_spot": "NOT is_n_trades_sweet_spot"}, ("sweet_bucket_not_flag", "sweet_flag_not_bucket")), ({"is_usable": "NULL"}, ("unusable",)),
        ({"dataset_bucket": "'other_unknown'"}, ("unknown",)), ({"label_quality": "'degraded'"}, ("ok_bucket_other_label",)), ({"reason_code": "'degraded_high_lag'"}, ("low_bucket_other_reason",)), ({"dataset_bucket": "'other_degraded'"}, ("other_bucket_other_reason",)),
    ],
)
def test_each_fault_of_the_clean_view_is_counted(spark, fault, counter):
    names = ["event_id", "label_quality", "reason_code", "dataset_bucket", "n_trades_bucket", "needs_downweight", "is_n_trades_sweet_spot", "is_usable"]
    good = spark.createDataFrame([("a", "ok", None, "ok_only", "Q2_6_9", False, True, True), ("b", "degraded", "degraded_low_density", "degraded_low_density", "Q1_le_5", True, False, True)], ", ".join(f"{n} {'boolean' if i > 4 else 'string'}" for i, n in enumerate(names)))
    assert ds.clean_view_asserts(good).first().passed
    told = ds.clean_view_asserts(good.withColumns({c: F.expr(x) for c, x in fault.items()})).first()
    assert not told.passed and all(told[c] == (2 if c in ("unknown", "unusable") else 1) for c in counter)
    assert not ds.clean_view_asserts(good.union(good)).first().passed and not ds.clean_view_asserts(good.filter("label_quality <> 'ok'")).first().passed


def test_upsert_changes_owned_columns_only(spark):
    t = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, label string, retries int")
    b = spark.createDataFrame([(2, "new", 0), (3, "z", 1)], "id int, label string, retries int")
    assert sorted(map(tuple, ds.upsert_latest(t, b, "id", ["label"]).collect())) == [(1, "x", 5), (2, "new", 6), (3, "z", 1)]
    assert sorted(map(tuple, ds.insert_if_absent(t, b.union(b), "id").collect())) == [(1, "x", 5), (2, "y", 6), (3, "z", 1)]


def test_ema_is_the_recursion(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    got = wn.ema(spark.createDataFrame([(i, "a", i, v) for i, v in enumerate(values)], "tick_id long, symbol string, us long, price double"), "price", (3,)).collect()
    want = [values[0]]
    for v in values[1:]:
        want.append(v * 0.5 + want[-1] * 0.5)
    assert [r.ema3 for r in sorted(got)] == pytest.approx(want)
