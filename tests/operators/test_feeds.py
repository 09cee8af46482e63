import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quotes as qf
from tidemark.functions import records as rc
from tidemark.operators import audit as au
from tidemark.operators import dataset as ds
from tidemark.operators import detect as dt
from tidemark.operators import moves as mv
from tidemark.operators import outcomes as oc
from tidemark.operators import sinks as sk
from tidemark.operators import universe as un
from tidemark.operators import windows as wn
from tidemark.sources import feeds
from tidemark.streaming import jobs


def test_trades_are_told_why_they_are_rejected(spark):
    bodies = {
        '{"T": 5, "p": "1.5", "q": 2, "m": true}': (5, 1.5, 2.0, True, None),
        '{"T": 5, "p": "1.5", "q": 2': (None,) * 4 + ("not_json",),
        "[1]": (None,) * 4 + ("not_json",),
        '{"p": "1.5", "q": 2, "m": true}': (None,) * 4 + ("missing_T",),
        '{"T": "x", "p": "1.5", "q": 2, "m": true}': (None,) * 4 + ("bad_T",),
        '{"T": 5, "p": "NaN", "q": 2, "m": true}': (None,) * 4 + ("bad_p",),
        '{"T": 5, "p": 1, "q": null, "m": true}': (None,) * 4 + ("missing_q",),
        '{"T": 5, "p": 1, "q": 1, "m": "perhaps"}': (None,) * 4 + ("bad_m",),
        None: (None,) * 4 + ("not_json",),
    }
    got = {r.body: tuple(r)[1:] for r in feeds.parsed_trades(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert got == bodies
    assert feeds.parsed_trades(spark.createDataFrame([], "body string")).collect() == []


def test_klines_and_broken_messages(spark):
    rows = [("a", '[[1,"2","3","1","2.5","9",5],[6,"x","3","1","2","8",9]]'), ("b", "nonsense"), ("c", None), ("d", "[]")]
    got = [tuple(r) for r in feeds.exploded_klines(spark.createDataFrame(rows, "symbol string, body string")).orderBy("nth").collect()]
    assert got == [("a", 0, 1, 2.0, 3.0, 1.0, 2.5, 9.0, 5), ("a", 1, 6, None, 3.0, 1.0, 2.0, 8.0, 9)]


@pytest.mark.parametrize(
    ("contract", "change", "broken"),
    [
        ("signal", {}, []),
        ("signal", {"side": "up"}, ["bad_side"]),
        ("signal", {"confidence": 1.01, "rr_est": -1}, ["bad_confidence", "bad_rr_est"]),
        ("signal", {"reasons": "r", "ttl_min": 0}, ["bad_reasons", "bad_ttl_min"]),
        ("signal", {"ts": "today?", "ttl_min": 1.5}, ["bad_ts", "bad_ttl_min"]),
        ("signal", {"symbol": None}, ["missing_symbol"]),
        ("watchlist", {}, []),
        ("watchlist", {"score": 101}, ["bad_score"]),
        ("watchlist", {"score": 0.5, "why": None}, ["missing_why", "bad_score"]),
    ],
)
def test_contracts(spark, contract, change, broken):
    good = {"symbol": "s", "side": "long", "confidence": 1, "rr_est": 0, "reasons": ["r"], "version": "v", "score": 100, "why": [], "ts": "2024-01-01T00:00:00Z", "ttl_min": 1}
    body = json.dumps({k: v for k, v in (good | change).items() if k in feeds.CONTRACTS[contract] and v is not None})
    df = spark.createDataFrame([(body,), ("{", ), (None,)], "body string")
    got = [r[0] for r in df.select(feeds.contract_violations(F.col("body"), contract)).collect()]
    assert got == [broken, ["json"], ["json"]]


def test_symbols_come_from_the_first_source_that_has_any(spark):
    lines = spark.createDataFrame([(" AUSDT ",), ("BEUR",), ("",), (None,)], "value string")
    other = spark.createDataFrame([("CUSDT",)], "symbol string")
    assert [r.symbol for r in feeds.symbol_list(lines, other).collect()] == ["AUSDT"]
    assert [r.symbol for r in feeds.symbol_list(lines.limit(0), other.limit(0), other).collect()] == ["CUSDT"]


def test_hashes_are_those_of_sorted_json(spark):
    rows = [({"b": "1", "a": '"x"', "c": "null"},), ({},), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "m map<string,string>").select(rc.config_hash(F.col("m"))).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert got == [sha(json.dumps({"b": 1, "a": "x", "c": None}, sort_keys=True)), sha("empty_config"), sha("empty_config")]


def test_extras_keep_leading_keys_within_the_limit(spark):
    extras = {"delta": 1.5, "a": 1, "b": "two", "c": True, "long": "x" * 50, "d": 4}
    known, rest = rc.extras_split(F.col("e"), {"delta": "double", "n_trades": "long"}, most_bytes=40)
    rows = [(json.dumps(extras),), (json.dumps({"delta": "NaN"}),), (None,), (json.dumps({"q": 'say "no"'}),)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "e string").select(*known.values(), rest).collect()]
    assert got == [(1.5, None, '{"a": 1, "b": "two", "c": true}'), (None, None, None), (None, None, None), (None, None, json.dumps({"q": 'say "no"'}))]


def test_day_sink_replaces_the_days_of_a_batch_only(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (2, "2024-01-02 05:00:00")], "id long, t string").withColumn("ts", F.to_timestamp("t"))
    sk.write_day_partitioned(rows, path)
    sk.write_day_partitioned(rows.filter("id = 2").withColumn("id", F.lit(9).cast("long")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 9]


def test_a_batch_may_come_twice(spark, tmp_path):
    write = sk.append_absent(str(tmp_path / "sink"), "id")
    batch = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-02 05:00:00")], "id long, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    for part in (batch, batch, batch.limit(0), batch.union(batch.filter("id = 2").withColumn("id", F.lit(3).cast("long")))):
        write(part, 0)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == [1, 2, 3]


def test_schemas_are_brought_in_line(spark):
    wide = spark.createDataFrame([(1, "x", 2.0)], "a long, b string, c double")
    old = spark.createDataFrame([(7, 3)], "z int, a int")
    assert [tuple(r) for r in sk.align_schema(old, wide.schema).collect()] == [(3, None, None)]
    assert sk.align_schema(old, wide.schema).schema.simpleString() == wide.schema.simpleString()


def test_run_status_of_tables(spark):
    one, none = spark.range(1), spark.range(0)
    run = lambda t, e=frozenset(): {r.table: (r.rows, r.status, r.run_status) for r in au.table_completeness(spark, t, set(e)).collect()}
    assert run({"a": one}) == {"a": (1, "ok", "OK_ALL")}
    assert run({"a": one, "b": none}, {"b"})["b"] == (0, "ok_empty", "OK_WITH_EMPTY_TABLES")
    assert run({"a": one, "b": none})["b"] == (0, "failed_semantic_empty", "PARTIAL_FAILED")
    assert run({"b": None}) == {"b": (None, "failed_missing_table", "FAILED_ALL")}


def test_signature_tells_universes_apart(spark):
    def of(symbols):
        return un.signature(spark.createDataFrame([(x,) for x in symbols], "symbol string").repartition(3)).first().signature

    assert of(["A", "BB", "CCCC"]) == of(["CCCC", "A", "BB"]) != of(["A", "BB", "CCCD"])


TICK = "tick_id long, symbol string, us long, price double, vol_24h double, blocked boolean, watched boolean, downtrend boolean"
FLOW = "tick_id long, n_trades long, buy_ratio double, quote_vol double"


def detected(spark, ticks, flow=None, **p):
    """Ticks (price, more) a second apart; by default trades confirm every one."""
    rows = [{"tick_id": i, "symbol": "s", "us": i * 1_000_000, "vol_24h": 2880.0, "blocked": False, "watched": True, "downtrend": False} | ({"price": t} if isinstance(t, float) else t) for i, t in enumerate(ticks)]
    flows = [(i, 5, 0.9, 10.0) if flow is None else (i, *flow[i]) for i in range(len(ticks))]
    names = TICK.replace(" long", "").replace(" string", "").replace(" double", "").replace(" boolean", "").split(", ")
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TICK)
    params = {"pump_pct": 1.0, "min_vol_24h": 100.0, "cooldown_us": 5_000_000, "ttl_us": 3_000_000, "rel_volume": 3.0} | p
    got = dt.pump_fast_detect(df, spark.createDataFrame(flows, FLOW), dt.DetectParams(**params)).orderBy("us").collect()
    return [(r.tick_id, r.kind, r.decision, r.rejection_reason) for r in got]


def test_detection_gates(spark):
    ok = ("alert", "passed", None)
    assert detected(spark, [100.0, 102.0]) == [(1, *ok)]
    assert detected(spark, [100.0, 100.5]) == []
    # within the cooldown of the last alert nothing is told
    assert detected(spark, [100.0, 102.0, 104.0, 106.0, 108.0, 110.0, 112.0, 114.0]) == [(1, *ok), (6, *ok)]
    # an unconfirmed rise keeps its trigger price, so that a later one may come too late
    none, well = (1, 0.9, 10.0), (5, 0.9, 10.0)
    assert detected(spark, [100.0, 102.0, 105.0, 108.0], [none, none, none, well]) == [(3, "alert", "rejected", "late_entry")]
    assert detected(spark, [100.0, 102.0, 104.0], [none, none, well]) == [(2, *ok)]
    assert detected(spark, [100.0, 102.0], [none, (5, 0.5, 10.0)]) == []
    assert detected(spark, [100.0, 102.0], [none, (5, 0.9, 2.0)]) == []
    row = lambda price, **k: {"price": price} | k
    assert detected(spark, [100.0, row(102.0, downtrend=True)]) == []
    assert detected(spark, [100.0, row(102.0, vol_24h=None), 104.1]) == [(2, *ok)]
    assert detected(spark, [100.0, row(102.0, watched=False), 100.5]) == []
    # a blocked tick is not seen, unless near misses are wanted
    assert detected(spark, [100.0, row(102.0, blocked=True), 100.5]) == []
    assert detected(spark, [100.0, row(102.0, blocked=True), 103.5], near_miss=True) == [(1, "near_miss", "blocked", "operator_sleep"), (2, *ok)]
    assert detected(spark, [100.0, row(None), row(0.0), 102.0]) == [(3, *ok)]


def test_states_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Ticks come shuffled over batches; a last one, far ahead, moves the watermark past all others."""
    rnd, price, rows = random.Random(2), 100.0, []
    for i in range(400):
        price = max(1.0, price * (1 + rnd.gauss(0, 0.01)))
        rows.append((i, rnd.choice("ab"), i * 100_000, price if i % 37 else None))
    schema = "tick_id long, symbol string, us long, price double"
    stamped = lambda part: spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1)
    mixed = sorted(rows, key=lambda r: r[0] + rnd.uniform(-60, 60))  # up to 12 seconds late
    for k in range(8):
        stamped(mixed[k * 50 : (k + 1) * 50]).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.02)  # files are taken in order of their times
    stamped([(1000, "z", 10**9, 1.0)]).write.parquet(f"{tmp_path}/in/end")
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    want = sorted(map(str, mv.move_states(spark.createDataFrame(rows, schema)).collect()))
    assert len(want) > 300 and sorted(map(str, jobs.run_available(mv.stream_move_states(stream, "13 seconds")).collect())) == want


def test_late_messages_are_a_table_of_their_own(spark, tmp_path):
    rows = [(i, "2024-01-01 00:00:00", i * 1_000_000) for i in range(20)]
    spark.createDataFrame(rows, "id long, t string, delay long").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in")
    live, late = jobs.split_late(spark.readStream.schema("id long, delay long, ts timestamp").parquet(f"{tmp_path}/in"), F.col("delay"))
    assert [r.id for r in live.orderBy("id").collect()] == [0, 1, 2, 3]
    assert [(r.id, r.status, r.delay_ms) for r in late.orderBy("id").collect()] == [(i, "late" if i <= 15 else "stale", i * 1000.0) for i in range(4, 20)]


def test_messages_once_in_a_while(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:03"), ("b", "2024-01-01 00:00:03")]
    spark.createDataFrame(rows, "m string, t string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("m string, ts timestamp").parquet(f"{tmp_path}/in")
    assert sorted(r.m for r in jobs.run_available(jobs.alert_dedup(stream, F.col("m"), "5 seconds")).collect()) == ["a", "b"]


def test_attempts_are_numbered_on(spark):
    new = [("a", 50, 40, "ok", None, "m" * 501), ("a", 10, 2_000, "odd", "E" * 101, "m" * 500), ("b", 5, 5_005, None, "E" * 100, None)]
    got = ds.numbered_attempts(spark.createDataFrame(new, "event_id string, started_us long, finished_us long, result_quality string, error_class string, error_message string"), spark.createDataFrame([("a", 3), ("a", 7), ("c", 9)], "event_id string, attempt_n int"))
    got = {(r.event_id, r.attempt_n): r for r in got.collect()}
    assert set(got) == {("a", 8), ("a", 9), ("b", 1)}
    assert (got["a", 8].duration_ms, got["a", 8].result_quality, got["a", 8].error_class, len(got["a", 8].error_message)) == (1, None, "E" * 97 + "...", 500)
    assert (got["a", 9].duration_ms, got["a", 9].error_message) == (0, "m" * 497 + "...") and (got["b", 1].duration_ms, got["b", 1].error_class) == (5, "E" * 100)


def test_movers_pass_volume_move_and_bias(spark):
    rows = [(1, "a", 0.5, 60_000.0, 40_000.0), (2, "b", -0.9, 60_000.0, 40_000.0), (3, "c", 5.0, 49_999.0, 49_000.0), (4, "d", 0.29, 60_000.0, 60_000.0), (5, "e", 2.0, 60_000.0, 30_000.0), (6, "f", 2.0, None, None), (7, "g", None, 60_000.0, 60_000.0), (8, "h", 0.9, 60_000.0, 50_000.0)]
    got = wn.top_movers(spark.createDataFrame(rows, "tick_id long, symbol string, delta_pct double, vol_24h double, buy_vol double"), 2).collect()
    assert [(r.tick_id, r.side) for r in got] == [(2, "DUMP"), (8, "PUMP")]


def test_ids_have_iso_times(spark):

    df = spark.createDataFrame([("S", "2024-01-01 00:00:11.172425", "2024-01-01 00:00:12"), ("S", None, "2024-01-01 00:00:12.5")], "s string, a string, b string").select("s", F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    got = [r.h for r in df.select(qf.candidate_id(F.col("s"), F.col("a"), F.col("b"), F.lit("v1"), F.lit("cfg")).alias("h")).collect()]
    want = ["S|2024-01-01T00:00:11.172425+00:00|2024-01-01T00:00:12+00:00|v1|cfg", "S|none|2024-01-01T00:00:12.500000+00:00|v1|cfg"]
    assert got == ["ev_" + hashlib.sha256(w.encode()).hexdigest()[:32] for w in want]


def test_all_features_are_masked(spark):
    names = (*qf.CRITICAL, *qf.OPTIONAL)
    mask, missing, degraded = qf.feature_quality()
    df = spark.createDataFrame([tuple([1.0] * 11), tuple([None] * 11), (*[1.0] * 3, *[None] * 8)], ", ".join(f"{n} double" for n in names)).select(mask.alias("m"), missing.alias("n"), degraded.alias("d"))
    a, b, c = df.collect()
    assert (a.m, a.n, a.d) == ({}, 0, False) and (b.n, b.d) == (11, True) and (c.n, c.d) == (8, False)
    assert b.m["rel_vol"] == "missing_critical" and b.m["stage_pct"] == "missing_optional"


def test_outcomes_of_streams_are_those_of_the_batch(spark, tmp_path):
    """Jobs and ticks come shuffled over batches; what comes last is far ahead and closes all that is open."""
    rnd, S = random.Random(6), 1_000_000
    ticks = [(i, rnd.choice("ab"), i * 60 * S + rnd.randrange(S), 100 + rnd.gauss(0, 1)) for i in range(300)]
    due = [(f"j{i}", rnd.choice("abc"), rnd.randrange(18_000) * S, 100.0) for i in range(80)]
    stamp = lambda rows, schema, of, to: spark.createDataFrame(rows, schema).withColumn(to, F.timestamp_micros(of)).coalesce(1)
    tick, job = "tick_id long, symbol string, us long, price double", "job_id string, symbol string, due_us long, start_price double"
    for name, rows, schema, of, to in (("t", ticks, tick, "us", "ts"), ("j", due, job, "due_us", "due_ts")):
        mixed = sorted(rows, key=lambda r: r[2] + rnd.uniform(-250, 250) * S)
        for k in range(4):
            stamp(mixed[k * len(mixed) // 4 : (k + 1) * len(mixed) // 4], schema, of, to).write.parquet(f"{tmp_path}/{name}/{k}")
            time.sleep(0.02)
        far = (999, "z", 10**6 * S, 1.0) if name == "t" else ("end", "z", 10**6 * S, 1.0)
        stamp([far], schema, of, to).write.parquet(f"{tmp_path}/{name}/end")
    read = lambda name, schema, to: spark.readStream.schema(f"{schema}, {to} timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    got = {r.job_id: r for r in jobs.run_available(jobs.stream_outcomes(read("j", job, "due_ts"), read("t", tick, "ts"), back="90 seconds", forward="200 seconds", late_s=600)).collect()}
    bars = spark.createDataFrame([], "symbol string, open_us long, c double")
    want = {r.job_id: r for r in oc.resolved(spark.createDataFrame(due, job), spark.createDataFrame(ticks, tick), bars, back_us=90 * S, forward_us=200 * S).collect()}
    assert set(got) == set(want) and {"done", "error"} == {r.next_status for r in got.values()}
    for i, w in want.items():
        assert tuple(got[i][c] for c in ("asof_price", "asof_pct", "asof_status", "next_price", "next_pct", "next_status")) == tuple(w[c] for c in ("asof_price", "asof_pct", "asof_status", "next_price", "next_pct", "next_status"))
        assert got[i].attempts == (3 if "error" in (w.asof_status, w.next_status) else 1)
    with pytest.raises(ValueError):
        jobs.stream_outcomes(read("j", job, "due_ts"), read("t", tick, "ts"), back="1 second", forward="1 second", late_s=179)
