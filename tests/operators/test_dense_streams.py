"""Streams whose work must grow with their ticks, and whose memory must not grow with a batch."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import moves as mv
from tidemark.operators import outcomes as oc
from tidemark.streaming import jobs

S = 1_000_000


def streamed(spark, path, parts, schema, of, to):
    """A stream of a file for each of ``parts``, in their order."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn(to, F.timestamp_micros(of)).coalesce(1).write.parquet(f"{path}/{k}")
        time.sleep(0.02)
    return spark.readStream.schema(f"{schema}, {to} timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_jobs_meet_ticks_by_buckets_of_time(spark, tmp_path):
    rnd = random.Random(4)
    tick, job = "tick_id long, symbol string, us long, price double", "job_id string, symbol string, due_us long, start_price double"
    ticks = [(i, rnd.choice("ab"), i * 60 * S + rnd.randrange(S), 100 + rnd.gauss(0, 1)) for i in range(200)]
    due = [(f"j{i}", rnd.choice("abc"), rnd.randrange(12_000) * S, 100.0) for i in range(60)]
    t, j = streamed(spark, tmp_path / "t", [ticks, [(999, "z", 10**6 * S, 1.0)]], tick, "us", "ts"), streamed(spark, tmp_path / "j", [due, [("end", "z", 10**6 * S, 1.0)]], job, "due_us", "due_ts")
    told = jobs.stream_outcomes(j, t, back="90 seconds", forward="200 seconds", late_s=600, bucket_us=45 * S)
    assert "_bucket" in next(line for line in told._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in line)
    got = {r.job_id: (r.asof_price, r.next_price) for r in jobs.run_available(told).collect()}
    bars = spark.createDataFrame([], "symbol string, open_us long, c double")
    want = {r.job_id: (r.asof_price, r.next_price) for r in oc.resolved(spark.createDataFrame(due, job), spark.createDataFrame(ticks, tick), bars, back_us=90 * S, forward_us=200 * S).collect()}
    assert got == want and any(None in x for x in got.values())


def test_moves_by_batches_are_those_of_the_whole(spark, tmp_path):
    """Ticks come shuffled over batches; what the watermark has not passed waits as a table. Ids are beyond what a double holds."""
    rnd, price, rows, big = random.Random(2), 100.0, [], 1 << 60
    for i in range(400):
        price = max(1.0, price * (1 + rnd.gauss(0, 0.01)))
        rows.append((big + i, rnd.choice("ab"), i * 100_000, price if i % 37 else None))
    schema = "tick_id long, symbol string, us long, price double"
    mixed = sorted(rows, key=lambda r: r[2] + rnd.uniform(-60, 60) * 100_000)  # up to 12 seconds late
    stream = streamed(spark, tmp_path / "in", [*(mixed[k : k + 100] for k in range(0, 400, 100)), [(big + 1000, "z", 10**9, 1.0)], [(big + 1001, "a", 5, 1.0)]], schema, "us", "ts")
    want = sorted(map(str, mv.move_states(spark.createDataFrame(rows, schema)).collect()))
    assert len(want) > 300 and sorted(map(str, jobs.run_move_states(stream, 13 * S).collect())) == want
