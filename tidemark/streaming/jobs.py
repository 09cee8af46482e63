"""Structured Streaming jobs: tumbling bars, sliding trade flow and candidate sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quotes import outcome_pct
from ..operators.audit import delay_status
from ..operators.moves import STATES, MoveRules, states_after
from ..operators.stage import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("price", F.lit(100.0) + F.col("value") / 10.0)


def run_available(stream: DataFrame) -> DataFrame:
    """Runs a stream over what there is and returns what it appended. Windows still open at the end are not in it."""
    at = shared_path(stream.sparkSession, "stream")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def run_into(stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over what there is, handing each batch to ``write``."""
    at = shared_path(stream.sparkSession, "stream")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def late_data(events: DataFrame, delay_us: Column, width: str, hard: str) -> DataFrame:
    """(open_us, status, n): live, late and stale messages of each window; what comes later than ``hard`` after its time is not waited for."""
    told = events.withColumn("status", delay_status(delay_us)).withWatermark("ts", hard).groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n"))
    return told.select(F.unix_micros("window.start").alias("open_us"), "status", "n")


def split_late(events: DataFrame, delay_us: Column) -> tuple[DataFrame, DataFrame]:
    """(live, late) rows of a stream run over what there is, with status and delay_ms: what came too late to count is a table of its own, not a gap.

    One stream writes both, by status, so each message is in exactly one, once, whatever is run again."""
    told = events.withColumns({"status": delay_status(delay_us), "delay_ms": delay_us / 1000.0})
    at = shared_path(events.sparkSession, "late")
    told.writeStream.format("parquet").partitionBy("status").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    held = events.sparkSession.read.schema(told.schema).parquet(f"{at}/out")
    return held.filter("status = 'live'"), held.filter("status <> 'live'")


def alert_dedup(alerts: DataFrame, message: Column, within: str) -> DataFrame:
    """``alerts`` (ts, ...) without those whose message came before, for ``within`` after it: the batch form is ``cooldown_filter`` by message."""
    marked = alerts.withColumn("_message", F.md5(message)).withWatermark("ts", within)
    return marked.dropDuplicatesWithinWatermark(["_message"]).drop("_message")


def stream_bars(events: DataFrame, width: str, late: str) -> DataFrame:
    bars = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", width)).agg(F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("n"))
    return bars.select("symbol", F.unix_micros("window.start").alias("open_us"), "avg_price", "n")


def stream_trade_flow(events: DataFrame, width: str, slide: str, late: str, least: int = 3, ratio: float = 0.55) -> DataFrame:
    """Sliding buy ratio by symbol; confirmed with enough trades and a high enough ratio."""
    qty = (1 + F.regexp_extract("props", "[0-9]+", 0).cast("int") % 9).cast("double")
    flow = events.withColumn("qty", qty).withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum(F.when(F.col("event_id") % 2 != 0, F.col("qty")).otherwise(0.0)).alias("bought"))
    r = F.col("bought") / F.col("qty")
    return flow.select("symbol", F.unix_micros("window.start").alias("open_us"), "n", r.alias("buy_ratio"), ((F.col("n") >= least) & (r >= ratio)).alias("confirmed"))


def run_move_states(ticks: DataFrame, late_us: int, rules: MoveRules | None = None) -> DataFrame:
    """``stream_move_states`` of a stream (tick_id, symbol, ts, us, price), run over what there is, for batches of any size.

    Ticks that the watermark has not passed are a table and not a symbol's state, and so are the moves after each batch: what it has passed is sorted
    by Spark and goes through a task row by row, so that memory does not grow with a batch. A tick not after the watermark of the batches before its own is dropped.
    """
    spark, r = ticks.sparkSession, rules or MoveRules()
    at, made, known = shared_path(spark, "moves"), [], {"mark": None, "held": None, "moves": None}

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.filter("price is not null and not isnan(price)").select("tick_id", "symbol", "us", "price")
        newest = rows.agg(F.max("us")).first()[0]
        if newest is None:
            return
        mark = max(x for x in (known["mark"], (newest // 1000 - late_us // 1000) * 1000) if x is not None)
        if known["mark"] is not None:
            rows = rows.filter(F.col("us") > known["mark"]).unionByName(known["held"])
        moves = known["moves"] if known["moves"] is not None else batch.sparkSession.createDataFrame([], "symbol string, move string")
        states_after(rows.filter(F.col("us") < mark), moves, r).write.mode("overwrite").parquet(f"{at}/made/{n}")
        rows.filter(F.col("us") >= mark).write.mode("overwrite").parquet(f"{at}/held/{n}")
        read = batch.sparkSession.read
        told = read.parquet(f"{at}/made/{n}").filter("move is not null").select("symbol", "move")
        told.unionByName(moves.join(told.select(F.col("symbol").alias("_symbol")), F.col("symbol").eqNullSafe(F.col("_symbol")), "left_anti")).write.mode("overwrite").parquet(f"{at}/after/{n}")
        known.update(mark=mark, held=read.parquet(f"{at}/held/{n}"), moves=read.parquet(f"{at}/after/{n}"))
        made.append(f"{at}/made/{n}")

    run_into(ticks, write)
    return (spark.read.schema(f"{STATES}, move string").parquet(*made) if made else spark.createDataFrame([], f"{STATES}, move string")).filter("move is null").drop("move")


#: Attempts that an outcome has, and the seconds between them, more each time: it is an error after the last.
ATTEMPTS, BACKOFF_S = 3, 60


def stream_outcomes(due: DataFrame, ticks: DataFrame, *, back: str, forward: str, late_s: int, width: str = "1 hour", bucket_us: int = 1_800_000_000) -> DataFrame:
    """Outcomes of a stream of jobs (job_id, symbol, due_ts, start_price) from a stream of ticks (tick_id, symbol, ts, price): the last price within ``back`` before the due time and the first within ``forward`` after it.

    Both streams may come ``late_s`` seconds late. Each job meets the ticks of its interval as either comes, and is told once, when no more can come: a side without
    a tick is an error then, its attempts being used up, for ``late_s`` is no less than all delays between them. Jobs still open when the stream ends are not in the result.
    The batch form is ``resolved`` with ticks alone.

    Jobs are copied to the buckets of time that their interval covers and meet ticks by (symbol, bucket), so that a tick is held against the jobs near it and
    not against all of its symbol.
    """
    if late_s < BACKOFF_S * sum(range(ATTEMPTS)):
        raise ValueError("an outcome is told before its last attempt")
    late = f"{late_s} seconds"
    t = ticks.select(F.col("tick_id").alias("t_id"), F.col("symbol").alias("t_symbol"), F.col("ts").alias("t_ts"), F.col("price").alias("t_price"), F.expr(f"unix_micros(ts) div {bucket_us}").alias("t_bucket")).withWatermark("t_ts", late)
    covered = F.explode(F.expr(f"sequence(unix_micros(due_ts - interval {back}) div {bucket_us}, unix_micros(due_ts + interval {forward}) div {bucket_us})"))
    met = due.withWatermark("due_ts", late).withColumn("_bucket", covered).join(t, F.expr(f"symbol = t_symbol AND _bucket = t_bucket AND t_ts >= due_ts - interval {back} AND t_ts <= due_ts + interval {forward}"), "leftOuter")
    place = F.struct("t_ts", "t_id")
    told = met.groupBy(F.window("due_ts", width), "job_id", "start_price").agg(F.max_by("t_price", F.when(F.col("t_ts") <= F.col("due_ts"), place)).alias("asof_price"), F.min_by("t_price", F.when(F.col("t_ts") >= F.col("due_ts"), place)).alias("next_price"))
    sides = [c for side in ("asof", "next") for c in (F.col(f"{side}_price"), outcome_pct(F.col(f"{side}_price"), F.col("start_price")).alias(f"{side}_pct"), F.when(F.col(f"{side}_price").isNull(), "error").otherwise("done").alias(f"{side}_status"))]
    return told.select("job_id", *sides, F.when(F.col("asof_price").isNull() | F.col("next_price").isNull(), ATTEMPTS).otherwise(1).alias("attempts"))


def candidate_sessions(events: DataFrame, ttl: str, late: str) -> DataFrame:
    """Lifetimes of candidates: every trigger extends the session by ``ttl``; the first trigger's price is kept."""
    s = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.session_window("ts", ttl).alias("w")).agg(F.min_by("price", "ts").alias("first_price"), F.count(F.lit(1)).alias("n"))
    return s.select("symbol", F.unix_micros("w.start").alias("open_us"), F.unix_micros("w.end").alias("close_us"), "first_price", "n")
