"""Audits: completeness of tables, invariants of snapshots, lateness and stale feeds, recent events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constraints import violations


def table_completeness(spark: SparkSession, tables: dict[str, DataFrame | None], may_be_empty: set[str]) -> DataFrame:
    """(table, rows, status, run_status): a row for each table; None stands for one that is missing."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") if t is not None else spark.range(1).select(F.lit(n).alias("table"), F.lit(None).cast("long").alias("rows")) for n, t in tables.items()]
    n = F.col("rows")
    status = F.when(n.isNull(), "failed_missing_table").when(n > 0, "ok").when(F.col("table").isin(*may_be_empty) if may_be_empty else F.lit(False), "ok_empty").otherwise("failed_semantic_empty")
    told = reduce(DataFrame.unionByName, counts).withColumn("status", status)
    every = Window.partitionBy()
    failed, empty, total = (F.sum(F.when(c, 1).otherwise(0)).over(every) for c in (F.col("status").startswith("failed"), F.col("status") == "ok_empty", F.lit(True)))
    return told.withColumn("run_status", F.when(failed == total, "FAILED_ALL").when(failed > 0, "PARTIAL_FAILED").when(empty > 0, "OK_WITH_EMPTY_TABLES").otherwise("OK_ALL"))


def snapshot_invariants(rows: DataFrame, constants: dict[str, str]) -> DataFrame:
    """``rows`` with ``broken``, the invariants that a snapshot breaks, and ``validity`` turned from valid to suspicious by any.

    ``rows``: window_start_us, window_end_us, source_us, snapshot_us, feature_us, trade_us, book_us, flow, quote_vol, bid, ask,
    validity, and the columns of ``constants``, which must hold the given values. Nulls break nothing.
    """
    c = F.col
    rules = {
        "window_order": c("window_start_us") <= c("window_end_us"),
        "source_before_window_end": c("window_end_us") <= c("source_us"),
        "source_after_snapshot": c("source_us") <= c("snapshot_us"),
        "feature_not_at_window_end": F.abs(c("feature_us") - c("window_end_us")) <= 1_000_000,
        "trade_after_snapshot": c("trade_us") <= c("snapshot_us"),
        "book_after_snapshot": c("book_us") <= c("snapshot_us"),
        "flow_above_volume": (c("quote_vol") < 0) | (F.abs(c("flow")) <= c("quote_vol") * 1.001),
        "crossed_book": c("bid") <= c("ask"),
    } | {f"{n}_changed": F.col(n).eqNullSafe(F.lit(v)) for n, v in constants.items()}
    told = rows.withColumn("broken", violations(rules))
    return told.withColumn("validity", F.when((F.size("broken") > 0) & (F.col("validity") == "valid"), "suspicious").otherwise(F.col("validity")))


def delay_status(delay_us: Column, soft_us: int = 3_000_000, hard_us: int = 15_000_000) -> Column:
    """live, late or stale by how long after its event a message is processed; null without a time."""
    return F.when(delay_us.isNull(), None).when(delay_us <= soft_us, "live").when(delay_us <= hard_us, "late").otherwise("stale")


def lateness_stats(rows: DataFrame, batch: list[Column | str], delay_us: Column, soft_us: int = 3_000_000, hard_us: int = 15_000_000) -> DataFrame:
    """For each batch: messages, those later than the soft and than the hard limit, and the longest delay, never below zero."""
    return rows.withColumn("_d", delay_us).groupBy(*batch).agg(F.count("_d").alias("n"), F.count_if(F.col("_d") > soft_us).alias("late"), F.count_if(F.col("_d") > hard_us).alias("stale"), (F.greatest(F.lit(0), F.max("_d")) / 1000.0).alias("max_delay_ms"))


def recent_events(events: DataFrame, features: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` events with their features."""
    return events.join(features, "event_id").orderBy(F.desc("us"), "event_id").limit(n)
