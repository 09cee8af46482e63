"""Outcomes of signals: due horizons, resolution from ticks and then from bars, status by signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import outcome_pct
from .timejoin import asof


def resolved(jobs: DataFrame, ticks: DataFrame, bars: DataFrame, *, back_us: int, forward_us: int, names: tuple[str, str] = ("ticks", "bars"), strict_us: int = 0) -> DataFrame:
    """Jobs (job_id, symbol, due_us, start_price, ...) with price, outcome, source and status of the last row up to the due time and of the first from it.

    Each side takes ticks (tick_id, symbol, us, price) within its tolerance and falls back on bars (symbol, open_us, c) by
    itself; with neither it is an error. A bar counts by the time it opens, so its close lies after that; ``strict_us``,
    the bars' width, makes the earlier side take bars that have closed by the due time.
    """
    b = bars.select("symbol", F.col("open_us").alias("us"), F.col("c").alias("price"), F.col("open_us").alias("tick_id"))
    out = jobs
    for side, forward, tolerance in (("asof", False, back_us), ("next", True, forward_us)):
        for source, rows in zip(names, (ticks, b.withColumn("us", F.col("us") + (0 if forward else strict_us))), strict=True):
            # jobs pass through with all their columns, so nothing is joined back by job
            out = asof(out, rows, "due_us", tolerance, key="job_id", value=["price"], forward=forward).withColumnsRenamed({"asof_price": f"_{side}_{source}", "asof_lag_us": f"_{side}_{source}_lag"})
    made: dict[str, Column] = {}
    for side in ("asof", "next"):
        first, second = (F.col(f"_{side}_{n}") for n in names)
        price = F.coalesce(first, second)
        made |= {
            f"{side}_price": price,
            f"{side}_pct": outcome_pct(price, F.col("start_price")),
            f"{side}_source": F.when(first.isNotNull(), names[0]).when(second.isNotNull(), names[1]).otherwise("none"),
            f"{side}_status": F.when(price.isNull(), "error").otherwise("done"),
            f"{side}_lag_us": F.when(first.isNotNull(), F.col(f"_{side}_{names[0]}_lag")).otherwise(F.col(f"_{side}_{names[1]}_lag")),
        }
    return out.select(*jobs.columns, *(c.alias(n) for n, c in made.items()))


def job_state(attempts: Column, status: Column, due_us: Column, now_us: Column, most: int = 3, backoff_us: int = 60_000_000) -> tuple[Column, Column]:
    """(state, next due time) of a job: done, pending, error after ``most`` attempts, else again after a delay that grows with the attempts."""
    failed = status == "error"
    state = F.when(due_us > now_us, "pending").when(~failed, "done").when(attempts + 1 >= most, "error").otherwise("pending")
    return state, F.when((due_us <= now_us) & failed & (attempts + 1 < most), now_us + (attempts + 1) * backoff_us).otherwise(due_us)


def signal_rollup(outcomes: DataFrame) -> DataFrame:
    """Status of each signal over its horizons (signal_id, asof_status, next_status, asof_source, next_source)."""
    terminal = F.col("asof_status").isin("done", "error") & F.col("next_status").isin("done", "error")

    def both(s: str) -> Column:
        return (F.col("asof_status") == s) & (F.col("next_status") == s)

    mixed = ~F.coalesce(F.col("asof_source"), F.lit("none")).isin("none") & ~F.coalesce(F.col("next_source"), F.lit("none")).isin("none") & (F.col("asof_source") != F.col("next_source"))
    n = outcomes.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(terminal).alias("n_terminal"), F.count_if(both("done")).alias("n_done"), F.count_if(both("error")).alias("n_error"), F.count_if(mixed).alias("n_mixed"))
    status = F.when(F.col("n_terminal") == 0, "pending").when(F.col("n_terminal") < F.col("n"), "partial").when(F.col("n_error") == F.col("n"), "error").when(F.col("n_done") == 0, "done_no_data").otherwise("done")
    return n.withColumn("status", status)
