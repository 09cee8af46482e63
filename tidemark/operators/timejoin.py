"""Range and as-of joins in event time, exact whatever the bucket width.

Both sides get a time bucket. In a range join events are copied to the buckets that their window covers and meet ticks by
(symbol, bucket), so a hot symbol is spread over as many keys as its time has buckets. An as-of join makes no pairs: in
each bucket both sides are one run in order of time, so its rows grow with the tables and not with their density.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(events: DataFrame, ticks: DataFrame, low: Column, high: Column, bucket_us: int, how: str = "inner") -> DataFrame:
    """Events (symbol, ...) with the ticks (symbol, us, ...) that have low <= us <= high. Columns of ticks get the prefix t_."""
    t = ticks.select(*(F.col(c).alias(f"t_{c}") for c in ticks.columns)).withColumn("_bucket", F.expr(f"t_us div {bucket_us}"))
    e = events.withColumn("_low", low).withColumn("_high", high)
    e = e.filter("_low <= _high").withColumn("_bucket", F.explode(F.expr(f"sequence(_low div {bucket_us}, _high div {bucket_us})")))
    on = (e["symbol"] == t["t_symbol"]) & (e["_bucket"] == t["_bucket"]) & (t["t_us"] >= e["_low"]) & (t["t_us"] <= e["_high"])
    return e.join(t, on, how).drop("_bucket", "_low", "_high", "t_symbol")


def asof(events: DataFrame, ticks: DataFrame, at: str, tolerance_us: int, *, key: str, value: list[str], forward: bool = False, bucket_us: int | None = None) -> DataFrame:
    """Each event with the values of the last tick in [at - tolerance, at], or of the first in [at, at + tolerance].

    Ties in time go to the larger (forward: the smaller) tick_id. Events without a tick stay, with nulls; ``key`` names
    the event's key. Also ``asof_lag_us``, never negative.

    Ticks and events of a bucket are one sorted run, in which each event sees the tick before it: rows are events and
    ticks, never pairs of them. A tick is copied to the buckets that its tolerance reaches.
    """
    width = bucket_us or max(1, 4 * tolerance_us)
    reach = f"sequence((us - {tolerance_us}) div {width}, us div {width})" if forward else f"sequence(us div {width}, (us + {tolerance_us}) div {width})"
    rows = ticks.filter("symbol is not null and us is not null").withColumn("_bucket", F.explode(F.expr(reach)))
    found = _newest(events, rows, at, ["symbol"], value, "tick_id", F.expr(f"`{at}` div {width}"), forward)
    lag = F.col("_best.us") - F.col(f"_event.{at}") if forward else F.col(f"_event.{at}") - F.col("_best.us")
    near = lag <= tolerance_us
    return found.select(*(F.col(f"_event.{c}").alias(c) for c in events.columns), *(F.when(near, F.col(f"_best.{c}")).alias(f"asof_{c}") for c in value), F.when(near, lag).alias("asof_lag_us"))


def _newest(events: DataFrame, rows: DataFrame, at: str, by: list[str], value: list[str], tie: str | None, bucket: Column, forward: bool) -> DataFrame:
    """(_event, _best): each event with the newest of ``rows`` (us, _bucket, ...) in its bucket that is not after it; ``forward``, with the first not before it. Ties go by ``tie``, then by the values."""
    turn = (lambda c: F.col(c).desc()) if forward else F.col
    row, event = F.struct("us", *([tie] if tie and tie not in value else []), *value), F.struct(*events.columns)
    seen = rows.select(*by, "_bucket", F.col("us").alias("_at"), F.lit(0).alias("_turn"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), row.alias("_row"), F.lit(None).cast(events.select(event.alias("e")).schema["e"].dataType).alias("_event"))
    asked = events.select(*by, bucket.alias("_bucket"), F.col(at).alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast(seen.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(seen.schema["_row"].dataType).alias("_row"), event.alias("_event"))
    order = Window.partitionBy(*by, "_bucket").orderBy(turn("_at"), "_turn", turn("_tie"), turn("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return asked.unionAll(seen).withColumn("_best", F.last("_row", True).over(order)).filter("_turn = 1").select("_event", "_best")


def asof_unbounded(events: DataFrame, series: DataFrame, at: str, *, key: str | list[str], value: list[str], bucket_us: int, by: str | None = None, forward: bool = False, tie: str | None = None) -> DataFrame:
    """Each event with the newest row of ``series`` (us, ...) not after it, or the first not before it, however far away.

    ``by`` names a column that both sides must share, if any; ties in time go by ``tie``. The last row of each bucket is
    carried forward (the first one back) over the table of buckets alone and stands in the next bucket as one more row; in a bucket
    rows and events are one sorted run, so that rows are never pairs. Events without a row stay, with nulls.
    """
    more = [by] if by else []
    best = F.min if forward else F.max
    named = list(dict.fromkeys(["us", *([tie] if tie else []), *value]))
    s = series.filter(" and ".join(f"{c} is not null" for c in ("us", *more))).select(*more, F.expr(f"us div {bucket_us}").alias("_bucket"), *named)
    bucket = F.expr(f"`{at}` div {bucket_us}")
    ends = s.groupBy(*more, "_bucket").agg(best(F.struct("us", *(c for c in named if c != "us"))).alias("_end"))
    # one row for each bucket of time that has data: a table of the calendar's size, not of the data's
    marks = ends.join(events.select(*more, bucket.alias("_bucket")).distinct(), [*more, "_bucket"], "full")
    order = Window.partitionBy(*more).orderBy(F.desc("_bucket") if forward else "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    beyond = marks.select(*more, "_bucket", F.last("_end", True).over(order).alias("_beyond")).filter("_beyond is not null").select(*more, "_bucket", *(F.col(f"_beyond.{c}").alias(c) for c in named))
    found = _newest(events, s.unionAll(beyond), at, more, value, tie, bucket, forward)
    lag = F.col("_best.us") - F.col(f"_event.{at}") if forward else F.col(f"_event.{at}") - F.col("_best.us")
    return found.select(*(F.col(f"_event.{c}").alias(c) for c in events.columns), *(F.col(f"_best.{c}").alias(c) for c in value), lag.alias("asof_lag_us"))
