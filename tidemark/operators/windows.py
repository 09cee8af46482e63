"""Rolling facts, bars, rules and sequential helpers over ticks and trades."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quotes import buy_vol_ratio
from .edges import DAY, with_neighbours
from .spans import Trailing, extremes, medians, over_spans
from .stage import staged


def latest_per_symbol(ticks: DataFrame, now_us: int | None = None, fresh_us: int = 10_000_000) -> DataFrame:
    """Each symbol's newest tick, ties by the larger tick_id; with ``now_us`` only one of the ``fresh_us`` up to then, so that a silent symbol has no row."""
    rows = ticks if now_us is None else ticks.filter((F.col("us") <= now_us) & (F.col("us") >= now_us - fresh_us))
    return rows.groupBy("symbol").agg(F.max_by(F.struct("tick_id", "us", "price"), F.struct("us", "tick_id")).alias("t")).select("symbol", "t.*")


def price_delta_pct(ticks: DataFrame, *, block_us: int = 3 * DAY) -> DataFrame:
    seen = with_neighbours(ticks.select("tick_id", "symbol", "us", "price"), {"prev": F.col("price")}, block_us=block_us)
    return seen.select("tick_id", "symbol", "us", "price", F.when(F.col("prev") != 0, (F.col("price") - F.col("prev")) / F.col("prev") * 100).alias("delta_pct"))


def top_movers(rows: DataFrame, n: int = 5, *, least_volume: float = 50_000.0, least_pct: float = 0.3, least_ratio: float = 0.55) -> DataFrame:
    """The ``n`` largest moves, either way, of ``rows`` (tick_id, symbol, delta_pct, vol_24h, buy_vol) with enough volume of the day and buyers' share; ties by tick_id. A day without volume, or a null one, counts as none."""
    share = buy_vol_ratio(F.coalesce("buy_vol", F.lit(0.0)), F.coalesce("vol_24h", F.lit(0.0)))
    kept = rows.filter((F.coalesce("vol_24h", F.lit(0.0)) >= least_volume) & (F.abs("delta_pct") >= least_pct)).withColumn("buy_ratio", share).filter(F.col("buy_ratio") >= least_ratio)
    return kept.orderBy(F.desc(F.abs("delta_pct")), "tick_id").limit(n).select("tick_id", "symbol", "delta_pct", "buy_ratio", F.when(F.col("delta_pct") > 0, "PUMP").otherwise("DUMP").alias("side"))


def rolling_returns(ticks: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(tick_id, and for each name the return from the first price of the trailing window); null with one price, or a first one of zero or less."""

    def compute(t: Trailing) -> dict[str, np.ndarray]:
        out = {}
        for name, width in widths.items():
            low, high = t.bounds(width)
            first = t["price"][low]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[name] = np.where((high - low >= 2) & (first > 0), (t["price"] - first) / first, np.nan)
        return out

    return over_spans(ticks, ["price"], max(widths.values()), dict.fromkeys(widths, "double"), compute).drop("symbol", "us")


def rolling_zscore(ticks: DataFrame, width_us: int, least: int = 30) -> DataFrame:
    """(tick_id, z, norm): the price against the trailing window that includes it, and that squashed to (-1, 1)."""

    def compute(t: Trailing) -> dict[str, np.ndarray]:
        z = t.zscore(t["price"], width_us, least)
        return {"z": z, "norm": np.tanh(np.clip(z, -3, 3))}

    return over_spans(ticks, ["price"], width_us, {"z": "double", "norm": "double"}, compute).drop("symbol", "us")


#: The facts of ``trade_flow``.
FLOW = {"n_trades": "long"} | dict.fromkeys(("quote_vol", "flow", "buy_ratio", "gap_ms", "rate", "intensity"), "double")


def flow_facts(t: Trailing, width_us: int) -> dict[str, np.ndarray]:
    low, high = t.bounds(width_us)
    value, sale = t["price"] * t["qty"], t["maker"] > 0
    gap = np.diff(t.us, prepend=t.us[:1]) / 1000.0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = t.total(np.where(sale, 0.0, t["qty"]), width_us) / t.total(t["qty"], width_us)
    wide = t.bounds(2 * width_us)
    return {
        "n_trades": high - low, "quote_vol": t.total(value, width_us), "flow": t.total(np.where(sale, -value, value), width_us), "buy_ratio": ratio,
        "gap_ms": t.filled(medians(gap, np.minimum(low + 1, high)[t.start :], high[t.start :])), "rate": (high - low) / (width_us / 1e6), "intensity": (wide[1] - wide[0]) / (2 * width_us / 1e6),
    }


def trade_flow(trades: DataFrame, width_us: int, *, timed: bool = False) -> DataFrame:
    """Trailing facts at each trade: count, quote volume, signed flow (a maker that buys counts as a sale), buy ratio by
    quantity, median gap between trades, trades a second, and the same over a window twice as wide. ``timed`` keeps the trade's time ``us``."""

    rows = trades.withColumn("maker", F.col("is_buyer_maker").cast("int"))
    told = over_spans(rows, ["price", "qty", "maker"], 2 * width_us, FLOW, lambda t: flow_facts(t, width_us), key="trade_id")
    return told if timed else told.drop("us")


def bars(ticks: DataFrame, width: str) -> DataFrame:
    t = F.struct("us", "tick_id")
    w = F.window("ts", width)
    return ticks.groupBy("symbol", w.alias("w")).agg(F.min_by("price", t).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", t).alias("c"), F.sum("bid_qty").alias("v"), F.avg("price").alias("avg_price")).withColumn("open_us", F.unix_micros("w.start")).drop("w")


def grid_asof(ticks: DataFrame, step_us: int, stale_us: int, values: tuple[str, ...] = ("price",), *, block_us: int = 3 * DAY) -> DataFrame:
    """Each point of a regular grid with ``values`` of the newest tick not older than ``stale_us``; points without one are left out.

    A tick serves the points from its own time on until the next tick or until it is stale, so points come from ticks
    without a join.
    """
    rows = with_neighbours(ticks.select("symbol", "tick_id", "us", *values), {"next_us": F.col("us")}, block_us=block_us, forward=True)
    end = F.least(F.coalesce(F.col("next_us") - 1, F.col("us")), F.col("us") + stale_us)
    spans = rows.select("symbol", "tick_id", "us", *values, F.expr(f"ceil(us / {step_us})").cast("long").alias("a"), F.floor(end / step_us).alias("b")).filter("a <= b")
    points = spans.select("symbol", "tick_id", *values, F.explode(F.sequence("a", "b")).alias("point"), "us")
    return points.select("symbol", "tick_id", *values, (F.col("point") * step_us).alias("grid_us"), "us").withColumn("age_ms", (F.col("grid_us") - F.col("us")) / 1000.0).drop("us")


def state_transitions(rows: DataFrame, state: Column, *, block_us: int = 3 * DAY) -> DataFrame:
    """The rows whose state is not that of the row before them; a series' first row is one."""
    marked = with_neighbours(rows.withColumn("state", state).select("symbol", "tick_id", "us", "state"), {"prev": F.col("state")}, alone="first", block_us=block_us)
    return marked.filter(F.col("first") | ~F.col("state").eqNullSafe(F.col("prev"))).select("symbol", "tick_id", "state", "prev")


def volume_percentile(rows: DataFrame, volume: str, p: float) -> DataFrame:
    """(cutoff, n): nearest-rank percentile over the whole market, one row; none without rows.

    Values are counted, dealt by ranges, and only the range that holds the rank is looked at.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(F.col(volume).alias("v")).agg(F.count(F.lit(1)).alias("m")).repartitionByRange(parts, "v")
    held = staged(counts.withColumn("part", F.spark_partition_id()), "percentile")
    sizes = held.groupBy("part").agg(F.sum("m").alias("m"), F.min("v").alias("low"))
    by_range = Window.orderBy("low")
    total = F.sum("m").over(Window.partitionBy())
    found = sizes.select("part", (F.sum("m").over(by_range) - F.col("m")).alias("before"), F.sum("m").over(by_range).alias("upto"), total.alias("n"))
    rank = F.greatest(F.lit(1), F.floor(F.col("n") * p / 100))
    one = found.withColumn("rank", rank).filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    within = held.join(F.broadcast(one), "part").withColumn("at", F.col("before") + F.sum("m").over(Window.partitionBy("part").orderBy("v")))
    return within.filter((F.col("at") >= F.col("rank")) & (F.col("at") - F.col("m") < F.col("rank"))).select(F.col("v").alias("cutoff"), "n")


def _averages(x: np.ndarray, start: float, span: int) -> np.ndarray:
    """Recursive averages from ``start`` on; NaN changes nothing."""
    known = ~np.isnan(x)
    out = np.full(len(x), np.nan)
    out[known] = pd.Series(np.concatenate(([start], x[known]))).ewm(span=span, adjust=False).mean().to_numpy()[1:]
    filled = pd.Series(out).ffill().to_numpy()
    return np.where(np.isnan(filled), start, filled)


def with_ema(rows: DataFrame, value: str, spans: tuple[int, ...], at: str = "us", tie: str = "tick_id", *, by: tuple[str, ...] = ("symbol",), block_us: int = 240 * 3_600_000_000) -> DataFrame:
    """``rows`` with recursive moving averages, k = 2 / (span + 1), started at the first value of each series.

    A series is cut into blocks of ``block_us``. A block of n values takes the average before it to (1 - k)**n of that plus
    a sum of its own, so the averages at which blocks start follow from a table of blocks, and each block is one task's. Null
    values change nothing, ties in time go by ``tie``, rows without a time are left out.
    """
    order = [(c, "ascending") for c in dict.fromkeys((at, tie))]
    keyed = rows.filter(F.col(at).isNotNull()).withColumn("_block", F.expr(f"{at} div {block_us}"))
    keys, columns = [rows.schema[k] for k in by], rows.columns
    sums = T.StructType([*keys, T.StructField("_block", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_first", T.DoubleType()), *(T.StructField(f"_e{n}", T.DoubleType()) for n in spans)])

    names = sums.names

    def values(t: pa.Table) -> np.ndarray:
        return t.column(value).cast(pa.float64()).to_numpy()

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        x = values(t)
        x = x[~np.isnan(x)]
        own = [_averages(x, 0.0, n)[-1] if len(x) else 0.0 for n in spans]
        cols = [len(x), x[0] if len(x) else None, *own]
        return pa.table([*(t.column(k).slice(0, 1) for k in (*by, "_block")), *(pa.array([c], pa.int64() if i == 0 else pa.float64()) for i, c in enumerate(cols))], names)

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("_block")
        first = [f for f in t.column("_first").to_pylist() if f is not None]
        starts = []
        for n in spans:
            e, k, own = first[0] if first else np.nan, 2 / (n + 1), []
            for m, add in zip(t.column("_n").to_pylist(), t.column(f"_e{n}").to_pylist(), strict=True):
                own.append(e)
                e = e * (1 - k) ** m + add
            starts.append(pa.array(own, pa.float64()))
        return pa.table([*(t.column(k) for k in (*by, "_block", "_n", "_first")), *starts], names)

    begins = keyed.select(*by, "_block", *dict.fromkeys((at, tie, value))).groupBy(*by, "_block").applyInArrow(block, sums).groupBy(*by).applyInArrow(chain, sums)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"ema{n}", T.DoubleType()) for n in spans)])

    def apply(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        made = [pa.array(e := _averages(values(t), t.column(f"_e{n}")[0].as_py(), n), mask=np.isnan(e)) for n in spans]
        return pa.table([*t.select(columns).columns, *made], [*columns, *(f"ema{n}" for n in spans)])

    return keyed.join(begins.drop("_n", "_first"), [*by, "_block"]).groupBy(*by, "_block").applyInArrow(apply, schema)


def ema(rows: DataFrame, value: str, spans: tuple[int, ...], at: str = "us", tie: str = "tick_id") -> DataFrame:
    return with_ema(rows.select(tie, "symbol", at, value), value, spans, at, tie).select(tie, "symbol", *(f"ema{n}" for n in spans))


def rolling_rv_range(ticks: DataFrame, short_us: int, mid_us: int, long_us: int) -> DataFrame:
    """Deviation of log returns between points inside each window, the range of the middle one, and short to long.

    The return that enters a window from before it does not count, nor does one of prices that are not positive.
    """

    def compute(t: Trailing) -> dict[str, np.ndarray]:
        return realised(t, {"rv_short": short_us, "rv_mid": mid_us, "rv_long": long_us}, mid_us)

    made = dict.fromkeys(("rv_short", "rv_mid", "rv_long", "price_range", "rv_ratio"), "double")
    return over_spans(ticks, ["price"], max(short_us, mid_us, long_us), made, compute).drop("symbol", "us")


def realised(t: Trailing, widths: dict[str, int], range_us: int) -> dict[str, np.ndarray]:
    p = t["price"]
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = np.log(np.where(p > 0, p, np.nan) / np.concatenate(([np.nan], np.where(p > 0, p, np.nan)[:-1]))) if len(p) else p
        out = {name: t.moments(ret, width, t.bounds(width)[0] + 1)[2] for name, width in widths.items()}
        low, high = t.bounds(range_us)
        out["price_range"] = np.where(high - low >= 2, extremes(p, low, high, np.fmax) - extremes(p, low, high, np.fmin), np.nan)
        out["rv_ratio"] = np.where(out["rv_long"] > 0, out["rv_short"] / out["rv_long"], np.nan)
    return out


def downtrend(bars: DataFrame, since_us: int, least: int = 50, fast: int = 20, slow: int = 50) -> DataFrame:
    """(symbol, n, downtrend) from the bars that open from ``since_us`` on: fast average and last close both below the slow one; false with fewer than ``least`` bars."""
    told = with_ema(bars.filter(F.col("open_us") >= since_us).select("symbol", "open_us", "c"), "c", (fast, slow), "open_us", "open_us")
    last = told.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("c", f"ema{fast}", f"ema{slow}"), "open_us").alias("t"))
    return last.select("symbol", "n", ((F.col("n") >= least) & (F.col(f"t.ema{fast}") < F.col(f"t.ema{slow}")) & (F.col("t.c") < F.col(f"t.ema{slow}"))).alias("downtrend"))
