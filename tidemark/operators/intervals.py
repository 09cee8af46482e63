"""Answers about intervals of time over an index of ticks, without a row for each tick of each interval.

The index holds a symbol's ticks in spans: one row with the sorted ticks of a span and of some time after it. A question is an
interval; it goes to the span it begins in and is answered there from the span's structure: counts and sums by running
sums, medians and quartiles from a wavelet matrix, extremes from a tree of maxima over powers of two, and the first tick
beyond a level by descending the same tree. An interval longer than what a span holds is cut at span ends, and its parts'
extremes and first touches merge. So the rows of a job are intervals times the spans that they touch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Order:
    """The values of a sequence by rank, for the k-th smallest of any part of it."""

    def __init__(self, x: np.ndarray):
        order = np.argsort(x, kind="stable")
        self.sorted, self.levels = x[order], []
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        for b in range(max(1, int(len(x)).bit_length()) - 1, -1, -1):
            bit = rank >> b & 1
            self.levels.append((b, np.concatenate(([0], np.cumsum(bit)))))
            rank = np.concatenate((rank[bit == 0], rank[bit == 1]))

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of x[low:high]; k must be less than high - low."""
        lo, hi, k, at = low.astype(np.int64), high.astype(np.int64), k.astype(np.int64), np.zeros(len(low), np.int64)
        for b, ones in self.levels:
            zeros = len(self.sorted) - int(ones[-1])
            less = (hi - ones[hi]) - (lo - ones[lo])
            up = k >= less
            k, at = np.where(up, k - less, k), np.where(up, at | 1 << b, at)
            lo, hi = np.where(up, zeros + ones[lo], lo - ones[lo]), np.where(up, zeros + ones[hi], hi - ones[hi])
        return self.sorted[at]

    def quantile(self, low: np.ndarray, high: np.ndarray, share: float) -> np.ndarray:
        """Between neighbours in proportion; NaN where the part is empty."""
        out, some = np.full(len(low), np.nan), np.flatnonzero(high > low)
        lo, hi = low[some], high[some]
        place = share * (hi - lo - 1)
        below = np.floor(place)
        a, b = self.kth(lo, hi, below), self.kth(lo, hi, np.minimum(below + 1, hi - lo - 1))
        out[some] = a + (b - a) * (place - below)
        return out


class Extremes:
    """Maxima and minima over powers of two."""

    def __init__(self, x: np.ndarray):
        self.n, self.high, self.low = len(x), [x], [x]
        while 2 << (len(self.high) - 1) <= self.n:
            half = 1 << (len(self.high) - 1)
            self.high.append(np.maximum(self.high[-1][:-half], self.high[-1][half:]))
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest, least) of x[low:high]; NaN where it is empty."""
        top, bottom = np.full(len(low), np.nan), np.full(len(low), np.nan)
        size = high - low
        for k in range(len(self.high)):
            at = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            a, b = low[at], high[at] - (1 << k)
            top[at], bottom[at] = np.maximum(self.high[k][a], self.high[k][b]), np.minimum(self.low[k][a], self.low[k][b])
        return top, bottom

    def first_beyond(self, low: np.ndarray, high: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The first place in [low, high) with a value of ``up`` or more, or ``down`` or less; ``high`` if there is none."""
        at = low.astype(np.int64)
        for k in range(len(self.high) - 1, -1, -1):
            may = np.flatnonzero(at + (1 << k) <= high)
            calm = (self.high[k][at[may]] < up[may]) & (self.low[k][at[may]] > down[may])
            at[may[calm]] += 1 << k
        return at


class Span:
    """One row of the index, opened."""

    def __init__(self, us: np.ndarray, mid: np.ndarray, spread: np.ndarray):
        ok = ~np.isnan(mid)
        self.all_us, self.us, self.mid, self.spread = us, us[ok], mid[ok], spread[ok]
        self._made: dict[str, object] = {}

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def valid(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, past) of the valid ticks with lo <= us <= hi."""
        first = np.searchsorted(self.us, lo, "left")
        return first, np.maximum(first, np.searchsorted(self.us, hi, "right"))

    def stats(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Of the valid ticks in [lo, hi]: count, first and last time, quartiles of mid, distance in time of the one nearest to ``at``; and the spread's median, mean and deviation. ``raw`` counts the others too."""
        i, j = self.valid(lo, hi)
        n = j - i
        some = n > 0
        mids, spreads = self._once("mids", lambda: Order(self.mid)), self._once("spreads", lambda: Order(self.spread))
        about = float(np.median(self.spread)) if len(self.spread) else 0.0
        runs = self._once("runs", lambda: [np.concatenate(([0.0], np.cumsum(v))) for v in (self.spread - about, (self.spread - about) ** 2)])
        with np.errstate(divide="ignore", invalid="ignore"):
            mean, square = ((r[j] - r[i]) / n for r in runs)
            sd = np.where(n > 1, np.sqrt(np.maximum(0.0, (square - mean * mean) * n / (n - 1))), np.nan)
        top, bottom = self._once("spread_tree", lambda: Extremes(self.spread)).of(i, j)
        out = {"raw": np.searchsorted(self.all_us, hi, "right") - np.searchsorted(self.all_us, lo, "left"), "n": n}
        pick = lambda x, k: np.where(some, x[np.clip(k, 0, len(x) - 1)] if len(x) else 0, 0)
        p = np.searchsorted(self.us, at)
        after, before = np.clip(p, i, np.maximum(i, j - 1)), np.clip(p - 1, i, np.maximum(i, j - 1))
        out |= {"first_us": pick(self.us, i), "last_us": pick(self.us, j - 1), "near_us": np.minimum(np.abs(pick(self.us, after) - at), np.abs(pick(self.us, before) - at))}
        out |= {f"mid_q{q}": mids.quantile(i, j, q / 100) for q in (25, 50, 75)}
        # sums leave a trace of rounding where all are equal
        return out | {"spread_q50": spreads.quantile(i, j, 0.5), "spread_mean": np.where(some, mean + about, np.nan), "spread_sd": np.where(n > 1, np.where(top == bottom, 0.0, sd), np.nan), "none": ~some}

    def reach(self, lo: np.ndarray, hi: np.ndarray, up: np.ndarray, down: np.ndarray) -> dict[str, np.ndarray]:
        """Largest and least mid of the valid ticks in [lo, hi], and time and side of the first that is ``up`` or more, or ``down`` or less; a NaN level is never reached."""
        i, j = self.valid(lo, hi)
        tree = self._once("mid_tree", lambda: Extremes(self.mid))
        top, bottom = tree.of(i, j)
        up, down = np.where(np.isnan(up), np.inf, up), np.where(np.isnan(down), -np.inf, down)
        at = tree.first_beyond(i, j, up, down)
        hit = at < j
        us, mid = (np.append(x, 0)[np.minimum(at, len(x))] for x in (self.us, self.mid))
        return {"high": top, "low": bottom, "touch_us": us, "side": np.where(mid >= up, 1, -1), "none": ~hit}

    def step_returns(self, before: np.ndarray, width: int, step: int) -> dict[str, np.ndarray]:
        """Of the ticks in [before - width, before): number, and number and deviation of the log returns between steps of a grid; the last valid mid of a step counts, and a step without one has the mid of the step before it."""
        steps = width // step
        edges = (before - width)[:, None] + step * np.arange(steps + 1)
        at = np.searchsorted(self.us, edges, "left")
        mid = np.where(at[:, 1:] > at[:, :-1], np.append(self.mid, np.nan)[at[:, 1:] - 1], np.nan)
        filled = np.where(np.isnan(mid), np.concatenate((np.full((len(mid), 1), np.nan), mid[:, :-1]), 1), mid)
        r = np.log(filled[:, 1:] / filled[:, :-1])
        n = (~np.isnan(r)).sum(1)
        total = np.nansum(r, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = r - (total / n)[:, None]
            sd = np.where(n > 1, np.sqrt(np.nansum(off * off, 1) / (n - 1)), np.nan)
        raw = np.searchsorted(self.all_us, before, "left") - np.searchsorted(self.all_us, before - width, "left")
        return {"raw": raw, "n": n, "sd": sd, "none": n < 2}


def tick_index(quotes: DataFrame, span_us: int, ahead_us: int) -> DataFrame:
    """(symbol, span, us, mid, spread): one row for each span of a symbol's ``quotes`` (tick_id, symbol, us, mid, spread), in order of (us, tick_id), with those of ``ahead_us`` after it.

    Null mids and spreads are kept, as NaN. Rows without a time or a symbol are left out."""
    first = F.expr(f"(us - {ahead_us}) div {span_us} - 1")
    spans = F.filter(F.sequence(first, F.expr(f"us div {span_us}")), lambda s: (s * span_us <= F.col("us")) & (F.col("us") < (s + 1) * span_us + ahead_us))
    nan = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    rows = quotes.filter("us is not null and symbol is not null").select("symbol", F.struct("us", "tick_id", nan("mid"), nan("spread")).alias("t"), F.explode(spans).alias("span"))
    held = rows.groupBy("symbol", "span").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("symbol", "span", *(F.col(f"t.{c}").alias(c) for c in ("us", "mid", "spread")))


_TYPES = {"raw": "long", "n": "long", "first_us": "long", "last_us": "long", "near_us": "long", "touch_us": "long", "side": "int"}


def _asked(index: DataFrame, questions: DataFrame, args: list[str], names: list[str], ask: Callable[[Span, list[np.ndarray]], dict[str, np.ndarray]], nulls: tuple[str, ...]) -> DataFrame:
    """``questions`` (symbol, span, keys, args) with ``names``; those in ``nulls`` are null where the answer says there is none."""
    keys = [c for c in questions.columns if c not in ("symbol", "span", *args)]
    kinds = {n: _TYPES.get(n, "double") for n in names}
    schema = ", ".join([*(f"`{k}` {questions.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} {t}" for n, t in kinds.items())])
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows:
            span = Span(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        else:
            us, mid, spread = (held.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("us", "mid", "spread"))
            span = Span(us.astype(np.int64), mid.astype(np.float64), spread.astype(np.float64))
        got = ask(span, [asked.column(a).to_numpy() for a in args])
        out = []
        for n, t in kinds.items():
            x = np.asarray(got[n])
            gone = got["none"] if n in nulls else np.isnan(x) if t == "double" else np.zeros(len(x), bool)
            out.append(pa.array(x, mask=gone).cast(arrow[t]))
        return pa.table([*(asked.column(k) for k in keys), *out], [*keys, *names])

    return index.groupBy("symbol", "span").cogroup(questions.groupBy("symbol", "span")).applyInArrow(run, schema)


def interval_stats(index: DataFrame, questions: DataFrame, lo: Column, hi: Column, at: Column, span_us: int) -> DataFrame:
    """The columns of ``questions`` (symbol, ...) but the symbol, and ``Span.stats`` of [lo, hi], which must be no longer than the index looks ahead."""
    q = questions.withColumns({"_lo": lo, "_hi": hi, "_at": at}).withColumn("span", F.floor(F.col("_lo") / span_us).cast("long"))
    names = ["raw", "n", "first_us", "last_us", "near_us", "mid_q25", "mid_q50", "mid_q75", "spread_q50", "spread_mean", "spread_sd"]
    return _asked(index, q, ["_lo", "_hi", "_at"], names, lambda s, a: s.stats(*a), ("first_us", "last_us", "near_us"))


def interval_reach(index: DataFrame, questions: DataFrame, keys: list[str], lo: Column, hi: Column, up: Column, down: Column, span_us: int) -> DataFrame:
    """(keys, high, low, touch_us, side): ``Span.reach`` of [lo, hi], however long: cut at span ends, one row for each of ``keys``. Null levels are not reached."""
    nan = F.lit(float("nan"))
    q = questions.select("symbol", *keys, lo.alias("_from"), hi.alias("_to"), F.coalesce(up, nan).alias("_up"), F.coalesce(down, nan).alias("_down"))
    q = q.withColumn("span", F.explode(F.sequence(F.floor(F.col("_from") / span_us).cast("long"), F.floor(F.col("_to") / span_us).cast("long"))))
    q = q.withColumns({"_lo": F.greatest("_from", F.col("span") * span_us), "_hi": F.least("_to", (F.col("span") + 1) * span_us - 1)}).drop("_from", "_to")
    parts = _asked(index, q, ["_lo", "_hi", "_up", "_down"], ["high", "low", "touch_us", "side"], lambda s, a: s.reach(*a), ("touch_us", "side"))
    first = F.min_by(F.struct("touch_us", "side"), "touch_us")
    return parts.groupBy(*keys).agg(F.max("high").alias("high"), F.min("low").alias("low"), first.alias("x")).select(*keys, "high", "low", "x.touch_us", "x.side")


def step_returns(index: DataFrame, questions: DataFrame, before: Column, width_us: int, step_us: int, span_us: int) -> DataFrame:
    """The columns of ``questions`` (symbol, ...) but the symbol, and ``Span.step_returns`` of the time ``width_us`` before ``before``, which the index must look ahead."""
    q = questions.withColumn("_before", before).withColumn("span", F.floor((F.col("_before") - width_us) / span_us).cast("long"))

    def ask(span: Span, args: list[np.ndarray]) -> dict[str, np.ndarray]:
        parts = [span.step_returns(args[0][i : i + 4096], width_us, step_us) for i in range(0, len(args[0]), 4096)]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else {c: np.zeros(0) for c in ("raw", "n", "sd", "none")}

    return _asked(index, q, ["_before"], ["raw", "n", "sd"], ask, ())
