"""Trailing windows in time that cost no more than sorting, however many rows a window holds.

A range frame of Spark computes its aggregate anew for each row, the product of rows and window. Here a symbol's series
is cut into spans of time, each with the window before it copied in, so that a hot symbol is many tasks; a span passes
through its task in chunks behind the window that they reach back over, in which all windows follow from running sums, from
minima over powers of two, and from counts in a wavelet matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counts_below(x: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray, *, equal: bool) -> np.ndarray:
    """How many of x[low[i]:high[i]] are below bound[i] (or equal to it). NaN is no value of x; a bound must not be NaN."""
    n = len(x)
    order = np.argsort(x, kind="stable")  # NaN comes last
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    known = x[order][: n - int(np.isnan(x).sum())]
    limit = np.searchsorted(known, bound, "right" if equal else "left")
    lo, hi, out = low.astype(np.int64), high.astype(np.int64), np.zeros(len(bound), np.int64)
    bits = max(1, int(n).bit_length())
    for b in range(bits - 1, -1, -1):
        ones = np.concatenate(([0], np.cumsum(rank >> b & 1)))
        zeros = n - int(ones[-1])
        up = (limit >> b & 1).astype(bool)
        lo1, hi1 = ones[lo], ones[hi]
        # where the limit has a one, all values with a zero here are below it
        out += np.where(up, (hi - hi1) - (lo - lo1), 0)
        lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        rank = np.concatenate((rank[rank >> b & 1 == 0], rank[rank >> b & 1 == 1]))
    return out


def medians(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The median of x[low[i]:high[i]], of two middle values their mean; NaN where there is none. x must hold no NaN in these."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    levels = []
    for b in range(max(1, int(n).bit_length()) - 1, -1, -1):
        levels.append((b, np.concatenate(([0], np.cumsum(rank >> b & 1))).astype(np.int32 if n < 1 << 31 else np.int64)))
        rank = np.concatenate((rank[rank >> b & 1 == 0], rank[rank >> b & 1 == 1]))
    some = np.flatnonzero(high > low)
    out = np.full(len(low), np.nan)
    for half in (0, 1):
        lo, hi = low[some].astype(np.int64), high[some].astype(np.int64)
        k, at = (hi - lo - 1 + half) // 2, np.zeros(len(some), np.int64)
        for b, ones in levels:
            zeros = n - int(ones[-1])
            less = (hi - ones[hi]) - (lo - ones[lo])
            up = k >= less
            k, at = np.where(up, k - less, k), np.where(up, at | 1 << b, at)
            lo, hi = np.where(up, zeros + ones[lo], lo - ones[lo]), np.where(up, zeros + ones[hi], hi - ones[hi])
        value = x[order][at] if len(at) else np.empty(0)
        out[some] = value if half == 0 else (out[some] + value) / 2
    return out


def extremes(x: np.ndarray, low: np.ndarray, high: np.ndarray, better: np.ufunc) -> np.ndarray:
    """The least or largest (np.fmin, np.fmax) of x[low[i]:high[i]]; NaN is no value, and what an empty window has."""
    out, size, level, width = np.full(len(low), np.nan), high - low, x.astype(np.float64), 1
    while len(level) and width <= max(1, int(size.max(initial=0))):
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        out[at] = better(level[low[at]], level[high[at] - width])
        level, width = better(level[:-width], level[width:]) if len(level) > width else level[:0], 2 * width
    return out


class Trailing:
    """Rows of a span in order of time, with the trailing window of each. Those before ``start`` only fill the windows of the others: what is computed for them is not used."""

    def __init__(self, us: np.ndarray, columns: dict[str, np.ndarray], start: int = 0):
        self.us, self.columns, self.start, self._low, self._high = us, columns, start, {}, None

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def bounds(self, width_us: int) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of each row's window: from ``width_us`` before it up to its own time, with all rows of that time."""
        if self._high is None:
            self._high = np.searchsorted(self.us, self.us, "right")
        if width_us not in self._low:
            self._low[width_us] = np.searchsorted(self.us, self.us - width_us, "left")
        return self._low[width_us], self._high

    def filled(self, x: np.ndarray) -> np.ndarray:
        """What is known from ``start`` on, as a value of each row."""
        return np.concatenate((np.full(self.start, np.nan), x))

    def total(self, x: np.ndarray, width_us: int, low: np.ndarray | None = None) -> np.ndarray:
        """Sum of what is not NaN. It runs in extended precision, so that windows of equal values, which ranks compare, have equal sums wherever they lie."""
        run = np.concatenate(([0.0], np.cumsum(np.nan_to_num(x.astype(np.float64)).astype(np.longdouble))))
        lo, hi = self.bounds(width_us)
        return (run[hi] - run[lo if low is None else np.minimum(low, hi)]).astype(np.float64)

    def count(self, x: np.ndarray, width_us: int, low: np.ndarray | None = None) -> np.ndarray:
        return np.rint(self.total(~np.isnan(x), width_us, low))

    def moments(self, x: np.ndarray, width_us: int, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, mean, sample deviation), NaN where there are too few; sums are taken about one value of the span."""
        about = np.nan_to_num(np.nanmedian(x)) if len(x) and not np.isnan(x).all() else 0.0
        n, s, ss = self.count(x, width_us, low), self.total(x - about, width_us, low), self.total((x - about) ** 2, width_us, low)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(n > 0, s / n, np.nan)
            sd = np.where(n > 1, np.sqrt(np.maximum(0.0, (ss - s * mean) / (n - 1))), np.nan)
        return n, mean + about, sd

    def zscore(self, x: np.ndarray, width_us: int, least: int = 30) -> np.ndarray:
        n, mean, sd = self.moments(x, width_us)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((n >= least) & (sd >= 1e-9), (x - mean) / sd, np.nan)

    def share(self, x: np.ndarray, width_us: int, bound: np.ndarray | None = None, *, equal: bool = True, least: int = 30) -> np.ndarray:
        """Share of the window's values that are below the bound (by default the row's own value) or equal to it."""
        bound = x if bound is None else bound
        lo, hi = self.bounds(width_us)
        n, some = self.count(x, width_us), ~np.isnan(bound)
        some[: self.start] = False
        out = np.full(len(x), np.nan)
        out[some] = counts_below(x, lo[some], hi[some], bound[some], equal=equal)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(some & (n >= least), out / n, np.nan)


#: Arrays by name, all at once or, to hold few of them, one after another.
Compute = Callable[[Trailing], dict[str, np.ndarray] | Iterator[tuple[str, np.ndarray]]]


def _series(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Batches sorted by (symbol, _span), cut where these change and into pieces of ``most`` rows."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        ends = {t.num_rows}
        for c in ("symbol", "_span"):
            ends |= set(pc.run_end_encode(t.column(c).combine_chunks()).run_ends.to_pylist())
        at = 0
        for end in sorted(ends):
            now = t.column("symbol")[at].as_py(), t.column("_span")[at].as_py()
            for low in range(at, end, most):
                yield now, t.slice(low, min(most, end - low))
            at = end


def over_spans(
    rows: DataFrame, columns: list[str], width_us: int, made: dict[str, str], compute: Compute, *, key: str = "tick_id", span_us: int | None = None, keep: list[str] | None = None, then: tuple[list[str], dict[str, str], Compute] | None = None, chunk_rows: int = 1 << 16
) -> DataFrame:
    """(key, symbol, us, the columns ``keep``, and the columns ``made``: name to type) of every row of ``rows`` (key, symbol, us, columns, keep).

    ``compute`` gets rows of a span sorted by (us, key), with ``columns`` as doubles, and gives an array for each name of
    ``made``; NaN becomes null. Its windows must not reach back further than ``width_us``. ``then`` has further columns and what
    computes them from those that it names of ``columns`` and ``made``, over windows of that width again. A span is ``span_us`` long, four
    windows by default, and passes through one task, which holds a window and a chunk of a quarter as many rows (``chunk_rows`` at least; rows of one
    time are never parted). Rows without a time are left out; other columns are left out; repeated rows count each; an empty
    table gives an empty one.
    """
    again, more, compute_more = then or ([], {}, None)
    reach = 2 * width_us if then else width_us
    span = span_us or 4 * reach
    kept, types = keep or [], made | more
    at = F.expr(f"us div {span}")
    given = {c: F.col(c).cast("double").alias(f"_{c}") for c in columns if c not in kept or rows.schema[c].dataType != T.DoubleType()}
    # a row serves its own span and those whose first window reaches back to it
    copies = rows.select(key, "symbol", "us", *kept, *given.values(), at.alias("_own"), F.explode(F.sequence(at, F.expr(f"(us + {reach}) div {span}"))).alias("_span"))
    schema = T.StructType([rows.schema[key], rows.schema["symbol"], T.StructField("us", T.LongType()), *(rows.schema[c] for c in kept), *(T.StructField(n, T.BooleanType() if t == "boolean" else T.LongType() if t == "long" else T.DoubleType()) for n, t in types.items())])
    named = {c: f"_{c}" if c in given else c for c in columns}
    used = [*columns, *(n for n in again if n in made)]
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}
    nothing = {"us": np.empty(0, np.int64)} | {c: np.empty(0) for c in used}

    def taken(table: pa.Table, held: dict[str, np.ndarray]) -> tuple[pa.Table, dict[str, np.ndarray]]:
        """The rows of ``table`` with what is made for them, and the window that the next ones reach back over."""
        start = len(held["us"])
        us = np.concatenate((held["us"], table.column("us").to_numpy()))
        seen = {c: np.concatenate((held.pop(c), table.column(n).to_numpy().astype(np.float64))) for c, n in named.items()}
        own = int(np.searchsorted(table.column("_own").to_numpy(), table.column("_span")[0].as_py()))
        out: dict[str, pa.Array] = {}

        def fill(how: Compute) -> None:
            got = how(Trailing(us, dict(seen), start))
            for n, x in got.items() if isinstance(got, dict) else got:
                x = x[start:].astype(np.float64)
                if n in held:
                    seen[n] = np.concatenate((held.pop(n), x))
                out[n] = pa.array(x[own:], mask=np.isnan(x[own:])).cast(kinds[types[n]])

        fill(compute)
        if compute_more:
            fill(compute_more)
        low = int(np.searchsorted(us, us[-1] - width_us, "left"))
        mine = table.slice(own).select([key, "symbol", "us", *kept])
        return pa.table([*mine.columns, *(out[n] for n in types)], [*mine.column_names, *types]), {"us": us[low:].copy()} | {c: seen.pop(c)[low:].copy() for c in used}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, held, waiting, n = None, dict(nothing), [], 0
        for now, part in _series(batches, chunk_rows):
            if now != series:
                if waiting:
                    yield from taken(pa.concat_tables(waiting).combine_chunks(), held)[0].to_batches(1 << 14)
                series, held, waiting, n = now, dict(nothing), [], 0
            waiting.append(part)
            n += part.num_rows
            if n < max(chunk_rows, len(held["us"]) // 4):
                continue
            table = pa.concat_tables(waiting).combine_chunks()
            us = table.column("us").to_numpy()
            whole = int(np.searchsorted(us, us[-1], "left"))
            waiting, n = [table.slice(whole)], table.num_rows - whole
            if whole:
                made_, held = taken(table.slice(0, whole), held)
                yield from made_.to_batches(1 << 14)
        if waiting:
            yield from taken(pa.concat_tables(waiting).combine_chunks(), held)[0].to_batches(1 << 14)

    return copies.repartition("symbol", "_span").sortWithinPartitions("symbol", "_span", "us", key).mapInArrow(run, schema)
