"""The greedy choice of firings that keep a distance, in parallel.

Which firings are kept depends on all before them. But a kept firing names the next one: the first at least a cooldown later. These
pointers, doubled, lead from any entry into a block of time to the last firing kept there. Only firings within a cooldown
of a block's beginning can be entries, so a block is told by a short table of entries and exits, and one pass over
these tables, block after block, finds where each block is entered. Then every block follows its own pointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import staged


def entries(us: np.ndarray, begin: int, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, exit): of the sorted times of a block that begins at ``begin``, those that may be the first kept one, and the last kept one from each."""
    n = len(us)
    nxt = np.searchsorted(us, us + cooldown, "left")
    # an entry comes less than a cooldown after the beginning, or is the first one after that
    many = min(n, int(np.searchsorted(us, begin + cooldown, "left")) + 1)
    at = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = at[at]
        if (further == at).all():
            break
        at = further
    first = np.searchsorted(us, us[:many], "left") == np.arange(many)  # ties enter at the first
    return us[:many][first], us[at[:many]][first]


def kept(us: np.ndarray, last: int | None, cooldown: int) -> np.ndarray:
    """Which of the sorted times are kept after ``last``."""
    out = np.zeros(len(us), bool)
    nxt = np.searchsorted(us, us + cooldown, "left")
    i = 0 if last is None else int(np.searchsorted(us, last + cooldown, "left"))
    while i < len(us):
        out[i] = True
        i = max(i + 1, int(nxt[i]))
    return out


def _chain(cooldown: int):
    """Rows (key, block, entry, exit) sorted by key and block: the last kept time before each block, null for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            told = []
            for k, entry, leave in zip(b.column("_key").to_pylist(), b.column("entry"), b.column("exit"), strict=True):
                if k != key:
                    key, last = k, None
                told.append(last)
                entry, leave = entry.values.to_numpy(), leave.values.to_numpy()
                i = 0 if last is None else int(np.searchsorted(entry, last + cooldown, "left"))
                if i < len(entry):
                    last = int(leave[i])
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_block"), pa.array(told, pa.int64())], ["_key", "_block", "_last"])

    return run


def cooldown_filter(firings: DataFrame, keys: list[str], cooldown_us: int, at: str = "us", tie: str = "tick_id", *, block_us: int | None = None) -> DataFrame:
    """Keeps a firing if the last kept one of its key is at least ``cooldown_us`` before it; what is suppressed does not extend it.

    A key's series is cut into blocks of ``block_us``, 100 cooldowns by default, each one task's; of blocks only their tables of
    entries pass through one task, a block at a time. Without a cooldown all are kept. Rows with a null key make one key; those without a time
    are left out.
    """
    if cooldown_us <= 0:
        return firings.filter(F.col(at).isNotNull())
    block_us, names = block_us or 100 * cooldown_us, firings.columns
    parts = int(firings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys))
    rows = firings.filter(F.col(at).isNotNull()).withColumns({"_key": key, "_block": F.floor(F.col(at) / block_us).cast("long")})

    def table(t: pa.Table) -> pa.Table:
        entry, leave = entries(np.sort(t.column(at).to_numpy()), t.column("_block")[0].as_py() * block_us, cooldown_us)
        return pa.table([t.column("_key").slice(0, 1), t.column("_block").slice(0, 1), pa.array([entry]), pa.array([leave])], ["_key", "_block", "entry", "exit"])

    tables = staged(rows.select("_key", "_block", at).groupBy("_key", "_block").applyInArrow(table, "_key string, _block long, entry array<long>, exit array<long>"), "cooldown")
    last = tables.repartition(parts, "_key").sortWithinPartitions("_key", "_block").mapInArrow(_chain(cooldown_us), "_key string, _block long, _last long")

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by([(at, "ascending"), (tie, "ascending")])
        return t.filter(pa.array(kept(t.column(at).to_numpy(), t.column("_last")[0].as_py(), cooldown_us))).select(names)

    return rows.join(last, ["_key", "_block"]).groupBy("_key", "_block").applyInArrow(choose, T.StructType(firings.schema.fields))
