"""What a row sees of the row before it or after it in its series, without a series in one task.

A series is cut into blocks of time. Within a block neighbours are a window's matter; the row at a block's edge has its
neighbour in another block, so the edge rows of all blocks, a table as long as the calendar and not as the data, are carried
from block to block, past blocks that are empty, and handed to each block's outermost row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 24 * 3_600_000_000


def with_neighbours(rows: DataFrame, values: dict[str, Column], *, known: dict[str, Column] | None = None, alone: str | None = None, by: tuple[str, ...] = ("symbol",), at: str = "us", tie: str = "tick_id", block_us: int = 3 * DAY, forward: bool = False) -> DataFrame:
    """``rows`` with, for each name of ``values``, that column of the row before it in order of (at, tie), or of the row after it (``forward``); for each of
    ``known`` the last value before it that is not null; and ``alone``, if named, whether there is no such row.

    Null times come first in the order; a null key is a series of its own. Names that ``rows`` has are replaced. Repeated rows count each,
    an empty table gives an empty one.
    """
    known = known or {}
    block = F.floor(F.col(at) / block_us).cast("long")
    keyed = rows.withColumns({"_block": block, **{f"_v_{n}": c for n, c in values.items()}, **{f"_k_{n}": c for n, c in known.items()}})
    row = F.struct(*(F.col(f"_v_{n}").alias(n) for n in values), F.lit(True).alias("_there"))
    place, turn = F.struct(F.col(at).isNotNull(), at, tie), (lambda c: F.col(c).desc()) if forward else F.col
    own = Window.partitionBy(*by, "_block").orderBy(turn(at), turn(tie))
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumns({"_near": F.lag(row).over(own), **{f"_n_{n}": F.last(f"_k_{n}", True).over(earlier) for n in known}})

    last = (F.min_by if forward else F.max_by)
    edges = keyed.groupBy(*by, "_block").agg(last(row, place).alias("_edge"), *(last(f"_k_{n}", F.when(F.col(f"_k_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in known))
    blocks = Window.partitionBy(*by).orderBy(turn("_block"))
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*(F.col(c).alias(f"_b_{c}") for c in (*by, "_block")), F.lag("_edge").over(blocks).alias("_far"), *(F.last(f"_e_{n}", True).over(before).alias(f"_f_{n}") for n in known))
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in (*by, "_block")))
    seen = near.join(carried, on, "left").withColumn("_seen", F.coalesce("_near", "_far"))
    made = {n: F.col(f"_seen.{n}") for n in values} | {n: F.coalesce(f"_n_{n}", f"_f_{n}") for n in known}
    if alone:
        made[alone] = F.col("_seen").isNull()
    return seen.select(*(F.col(f"`{c}`") for c in rows.columns if c not in made), *(c.alias(n) for n, c in made.items()))
