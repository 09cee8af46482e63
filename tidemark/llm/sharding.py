"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame and SQL functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ring positions have 63 bits; pieces of the ring end at every virtual node and at every 2**51, so a piece holds few keys.
RING_BITS, PIECE_BITS = 63, 12
#: Rows of a piece that are ranked together, about.
LOT = 100_000


def _position(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 1)


def _nodes(spark: SparkSession, shards: int, vnodes: int, seed: int) -> DataFrame:
    """(lo, shard): a node's position depends on its shard and number alone, so one more shard moves no other node."""
    shard = (F.col("id") % shards).cast("int")
    return spark.range(shards * vnodes).select(_position(F.lit(seed), F.lit("node"), shard, F.expr(f"id div {shards}")).alias("lo"), shard.alias("shard"))


def ring_pieces(spark: SparkSession, shards: int, vnodes: int, seed: int) -> DataFrame:
    """(piece, bucket, lo, hi, arc): the ring cut into pieces; a piece's keys belong to the first virtual node clockwise, whose place in ring order is ``arc``. Its size depends on the parameters alone."""
    nodes = _nodes(spark, shards, vnodes, seed).select("lo", F.lit(1).alias("node"))
    cuts = spark.range(1 << PIECE_BITS).select(F.shiftleft("id", RING_BITS - PIECE_BITS).alias("lo"), F.lit(0).alias("node"))
    ring = Window.orderBy("lo", "node")
    return (
        nodes.union(cuts)
        .select(
            (F.row_number().over(ring) - 1).cast("int").alias("piece"),
            F.shiftright("lo", RING_BITS - PIECE_BITS).alias("bucket"),
            "lo",
            F.coalesce(F.lead("lo").over(ring) - 1, F.lit((1 << RING_BITS) - 1)).alias("hi"),
            (F.sum("node").over(ring.rowsBetween(Window.unboundedPreceding, 0)) % (shards * vnodes)).cast("int").alias("arc"),
        )
        .filter("lo <= hi")
    )


def _walks(spark: SparkSession, shards: int, vnodes: int, seed: int) -> DataFrame:
    """(arc, walk): the distinct shards met clockwise from each arc."""
    ring = _nodes(spark, shards, vnodes, seed).agg(F.transform(F.array_sort(F.collect_list(F.struct("lo", "shard"))), lambda x: x["shard"]).alias("ring"))
    return ring.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(shards * vnodes - 1)), lambda a: F.array_distinct(F.concat(F.slice("ring", a + 1, F.lit(shards * vnodes)), F.slice("ring", F.lit(1), a))))).alias("arc", "walk"))


def bounded_placement(arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """(arc, from, to, shard, slot): which of an arc's keys, counted in ring order, go to which shard.

    ``arcs`` (arc, n, walk) has one row for each virtual node. Keys arrive in ring order; a key whose shard is full
    continues clockwise to the next shard with room. A shard holds ``ceil((1 + slack) * n / shards)`` keys; without
    slack, n // shards and one more in the first n % shards of them, so counts are at most one apart.
    """
    room = (
        f"transform(sequence(0, {shards - 1}), s -> cast(sum_n div {shards} + if(s < sum_n % {shards}, 1, 0) as bigint))"
        if not slack
        else f"transform(sequence(0, {shards - 1}), s -> cast(ceil(round((1 + {slack!r}D) * sum_n / {shards}, 6)) as bigint))"
    )
    parts = "array<struct<arc:int,first:bigint,past:bigint,shard:int,slot:bigint>>"
    take = "least(s.rest, s.room[w])"
    placed = f"""
      aggregate(arcs, named_struct('room', caps, 'parts', cast(array() as {parts})), (st, a) ->
        aggregate(a.walk, named_struct('room', st.room, 'parts', st.parts, 'rest', a.n),
          (s, w) -> named_struct(
            'room', transform(s.room, (r, i) -> if(i = w, r - least(s.rest, r), r)),
            'parts', if({take} > 0, concat(s.parts, array(named_struct('arc', a.arc, 'first', a.n - s.rest,
                        'past', a.n - s.rest + {take}, 'shard', w, 'slot', caps[w] - s.room[w]))), s.parts),
            'rest', s.rest - {take}),
          s -> named_struct('room', s.room, 'parts', s.parts))).parts"""
    return (
        arcs.agg(F.array_sort(F.collect_list(F.struct("arc", "n", "walk"))).alias("arcs"), F.coalesce(F.sum("n"), F.lit(0)).alias("sum_n"))
        .withColumn("caps", F.expr(room))
        .select(F.explode(F.expr(placed)).alias("p"))
        .select("p.*")
    )


def _stacked(df: DataFrame, same: list[str], lot: int) -> DataFrame:
    """``df`` with ``_ring_m``, how many equal rows a row stands for, and ``_ring_stack``, a number that tells such rows apart: 1 and 0, but where over ``lot`` rows share ``same``."""
    one = lambda rows: rows.withColumns({"_ring_m": F.lit(1).cast("long"), "_ring_stack": F.lit(0).cast("long")})
    # at most one in ``lot`` of the rows
    hot = df.groupBy(*same).agg(F.count(F.lit(1)).alias("_ring_m")).filter(F.col("_ring_m") > lot).select(*(F.col(c).alias(f"_ring_same_{i}") for i, c in enumerate(same)))
    if hot.isEmpty():
        return one(df)
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_ring_same_{i}")) for i, c in enumerate(same)))
    counted = df.join(hot, on, "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_ring_all"))
    stacks = counted.withColumn("_ring_stack", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_ring_all") - 1) / lot))))
    stacks = stacks.withColumn("_ring_m", F.least(F.lit(lot), F.col("_ring_all") - F.col("_ring_stack") * lot).cast("long")).drop("_ring_all")
    return one(df.join(hot, on, "left_anti")).unionByName(stacks)


def ring_shards(df: DataFrame, key: str, shards: int, *, vnodes: int = 64, slack: float = 0.0, seed: int = 7, ties: tuple[str, ...] = (), lot: int = LOT) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), balanced by rows.

    A key's ring position is a hash of its value. A null key has a position of its own. Columns of ``df`` named shard or
    slot are replaced; columns that begin with ``_ring_`` are reserved. An empty table gives an empty result; repeated rows
    are placed one by one.

    Only counts by ring piece (their number is fixed by the parameters) meet in one place. Rows are ranked within their
    piece, in the order of ring position, key and ``ties``; a piece of over ``lot`` rows, as a much repeated key makes it, is
    cut by a hash of key and ``ties`` into lots of about that many rows, which follow one another. Rows that are equal in all columns
    are interchangeable: where over ``lot`` rows share key and ``ties``, equal ones are counted, and stand as one row
    for every ``lot`` of them until all have their places. Columns must be such that Spark can group by them.
    """
    spark = df.sparkSession
    copies = _stacked(df.drop("shard", "slot"), [key, *ties], lot)
    pieces = ring_pieces(spark, shards, vnodes, seed).select(*(F.col(c).alias(f"_ring_{c}") for c in ("piece", "bucket", "lo", "hi", "arc")))
    at = (F.col("_ring_bucket") == F.shiftright("_ring_pos", RING_BITS - PIECE_BITS)) & F.col("_ring_pos").between(F.col("_ring_lo"), F.col("_ring_hi"))
    keyed = copies.withColumn("_ring_pos", _position(F.lit(seed), F.col(key)))
    found = keyed.join(F.broadcast(pieces), (F.shiftright("_ring_pos", RING_BITS - PIECE_BITS) == F.col("_ring_bucket")) & at)

    counts = found.groupBy("_ring_piece", "_ring_arc").agg(F.sum("_ring_m").alias("_ring_n"))
    lots = counts.select("_ring_piece", F.ceil(F.col("_ring_n") / lot).alias("_ring_lots"))
    found = found.join(F.broadcast(lots), "_ring_piece").withColumn("_ring_lot", F.pmod(F.xxhash64(key, *ties, "_ring_stack"), "_ring_lots"))
    by_lot = found.groupBy("_ring_piece", "_ring_arc", "_ring_lot").agg(F.sum("_ring_m").alias("_ring_n"))
    in_arc = Window.partitionBy("_ring_arc").orderBy("_ring_piece", "_ring_lot").rowsBetween(Window.unboundedPreceding, -1)
    before = by_lot.select("_ring_piece", "_ring_lot", F.coalesce(F.sum("_ring_n").over(in_arc), F.lit(0)).alias("_ring_before"))
    arcs = _walks(spark, shards, vnodes, seed).join(F.broadcast(counts.groupBy(F.col("_ring_arc").alias("arc")).agg(F.sum("_ring_n").alias("n"))), "arc")
    parts = bounded_placement(arcs.select("arc", "n", "walk"), shards, slack).select(*(F.col(c).alias(f"_ring_p_{c}") for c in ("arc", "first", "past", "shard", "slot")))

    in_lot = Window.partitionBy("_ring_piece", "_ring_lot").orderBy("_ring_pos", key, *ties, "_ring_stack").rowsBetween(Window.unboundedPreceding, 0)
    ranked = found.withColumn("_ring_rank", F.sum("_ring_m").over(in_lot) - F.col("_ring_m")).join(before, ["_ring_piece", "_ring_lot"])
    ranked = ranked.withColumn("_ring_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ring_m") - 1))).withColumn("_ring_rank", F.col("_ring_rank") + F.col("_ring_copy") + F.col("_ring_before"))
    placed = ranked.join(F.broadcast(parts), (F.col("_ring_arc") == F.col("_ring_p_arc")) & (F.col("_ring_rank") >= F.col("_ring_p_first")) & (F.col("_ring_rank") < F.col("_ring_p_past")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.col("_ring_p_shard").alias("shard"), (F.col("_ring_p_slot") + F.col("_ring_rank") - F.col("_ring_p_first")).alias("slot"))


def op6_sharding(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's shard by the ``rows`` law, with size, text_crc32, law, slot and a null grown_shard.

    A null text has size 1 and checksum 0; null and repeated ids are placed row by row, by text checksum and size where ids
    are equal; of rows equal in all of these any may come first. Without documents there is no row. Other columns are left
    out. Counts differ by one at most, so there is no slack: the figures of what one more shard moves are in the README.
    """
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = ring_shards(sized, "doc_id", shards, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
