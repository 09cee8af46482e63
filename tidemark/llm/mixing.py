"""Mixing sources to target weights: fixed-length blocks, multinomial shard counts, keyed index permutations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, written
from .textbytes import word_bounds

#: Documents of a cell, about: each source's token stream is its cells one after the other, and a cell is sorted by one task.
CELL_ROWS = 20_000
#: Output shards whose source counts one task draws, one after the other.
RANGE_SHARDS = 16
#: Copies of a document that are made at once.
_COPIES = 4096


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """(src, source, source_size, target) from (source, source_size): one row for each source.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all sizes by weight. A target
    stops at ``cap`` times its source's size and the excess goes to the others by weight, until none is above: with
    sources sorted by room for each unit of weight, that level is the largest over all prefixes taken as full.
    """
    order, by_room, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "src"), Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("src", F.row_number().over(order) - 1).withColumn("weight", F.array(*map(F.lit, weights))[F.col("src") % len(weights)])
    ratio = ranked.withColumn("room", cap * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("weight"))
    level = ratio.withColumn(
        "level",
        (share * F.sum("source_size").over(all_) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    return level.select("src", "source", "source_size", F.least("room", F.max("level").over(all_) * F.col("weight")).alias("target"))


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1: a Feistel network over the next even number of bits, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_key(key, r))
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (outside := out >= n).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def drawn_counts(rng: np.random.Generator, size: int, left: np.ndarray) -> np.ndarray:
    """Multinomial counts of ``size`` draws by the weights ``left``, none above it: what would be is drawn again among the rest."""
    got = np.zeros_like(left)
    while (need := size - int(got.sum())) > 0:
        room = left - got
        got += np.minimum(rng.multinomial(need, room / room.sum()), room)
    return got


_PLAN = "range long, blocks long, src array<int>, source_size array<long>, words array<long>, draws array<long>, first array<long>, n array<long>"


def _range_counts(per_range: int, seed: int):
    """The plan of all sources, one row, to a row for each range of shards: how many draws of each source it has, and the first."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["plan"]:
                src, size, words, draws = (np.array([s[c] for s in p], np.int64) for c in ("src", "source_size", "words", "draws"))
                left, k, held = draws.copy(), 0, []
                while left.sum():
                    n = drawn_counts(np.random.default_rng(_key(seed, "range", k)), min(per_range, int(left.sum())), left)
                    held.append({"range": k, "blocks": int(n.sum()), "src": src.astype(np.int32), "source_size": size, "words": words, "draws": draws, "first": draws - left, "n": n})
                    left, k = left - n, k + 1
                    if len(held) == 1000:
                        yield pd.DataFrame(held)
                        held = []
                if held:
                    yield pd.DataFrame(held)

    return draw


def _draws(length: int, shard_blocks: int, seed: int):
    """A range of shards to the draws of its shards: each shard has multinomial source counts, and each draw a block."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples(index=False):
                left, first, shard = p.n.copy(), p.first.copy(), p.range * RANGE_SHARDS
                while left.sum():
                    n = drawn_counts(np.random.default_rng(_key(seed, "shard", shard)), min(shard_blocks, int(left.sum())), left)
                    for i in np.flatnonzero(n):
                        size, many = int(p.source_size[i]), int(p.draws[i])
                        k = np.arange(first[i], first[i] + n[i])
                        blocks, full = -(-size // length), size // length
                        epoch, j = k // blocks, k % blocks
                        block = j.copy()
                        for e in np.unique(epoch):
                            at = (epoch == e) & (j < full)
                            block[at] = permuted(j[at], full, _key(seed, int(p.src[i]), int(e)))
                        take = np.minimum(length, size - block * length)
                        last = (k == many - 1) & (p.words[i] % size > 0)
                        take[last] = p.words[i] % size - j[last] * length
                        yield pd.DataFrame({"src": p.src[i], "shard": shard, "draw": k, "epoch": epoch, "block": block, "take": take})
                    left, first, shard = left - n, first + n, shard + 1

    return expand


def mix(sized: DataFrame, *, length: int = 256, shard_blocks: int = 4096, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0, seed: int = 11, row: tuple[str, ...] = (), cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(targets, streams, draws, pieces) of a mix of ``sized`` (doc_id, source, size in words; other columns are left out).

    A source's documents, in a fixed pseudorandom order, are one stream of words packed into blocks of ``length``; the
    last block may be short. The source's number of draws follows from its target. Every output shard of ``shard_blocks``
    blocks draws its source counts from a multinomial law whose weights are the draws that each source has left, so that
    totals meet the targets. The k-th draw of a source takes the block at the k-th place of a keyed permutation of its
    block indices, a new one when all are used (a short last block ends each pass); the very last draw stops where the
    target is reached. Blocks and documents meet by (source, block index), so no source's size makes a task large.

    ``targets`` is (src, source, source_size, target), ``streams`` has each document's src and ``start``, ``draws`` is the
    plan of the shards (src, shard, draw, epoch, block, take in words), ``pieces`` is a row for each part of a document
    that a draw takes: src, start, doc_id, shard, draw, epoch, and words [from_word, to_word) of the document.

    Null sources are a source of their own; documents without words are in no piece; a null id sorts first. Repeated rows
    are documents of their own: one row with a count until their places are known. Columns ``row`` are names of
    ``sized`` that tell its rows apart where ids do not: they order equal ids and are in the pieces. A row of counts for
    each source is held by a task and by the driver's plan, nothing that grows with documents.
    """
    spark = sized.sparkSession
    told = ["doc_id", "source", "size", *row]
    units = written(sized.groupBy(*told).agg(F.count(F.lit(1)).alias("copies")), "mix-units")
    cells = max(1, -(-units.count() // cell_rows))
    units = units.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", *row), F.lit(cells)).cast("int"))
    whole = F.col("size") * F.col("copies")
    by_cell = units.groupBy("source", "cell").agg(F.sum(whole).alias("n"))
    targets = written(source_targets(by_cell.groupBy("source").agg(F.sum("n").alias("source_size")), share, weights, cap), "mix-targets")
    # one row for each source and cell
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.withColumn("cell_start", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("cell").alias("c"), "cell_start")
    starts = starts.join(targets.select(F.col("source").alias("s2"), "src", "source_size", "target"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    within = Window.partitionBy("source", "cell").orderBy("doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        units.withColumn("at", F.coalesce(F.sum(whole).over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .select(*told, "src", "source_size", "target", (F.col("at") + F.col("cell_start")).alias("start"), "copies")
    )
    some = placed.withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)")))
    each = some.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + (_COPIES - 1), F.col("copies") - 1))))
    streams = each.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copies", "from", "copy")

    words = F.least(F.round("target"), cap * F.col("source_size")).cast("long")
    blocks = F.ceil(F.col("source_size") / length)
    plan = targets.filter("source_size > 0").select("src", "source_size", words.alias("words")).withColumn("draws", F.expr("words div source_size") * blocks + F.ceil(F.col("words") % F.col("source_size") / length))
    one = plan.agg(F.array_sort(F.collect_list(F.struct("src", "source_size", "words", "draws"))).alias("plan"))
    ranges = one.mapInPandas(_range_counts(shard_blocks * RANGE_SHARDS, seed), _PLAN)
    # by number, as the few small rows of the plan become many
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    draws = ranges.repartition(parts, "range").mapInPandas(_draws(length, shard_blocks, seed), "src int, shard long, draw long, epoch long, block long, take long")

    spans = streams.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {length}, (start + size - 1) div {length})")))
    begin = F.greatest(F.lit(0), F.col("block") * length - F.col("start"))
    end = F.least(F.col("size"), F.col("block") * length + F.col("take") - F.col("start"))
    # by merge: the planner takes the draws for as small as the plan they come from
    pieces = spans.join(draws.hint("merge"), ["src", "block"]).select("src", "start", "doc_id", *row, "shard", "draw", "epoch", begin.alias("from_word"), end.alias("to_word")).filter("from_word < to_word")
    return targets, streams, draws, pieces


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The words [from, to) of each span with what stands between them; spans that touch are one, others a line each."""
    raw = text.encode("utf-8", "surrogatepass")
    start, end = word_bounds(np.frombuffer(raw, np.uint8))
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return b"\n".join(raw[start[a] : end[b - 1]] for a, b in merged).decode("utf-8", "surrogatepass")


def mixed_documents(docs: DataFrame, row: str, **options) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source, other columns) as documents: a row for each pass over a source in which
    draws take words of the document, with those words as its text. ``row`` names a long column that tells rows apart,
    whatever their ids, and is read several times: hand in a written table. Documents without words are in no mix. Rows
    of a document and a pass meet by ``row``; no source is gathered anywhere."""
    sized = docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("text_hash"), row)
    *_, pieces = mix(sized, row=("text_hash", row), **options)
    names = docs.columns
    spans = pieces.groupBy(F.col(row).alias("p_row"), "epoch").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [cut_text(t.as_py(), [(x["from_word"], x["to_word"]) for x in s.as_py()]) for t, s in zip(b.column("text"), b.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else b.column(c) for c in names], names)

    joined = docs.join(spans.hint("merge"), F.col(row) == F.col("p_row")).drop("p_row", "epoch")
    return joined.mapInArrow(run, docs.schema)


def op1_mixing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) with its size, its source's size and target, and the words the mix takes of it.

    A null or word-free text has size 0 and is not taken; a null source is the last one; repeated rows are documents of
    their own; without documents there is no row. Other columns are left out, whatever their names.
    """
    _, streams, _, pieces = mix(docs.select("doc_id", "source", n_words("text").alias("size")))
    taken = pieces.groupBy(F.col("src").alias("p_src"), F.col("start").alias("p_start")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"))
    out = streams.join(taken, (F.col("src") == F.col("p_src")) & (F.col("start") == F.col("p_start")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))
