"""The prefix trie of conversations, built shard by shard as double arrays.

A node is a sequence of turns with which some conversation begins. Copies of a conversation are one sequence with a count.
Sequences are dealt by prefix: a prefix grows by steps until the sequences that share it have at most SHARD_TURNS turns
after it, and what begins with it is then whole in one shard. A shard numbers its turns densely and packs BASE and CHECK: the child
of state s by turn c is state t = BASE[s] + c, if CHECK[t] = s. Sequences are walked through the arrays to count members, and
CHECK leads sums back from each state to the one before. The nodes above, shared by several shards, are merged by
Spark: each sums over what it owns, and an owner's path leads its sums to all nodes above.

Prefixes are told apart by 128 bits, exclusive sums of a hash of each turn at its place, so that those of a long conversation
are made in pieces. No conversation, node or group of copies needs to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Turns below a prefix, at most, that one shard takes whole.
SHARD_TURNS = 50_000
#: Turns of a conversation that are hashed together.
STRETCH = 1024
#: Upper nodes that are broadcast to look parents up; more are joined.
BROADCAST_NODES = 200_000
#: Bytes of ids that are hashed together.
CHUNK = 1 << 16

_steps = [1]
while _steps[-1] < 1 << 40:
    _steps.append(max(_steps[-1] + 1, _steps[-1] * 4 // 3))
#: Lengths of prefixes that may make a shard.
STEPS = tuple(_steps)


# ---- turns in order


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: the part of the table and the place within the conversation's turns of that part."""
    part, now, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        at = []
        for c in b.column("conv_id").to_pylist():
            n = n + 1 if c == now else 1
            now = c
            at.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at, pa.int64()), *b.columns], ["part", "at", *b.schema.names])


def ordered_turns(turns: DataFrame, parts: int) -> DataFrame:
    """(conv_id, pos, k1, k2, chars): turns numbered from 1 by (turn, role, text), null turns first; k1 and k2 tell a (role, text) apart.

    Rows without a conversation id are left out: they belong to none. Turns are dealt by ranges, so that one conversation may
    lie in several; where a range begins within a conversation, the turns before are added."""
    whole = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = ["conv_id", "turn", "role", "text"]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    cut = whole.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("conv_id", F.xxhash64(digest).alias("k1"), F.xxhash64(F.lit(1), digest).alias("k2"), F.length("text").cast("long").alias("chars"))
    placed = written(cut.mapInArrow(_placed, "part int, at long, conv_id long, k1 long, k2 long, chars long"), "trie-turns")
    sizes = placed.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    # only a part's first conversation can have turns before it: at most one row for each part
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).filter("before > 0").drop("n")
    found = placed.join(F.broadcast(before), ["conv_id", "part"], "left")
    return found.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "k1", "k2", "chars")


def with_prefixes(rows: DataFrame, by: str, depth: Column, begin: tuple[Column, Column] | None = None) -> DataFrame:
    """``rows`` (conv_id, stretch, ...) with depth, h1 and h2, the hashes of each turn at its depth, and p1 and p2, the exclusive sums of these up to it.

    ``rows`` are dealt by (conv_id, stretch), stretches of consecutive turns in order of ``by``; ``begin`` is the sum before the first."""
    made = rows.withColumn("depth", depth).withColumn("h1", F.xxhash64(F.lit(1), "depth", "k1", "k2")).withColumn("h2", F.xxhash64(F.lit(2), "depth", "k2", "k1"))
    so_far = Window.partitionBy("conv_id", "stretch").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    run = made.withColumn("p1", F.bit_xor("h1").over(so_far)).withColumn("p2", F.bit_xor("h2").over(so_far))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = made.groupBy("conv_id", "stretch").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = sums.select("conv_id", "stretch", F.bit_xor("s1").over(earlier).alias("s1"), F.bit_xor("s2").over(earlier).alias("s2")).filter("s1 is not null")
    out = run.join(sums, ["conv_id", "stretch"], "left")
    for p, s, b in zip(("p1", "p2"), ("s1", "s2"), begin or (F.lit(0), F.lit(0)), strict=True):
        out = out.withColumn(p, F.col(p).bitwiseXOR(F.coalesce(s, F.lit(0))).bitwiseXOR(b))
    return out.drop("s1", "s2")


def _stretch(place: Column) -> Column:
    return F.floor((place - 1) / STRETCH).cast("long")


ROWS = ["conv_id", "depth", "k1", "k2", "chars", "h1", "h2", "p1", "p2", "len"]


def rebuilt(turns: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): the rebuilt conversations' turns, as ROWS, and (conv_id, len) of each.

    Conversation c begins with the first h turns of conversation c - c % 100, h being crc32(c) % 6, and goes on with its own after its first h."""
    own = written(ordered_turns(turns, parts), "trie-ordered")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    first = own.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") <= 5)).withColumn("stretch", F.lit(0).cast("long"))
    first = with_prefixes(first, "pos", F.col("pos"))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("depth"), "k1", "k2", "chars", "h1", "h2", "p1", "p2"))).alias("heads"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.when(F.col("heads").isNull(), F.slice("heads", 1, 0)).otherwise(F.slice("heads", F.lit(1), F.col("h"))))
    convs = convs.withColumn("k", F.greatest(F.size("head"), F.lit(0)))
    convs = written(convs.select("conv_id", "n", "h", "head", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-conversations")
    last = F.element_at("head", -1)
    info = convs.select("conv_id", "h", "k", "len", *(F.when(F.col("k") > 0, last[p]).otherwise(F.lit(0)).alias(b) for p, b in (("p1", "b1"), ("p2", "b2"))), F.explode(F.sequence(F.lit(0).cast("long"), _stretch(F.col("n")))).alias("stretch"))
    tails = own.withColumn("stretch", _stretch(F.col("pos"))).join(info, ["conv_id", "stretch"]).filter("pos > h")
    tails = with_prefixes(tails, "pos", F.col("pos") - F.col("h") + F.col("k"), (F.col("b1"), F.col("b2")))
    begun = convs.select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", "t.*", "len")
    return written(tails.select(*ROWS).unionByName(begun.select(*ROWS)), "trie-rebuilt"), convs.select("conv_id", "len")


# ---- sequences and who has them


def _chunks(chunk: int):
    """Rows (p1, p2, len, conv_id) in order: runs of one sequence's ids, comma-joined, of about ``chunk`` bytes at most."""
    names = ["p1", "p2", "len", "first", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0
        made: list[tuple] = []

        def close() -> None:
            if ids:
                made.append((*now, ids[0], len(ids), ",".join(map(str, ids))))

        for b in batches:
            for *key, conv in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "len", "conv_id")), strict=True):
                if key != now or size >= chunk:
                    close()
                    now, ids, size = key, [], 0
                ids.append(conv)
                size += len(str(conv)) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names)
                made = []
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names)

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order: each sequence with its smallest id, their number and the digest of them all; a digest is fed chunk by chunk."""
    now, seq, n, digest, made = None, None, 0, sha256(), []
    for b in batches:
        for *key, first, many, ids in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "len", "first", "n", "ids")), strict=True):
            if key != now:
                if now is not None:
                    made.append((seq, *now, n, digest.hexdigest()))
                now, seq, n, digest = key, first, 0, sha256()
            digest.update(("," if n else "").encode() + ids.encode())
            n += many
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["seq", "p1", "p2", "len", "n", "sha"])
            made = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (seq, *now, n, digest.hexdigest())], ["seq", "p1", "p2", "len", "n", "sha"])


def sequences(turns: DataFrame, convs: DataFrame, parts: int) -> DataFrame:
    """(seq, p1, p2, len, n, sha): each different sequence by its smallest conversation, how many have it and the digest of their ids."""
    none = F.lit(0).cast("long")
    ends = turns.filter("depth = len").select("conv_id", "len", "p1", "p2").union(convs.filter("len = 0").select("conv_id", "len", none, none))
    runs = ends.repartitionByRange(parts, "p1", "p2", "len", "conv_id").sortWithinPartitions("p1", "p2", "len", "conv_id").select("p1", "p2", "len", "conv_id").mapInArrow(_chunks(CHUNK), "p1 long, p2 long, len long, first long, n long, ids string")
    return runs.repartition(parts, "p1", "p2").sortWithinPartitions("p1", "p2", "len", "first").mapInArrow(_sequences, "seq long, p1 long, p2 long, len long, n long, sha string")


# ---- double arrays


class DoubleArray:
    """BASE and CHECK of the trie of some sequences of numbers from 1 on, laid end to end in ``codes``; each begins at a place of ``starts``."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.codes, self.starts, self.sizes = codes, starts, np.diff(np.append(starts, len(codes)))
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.top, self.states = 2, 1  # state 1 is the root
        self.holes = np.zeros(0, np.int64)
        level, live, state = 0, np.arange(len(starts)), np.ones(len(starts), np.int64)
        while len(live := live[self.sizes[live] > level]):
            code = codes[starts[live] + level]
            order = np.lexsort((code, state[live]))
            s, c = state[live][order], code[order]
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
            self._place(s[new], c[new])
            state[live] = self.base[state[live]] + code
            level += 1

    def _room(self, past: int) -> None:
        if past > len(self.base):
            more = max(past, 2 * len(self.base)) - len(self.base)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1))

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Gives each parent a base at which all its codes' cells are free."""
        first = np.concatenate(([True], parents[1:] != parents[:-1]))
        start = np.flatnonzero(first)
        many = np.diff(np.append(start, len(parents)))
        for lo, n in zip(start[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            at = self._fit(codes[lo : lo + n])
            self.base[parents[lo]] = at
            self.check[at + codes[lo : lo + n]] = parents[lo]
        # an only child takes any free cell
        alone = start[many == 1]
        cells = self.holes[: len(alone)]
        self.holes = self.holes[len(cells) :]
        fresh = len(alone) - len(cells)
        cells = np.concatenate((cells, np.arange(self.top, self.top + fresh)))
        self.top += fresh
        self._room(self.top)
        self.base[parents[alone]] = cells - codes[alone]
        self.check[cells] = parents[alone]
        self.states += len(codes)

    def _fit(self, codes: np.ndarray) -> int:
        """The first base at which the codes' cells are free: among the first holes, among all where many are empty, else at the end."""
        span = int(codes[-1] - codes[0]) + 1
        holes = self.holes if self.top > 16 * (self.states + 64) else self.holes[:4096]
        at = holes - codes[0]
        for c in codes[1:]:
            at = at[at + c < self.top]
            at = at[self.check[at + c] < 0]
            if not len(at):
                break
        if len(at):
            self.holes = np.setdiff1d(self.holes, at[0] + codes, assume_unique=True)
            return int(at[0])
        begin, self.top = self.top, self.top + span
        self._room(self.top)
        self.holes = np.append(self.holes, np.setdiff1d(np.arange(begin, self.top), begin + codes - codes[0], assume_unique=True))
        return begin - int(codes[0])

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sequences, states, rows) for each step from the root: who is still walking, where each one is, and the row of ``codes`` that led there."""
        level, live, state = 0, np.arange(len(self.starts)), np.ones(len(self.starts), np.int64)
        while len(live := live[self.sizes[live] > level]):
            row = self.starts[live] + level
            to = self.base[state[live]] + self.codes[row]
            if (self.check[to] != state[live]).any():
                raise AssertionError("a sequence has left the trie")
            state[live] = to
            yield live, to, row
            level += 1


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_seq long, q1 long, q2 long"


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the different pairs (a, b)."""
    order = np.lexsort((b, a))
    new = np.concatenate(([False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def shard_nodes(g1, g2, conv, depth, k1, k2, chars, n, length, q1, q2) -> pa.RecordBatch:
    """The nodes of whole prefix groups (g1, g2), rows being sorted by group, sequence and depth. A sequence's first row is the group's own turn, the same for all of the group."""
    starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    group, turn = _numbered(g1, g2), _numbered(k1, k2)
    codes = turn + group.max() + 2
    codes[starts] = group[starts] + 1  # which group, not which turn: turns at the ends of different prefixes may be equal
    trie = DoubleArray(codes, starts)
    cells = trie.top
    n_convs, first, at_depth, of_chars, of_row = np.zeros(cells, np.int64), np.full(cells, np.iinfo(np.int64).max), np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    end = np.full(cells, -1, np.int64)
    levels = []
    for live, to, row in trie.walk():
        np.add.at(n_convs, to, n[starts[live]])
        np.minimum.at(first, to, conv[starts[live]])
        at_depth[to], of_chars[to], of_row[to] = depth[row], chars[row], row
        ends = depth[row] == length[row]
        end[to[ends]] = row[ends]
        levels.append(np.unique(to))
    parent = trie.check[:cells]
    used = np.concatenate(levels)
    n_children = np.bincount(parent[used], minlength=cells)
    n_leaves, saved = (n_children == 0).astype(np.int64), (n_convs - 1) * of_chars
    for level in levels[:0:-1]:
        np.add.at(n_leaves, parent[level], n_leaves[level])
        np.add.at(saved, parent[level], saved[level])
    top = parent[used] == 1
    masked = lambda values, none: pa.array(values, mask=none)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first[used]), pa.array(at_depth[used]), masked(first[parent[used]], top), pa.array(n_convs[used]), pa.array(n_children[used]), pa.array(n_leaves[used]),
            pa.array(saved[used]), masked(conv[end[used]], end[used] < 0), masked(q1[of_row[used]], ~top), masked(q2[of_row[used]], ~top),
        ],
        [f.split()[0] for f in NODE.split(", ")],
    )


SHARD_COLUMNS = ["g1", "g2", "conv_id", "depth", "k1", "k2", "chars", "n", "len", "q1", "q2"]


def _shards(turns: int):
    """Rows sorted by group, sequence and depth; groups that come one after another share a double array as far as ``turns`` allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size >= turns:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                other = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
                held = [whole]
                if len(other):
                    cut = int(other[-1]) + 1
                    yield shard_nodes(*(c[:cut] for c in whole))
                    held = [[c[cut:] for c in whole]]
                size = len(held[0][0])
        if held:
            yield shard_nodes(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


# ---- the whole trie


def prefix_nodes(turns: DataFrame, convs: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` (ROWS) and ``convs`` (conv_id, len) are written tables, ``convs`` with the conversations without turns too."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seqs = written(sequences(turns, convs, parts), "trie-sequences")
    of_seq = turns.join(seqs.select(F.col("seq").alias("conv_id"), "n"), "conv_id")
    q = [F.col(p).bitwiseXOR(F.col(h)).alias(to) for p, h, to in (("p1", "h1", "q1"), ("p2", "h2", "q2"))]
    of_seq = written(of_seq.select("conv_id", "depth", "k1", "k2", "chars", "n", "len", "p1", "p2", *q), "trie-sequence-turns")

    steps = of_seq.filter(F.col("depth").isin(*STEPS)).select("conv_id", "depth", "p1", "p2", "len")
    large = steps.groupBy("depth", "p1", "p2").agg(F.sum(F.col("len") - F.col("depth") + 1).alias("size")).filter(F.col("size") > shard_turns).drop("size")
    cuts = steps.join(large, ["depth", "p1", "p2"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("c"))
    cuts = cuts.select("conv_id", F.col("c.depth").alias("cut"), F.col("c.p1").alias("g1"), F.col("c.p2").alias("g2"))
    dealt = written(of_seq.join(cuts, "conv_id", "left"), "trie-dealt")
    shards = dealt.filter("depth >= cut").select(*SHARD_COLUMNS).repartition(parts, "g1", "g2").sortWithinPartitions("g1", "g2", "conv_id", "depth")
    below = written(shards.mapInArrow(_shards(shard_turns), NODE), "trie-nodes")

    # upper nodes: shared by shards, or on the way of a sequence that no shard takes whole
    zero = F.lit(0).cast("long")
    path = ["conv_id", "depth", "p1", "p2", "q1", "q2", "chars", "n", "len"]
    roots = seqs.select(F.col("seq").alias("conv_id"), *(zero.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "chars")), "n", "len")
    upper = dealt.filter("cut is null or depth < cut").select(*path).union(roots.select(*path))
    node = ["depth", "p1", "p2"]
    ends = F.min(F.when(F.col("depth") == F.col("len"), F.col("conv_id"))).alias("end_seq")
    merged = upper.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), ends)
    merged = written(merged, "trie-upper")
    tops = below.filter("parent_conv_id is null")
    to_parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = merged.filter("depth > 0").select(*to_parent).union(tops.select(*to_parent)).groupBy(*node).agg(F.count(F.lit(1)).alias("n_children"))
    merged = merged.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    merged = written(merged, "trie-upper-children")

    owned = merged.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    owned = owned.union(tops.select("conv_id", "depth", "n_leaves", "saved_tokens"))
    along = owned.select("conv_id", "depth", "leaves", "saved", zero.alias("p1"), zero.alias("p2"), F.lit(False).alias("is_node"))
    along = along.union(upper.select("conv_id", "depth", zero, zero, "p1", "p2", F.lit(True))).withColumn("stretch", _stretch(F.col("depth") + 1))
    from_here = Window.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = along.groupBy("conv_id", "stretch").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select("conv_id", "stretch", F.sum("l").over(later).alias("l"), F.sum("s").over(later).alias("s")).filter("l is not null")
    below_here = along.select("conv_id", "stretch", *node, "is_node", *(F.sum(c).over(from_here).alias(c) for c in ("leaves", "saved"))).filter("is_node").join(rest, ["conv_id", "stretch"], "left")
    sums = below_here.groupBy(*node).agg(*(F.sum(F.col(c) + F.coalesce(m, F.lit(0))).alias(to) for c, m, to in (("leaves", "l", "n_leaves"), ("saved", "s", "saved_tokens"))))

    parents = merged.select("depth", "p1", "p2", F.col("conv_id").alias("up"))
    parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "up")
    if merged.count() <= BROADCAST_NODES:
        parents = F.broadcast(parents)
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_seq"]
    above = merged.join(sums, node).join(parents, ["depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.col("up")).select(*told)
    tops = tops.drop("parent_conv_id").join(parents, ["depth", "q1", "q2"]).withColumnRenamed("up", "parent_conv_id").select(*told)
    nodes = above.union(tops).union(below.filter("parent_conv_id is not null").select(*told))
    named = nodes.filter("end_seq is not null").join(seqs.select(F.col("seq").alias("end_seq"), F.col("sha").alias("ends_sha256")), "end_seq")
    unnamed = nodes.filter("end_seq is null").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    out = [*told[:-1], "ends_sha256"]
    return named.select(*out).union(unnamed.select(*out))


def op11_trie(spark: SparkSession, conversations: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations.

    Turns are in order of (turn, role, text), a null turn first; a null role or text is empty; repeated rows are turns of their own.
    A row without a conversation id belongs to no conversation and is left out. Without conversations there is no node, not even the
    root; a rebuilt conversation without turns ends at the root. Other columns are left out.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns, convs = rebuilt(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"), parts)
    return prefix_nodes(turns, convs, shard_turns=shard_turns)


ORACLE = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, CAST(conv_id AS VARCHAR) AS s FROM own),
h AS (
  SELECT conv_id, base, xor(list_reduce([4294967295] || list_transform(range(1, len(s) + 1), lambda i: CAST(ord(s[i]) AS BIGINT)),
                                        lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) % 6 AS h
  FROM convs CROSS JOIN tab),
rows AS (
  SELECT c.conv_id, o.pos AS k, o.x FROM h c JOIN own o ON o.conv_id = c.base WHERE o.pos <= c.h
  UNION ALL SELECT c.conv_id, 10 + o.pos, o.x FROM h c JOIN own o ON o.conv_id = c.conv_id WHERE o.pos > c.h),
seqs AS (SELECT h.conv_id, coalesce(s, []) AS s FROM h LEFT JOIN (SELECT conv_id, list(x ORDER BY k) AS s FROM rows GROUP BY conv_id) USING (conv_id)),
nodes AS (
  SELECT d, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d) AS ends
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs) GROUP BY d, s[1:d]),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own_sums AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
         CASE WHEN n.d > 0 THEN (n.n - 1) * length(n.p[n.d].t) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids USING (d, p)),
sums AS (SELECT d, p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT up AS d, p[1:up] AS p, leaf, saved FROM (SELECT p, leaf, saved, unnest(range(0, d + 1)) AS up FROM own_sums)) GROUP BY d, p)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own_sums o JOIN sums USING (d, p) LEFT JOIN nodes u ON u.d = o.d - 1 AND u.p = o.p[1:o.d - 1]
"""
