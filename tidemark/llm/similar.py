"""Near duplicates by Jaccard similarity of word shingles: SimHash with Golay keys proposes, the shingles decide.

Each set of shingles has several fingerprints, made of differently mixed hashes of the same shingles. Fingerprints meet
at pairs of Golay codewords as in ``simhash``; those at most ``reach`` bits apart are candidates, and every candidate pair
is judged by its sets. At a similarity of 0.8 a bit differs with a chance of 0.15, so some pairs never meet: the recall is
measured, not certain, and grows with the number of fingerprints.

What meets is looked at with one hub first, then, with the components that this has made, where it has left members apart:
they meet at their keys a second time, for a list of members of each key would be a row for every key of a member, twice.
Where many of these are near each other, as in a large group of texts that differ from each other at many places, their
sets meet in blocks and the similarity is found there: rows are members times blocks, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .simhash import bit_distance, folded, hashes_of, pair_keys
from .textbytes import mixed

#: Bits of a Golay pair key; the number of the fingerprint stands above them.
_KEY_BITS = 26
#: Fingerprints under one key whose bits are all compared at once; beyond it, those with one of them.
BUCKET = 2048
#: Hubs that a fingerprint is compared with at first; those with more, or in a list, meet again at all of their keys.
HUBS = 3
#: Members of a list that are compared by their bits in one task, and candidate pairs for each member that are made; beyond either, sets meet in blocks.
TOGETHER, PAIRS = 4096, 1
#: Members of a group, outside its largest part, whose sets one task holds while those of all members pass.
BLOCK = 256


def sets_of(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted hashes of the different shingles; fewer words than ``size`` are one shingle, none are no shingle."""
    return [np.unique(h) for h in hashes_of(texts, size, 42)]


def prints_of(hashes: np.ndarray, seeds: int) -> list[int]:
    return [folded(mixed(hashes + np.uint64(s * 0x9E3779B97F4A7C15 % (1 << 64))) if s else hashes) for s in range(seeds)]


def _prints(size: int, seeds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, same, fps = [], [], []
            for s in sets_of(b.column("text").to_pylist(), size):
                n.append(len(s))
                same.append(blake2b(s.tobytes(), digest_size=16).digest())
                fps.append(prints_of(s, seeds))
            fps = pa.FixedSizeListArray.from_arrays(pa.array(np.array(fps, np.uint64).reshape(-1).view(np.int64)), seeds).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), fps], ["node", "n", "same", "fps"])

    return run


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seed, fps = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seed", "fp"))
        for i in range(0, len(fps), 20_000):
            key, at = pair_keys(fps[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(key | seed[i : i + 20_000][at] << _KEY_BITS), pa.array(fps[i : i + 20_000][at])], ["key", "fp"])


def _lists_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seed, fp, node, n, comp, f0, f1, ...): the list of every key of fp, and from node on what the row has."""
    for batch in batches:
        seed, fps, *more = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for i in range(0, len(fps), 2_000):
            key, at = pair_keys(fps[i : i + 2_000])
            at = at + i
            yield pa.RecordBatch.from_arrays([pa.array(key | seed[at] << _KEY_BITS), *(pa.array(c[at]) for c in more)], ["list", *batch.schema.names[2:]])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by key, the first column, cut between keys."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
        if n >= 200_000 and held[0][0][0] != held[-1][0][-1]:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            yield [c[:cut] for c in whole]
            held = [[c[cut:] for c in whole]]
            n = len(held[0][0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _meetings(reach: int, bucket: int):
    """Rows (key, fp) sorted by key: (seed, a, b, near) of each fingerprint of a bucket that is within ``reach`` of one of them, its hub b, which has so many near it; where there are no more than these two, of both. Where three or more have one so near, (seed, a, null, null) for those, once for all buckets that are looked at together.

    In a bucket of more than ``bucket`` fingerprints all count as near some other: it is never compared pair by pair here.
    """
    cell = 1 << 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _whole_keys(batches):
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            pairs, lists = [], []

            def add(k: np.ndarray, x: np.ndarray, near_some: np.ndarray | None, near_hub: np.ndarray, hub: np.ndarray) -> None:
                g, at = np.nonzero(near_hub)
                met = np.stack((k[g] >> _KEY_BITS, x[g, at], x[np.arange(len(x)), hub][g], near_hub.sum(1)[g]))
                many = np.full(len(x), True) if near_some is None else near_some.sum(1) > 2
                pairs.extend((met, met[[0, 2, 1, 3]][:, ~many[g]]))
                g, at = np.nonzero((np.full(x.shape, True) if near_some is None else near_some) & many[:, None])
                lists.append(np.stack((k[g] >> _KEY_BITS, x[g, at])))

            for n in np.unique(size[(size > 1) & (size <= bucket)]).tolist():
                of = start[size == n]
                for i in range(0, len(of), max(1, cell // (n * n))):
                    part = of[i : i + max(1, cell // (n * n))]
                    x, k = fp[part[:, None] + np.arange(n)], key[part]
                    near = bit_distance(x[:, :, None], x[:, None, :]) <= reach
                    near[:, np.arange(n), np.arange(n)] = False
                    # the hub is one with most company, and of these the same in many buckets: so most others are near it, and pairs repeat
                    hub = (near.sum(2) + mixed(x.view(np.uint64)) / 2.0**65).argmax(1)
                    add(k, x, near.any(2), near[np.arange(len(x)), hub], hub)
            for s, n in zip(start[size > bucket].tolist(), size[size > bucket].tolist(), strict=True):
                x, hub = fp[s : s + n], int(key[s]) % n
                near = bit_distance(x, np.full(n, x[hub])) <= reach
                near[hub] = False
                add(key[s : s + 1], x[None], None, near[None], np.array([hub]))
            if pairs:
                met = np.concatenate(pairs, 1)
                met = met[:, np.lexsort((-met[3], *met[2::-1]))]
                met = met[:, np.concatenate((np.full(min(1, met.shape[1]), True), (met[:3, 1:] != met[:3, :-1]).any(0)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in met], ["seed", "a", "b", "near"])
                seed, a = np.unique(np.concatenate(lists, 1), axis=1)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(a), none, none], ["seed", "a", "b", "near"])

    return run


def _candidates(star: bool, total: int, seeds: int, together: int):
    """Rows (list, node, n, comp, f0, f1, ...) sorted by list: (a, b) that may be similar by size and bits, with one node of the list, or else of different components.

    Of a list that is too long for the latter, or has too many such pairs, the components that have any, each beside the smallest of them, and marked, once for all lists that are looked at together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, comp, *fps in _whole_keys(batches):
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            a, b, dense = [], [], []
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
                if not star and (comp[lo:hi] == comp[lo]).all():
                    continue
                if not star and hi - lo > together:
                    dense.append(np.unique(comp[lo:hi]))
                    continue
                # lists of the same nodes have different hubs
                hub = lo + int(key[lo]) % (hi - lo)
                first, past, step = (hub, hub + 1, 1) if star else (lo, hi, max(1, (1 << 20) // (hi - lo)))
                x_of, y_of = [], []
                for x in range(first, past, step):
                    end = min(x + step, past)
                    m, k = n[x:end, None], n[None, lo:hi]
                    good = 5 * np.minimum(m, k) >= 4 * np.maximum(m, k)
                    good &= node[x:end, None] != node[None, lo:hi] if star else (node[x:end, None] < node[None, lo:hi]) & (comp[x:end, None] != comp[None, lo:hi])
                    f, g = np.nonzero(good)
                    f, g = f + x, g + lo
                    close = sum(bit_distance(fp[f], fp[g]).astype(np.int64) for fp in fps) <= total
                    x_of.append(f[close])
                    y_of.append(g[close])
                f, g = np.concatenate(x_of), np.concatenate(y_of)
                if not star and len(f) > PAIRS * (hi - lo):
                    dense.append(np.unique(comp[np.concatenate((f, g))]))
                else:
                    a.append(node[f])
                    b.append(node[g])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.zeros(pairs.shape[1], bool))], ["a", "b", "dense"])
            if dense:
                met = np.unique(np.stack((np.concatenate([c[1:] for c in dense]), np.concatenate([np.full(len(c) - 1, c[0]) for c in dense]))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1]), pa.array(np.ones(met.shape[1], bool))], ["a", "b", "dense"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, holds, node, comp, keys) sorted by block, those that it holds first: links (a, b) of similarity 0.8 or more between what a block holds and all that pass, as many as join different components there."""
    now, held, head = None, [], {}

    def root(c: int) -> int:
        while head.get(c, c) != c:
            c = head[c]
        return c

    for batch in batches:
        a, b = [], []
        passing: list[tuple[int, int, np.ndarray]] = []

        def meet() -> None:
            """Counts the shared keys of all held with all passing, by the keys of the held."""
            if not held or not passing:
                return
            keys = np.concatenate([k for _, _, k in held])
            owner = np.repeat(np.arange(len(held)), [len(k) for _, _, k in held])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            theirs = np.concatenate([k for _, _, k in passing])
            who = np.repeat(np.arange(len(passing)), [len(k) for _, _, k in passing])
            lo, hi = np.searchsorted(keys, theirs, "left"), np.searchsorted(keys, theirs, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(np.repeat(who, n) * len(held) + owner[at], minlength=len(passing) * len(held)).reshape(len(passing), len(held))
            sizes = np.array([len(k) for _, _, k in held])[None] + np.array([len(k) for _, _, k in passing])[:, None]
            for y, x in zip(*np.nonzero(5 * both >= 4 * (sizes - both)), strict=True):
                (m, c, _), (o, d, _) = held[x], passing[y]
                if (r := root(c)) != (q := root(d)):
                    head[r] = q
                    a.append(m)
                    b.append(o)

        for block, holds, node, comp, keys in zip(*(batch.column(c) for c in ("block", "holds", "node", "comp", "keys")), strict=True):
            if block.as_py() != now:
                meet()
                now, held, head, passing = block.as_py(), [], {}, []
            (held if holds.as_py() else passing).append((node.as_py(), comp.as_py(), keys.values.to_numpy()))
            if len(passing) == BLOCK:
                meet()
                passing = []
        meet()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [s.view(np.int64) for s in sets_of(b.column("text").to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with a Jaccard similarity of 0.8 or more."""
    pairs = written(pairs.distinct(), "similar-pairs")
    x, y = (sets.select(F.col("node").alias(to), F.col("keys").alias(name)) for to, name in (("a", "x"), ("b", "y")))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), "similar-links")


def _joined_in_blocks(dense: DataFrame, nodes: DataFrame, sets: DataFrame, parts: int, block: int) -> DataFrame:
    """Links (a, b) between the ``nodes`` (node, comp) of components that ``dense`` (a, b) joins to groups: each block of those outside a group's largest component meets all of the group."""
    if dense.isEmpty():
        return dense.limit(0)
    whole = connected_components(dense)
    told = written(nodes.join(whole.select(F.col("node").alias("comp"), F.col("component").alias("group")), "comp").select("group", "comp", "node"), "similar-dense")
    largest = told.groupBy("group", "comp").count().groupBy("group").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"))
    small = told.join(largest, "group").filter("comp <> most")
    # blocks are numbered by a hash: their sizes are near BLOCK
    sizes = small.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    held = small.join(sizes, "group").select("group", F.pmod(F.xxhash64("node"), "blocks").alias("at"), F.lit(True).alias("holds"), "node", "comp")
    passing = told.join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"), F.lit(False).alias("holds"), "node", "comp")
    rows = held.union(passing).withColumn("block", F.xxhash64("group", "at")).join(sets, "node").select("block", "holds", "node", "comp", "keys")
    return written(rows.repartition(parts, "block").sortWithinPartitions("block", F.desc("holds")).mapInArrow(_blocks, "a long, b long"), "similar-block-links")


def similar_groups(docs: DataFrame, *, size: int = 5, seeds: int = 3, reach: int = 12, total: int = 44, bucket: int = BUCKET, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """(row, component) of every row of ``docs`` (row, text), a written table with a long ``row`` that does not repeat.

    Two texts are linked if their sets of shingles of ``size`` words (ASCII letters folded) have a Jaccard similarity of
    0.8 or more, one of their ``seeds`` fingerprints proposes them, being within ``reach`` bits, and all of them together
    are within ``total`` bits. Texts without words, null too, are linked. component is the smallest row reachable. Texts with
    equal sets stand for one node. Fingerprints that meet in a bucket, or that are equal, are compared with one of them;
    then, as far as that has left them in different groups, with each other: nothing is capped, and a group of many near
    copies costs a few rows a member for each block of members that stay outside its largest part.
    """
    prints = written(docs.select(F.col("row").alias("node"), "text").mapInArrow(_prints(size, seeds), "node long, n long, same binary, fps array<long>"), "similar-prints")
    leads = written(prints.groupBy("same").agg(F.min(F.struct("node", "n", "fps")).alias("s")).select("same", "s.*"), "similar-nodes")
    copies = written(prints.select("same", F.col("node").alias("row")).join(leads.select("same", "node"), "same").select("row", "node"), "similar-copies")

    own = ["node", "n", "fps"]
    by_fp = leads.select(*own, F.posexplode("fps").alias("seed", "fp")).withColumn("seed", F.col("seed").cast("long"))
    lead_fp = written(by_fp.groupBy("seed", "fp").agg(F.min(F.struct(*own)).alias("s"), F.count(F.lit(1)).alias("many")).select("seed", "fp", "s.*", "many"), "similar-fingerprints")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = lead_fp.select("seed", "fp").mapInArrow(_emit_keys, "key long, fp long")
    met = written(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meetings(reach, bucket), "seed long, a long, b long, near long"), "similar-meetings")
    # a fingerprint has no more hubs than keys; those with the most near them come first
    by_hub = met.filter("b is not null").groupBy("seed", "a", "b").agg(F.max("near").alias("near"))
    hubs = written(by_hub.groupBy("seed", "a").agg(F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("near"), "b")))["b"].alias("hubs")), "similar-hubs")

    def close(pairs: DataFrame) -> DataFrame:
        """Of pairs with both sides' n and fps, those that may be similar by size and by all bits."""
        bits = sum((F.bit_count(F.col("a_fps")[k].bitwiseXOR(F.col("b_fps")[k])) for k in range(seeds)), F.lit(0))
        good = pairs.filter((5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n")) & (bits <= total) & (F.col("a_node") != F.col("b_node")))
        return good.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))

    side = lambda of, c, *more: of.select("seed", F.col("fp").alias(c), *(F.col(o).alias(f"{c}_{o}") for o in (*own, *more)))
    first = hubs.select("seed", F.col("a").alias("x"), F.explode(F.slice("hubs", 1, HUBS)).alias("y"))
    met_pairs = first.select("seed", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = written(met_pairs.join(side(lead_fp, "a", "many"), ["seed", "a"]).join(side(lead_fp, "b", "many"), ["seed", "b"]), "similar-proposed")
    # members of buckets, once for each fingerprint, and those with more hubs; of fingerprints that several sets share; and of two such that met
    crowd = met.filter("b is null").select("seed", F.col("a").alias("fp")).union(hubs.filter(F.size("hubs") > HUBS).select("seed", "a")).distinct()
    members = written(crowd.join(by_fp, ["seed", "fp"]), "similar-members")
    shared = by_fp.join(lead_fp.filter("many > 1").select("seed", "fp"), ["seed", "fp"]).withColumn("list", F.xxhash64("seed", "fp"))
    wide = pairs.filter("a_many > 1 or b_many > 1").select("seed", F.xxhash64(F.lit("wide"), "seed", "a", "b").alias("list"), F.explode(F.array("a", "b")).alias("fp")).join(by_fp, ["seed", "fp"])
    member = ["node", "n", "comp", *(F.col("fps")[k].alias(f"f{k}") for k in range(seeds))]

    def listed(rows: DataFrame, star: bool) -> DataFrame:
        return rows.repartition(parts, "list").sortWithinPartitions("list", "node").mapInArrow(_candidates(star, total, seeds, together), "a long, b long, dense boolean")

    # a group of near copies has many pairs a member: first each node with the smallest that it met, then what is still apart
    proposed = written(close(pairs).union(listed(shared.withColumn("comp", F.col("node")).select("list", *member), True).select("a", "b")).distinct(), "similar-candidates")
    met_nodes = proposed.select("a").union(proposed.select("b")).union(members.select("node")).union(shared.select("node")).union(wide.select("node")).distinct().select(F.col("a").alias("met"))
    texts = docs.select(F.col("row").alias("node"), "text").join(met_nodes.hint("merge"), F.col("node") == F.col("met"), "left_semi")
    sets = written(texts.mapInArrow(_sets(size), "node long, keys array<long>"), "similar-sets")
    links = _judged(proposed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
    groups = written(connected_components(links), "similar-groups")

    def still_apart(of: DataFrame, groups: DataFrame) -> DataFrame:
        comp = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp"))
        told = of.join(comp("a"), "a", "left").join(comp("b"), "b", "left")
        return told.filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b")

    links = links.union(_judged(still_apart(proposed, groups), sets))
    groups = written(connected_components(links), "similar-groups")
    # lists whose members are not all in one group are looked at in full, others passed over; what two shared fingerprints have is a list too
    grouped = lambda of: of.join(groups.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    told = grouped(members).select("seed", "fp", *member)
    again = told.mapInArrow(_lists_again, f"list long, node long, n long, comp long, {', '.join(f'f{k} long' for k in range(seeds))}")
    lists = again.union(grouped(shared.select("list", *own).union(wide.select("list", *own))).select("list", *member))
    more = written(listed(lists, False), "similar-more")
    some = more.filter("not dense").select("a", "b").distinct().join(proposed, ["a", "b"], "left_anti")
    links = links.union(_judged(some, sets)).union(_joined_in_blocks(more.filter("dense").select("a", "b"), grouped(sets.select("node")), sets, parts, block))
    groups = written(connected_components(links), "similar-groups")
    return copies.join(groups, "node", "left").select("row", F.coalesce("component", "node").alias("component"))


def measured_recall(docs: DataFrame, groups: DataFrame, *, size: int = 5, sample: int = 500) -> tuple[int, int]:
    """(pairs in one group, all pairs) of texts with a similarity of 0.8 or more: about ``sample`` texts against all, by their sets alone.

    ``docs`` (row, text) and ``groups`` (row, component) are written tables. The sample, a share of the rows by hash, is broadcast; equal sets are no pair.
    """
    spark = docs.sparkSession
    share = max(1, docs.count() // sample)
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("audit"), "row"), F.lit(share)) == 0).select("row", "text").collect()
    held = [(r.row, s) for r, s in zip(drawn, sets_of([r.text for r in drawn], size), strict=True) if len(s)]
    if not held:
        return 0, 0
    keys, owner = np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held)), [len(s) for _, s in held])
    order = np.argsort(keys, kind="stable")
    index = spark.sparkContext.broadcast((keys[order], owner[order], np.array([len(s) for _, s in held]), np.array([r for r, _ in held])))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owner, sizes, rows = index.value
        for b in batches:
            x, y = [], []
            for row, s in zip(b.column("row").to_pylist(), sets_of(b.column("text").to_pylist(), size), strict=True):
                lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
                n = hi - lo
                both = np.bincount(owner[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())], minlength=len(rows)) if n.any() else np.zeros(len(rows), np.int64)
                alike = (5 * both >= 4 * (sizes + len(s) - both)) & (both > 0) & ~((both == sizes) & (both == len(s)))
                x += rows[alike].tolist()
                y += [row] * int(alike.sum())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    pairs = docs.select("row", "text").mapInArrow(near, "a long, b long")
    side = lambda c: groups.select(F.col("row").alias(c), F.col("component").alias(f"{c}_group"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").agg(F.count_if(F.col("a_group") == F.col("b_group")), F.count(F.lit(1))).first()
    return found[0], found[1]
