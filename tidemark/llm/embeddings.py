"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from sorted random projections and is refined by joins of neighbours of neighbours; links are
the graph's edges at the threshold. A list that is full of links is saturated: it is enlarged to its whole component,
which is compared in blocks. Recall is audited against brute force for a bounded set of query vectors.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

LOG = logging.getLogger(__name__)
EDGE = "u long, v long, sim double"


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision with length one; scaled first, so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Columns and the places where a new group starts, for as many whole groups as a few batches hold. Rows come sorted by the first ``keys`` columns."""
    left = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        now = now.combine_chunks()
        cols = [now.column(i).to_numpy() for i in range(keys)]
        new = np.flatnonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])) + 1
        if not len(new):
            left = now
            continue
        whole, left = now.slice(0, new[-1]).combine_chunks(), now.slice(new[-1])
        yield [c.chunk(0) for c in whole.columns], np.concatenate(([0], new))
    if left is not None and len(left):
        left = left.combine_chunks()
        yield [c.chunk(0) for c in left.columns], np.array([0, len(left)])


def _edges(u: list, v: list, sim: list) -> pa.RecordBatch:
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(join(u, np.int64)), pa.array(join(v, np.int64)), pa.array(join(sim, np.float64))], ["u", "v", "sim"])


def _project(tables: int, seed: int):
    """(t, grp, code, proj) places of each vector: the signs of its first ``bits`` random projections, then one more projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, bits = b.column("dim").to_numpy(), b.column("bits").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows = b.take(pa.array(at))
                x = _unit(_vectors(rows.column("vec"), int(dim)))
                for t in range(tables):
                    p = x @ np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), 21))
                    code = ((p[:, :20] > 0) @ (1 << np.arange(20))) & ((1 << bits[at]) - 1)
                    cols = [pa.array(np.full(len(at), t)), rows.column("grp"), pa.array(code), pa.array(p[:, 20]), rows.column("node"), rows.column("dim"), rows.column("vec")]
                    yield pa.RecordBatch.from_arrays(cols, ["t", "grp", "code", "proj", "node", "dim", "vec"])

    return run


def _along(reach: int):
    """Each vector with its next ``reach`` in sorted order, if they are of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            now = now.combine_chunks()
            t, grp, node, dims = (now.column(c).to_numpy() for c in ("t", "grp", "node", "dim"))
            flat = now.column("vec").chunk(0)
            u, v, sim = [], [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _unit(_vectors(flat.take(pa.array(at)), int(dim)))
                for d in range(1, reach + 1):
                    ok = (t[at[d:]] == t[at[:-d]]) & (grp[at[d:]] == grp[at[:-d]])
                    i = np.flatnonzero(ok)
                    s = np.einsum("ij,ij->i", x[i], x[i + d])
                    u += [node[at[i]], node[at[i + d]]]
                    v += [node[at[i + d]], node[at[i]]]
                    sim += [s, s]
            left = now.slice(max(0, len(now) - reach))
            yield _edges(u, v, sim)

    return run


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, u, least, dim, vec) sorted by w: the neighbours of w compared with each other; a pair is kept if it betters either's list."""
    for (_, node, least, dims, vec), cut in _groups(batches, 1):
        node, least, dims = node.to_numpy(), least.to_numpy(), dims.to_numpy()
        u, v, sim = [], [], []
        starts = np.concatenate(([0], np.cumsum(dims)))
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            x = _unit(flat[starts[a] : starts[b]].reshape(b - a, -1))
            s = x @ x.T
            better = np.triu(s > np.minimum(least[a:b, None], least[None, a:b]), 1)
            i, j = np.nonzero(better)
            if len(i):
                u += [node[a + i], node[a + j]]
                v += [node[a + j], node[a + i]]
                sim += [s[i, j], s[i, j]]
        yield _edges(u, v, sim)


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors link. A product of matrices may differ from ``_cosine`` in the last bits, so what is that near the threshold is judged by the latter, as links are."""
    s = x @ y.T
    close = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
    close[i, j] = _cosine(x[i], y[j]) >= threshold
    return close


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the unit vectors of each row."""
    return (x * y).sum(1)


def _block_counts(threshold: float):
    """Rows (comp, x, y, mine, node, weight, dim, vec) sorted by (comp, x, y): for each vector of a pair of blocks, the vectors of the other that it links to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y, mine, node, weight, dims, vec), cut in _groups(batches, 3):
            x, y, mine, node, weight, dims = (c.to_numpy() for c in (x, y, mine, node, weight, dims))
            starts, out = np.concatenate(([0], np.cumsum(dims))), []
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows = _unit(flat[starts[a] : starts[b]].reshape(b - a, -1))
                p, q = (np.flatnonzero(mine[a:b] == k) for k in (x[a], y[a]))
                close = _linked(rows[p], rows[q], threshold)
                out.append((node[a + p], close @ weight[a + q] - (weight[a + p] if x[a] == y[a] else 0), close.sum(1) - (x[a] == y[a])))
                if x[a] != y[a]:
                    out.append((node[a + q], close.T @ weight[a + p], close.sum(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["node", "n", "nodes"])

    return run


def _brute(queries, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp, node, dims = (b.column(c).to_numpy() for c in ("grp", "node", "dim"))
            out = []
            for g, (q_node, q) in queries.value.items():
                at = np.flatnonzero(grp == g)
                if len(at):
                    x = _unit(_vectors(b.column("vec").take(pa.array(at)), q.shape[1]))
                    close = _linked(q, x, threshold) & (q_node[:, None] != node[at])
                    out.append((q_node, close.sum(1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], ["node", "want"])

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each u, with rank and whether they are new."""
    merged = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    by = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return merged.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def descend(nodes: DataFrame, threshold: float, *, k: int, tables: int, rounds: int, settled: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(lists, links): the final neighbour lists and all edges at the threshold that were met on the way."""
    n_by_group = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sized = nodes.join(n_by_group, "grp").withColumn("bits", F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / 32)))).cast("long"))
    at = sized.select("node", "grp", "dim", "bits", "vec").mapInArrow(_project(tables, seed), f"t long, grp long, code long, proj double, node long, dim long, vec {dict(nodes.dtypes)['vec']}")
    # by ranges of the projection too, so that a bucket of many near copies is cut as well
    order = ["t", "grp", "code", "proj"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = at.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_along(3), EDGE)
    first = written(near.groupBy("u", "v").agg(F.max("sim").alias("sim")), "nn-start")
    links = [first.filter(F.col("sim") >= threshold - 1e-9).select("u", "v")]
    lists = written(_best(first.withColumn("new", F.lit(1)), k), "nn-lists")
    many = lists.count()
    for _ in range(rounds):
        least = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("least"))
        into = lists.withColumn("back", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).filter(F.col("back") <= k)
        around = lists.select(F.col("u").alias("w"), F.col("v").alias("u")).union(into.select(F.col("v").alias("w"), "u")).distinct()
        carried = nodes.select(F.col("node").alias("u"), "dim", "vec").join(least, "u")
        joined = around.join(carried, "u").select("w", "u", "least", "dim", "vec").repartition("w").sortWithinPartitions("w").mapInArrow(_local_join, EDGE)
        met = written(joined.groupBy("u", "v").agg(F.max("sim").alias("sim")), "nn-met")
        links.append(met.filter(F.col("sim") >= threshold - 1e-9).select("u", "v"))
        lists = written(_best(lists.select("u", "v", "sim", F.lit(0).alias("new")).union(met.withColumn("new", F.lit(1))), k), "nn-lists")
        if (lists.agg(F.sum("new")).first()[0] or 0) <= settled * many:
            break
    return lists, reduce(DataFrame.union, links)


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.98, k: int = 8, tables: int = 8, rounds: int = 4, settled: float = 0.02, block: int = 4096, audit: int = 512, least_links: int = 1000, audits: int = 32, attempts: int = 5, least_recall: float = 0.95, seed: int = 3) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label), recall audited).

    Only vectors with equal, non-null labels and equal dimensions are compared. A vector that is null, empty, zero, or
    holds a null or non-finite component links with nothing; repeated rows and equal vectors are one node of the graph
    and count as links of each other; a null vec_id never names a component unless it is alone. Other columns are left
    out.

    Query vectors, in the order of a hash, are compared with all vectors of their label, ``audit`` at a time, until they
    have ``least_links`` links or all vectors are drawn. After ``audits`` such blocks it is logged that fewer were found,
    as a table almost without links would else be compared in full. If less than ``least_recall`` of these links are in
    the result, the descent is repeated with twice the lists and tables; a RuntimeError after ``attempts`` of them.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("vec"), "label")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) | ~F.exists("vec", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)) & (F.size("vec") > 0)
    grouped = rows.filter(usable).groupBy("label", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
    dim = F.size("vec").cast("long")
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "label", dim.alias("dim"), F.xxhash64("label", dim).alias("grp"), "vec", "weight", "low"), "nn-nodes")
    small = nodes.select("node", "weight")

    want: dict[int, int] = {}
    many, drawn = nodes.count(), 0
    while drawn < min(many, audit * audits) and sum(want.values()) < least_links:
        q = nodes.orderBy(F.xxhash64("node"), "node").offset(drawn).limit(audit).select("node", "grp", "vec").collect()
        by_group: dict[int, list] = {}
        for r in q:
            by_group.setdefault(r.grp, []).append((r.node, r.vec))
        held = spark.sparkContext.broadcast({g: (np.array([n for n, _ in x], np.int64), _unit(np.array([v for _, v in x], np.float64))) for g, x in by_group.items()})
        one = nodes.select("grp", "node", "dim", "vec").mapInArrow(_brute(held, threshold), "node long, want long").groupBy("node").agg(F.sum("want").alias("want"))
        want |= {r.node: r.want for r in one.collect() if r.want}
        drawn += len(q)
    if drawn < many and sum(want.values()) < least_links:
        LOG.warning("audit of vectors: only %d links at %d of %d vectors", sum(want.values()), drawn, many)

    for attempt in range(attempts):
        size = k << attempt
        lists, found = descend(nodes, threshold, k=size, tables=tables << attempt, rounds=rounds, settled=settled, seed=seed + attempt)
        # the graph's sims may differ in the last bits between its steps: judge each link once, by one formula
        pairs = found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        v = nodes.select("node", "vec")
        cos = pairs.join(v.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a").join(v.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b").mapInArrow(_judge(threshold), "a long, b long")
        links = written(cos, "nn-links")
        comps = written(connected_components(links), "nn-components")
        full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).filter((F.col("n") >= size) & (F.col("least") >= threshold - 1e-9))
        wide = comps.join(full.select(F.col("u").alias("node")), "node", "left_semi").select("component").distinct()
        members = comps.join(wide, "component", "left_semi")
        # each vector is copied once for each block of its component: few blocks, but enough of them for several tasks
        size_ = F.count(F.lit(1))
        blocks = members.groupBy("component").agg(F.greatest(F.ceil(size_ / block), F.least(F.lit(8), F.ceil(size_ / 256))).alias("blocks"))
        placed = members.join(blocks, "component").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks")).join(nodes, "node")
        copied = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
            F.col("component").alias("comp"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "weight", "dim", "vec"
        )
        dense = copied.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y").mapInArrow(_block_counts(threshold), "node long, n long, nodes long")
        both = links.union(links.select(F.col("b"), F.col("a")))
        sparse = both.join(members.select(F.col("node").alias("a")), "a", "left_anti").join(small.withColumnRenamed("node", "b"), "b")
        counts = dense.union(sparse.select("a", "weight", F.lit(1).cast("long"))).groupBy("node").agg(F.sum("n").alias("n"), F.sum("nodes").alias("nodes"))
        counts = written(counts, "nn-counts")
        got = {r.node: r.nodes for r in counts.filter(F.col("node").isin(list(want))).select("node", "nodes").collect()} if want else {}
        recall = sum(min(got.get(n, 0), w) for n, w in want.items()) / sum(want.values()) if want else 1.0
        LOG.info("audit of vectors: recall %.4f of %d links at %d of %d vectors, lists of %d", recall, sum(want.values()), drawn, many, size)
        if recall >= least_recall:
            break
    else:
        raise RuntimeError(f"{recall:.4f} of {sum(want.values())} audited links found after {attempts} attempts, {least_recall} wanted")

    low = nodes.join(comps, "node", "left").select("node", "low", "weight", F.coalesce("component", "node").alias("component"))
    lowest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    told = nodes.select("node", "label", "vec").join(low.select("node", "weight", "component"), "node").join(lowest, "component").join(counts, "node", "left")
    told = told.select("label", "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    ok = rows.filter(usable).join(told, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ok.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())), recall


def _judge(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            dims = np.diff(x.offsets.to_numpy())
            keep = []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                s = _cosine(_unit(_vectors(x.take(pa.array(at)), int(dim))), _unit(_vectors(y.take(pa.array(at)), int(dim))))
                keep.append(at[s >= threshold])
            keep = pa.array(np.concatenate(keep) if keep else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    return run


def op10_embeddings(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Links and group of every row of ``vectors`` (vec_id, embedding, label), see ``near_duplicate_vectors``.

    A vector that is null, empty or zero, or holds a null or non-finite component, and one without a label, links with nothing
    and is kept. Repeated rows link with each other; a null id names a group only if it has no other. Without vectors there is
    no row. Other columns are left out.
    """
    return near_duplicate_vectors(vectors)[0]
