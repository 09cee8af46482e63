"""Exact substring dedup by suffix trees over prefix-partitioned suffixes of words.

Suffixes are indexed at anchors: of every WINDOW words in a row, the GRAM-word stretch with the smallest hash. The same
words have the same anchor wherever they stand, so two equal windows meet at it. The windows that share an anchor
travel together as one run of words, and the anchor's words are the prefix by which runs are split into groups. Only a
prefix that occurs twice makes a group.

Of runs with the same words (told by a digest of the words themselves) the earliest goes on and all windows of the
others go. A prefix with at most GROUP such runs is a group that fits in memory: ``deep_nodes`` sorts its suffixes
and finds the lengths of their common prefixes, which together are the group's suffix tree. Its internal nodes at
least WINDOW words deep are the repeats; the earliest leaf below such a node stays, the words of the others go.

A prefix with more runs is made longer, from 5 to 13, 17, 19 and 20 words: of the windows around a prefix some hold
the next words after it and the others the words before it, so each run splits in two, with one longer prefix each, and
these are grouped anew. A prefix as long as the window is a deep node itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .textbytes import mixed, word_hashes

WINDOW, GRAM, GROUP = 20, 5, 1000
#: Words whose places fit into the low bits of an anchor's order.
_PLACES = 22


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(rows, their first word, bytes, (start, hash) of words) of several texts at a time; one byte lies between words."""
    rows, held, n = [], [], 0

    def out():
        whole = b"\n".join(held)
        start, h = word_hashes(np.frombuffer(whole, np.uint8))
        first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in held])[:-1])
        return np.array(rows), first, whole, start, h

    for i, text in enumerate(texts):
        text = text.as_py()
        if not text:
            continue
        rows.append(i)
        held.append(b" ".join(text.encode("utf-8", "surrogatepass").split()))
        n += len(held[-1]) + 1
        if n >= size:
            yield out()
            rows, held, n = [], [], 0
    if rows:
        yield out()


def anchors_of(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, anchor, key): the starts of all windows within a text, the place of each one's anchor, and the hash of the anchor's words.

    Long inputs are taken in overlapping parts, for a part's places must fit beside the order of the hashes.
    """
    n, part = len(h) - window + 1, 1 << _PLACES
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.ones(n, bool)
    for k in range(1, window):  # a window that reaches into the next text is none
        cut = first[first > 0] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    anchor = np.empty(n, np.int64)
    key = np.empty(n, np.uint64)
    span, step = window - gram + 1, part - window
    for a in range(0, n, step):
        b = min(n, a + step)
        x = h[a : b + window - 1]
        g = np.zeros(len(x) - gram + 1, np.uint64)
        for k in range(gram):
            g = g * np.uint64(0xD6E8FEB86659FD93) + x[k : k + len(g)]
        g = mixed(g)
        low = (g & ~np.uint64(part - 1)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width < span:
            more = min(width, span - width)
            low = np.minimum(low[: len(low) - more], low[more:])
            width += more
        at = (low & np.uint64(part - 1)).astype(np.int64)
        anchor[a:b], key[a:b] = at + a, g[at]
    starts = np.flatnonzero(inside)
    return starts, anchor[starts], key[starts]


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    """128 bits of each part's content, as two longs a row."""
    return np.frombuffer(b"".join([blake2b(p, digest_size=16).digest() for p in parts]), np.int64).reshape(-1, 2)


def _emit_anchors(window: int, gram: int):
    """Rows (key, r1, r2, doc, th, start): each anchor's prefix, the digest of its run's words, and the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, th = b.column("doc").to_numpy(), b.column("th").to_numpy()
            for rows, first, whole, start, h in _groups(b.column("text")):
                starts, anchor, key = anchors_of(h, first, window, gram)
                if not len(anchor):
                    continue
                opens = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                last = np.append(opens[1:], len(anchor)) - 1
                end = np.append(start[1:] - 1, len(whole))
                words = _digests(whole[p:q] for p, q in zip(start[starts[opens]].tolist(), end[starts[last] + window - 1].tolist(), strict=True))
                anchor, key = anchor[opens], key[opens]
                of = np.searchsorted(first, anchor, "right") - 1
                cols = [pa.array(key.view(np.int64)), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(doc[rows[of]]), pa.array(th[rows[of]]), pa.array(anchor - first[of], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "r1", "r2", "doc", "th", "start"])

    return run


#: What becomes of a run: it is a leaf of its group's tree, its prefix is made longer, or all of its windows go.
SORTED, DEEP, GONE = 1, 2, 3
#: A run's prefix, its first window, how many windows it has, the word at which the prefix begins, and its words.
_RUNS = "kind int, key long, doc long, th long, start int, n int, pre int, words binary"


def _emit_runs(window: int, gram: int):
    """Rows (doc, th, text, anchors): for each anchor its run of windows with their words; if GONE, the stretch of windows alone."""
    names = [f.split()[0] for f in _RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, th = b.column("doc").to_numpy(), b.column("th").to_numpy()
            lists = b.column("anchors")
            cut, at, kind = lists.offsets.to_numpy(), lists.flatten().field("at").to_numpy(), lists.flatten().field("kind").to_numpy()
            cut = cut - cut[0]
            for rows, first, whole, start, h in _groups(b.column("text")):
                starts, anchor, key = anchors_of(h, first, window, gram)
                mark = np.zeros(len(h) + 1, np.int8)
                for r, f in zip(rows.tolist(), first.tolist(), strict=True):
                    own = slice(cut[r], cut[r + 1])
                    mark[f + at[own]] = kind[own]
                what = mark[anchor]
                some = np.flatnonzero(what)
                if not len(some):
                    continue
                of = np.searchsorted(first, starts, "right") - 1
                # runs that go are one stretch as long as windows follow each other
                what, place, group = what[some], starts[some], np.where(what[some] == GONE, -1, anchor[some])
                new = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (np.diff(group) != 0) | (np.diff(of[some]) != 0))))
                n, lo = np.diff(np.append(new, len(some))), some[new]
                what, r, end = what[new], rows[of[lo]], np.append(start[1:] - 1, len(whole))
                stays = what != GONE
                words = [whole[p:q] if s else None for s, p, q in zip(stays.tolist(), start[starts[lo]].tolist(), end[starts[lo] + n + window - 2].tolist(), strict=True)]
                place = pa.array(starts[lo] - first[of[lo]], pa.int32())
                cols = [pa.array(what, pa.int32()), pa.array(key[lo].view(np.int64)), pa.array(doc[r]), pa.array(th[r]), place, pa.array(n, pa.int32()), pa.array(anchor[lo] - starts[lo], pa.int32()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


_LONGER = "key long, r1 long, r2 long, doc long, th long, start int, n int, pre int, words binary"


def _lengthen(window: int, old: int, new: int):
    """Runs around a prefix of ``old`` words as runs around one of ``new`` words: windows that hold the words after it, and those that hold the words before it."""
    names = [f.split()[0] for f in _LONGER.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, th, start, n, pre, text in zip(*(b.column(c).to_pylist() for c in ("doc", "th", "start", "n", "pre", "words")), strict=True):
                words, cut = text.split(b" "), min(n, max(0, pre - window + new))
                for lo, hi, at in ((0, cut, pre - (window + 1 - new)), (cut, n, pre)):
                    if lo < hi:
                        own = words[lo : hi + window - 1]
                        key, part = b" ".join(words[at : at + new]), b" ".join(own)
                        rows.append((key, doc, th, start + lo, hi - lo, at - lo, part))
            if rows:
                key, doc, th, start, n, pre, part = zip(*rows, strict=True)
                told, prefix = _digests(part), _digests(key)[:, 0]
                cols = [prefix, told[:, 0], told[:, 1], doc, th, start, n, pre, part]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def deep_nodes(n: np.ndarray, words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, offset, node) of the windows below internal nodes of at least ``window`` words in the suffix tree of these runs.

    The tree is the sorted suffixes with the lengths of common prefixes of neighbours. Suffixes are ranked by 1, 2, 4, ...
    words until the longest run is covered; the same ranks, from the longest down, give the common prefixes.
    """
    lists = pc.split_pattern(words, b" ")
    size = np.diff(lists.offsets.to_numpy())
    # an end mark, below all words, after each run
    ids = np.zeros(size.sum() + len(size), np.int64)
    base = np.cumsum(size + 1) - (size + 1)
    body = np.ones(len(ids), bool)
    body[base + size] = False
    ids[body] = lists.flatten().dictionary_encode().indices.to_numpy() + 1
    ranks, depth = [ids], 1
    while depth < size.max():
        second = np.zeros(len(ids), np.int64)
        second[: len(ids) - depth] = ranks[-1][depth:]
        ranks.append(np.unique(ranks[-1] * (int(second.max()) + 1) + second, return_inverse=True)[1])
        depth *= 2
    run = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = base[run] + offset
    order = np.argsort(ranks[-1][place], kind="stable")
    a, b = place[order][:-1], place[order][1:]
    rest = (size[run] - offset)[order]
    common, most = np.zeros(len(a), np.int64), np.minimum(rest[:-1], rest[1:])
    for k in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(a + common, len(ids) - 1), np.minimum(b + common, len(ids) - 1)
        common += (ranks[k][x] == ranks[k][y]).astype(np.int64) << k
    deep = np.minimum(common, most) >= window
    below = np.concatenate((deep, [False])) | np.concatenate(([False], deep))
    node = np.cumsum(np.concatenate(([True], ~deep)))
    return run[order][below], offset[order][below], node[below]


def later_leaves(doc: np.ndarray, start: np.ndarray, n: np.ndarray, words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of the windows that are not the earliest leaf below their deep node."""
    run, offset, node = deep_nodes(n, words, window)
    if not len(run):
        return run, offset
    at = start[run] + offset
    order = np.lexsort((at, doc[run], node))
    opens = np.concatenate(([True], np.diff(node[order]) != 0))
    head = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    later = order[(doc[run][order] != doc[run][head]) | (at[order] != at[head])]
    later = later[np.lexsort((offset[later], run[later]))]
    return run[later], offset[later]


def _subtrees(window: int, windows_at_once: int = 400_000):
    """Rows sorted by key; whole groups are taken together until they hold ``windows_at_once`` windows."""

    def found(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        doc, th, start, n = (t.column(c).to_numpy() for c in ("doc", "th", "start", "n"))
        run, offset = later_leaves(doc, start.astype(np.int64), n.astype(np.int64), t.column("words").chunk(0), window)
        # windows in a row make one span
        new = np.flatnonzero(np.concatenate(([True], (np.diff(run) != 0) | (np.diff(offset) != 1)))) if len(run) else np.empty(0, np.int64)
        last = np.append(new[1:], len(run)) - 1
        r = run[new]
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(th[r]), pa.array(start[r] + offset[new], pa.int32()), pa.array(start[r] + offset[last[: len(new)]] + window, pa.int32())], ["doc", "th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += int(batch.column("n").to_numpy().sum())
            if n < windows_at_once:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield found(t.slice(0, cut))
                left = t.slice(cut).combine_chunks()
                held, n = left.to_batches(), int(left.column("n").to_numpy().sum())
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, total, gone = [], [], []
        for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            drop = np.zeros(len(words) + 1, np.int64)
            for s in spans.as_py() or []:
                drop[s["a"]] += 1
                drop[s["b"]] -= 1
            stay = np.cumsum(drop)[:-1] == 0
            kept.append(b" ".join(words) if stay.all() else b" ".join(w for w, k in zip(words, stay.tolist(), strict=True) if k))
            total.append(len(words))
            gone.append(len(words) - int(stay.sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def _judged(runs: DataFrame, group: int, whole: bool = False) -> DataFrame:
    """``runs`` (key, r1, r2, doc, start, ...) with ``kind``: GONE if the same words come earlier; else null if its prefix has no other run, SORTED if it has few, DEEP if many. If ``whole``, prefixes are windows and nothing is left to find among different runs."""
    heads = runs.groupBy("key", "r1", "r2").agg(F.min(F.struct("doc", "start")).alias("head"))
    if whole:
        kinds = heads.withColumn("kind", F.lit(None).cast("int"))
    else:
        heads = written(heads, "heads")
        groups = heads.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", F.when(F.col("many") > group, DEEP).otherwise(SORTED).alias("kind"))
        kinds = heads.join(groups.hint("merge"), "key", "left")
    first = (F.col("doc") == F.col("head.doc")) & (F.col("start") == F.col("head.start"))
    return runs.join(kinds.hint("merge"), ["key", "r1", "r2"]).withColumn("kind", F.when(first, F.col("kind")).otherwise(GONE)).drop("head").filter("kind is not null")


def repeated_spans(texts: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc, th, a, b): word spans [a, b) of ``texts`` (doc, th, text) covered by windows that also start earlier."""
    anchors = written(texts.mapInArrow(_emit_anchors(window, gram), "key long, r1 long, r2 long, doc long, th long, start int"), "anchors")
    # written, so that the join below reads both sides from a shuffle and a frequent anchor's rows can be split
    many = written(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "many")
    again = written(anchors.join(many.hint("merge"), "key"), "again")
    marked = _judged(again, group).groupBy("doc", "th").agg(F.collect_set(F.struct(F.col("start").alias("at"), "kind")).alias("anchors"))
    # rows repeated as they are need their runs once
    once = texts.dropDuplicates(["doc", "th"])
    runs = written(once.join(marked.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "anchors").mapInArrow(_emit_runs(window, gram), _RUNS), "runs")

    def spans(of: DataFrame) -> DataFrame:
        leaves = of.filter(F.col("kind") == SORTED).select("key", "doc", "th", "start", "n", "words").repartition("key").sortWithinPartitions("key")
        gone = of.filter(F.col("kind") == GONE).select("doc", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") + (window - 1)).alias("b"))
        return leaves.mapInArrow(_subtrees(window), "doc long, th long, a int, b int").union(gone)

    out, prefix = spans(runs), gram
    while prefix < window and not runs.filter(F.col("kind") == DEEP).isEmpty():
        longer = (prefix + window + 1) // 2
        deep = runs.filter(F.col("kind") == DEEP).select("doc", "th", "start", "n", "pre", "words")
        split = written(deep.mapInArrow(_lengthen(window, prefix, longer), _LONGER), "longer")
        runs, prefix = written(_judged(split, group, longer == window), "runs"), longer
        out = out.union(spans(runs))
    return out


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row of ``docs`` (doc_id, text; other columns are left out); ``text`` is what is kept, joined by single spaces.

    Windows are compared on the input; an earlier one is in a document with a smaller doc_id, or earlier in the same
    document. A null doc_id comes after all others. Rows with one doc_id count as one document each time: of equal windows
    at the same place of such rows none is earlier. Null and empty texts have no words; texts below ``window`` words lose
    none.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(keyed.select("doc", "th", "text"), window=window, gram=gram, group=group)
    gathered = spans.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(gathered.hint("merge"), ["doc", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_words, "doc_id long, n_words long, n_removed long, text string")


def op8_substrings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the words it has, those that go, and the digest of what is kept, see ``dedup_substrings``.

    A null text has no words and the digest of an empty one. Without documents there is no row.
    """
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_substrings(spark, table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS h FROM places),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
