"""Benchmark decontamination by an FM-index over each training shard.

A shard is a run of documents that one task holds at a time. Its words become the benchmark's word numbers; a word
that no benchmark item has, or a pair of neighbours that no item has, ends a run, for no phrase can lie across it.
Runs that could hold a phrase are joined to one text with its suffix array, the Burrows-Wheeler transform in a wavelet
tree, and the positions of every SAMPLE-th place. Phrases are found by backward search, all at once, and located by
walking back to the nearest sampled position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 13
#: Suffix positions kept: every eighth.
SAMPLE = 8
#: Words of a shard at most, unless one document has more.
SHARD_WORDS = 2_000_000
#: Characters of benchmark text that one pass takes (and sends to the executors); more text takes more passes.
PASS_CHARS = 16_000_000

#: A-Z to lower case, other bytes outside words to a space. Bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold_words(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WaveletTree:
    """Ranks over a sequence of numbers below 2**bits, stored as one bit vector for each level (most significant first)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, at = [], values
        for b in range(bits - 1, -1, -1):
            ones = (at >> b & 1).astype(np.int32)
            self.levels.append(np.concatenate(([0], np.cumsum(ones, dtype=np.int64))))
            at = np.concatenate((at[ones == 0], at[ones == 1]))  # a wavelet matrix: zeros first at every level
        self.bits = bits

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[k] occurs in the first i[k] places."""
        lo, hi = np.zeros_like(i), i
        for level, ones in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            zeros = len(ones) - 1 - ones[-1]
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for ones in self.levels:
            bit = ones[i + 1] - ones[i]
            zeros = len(ones) - 1 - ones[-1]
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
            out = out << 1 | bit
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes not yet told apart are sorted again."""
    n, k = len(text), 1
    order = np.argsort(text, kind="stable")
    rank = np.searchsorted(text[order], text)  # the place of its first suffix, so ranks of suffixes told apart stay
    while True:
        sorted_rank = rank[order]
        same = np.zeros(n + 1, bool)
        same[1:n] = sorted_rank[1:] == sorted_rank[:-1]
        open_ = np.flatnonzero(same[:-1] | same[1:])
        if not len(open_):
            return order
        at = order[open_]
        second = np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
        by = np.lexsort((second, rank[at]))
        at, first, second = at[by], rank[at][by], second[by]
        order[open_] = at
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int):
        """``text`` holds numbers from 1 to alphabet - 1; the end mark is 0."""
        text = np.concatenate((text, [0]))
        self.order = suffix_array(text)
        self.text_len = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.tree = WaveletTree(text[self.order - 1], max(1, int(alphabet - 1).bit_length()))
        self.sampled = np.where(self.order % SAMPLE == 0, self.order, -1)
        del self.order

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the suffixes that begin with each row of ``phrases``; the words are read from the last to the first."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_len, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = phrases[live, j]
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, rows = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        left = np.arange(len(rows))
        while len(left):
            known = self.sampled[rows[left]] >= 0
            done = left[known]
            out[done] = self.sampled[rows[done]] + steps[done]
            left = left[~known]
            c = self.tree.access(rows[left])
            rows[left] = self.first[c] + self.tree.rank(c, rows[left])
            steps[left] += 1
        return out


class Phrases:
    """Windows of benchmark items as rows of word numbers, by length, with the items that have them.

    A pass of the benchmark is held as arrays: 4 bytes for each word of each different window and 12 for each window of an
    item, besides the dictionary of different words.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 2) for w in fold_words(text)], np.int32)
            if len(ids):
                n = min(window, len(ids))
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), place[item]))
        self.alphabet = len(self.number) + 2
        self.by_length: dict[int, np.ndarray] = {}
        owners, first = [], 0
        for n in sorted(found):
            rows, which = np.unique(np.concatenate([r for r, _ in found[n]]), axis=0, return_inverse=True)
            item = np.repeat([i for _, i in found[n]], [len(r) for r, _ in found[n]])
            owners.append(np.unique(np.stack((which.ravel() + first, item)), axis=1))
            self.by_length[n] = rows
            first += len(rows)
        # the items of window k are owner[start[k] : start[k + 1]]
        window_of, self.owner = np.concatenate(owners, 1) if owners else np.empty((2, 0), np.int64)
        self.start = np.searchsorted(window_of, np.arange(first + 1))
        pairs = [rows[:, i].astype(np.int64) * self.alphabet + rows[:, i + 1] for rows in self.by_length.values() for i in range(rows.shape[1] - 1)]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.shortest = min(self.by_length, default=0)
        self.single = np.zeros(self.alphabet, bool)
        if 1 in self.by_length:
            self.single[self.by_length[1][:, 0]] = True

    def runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the stretches that could hold a phrase: neighbours are a pair of some phrase."""
        key = ids[:-1] * self.alphabet + ids[1:]
        linked = np.zeros(len(key), bool)
        both = np.flatnonzero((ids[:-1] > 1) & (ids[1:] > 1))
        if len(both) and len(self.pairs):
            k = key[both]
            linked[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, k), len(self.pairs) - 1)] == k
        edge = np.diff(np.concatenate(([0], linked.astype(np.int8), [0])))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        long = hi - lo >= max(2, self.shortest)
        lo, hi = lo[long], hi[long]
        if self.single.any():
            alone = np.flatnonzero(self.single[ids])
            inside = np.searchsorted(lo, alone, "right") - 1
            alone = alone[(inside < 0) | (alone >= hi[np.maximum(inside, 0)])] if len(lo) else alone
            lo, hi = np.concatenate((lo, alone)), np.concatenate((hi, alone + 1))
        return lo, hi

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in one shard: positions, lengths, and the number of the window."""
        lo, hi = self.runs(ids)
        none = np.empty(0, np.int64)
        if not len(lo):
            return none, none, none
        size = hi - lo + 1  # each run and an end mark after it
        start = np.cumsum(size) - size
        where = np.repeat(lo - start, size) + np.arange(size.sum())
        text = np.ones(size.sum(), np.int64)
        body = np.ones(len(text), bool)
        body[start + size - 1] = False
        text[body] = ids[where[body]]
        index = FMIndex(text, self.alphabet)
        at, length, which, first = [none], [none], [none], 0
        for n, rows in self.by_length.items():
            a, b = index.search(rows)
            count = b - a
            some = np.flatnonzero(count)
            c = count[some]
            every = np.repeat(a[some] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            at.append(where[index.locate(every)])
            length.append(np.full(len(every), n))
            which.append(np.repeat(some, c) + first)
            first += len(rows)
        return np.concatenate(at), np.concatenate(length), np.concatenate(which)


_SPAN = pa.struct([("from_word", pa.int32()), ("to_word", pa.int32())])


def _shard_rows(phrases: Phrases, docs: list[int | None], words: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in words], np.int64)
    # an end mark after each document keeps phrases from lying across two
    ids = np.concatenate([np.append(w, 1) for w in words])
    base = np.cumsum(sizes + 1) - (sizes + 1)
    at, length, which = phrases.hits(ids)
    spans, found = [[] for _ in docs], [set() for _ in docs]
    if len(at):
        by = np.argsort(at, kind="stable")
        at, length, which = at[by], length[by], which[by]
        doc = np.searchsorted(base, at, "right") - 1
        reach = np.maximum.accumulate(at + length)
        opens = np.concatenate(([True], (at[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(opens)
        ends = reach[np.concatenate((first[1:] - 1, [len(at) - 1]))]
        for f, e in zip(first, ends, strict=True):
            spans[doc[f]].append({"from_word": int(at[f] - base[doc[f]]), "to_word": int(e - base[doc[f]])})
        for d, w in {*zip(doc.tolist(), which.tolist(), strict=True)}:
            found[d].update(phrases.owner[phrases.start[w] : phrases.start[w + 1]].tolist())
    names = [[phrases.names[i] for i in sorted(x)] for x in found]
    cols = [pa.array(docs, pa.int64()), pa.array(sizes), pa.array(spans, pa.list_(_SPAN)), pa.array(names, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "spans", "items"])


def _find(shared, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        get = phrases.number.get
        docs, words, n = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text"), strict=True):
                split = fold_words(text.as_py())
                docs.append(doc)
                words.append(np.fromiter((get(w, 1) for w in split), np.int64, len(split)))
                if (n := n + len(split)) >= shard_words:
                    yield _shard_rows(phrases, docs, words)
                    docs, words, n = [], [], 0
        if docs:
            yield _shard_rows(phrases, docs, words)

    return run


SPANS = "array<struct<from_word:int,to_word:int>>"


def find_benchmark_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of ``docs`` (doc_id, text): merged word spans that occurrences of
    benchmark windows cover, and the item_ids with an occurring window, as sorted strings.

    Null or empty texts have no words and no spans; repeated documents count for themselves; a repeated item counts once, and one with a
    null id has an empty name. Other columns are left out. The benchmark goes to the executors in passes of at most
    ``pass_chars`` characters (or one item); with more than one pass, spans are merged by document and text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // pass_chars))
    schema = f"doc_id long, n_words long, spans {SPANS}, items array<string>"
    if passes == 1:
        held = spark.sparkContext.broadcast(Phrases([tuple(r) for r in items.collect()], window))
        return docs.select("doc_id", "text").mapInArrow(_find(held, shard_words), schema)
    # written, so that every pass and the last join see the same rows under the same number
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate-rows")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = None
    for p in range(passes):
        held = spark.sparkContext.broadcast(Phrases([tuple(r) for r in items.filter(part == p).collect()], window))
        one = keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_find(held, shard_words), schema)
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy(F.col("doc_id").alias("row")).agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = F.expr(
        f"""aggregate(all, cast(array() as {SPANS}), (m, s) -> if(size(m) > 0 and m[size(m) - 1].to_word >= s.from_word,
            concat(slice(m, 1, size(m) - 1), array(named_struct('from_word', m[size(m) - 1].from_word, 'to_word', greatest(m[size(m) - 1].to_word, s.to_word)))),
            concat(m, array(s))))"""
    )
    return merged.withColumn("spans", spans).drop("all").join(keyed.select("row", "doc_id"), "row").select("doc_id", "n_words", "spans", "items")


def op3_decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the number of its words that benchmark windows cover.

    Null, empty and word-free texts have no words, no hit and the digest of an empty list, and are not contaminated; ids of
    any size, null and repeated ones come back as they are, a row each. Items that share an id count as one. Without
    documents there is no row, without items nothing is contaminated. Other columns are left out.
    """
    found = find_benchmark_spans(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to_word"] - s["from_word"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
starts AS (
  SELECT doc_id, i, l.n, array_to_string(w[i : i + l.n - 1], ' ') AS words
  FROM places CROSS JOIN (SELECT DISTINCT n FROM windows) l WHERE i + l.n - 1 <= len(w)),
found AS (SELECT doc_id, i, n, item_id FROM starts JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS names FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
