"""Ranked lexical search: the best documents for each query, term at a time over short lists and document at a time over long ones.

Documents stand in shards of bounded size, each a row with the posting lists of the query terms it holds: places of
documents in ascending order of id, and frequencies. In a shard a query's short lists are summed at once, term at a time,
into accumulators. These are then one list more, with bounds of its own, beside the long lists, which are read document at
a time in blocks: every list states the most that it adds within a block, and blocks that cannot come into the best k,
by these bounds, are passed over. So do documents whose sum so far and what the lists left can add falls short.
The best of each shard meet in two steps.

Scores are integers: a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document of n terms has
m = 25 + (75 n N) div L, and a term that it holds tf times adds weight * ((10**9 tf) div (1000 tf + 8 m)).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .decontaminate import fold_words

#: Terms of a shard at most, unless one document has more.
SHARD_TERMS = 2_000_000
#: Characters of query texts that one pass takes (and sends to the executors); more take more passes.
PASS_CHARS = 4_000_000
#: Entries that a query's short lists have together, at most.
SHORT = 1024
#: Documents of a block, and blocks that are read together.
BLOCK, STRIDE = 64, 16
#: Groups of shards whose best documents meet first.
SALTS = 64

POSTINGS = "doc_ids array<{id}>, sizes array<long>, terms array<int>, ends array<int>, docs array<int>, tfs array<int>, n_docs long, n_terms long"


def _index(vocabulary, shard_terms: int):
    """Rows (doc_id, text): one row for each shard. Lists of ``terms`` lie end to end in ``docs`` and ``tfs``."""

    def shard(held: list[tuple[object, int, dict[int, int]]], kind: pa.DataType, other: tuple[int, int]) -> pa.RecordBatch:
        held.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
        term = np.fromiter((t for _, _, c in held for t in c), np.int32)
        tf = np.fromiter((n for _, _, c in held for n in c.values()), np.int32)
        doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(c) for _, _, c in held])
        order = np.argsort(term, kind="stable")
        terms, n = np.unique(term, return_counts=True)
        arrays = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (terms, np.cumsum(n), doc[order], tf[order])]
        sizes = [n for _, n, _ in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([[i for i, _, _ in held]], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), *arrays, pa.array([other[0]], pa.int64()), pa.array([other[1]], pa.int64())],
            ["doc_ids", "sizes", "terms", "ends", "docs", "tfs", "n_docs", "n_terms"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        held, size, n_docs, n_terms, kind = [], 0, 0, 0, None
        for b in batches:
            kind = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                words = fold_words(text.as_py())
                if not words:
                    continue
                if held and size + len(words) > shard_terms:
                    yield shard(held, kind, (n_docs, n_terms))
                    held, size, n_docs, n_terms = [], 0, 0, 0
                size, n_docs, n_terms = size + len(words), n_docs + 1, n_terms + len(words)
                found = {known[w]: n for w, n in Counter(words).items() if w in known}
                if found:  # others count for N and L alone
                    held.append((doc_id.as_py(), len(words), found))
        if n_docs:
            yield shard(held, kind, (n_docs, n_terms))

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for terms, ends in zip(b.column("terms"), b.column("ends"), strict=True):
            ends = ends.values.to_numpy()
            yield pa.RecordBatch.from_arrays([terms.values, pa.array(np.diff(ends, prepend=0), pa.int64())], ["term", "df"])


class Postings:
    """The lists of a shard, with what an occurrence adds before it is weighed."""

    def __init__(self, row: dict, n: int, total: int):
        sizes, ends = row["sizes"].values.to_numpy(), row["ends"].values.to_numpy()
        self.doc_ids, self.n_docs, self.blocks = row["doc_ids"].values, len(sizes), -(-len(sizes) // BLOCK)
        self.docs, tf = row["docs"].values.to_numpy(), row["tfs"].values.to_numpy().astype(np.int64)
        m = 100 - 75 + 75 * sizes * n // total
        self.adds = 10**9 * tf // (1000 * tf + 8 * m[self.docs])
        terms = row["terms"].values.to_numpy().tolist()
        self.at = dict(zip(terms, zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True), strict=True))
        self._most: dict[int, np.ndarray] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.at[term]
        return self.docs[lo:hi], self.adds[lo:hi]

    def most(self, term: int) -> np.ndarray:
        """The most that the term adds in each block."""
        if term not in self._most:
            docs, adds = self.of(term)
            self._most[term] = _most(docs, adds, self.blocks)
        return self._most[term]


def _most(docs: np.ndarray, values: np.ndarray, blocks: int) -> np.ndarray:
    out = np.zeros(blocks, np.int64)
    np.maximum.at(out, docs // BLOCK, values)
    return out


def accumulated(postings: Postings, short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(docs, sums) over the short lists (term, weight), term at a time."""
    lists = [(d, a * w) for t, w in short for d, a in [postings.of(t)]]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, at = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, at, np.concatenate([a for _, a in lists]))
    return docs, sums


def best_of(postings: Postings, query: list[tuple[int, int]], k: int, *, short: int = SHORT, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(docs, scores) of the ``k`` best documents of a shard, equal scores in order of place; those with score 0 are none.

    ``query`` has each term of the shard once, with its weight times its occurrences. ``seen`` takes the blocks read.
    """
    by_length = sorted((postings.at[t][1] - postings.at[t][0], t, w) for t, w in query if w > 0 and t in postings.at)
    held = list(np.cumsum([n for n, _, _ in by_length]))
    cut = int(np.searchsorted(held, short, side="right"))
    acc_docs, acc_sums = accumulated(postings, [(t, w) for _, t, w in by_length[:cut]])
    # from here on the accumulators are one list among the long ones
    lists = [(acc_docs, acc_sums, 1, _most(acc_docs, acc_sums, postings.blocks))] if len(acc_docs) else []
    lists += [(*postings.of(t), w, postings.most(t)) for _, t, w in by_length[cut:]]
    lists.sort(key=lambda x: -int(x[3].max()) * x[2])
    bound = sum((w * most for *_, w, most in lists), np.zeros(postings.blocks, np.int64))
    left = np.cumsum([0, *(int(most.max()) * w for *_, w, most in lists[:0:-1])])[::-1].tolist() if lists else []
    # sums so far only grow, so the k-th of them is a bound before any long list is read
    least = int(np.partition(acc_sums, -k)[-k]) if len(acc_sums) >= k else 1
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for first in range(0, postings.blocks, STRIDE):
        worth = np.flatnonzero(bound[first : first + STRIDE] >= least)
        if not len(worth):
            continue
        lo, hi = (first + int(worth[0])) * BLOCK, min((first + int(worth[-1]) + 1) * BLOCK, postings.n_docs)
        if seen is not None:
            seen += range(lo // BLOCK, -(-hi // BLOCK))
        sums = np.zeros(hi - lo, np.int64)
        for (d, a, w, _), rest in zip(lists, left, strict=True):
            i, j = np.searchsorted(d, (lo, hi))
            sums[d[i:j] - lo] += a[i:j] * w
            if rest < least and int(sums.max()) + rest < least:
                break  # what has been skipped adds too little to all of them
        else:
            good = np.flatnonzero(sums >= least)
            if len(good):
                docs, scores = np.concatenate((docs, good + lo)), np.concatenate((scores, sums[good]))
                top = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[top], scores[top]
                if len(scores) == k:
                    # later documents must be better: equal ones come after
                    least = max(least, int(scores[-1]) + 1)
    return docs, scores


def _search(queries, k: int, n: int, total: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if not len(b.column("terms")[i].values):
                    continue
                postings = Postings({c: b.column(c)[i] for c in ("doc_ids", "sizes", "terms", "ends", "docs", "tfs")}, n, total)
                number, docs, scores = [], [], []
                for q, query in enumerate(queries.value):
                    d, s = best_of(postings, query, k, short=short)
                    number.append(np.full(len(d), q, np.int64))
                    docs.append(d)
                    scores.append(s)
                place = pa.array(np.concatenate(docs))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number)), postings.doc_ids.take(place), pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

    return run


def _pass(docs: DataFrame, queries: list[tuple[object, bytes, int]], k: int, shard_terms: int, short: int, salts: int) -> DataFrame:
    """(query, rank, doc_id, score) for queries (id, text, copies), ``query`` being their place in the list."""
    spark = docs.sparkSession
    numbers = count()
    words = [Counter(fold_words(text)) for _, text, _ in queries]
    vocabulary: dict[bytes, int] = {}
    for c in words:
        for w in c:
            if w not in vocabulary:
                vocabulary[w] = next(numbers)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    index = written(docs.select("doc_id", "text").mapInArrow(_index(spark.sparkContext.broadcast(vocabulary), shard_terms), POSTINGS.format(id=id_type)), "ranked-index")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # one row for each term of the pass
    df = dict(index.select("terms", "ends").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect())
    weight = {t: floor(1000 * log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    weighed = spark.sparkContext.broadcast([[(t, weight[t] * r) for w, r in c.items() if (t := vocabulary[w]) in weight] for c in words])
    found = index.select("doc_ids", "sizes", "terms", "ends", "docs", "tfs").mapInArrow(_search(weighed, k, n, max(total, 1), short), f"query long, doc_id {id_type}, score long")
    # a query's best of all shards meet in two steps, k for each group of shards in the second
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    salted = found.withColumn("salt", F.spark_partition_id() % salts)
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = 10, shard_terms: int = SHARD_TERMS, short: int = SHORT, pass_chars: int = PASS_CHARS, salts: int = SALTS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``queries`` (item_id, text).

    Terms are runs of ASCII letters and digits and of other characters than ASCII, with A-Z lower-cased. Equal scores rank by
    ascending doc_id, a null id last; rows with one id rank one by one. Null texts have no terms; documents without terms count
    nowhere, queries without known terms have no rows. Queries that share an id are searched one by one, repeated ones once
    for all their copies. Other columns are left out. Queries go to the executors in passes of about ``pass_chars`` characters.
    """
    spark = docs.sparkSession
    items = queries.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // pass_chars))
    kind = queries.schema["item_id"].dataType.simpleString()
    found = None
    for p in range(passes):
        held = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()]
        ids = spark.createDataFrame([(q, i, c) for q, (i, _, c) in enumerate(held)], f"query long, item_id {kind}, copies long")
        one = _pass(docs, held, k, shard_terms, short, salts).join(F.broadcast(ids), "query")
        one = one.select("item_id", "rank", "doc_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
        found = one if found is None else found.unionByName(one)
    return found


def op13_ranked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every benchmark item's ten best documents, as ``ranked_search`` states it; without documents or items there is no row."""
    return ranked_search(docs, benchmark).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_ranked(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d WHERE t IS NOT NULL),
held AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM dw WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM held) GROUP BY r, term),
df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS reps FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(reps * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN held USING (r) CROSS JOIN whole GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
