"""Ranked search against the definition, term by term and document by document."""

import re
from collections import Counter
from math import floor, log

import duckdb
import numpy as np

from tidemark.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain(docs, items, k=10):
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    N, L = len(bags), sum(n for *_, n in bags)
    df = Counter(w for _, c, _ in bags for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in bags:
            m = 25 + 75 * n * N // L
            s = sum(floor(1000 * log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if c[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "雪"]
    p = 1 / np.arange(1, len(vocab) + 1)
    text = lambda size: " ".join(rng.choice(vocab, size, p=p / p.sum()))
    return [(int(i), text(int(rng.integers(1, 40)))) for i in rng.permutation(n)], [(j, text(int(rng.integers(1, 9)))) for j in range(40)]


def test_equals_the_definition_with_ties_nulls_and_repeats(spark):
    docs, items = corpus(400, 1)
    docs += [(None, "w1 W2 ünï"), (7, "w5 w5 w61"), (7, "w5 w5 w61"), (900, None), (901, ""), (902, "-- !!"), (903, "w1 w2"), (904, "w1 w2"), (905, "w1-w2!")]
    items += [(50, None), (51, ""), (52, "w1 w1 w2 nowhere"), (52, "w3"), (53, "nowhere"), (None, "w4 w4"), (54, "w5"), (54, "w5")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int")
    want = sorted(plain(docs, items), key=str)
    assert rows(ranked.op13_ranked(spark, d, q)) == want
    # several shards a task, several passes, only long lists, only accumulators
    for more in ({"shard_terms": 100}, {"pass_chars": 60}, {"short": 0}, {"short": 10**6}, {"shard_terms": 500, "short": 20, "salts": 2}):
        assert rows(ranked.ranked_search(d, q, **more).selectExpr("item_id", "int(rank)", "doc_id", "score")) == want


def test_blocks_are_passed_over(spark):
    rng = np.random.default_rng(5)
    n = 64 * 200
    # a frequent word everywhere, a rare one in a few documents of one block
    sizes = np.full(n, 10)
    docs = np.concatenate((np.arange(n), np.arange(70, 90)))
    import pyarrow as pa

    row = {"doc_ids": list(range(n)), "sizes": sizes.tolist(), "terms": [0, 1], "ends": [n, n + 20], "docs": docs.tolist(), "tfs": rng.integers(1, 3, len(docs)).tolist()}
    table = pa.RecordBatch.from_pylist([row])
    postings = ranked.Postings({c: table.column(c)[0] for c in row}, n, 10 * n)
    seen: list[int] = []
    got = ranked.best_of(postings, [(0, 1), (1, 9000)], 10, seen=seen)
    every = np.zeros(n, np.int64)
    for t, w in ((0, 1), (1, 9000)):
        d, a = postings.of(t)
        every[d] += a * w
    want = np.lexsort((np.arange(n), -every))[:10]
    assert got[0].tolist() == want.tolist() and got[1].tolist() == every[want].tolist()
    assert len(seen) < 20


def test_empty_tables_and_long_texts(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.op13_ranked(spark, docs, items).collect() == []
    some = spark.createDataFrame([(1, "a " * 3_000_000 + "b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    assert ranked.op13_ranked(spark, some, spark.createDataFrame([], "item_id long, text string")).collect() == []
    want = sorted(plain([(1, "a " * 3_000_000 + "b"), (2, "a b"), (3, "c")], [(1, "a b")]), key=str)
    assert rows(ranked.op13_ranked(spark, some, items)) == want


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(ranked.op13_query(spark, sf)) == sorted(con.execute(ranked.ORACLE).fetchall(), key=str)
