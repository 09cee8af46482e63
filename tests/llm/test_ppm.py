"""Scores under the language model, against a plain trie of dictionaries."""

import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from tidemark.llm import ppm

ORDER = ppm.ORDER


def plain(rows):
    """(n_tokens, n_known, N, base, score) of each (doc_id, text), by the definition."""
    trie, words = defaultdict(Counter), Counter()
    toks = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w] + [None]
    trains = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0

    def symbols(t):
        raw = [ppm.BEFORE] * ORDER + list((t or "").encode()) + [ppm.END]
        return [(tuple(raw[i - ORDER : i]), raw[i]) for i in range(ORDER, len(raw))]

    for i, t in rows:
        if trains(i):
            words.update(toks(t))
            for ctx, s in symbols(t):
                trie[ctx][s] += 1
    for k in range(ORDER, 0, -1):  # each kind of a longer context counts once for the shorter one
        for ctx in [c for c in trie if len(c) == k]:
            for s in trie[ctx]:
                trie[ctx[1:]][s] += 1
    N, V = sum(words.values()), len(words)

    def prob(ctx, s):
        p, gone = 1.0, set()
        for k in range(ORDER, -1, -1):
            after = {x: n for x, n in trie.get(ctx[ORDER - k :], {}).items() if x not in gone}
            if after:
                n = sum(after.values())
                if s in after:
                    return p * (after[s] - 0.5) / n
                p *= len(after) / 2 / n
                gone |= set(after)
        return p / (ppm.SYMBOLS - len(gone))

    out = []
    for i, t in rows:
        base = sum(log10((words[w] + 0.1) / (N + 0.1 * (V + 1))) for w in toks(t))
        out.append((i, i is not None and not trains(i), len(toks(t)), sum(words[w] > 0 for w in toks(t)), N, base, sum(log10(prob(c, s)) for c, s in symbols(t))))
    return out, prob


ROWS = [
    (1, "the cat sat on the mat"), (2, "The cat sat on the\tmat again"), (3, None), (4, ""), (5, "ünïcode ñandú 雪 the"), (None, "the cat that no id names"),
    (2, "The cat sat on the\tmat again"), (11, "zebra quartz \x0b\x0c jumps"), (13, "x"), *((i, f"row {i % 7} of the mat and {'ab' * (i % 5)}") for i in range(20, 60)),
]


def _same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == tuple(w[:5])
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_equal_a_plain_trie(spark, monkeypatch):
    want, _ = plain(ROWS)
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in ROWS], "doc_id long, text string, block long, score double").repartition(3)
    _same([tuple(r) for r in ppm.op12_ppm(spark, docs).collect()], want)
    assert any(r[1] for r in want) and any(not r[1] for r in want)
    # blocks of a few texts each, and grams of a bucket that several tasks take
    monkeypatch.setattr(ppm, "SALTED", 3)
    _same([tuple(r) for r in ppm.op12_ppm(spark, docs.coalesce(1), block_bytes=40).collect()], want)


def test_probabilities_after_a_context_sum_to_one(spark):
    _, prob = plain(ROWS)
    rng = np.random.default_rng(3)
    raw = [bytes(x) for x in rng.integers(97, 101, (30, 40)).astype(np.uint8)]
    keys, counts = np.unique(np.concatenate([g for r in raw for g in ppm.grams(r)]), return_counts=True)
    by_length = ppm.tries(keys, counts.astype(float), ORDER, 0)
    for ctx in (b"abcda", b"zzzzz", b"\xfe\xfe\xfe\xfe\xfe", b"zzzab"):
        every = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256) if s != ppm.BEFORE], np.uint64)
        assert (10 ** ppm.log_probs(every, by_length)).sum() == pytest.approx(1)
    assert sum(prob(tuple(b"the c"), s) for s in range(256) if s != ppm.BEFORE) == pytest.approx(1)


def test_untrained_empty_and_long(spark):
    schema = "doc_id long, text string"
    assert ppm.op12_ppm(spark, spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = ppm.op12_ppm(spark, spark.createDataFrame([(held, "ab c")], schema)).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(-5 * log10(255))
    long = [(1, "ab " * 700_000 + "y" * 2_000_000), (2, "ab ab")]
    got = {r.doc_id: r for r in ppm.op12_ppm(spark, spark.createDataFrame(long, schema)).collect()}
    assert got[1].n_tokens == 700_002 and got[2].n_known == 3 and got[1].score < 0


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in ppm.op12_ppm(spark, docs).collect() if r.held_out]
    # so few texts know half the words that larger ones would; bytes do as well as words there
    assert len(rows) > 50 and sum(r.score for r in rows) > 1.01 * sum(r.base_score for r in rows)
