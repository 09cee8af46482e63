import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(13, len(b))
            for j in range(len(b) - n + 1) if b else []:
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit |= set(range(i, i + n))
                        names.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_suffix_array_and_index_match_brute_force():
    rng = np.random.default_rng(1)
    for n, a in ((1, 2), (2, 2), (50, 3), (400, 2), (300, 9)):
        text = rng.integers(1, a + 1, n)
        full = np.append(text, 0)
        assert list(dc.suffix_array(full)) == sorted(range(n + 1), key=lambda i: full[i:].tolist())
        index = dc.FMIndex(text, a + 1)
        phrases = rng.integers(1, a + 1, (20, min(3, n)))
        lo, hi = index.search(phrases)
        for p, x, y in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(n - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(x, y))) == want


@pytest.mark.parametrize(("shard_words", "pass_chars"), [(2_000_000, 16_000_000), (40, 60)])
def test_same_as_brute_force(spark, shard_words, pass_chars, monkeypatch):
    rnd = random.Random(3)
    vocab = ["the", "of", "é", "Zeta", "x1", "straße", "ÀB"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 5, 13, 14, 30])))) for i in range(8)]
    items = [x for x in items if len(words(x[1])) > 1] + [(50, "unique-word"), (51, ""), (52, None), (None, "lone WORD here"), (0, items[0][1])]
    docs = []
    for i in range(60):
        parts = [" ".join(rnd.choices([*vocab, "zz", "-", "1,2"], k=rnd.randint(0, 40)))]
        parts += [rnd.choice(items)[1] or "" for _ in range(rnd.randint(0, 2))]
        docs.append((i, "; ".join(rnd.sample(parts, len(parts)))))
    docs += [(60, None), (61, ""), (62, "lone word, HERE"), (1, docs[1][1]), (None, "a unique word b"), (63, " ".join(vocab * 900))]
    monkeypatch.setattr(dc.find_benchmark_spans, "__kwdefaults__", {**dc.find_benchmark_spans.__kwdefaults__, "shard_words": shard_words, "pass_chars": pass_chars})
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, items string")
    got = dc.op3_decontaminate(spark, d, b).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in dc.op3_decontaminate(spark, d, b).collect()] == [(1, 2, 0, 0)]
    assert dc.op3_decontaminate(spark, d.limit(0), b).collect() == []


@pytest.mark.parametrize("pass_chars", [16_000_000, 3])
def test_large_ids_beside_null_ids(spark, pass_chars, monkeypatch):
    monkeypatch.setattr(dc.find_benchmark_spans, "__kwdefaults__", {**dc.find_benchmark_spans.__kwdefaults__, "pass_chars": pass_chars})
    ids = [(1 << 53) + 1, None, (1 << 62) + 3, None, -(1 << 62) - 5, (1 << 53) + 1]
    docs = [(i, f"some words and item{k % 2} text") for k, i in enumerate(ids)]
    items = [(1, "item0 text"), (2, "words and item1")]
    got = dc.op3_decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, items)
