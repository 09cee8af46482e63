import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substrings
from tidemark.llm.textbytes import word_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_hand(docs, window):
    first, out = {}, []
    key = lambda i: (i is None, i or 0)
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for a in range(len(w) - window + 1):
            s = tuple(w[a : a + window])
            first[s] = min(first.get(s, ((True, 1), 0)), (key(i), a))
    for i, w in words:
        gone = {a + k for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < (key(i), a) for k in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_word_hashes_do_not_depend_on_place():
    raw = " ab\tab c ab\n\x1cab  ab ".encode()
    start, h = word_hashes(np.frombuffer(raw, np.uint8))
    words = raw.split()
    assert [raw[s:].split()[0] for s in start] == words
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


@pytest.mark.parametrize(("group", "vocab"), [(1000, 40), (3, 40), (1000, 2), (2, 400), (1, 40), (1, 2)])
def test_same_as_brute_force(spark, group, vocab):
    rnd = random.Random(group + vocab)
    text = lambda n: " ".join(rnd.choice([f"w{rnd.randrange(vocab)}", "é", "A"][: 1 if vocab > 100 else 3]) for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 60, 200)]
    docs = []
    for i in range(60):
        parts = [text(rnd.randint(0, 50)) for _ in range(rnd.randint(0, 4))] + rnd.choices(shared, k=rnd.randint(0, 3))
        rnd.shuffle(parts)
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(60, docs[5][1]), (61, docs[5][1]), (62, None), (63, ""), (64, " \n"), (65, "x " * 300), (66, "x " * 25), (None, docs[7][1]), (3, docs[3][1]), (67, "long" * 50_000 + " " + shared[3])]
    rnd.shuffle(docs)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_words string").repartition(4)
    out = substrings.dedup_substrings(df, group=group)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == by_hand(docs, 20)

def regular(n):
    """The first n letters of the Thue-Morse sequence and the same with letters swapped."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 4096, 3 << 20])
def test_regular_long_words_are_told_apart(spark, n):
    x, y = regular(n)
    left, right = [f"l{i}" for i in range(12)], [f"r{i}" for i in range(12)]
    docs = [(1, " ".join([*left, x, *right])), (2, " ".join([*left, y, *right])), (3, " ".join([*left, x, *right]))]
    out = substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in out) == [(1, 25, 0), (2, 25, 0), (3, 25, 25)]


@pytest.mark.parametrize("window", [7, 20])
def test_tree_has_the_repeats_of_its_runs(window):
    rnd, gram = random.Random(window), 3
    runs = [[f"w{rnd.randrange(3)}" for _ in range(rnd.randint(window, 2 * window - gram))] for _ in range(80)]
    runs += [r[rnd.randrange(0, len(r) - window + 1) :] for r in runs]
    n = np.array([len(r) - window + 1 for r in runs])
    run, offset, node = substrings.deep_nodes(n, pa.array([" ".join(r).encode() for r in runs], pa.binary()), window)
    got, want = {}, {}
    for r, o, k in zip(run.tolist(), offset.tolist(), node.tolist()):
        got.setdefault(k, set()).add((r, o))
    for r, words in enumerate(runs):
        for o in range(len(words) - window + 1):
            want.setdefault(tuple(words[o : o + window]), set()).add((r, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_empty(spark):
    assert substrings.op8_substrings(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
