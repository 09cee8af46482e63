import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import connected_components


def groups_by_hand(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def fingerprint_by_hand(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in [None, "", " \t", "One", "one two\x0bthree", "A b c D é f", "x " * 300, " ".join(map(str, range(500)))]:
        assert simhash.fingerprint(text, 4, 42) == fingerprint_by_hand(text)


def test_every_vector_has_a_nearest_codeword_and_close_ones_meet():
    rest, table = simhash.codeword_keys()
    assert set((table >= 0).sum(1)) == {1, 6}
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= 1 << b
        for a, b in zip(simhash.segment_keys(x), simhash.segment_keys(y), strict=True):
            assert {*a} & {*b} - {-1}


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_join_what_brute_force_joins(spark, bucket):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for _ in range(140):
        f = rnd.choice(sorted(fps))
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            f ^= 1 << b
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket).collect()
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    assert all(near(a, b) for a, b in links)
    want = groups_by_hand(signed, [(a, b) for a, b in combinations(signed, 2) if near(a, b)])
    assert groups_by_hand(signed, [tuple(x) for x in links]) == want


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rnd.randint(50, 300), rnd.randint(50, 300)) for _ in range(150)] + [(400, x) for x in range(401, 440)] + [(7, 7), (1, 2), (2, 1)]
    nodes = {n for link in links for n in link if link[0] != link[1]}
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: v for k, v in groups_by_hand({n for link in links for n in link}, links).items() if k in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200 ", "changed ")
    rows = [(5, base), (3, near), (9, base), (9, base), (1, None), (2, ""), (4, "\n"), (7, "other words"), (None, base)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, df).collect())
    fp = {i or -1: fingerprint_by_hand(t) for i, t in rows}
    low = groups_by_hand(fp, [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    low = {k: min(x for x in low if low[x] == v and x >= 0) for k, v in low.items()}
    assert got == sorted((i or -1, f"{fp[i or -1]:016x}", low[i or -1]) for i, _ in rows)
    assert simhash.op9_simhash(spark, df.limit(0)).collect() == []


def test_all_hashes_at_once_are_xxh64():
    rnd = random.Random(7)
    raw = bytes(rnd.randrange(256) for _ in range(3000))
    start = np.array([rnd.randrange(2000) for _ in range(600)])
    size = np.array([rnd.choice([0, 1, 3, 4, 5, 7, 8, 12, 24, 31, 32, 33, 63, 64, 96, 257, 900]) for _ in start])
    want = [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(start.tolist(), size.tolist())]
    assert simhash.xxh64(raw, start, size, 42).tolist() == want
    texts = ["a b c d e", "", None, " x ", "A B\tC  d", "w " * 500]
    for at_once in (1, 40, 1 << 22):
        got = simhash.hashes_of(texts, 4, 42, at_once)
        assert [h.tolist() for h in got] == [simhash.shingle_hashes(t, 4, 42).tolist() for t in texts]
    assert [len(h) for h in got] == [2, 0, 0, 1, 1, 497]


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(5)
    fps = rng.integers(-(2**62), 2**62, 400)
    for n in range(5):
        flips = np.array([sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for _ in fps], np.uint64)
        near = (fps.view(np.uint64) ^ flips).view(np.int64)
        keys = [{i: set(k[at == i].tolist()) for i in range(len(fps))} for k, at in (simhash.bucket_keys(fps), simhash.bucket_keys(near))]
        assert all(keys[0][i] & keys[1][i] for i in range(len(fps)))


def test_fingerprint_of_a_very_long_text(spark):
    text = " ".join(f"Word{i % 977}x{i % 31}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " more"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(df).collect())
    assert got[1:] == [(1, fingerprint_by_hand(text))] * 2 + [(2, 0)]
    assert got[0] == (0, fingerprint_by_hand(text + " more"))
