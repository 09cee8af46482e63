"""The prefix trie against dictionaries of prefixes."""

import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        seqs[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def sums(p):
        below = [sums(k) for k in kids[p]]
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        return (sum(b[0] for b in below) if below else 1, own_saved + sum(b[1] for b in below))

    out = []
    for p, m in members.items():
        leaves, saved = sums(p)
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def random_rows(seed, n=90):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-150, 450), n, replace=False).tolist():
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], "abc"[int(rng.integers(0, 3))] * int(rng.integers(1, 3))))
    return rows


ODD = [
    (100, None, "user", "first"), (100, 0, None, None), (100, 1, "user", "é雪"), (100, 1, "user", "é雪"), (101, 0, "", ""), (102, 5, "user", "x"), (102, 3, "user", "y"),
    (None, 0, "user", "nobody"), (7, 0, "a", "b"), (8, 0, "ab", ""), (9, 0, "", "ab"), (300, 0, "user", "u"), *((i, t, "user", f"same {t}") for i in range(301, 340) for t in range(7)),
]


@pytest.mark.parametrize("shard_turns", [1, 3, 40, 50_000])
def test_equals_a_dictionary_of_prefixes(spark, shard_turns):
    for rows in (ODD, random_rows(2) + ODD):
        assert got(trie.op11_trie(spark, made(spark, rows), shard_turns=shard_turns)) == plain(rows)


def test_long_conversations_are_hashed_in_stretches(spark, monkeypatch):
    rows = [(c, t, "user", f"{t % 5}" if t < 60 else f"{c} {t}") for c in (100, 104, 205) for t in range(100)] + random_rows(4, 20)
    monkeypatch.setattr(trie, "STRETCH", 7)
    monkeypatch.setattr(trie, "CHUNK", 4)
    want = plain(rows)
    for shard_turns in (20, 1000):
        assert got(trie.op11_trie(spark, made(spark, rows), shard_turns=shard_turns)) == want


def test_double_array_holds_what_was_put_in():
    rng = np.random.default_rng(1)
    seqs = sorted({tuple(rng.integers(1, 50, rng.integers(1, 6)).tolist()) for _ in range(3000)})
    codes, starts = np.concatenate([np.array(s) for s in seqs]), np.cumsum([0, *(len(s) for s in seqs)])[:-1]
    t = trie.DoubleArray(codes, starts)
    prefixes = {s[: d + 1] for s in seqs for d in range(len(s))}
    assert t.states == len(prefixes) + 1 == (t.check >= 0).sum() + 1
    assert t.top < 4 * t.states
    at = {}
    for live, to, row in t.walk():
        for s, state in zip(live.tolist(), to.tolist(), strict=True):
            prefix = seqs[s][: int(row[0] - starts[live[0]]) + 1]
            assert at.setdefault(prefix, state) == state
    assert len(set(at.values())) == len(at) == len(prefixes)


def test_empty_and_turnless(spark):
    assert trie.op11_trie(spark, made(spark, [])).collect() == []
    assert trie.op11_trie(spark, made(spark, [(None, 1, "user", "x")])).collect() == []
    turnless = [(c, 0, "user", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert got(trie.op11_trie(spark, made(spark, turnless))) == plain(turnless)


def test_a_hot_first_turn_is_split(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c % 97} {t}") for c in range(100, 900) for t in range(4)]
    assert got(trie.op11_trie(spark, made(spark, rows), shard_turns=64)) == plain(rows)


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cur = con.execute(trie.ORACLE)
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    assert got(trie.op11_trie(spark, spark.read.parquet(f"{sf}/conversations.parquet"))) == want
