import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


def targets_by_hand(sizes, share=1.5, weights=(3, 1, 2), cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in names}
        above = {s for s in free if t[s] > cap * sizes[s] + 1e-9}
        if not above:
            return t
        full |= above


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 257, 1000):
        got = mixing.permuted(np.arange(n), n, 5)
        assert sorted(got) == list(range(n))
    assert list(mixing.permuted(np.arange(50), 50, 1)) != list(mixing.permuted(np.arange(50), 50, 2))


def test_mix_meets_targets_and_bounds(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), ["a", "b", "c", None, "hot"][min(4, int(rng.integers(0, 8)))]) for i in range(300)]
    rows += [(300, None, "empty"), (301, "", "a"), (302, "\t \n", None), (303, "w w", "a"), (303, "w w", "a")]
    out = mixing.op1_mixing(spark, docs(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, source = targets_by_hand(sizes), {}
    by = Counter()
    for i, t, s in rows:
        source.setdefault(i, s)
    for r in out:
        assert r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        by[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(by[s] - t) <= 1
    again = mixing.op1_mixing(spark, docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


@pytest.mark.parametrize(("length", "shard_blocks", "cell_rows"), [(16, 8, 10), (7, 300, 5000)])
def test_pieces_replay_the_plan(spark, length, shard_blocks, cell_rows):
    """Streams have neither gap nor overlap, each pass takes every block once, shards are full, and what is taken is what the draws cover."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 150)) or None, ["a", "b", None, "hot"][min(3, int(rng.integers(0, 6)))], int(rng.integers(0, 60))) for _ in range(300)]
    rows += [(5, "a", 9)] * 50 + [(7, "big", 4000), (8, "none", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({"target": F.lit("clash"), "start": F.lit(1)})
    parts = [t.collect() for t in mixing.mix(sized, length=length, shard_blocks=shard_blocks, cell_rows=cell_rows)]
    targets, streams, draws, pieces = parts
    assert Counter((r.doc_id, r.source, r.size) for r in streams) == Counter(rows)
    size = {t.src: t.source_size for t in targets}
    for src, n in size.items():
        at = 0
        for r in sorted((r for r in streams if r.src == src and r.size), key=lambda r: r.start):
            assert r.start == at
            at += r.size
        assert at == n
    shards = Counter(d.shard for d in draws)
    assert sorted(shards) == list(range(len(shards))) and [n for _, n in sorted(shards.items())][:-1] == [shard_blocks] * (len(shards) - 1)
    want = Counter()
    for src, n in size.items():
        own = sorted((d for d in draws if d.src == src), key=lambda d: d.draw)
        assert [d.draw for d in own] == list(range(len(own)))
        blocks = -(-n // length)
        for e in {d.epoch for d in own}:
            met = [d.block for d in own if d.epoch == e]
            assert len(set(met)) == len(met) and (len(met) == blocks or e == own[-1].epoch)
        for d in own:
            lo, hi = d.block * length, d.block * length + d.take
            for r in streams:
                if r.src == src and (both := min(hi, r.start + r.size) - max(lo, r.start)) > 0:
                    want[src, r.start] += both
    got = Counter()
    for p in pieces:
        got[p.src, p.start] += p.to_word - p.from_word
    assert got == want
    assert [sorted(map(str, t.collect())) for t in mixing.mix(sized.repartition(5), length=length, shard_blocks=shard_blocks, cell_rows=cell_rows)] == [sorted(map(str, t)) for t in parts]


def test_counts_of_a_shard_follow_the_weights():
    left, rng = np.array([3000, 1000, 2000]), np.random.default_rng(1)
    n = np.mean([mixing.drawn_counts(rng, 600, left) for _ in range(300)], 0)
    assert np.abs(n - [300, 100, 200]).max() < 5
    assert list(mixing.drawn_counts(rng, 6, np.array([1, 0, 5]))) == [1, 0, 5]


def test_mix_of_nothing(spark):
    assert mixing.op1_mixing(spark, docs(spark, [])).collect() == []
    only = mixing.op1_mixing(spark, docs(spark, [(1, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)]


def by_hand(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_chat_round_trip(spark):
    nasty = ["", "\\", "\\h", "###", "####", "</turn>", "<", "</turn", "<more/>", "\\### Assistant: </turn> ok", "a: b\n", "\\s\\t", "é☃", "x" * 40000]
    convs = {
        1: [("user", x) for x in nasty] + [("assistant", x) for x in nasty],
        2: [("system", "s"), ("assistant", "a"), ("assistant", "</turn>\n### user: b")],
        3: [("we: ird\\###", "a"), ("we: ird\\###", "b")],
        4: [("", ""), ("user", "")],
        None: [("user", "no id")],
    }
    rows = [(c, i, r, t or None if i % 2 else t, "extra") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.op5_chat(spark, df).collect()}
    convs[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert got == {c: by_hand(t) for c, t in convs.items()}


def test_chat_merges_runs_of_a_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 2, "assistant", "c")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert out.formatted == "### user: a<more/>b</turn>\n### assistant: c<more/>c</turn>\n"
    assert [out.formatted[s["from"] : s["to"]] for s in out.loss_spans] == ["c", "c"]


def test_a_long_conversation_and_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = [(["user", "assistant", "assistant"][i % 3], f"\\{i} ### é" if i % 5 else "") for i in range(4000)]
    out = chat.op5_chat(spark, spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], schema).repartition(4)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in out}[1] == by_hand(turns)
    assert [r.conv_id for r in chat.op5_chat(spark, spark.createDataFrame([], schema)).collect()] == [-7]


def test_reading_a_conversation_is_linear(spark):
    def seconds(n):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('word ###', 17) AS text")
        began = time.time()
        got = chat.op5_chat(spark, rows).filter("conv_id = 1").first()
        assert got.loss_chars == n // 2 * 136 and got.n_turns == n
        return time.time() - began

    seconds(1000)
    short, long = min(seconds(5000) for _ in range(2)), seconds(20_000)
    assert long < 10 and long < 6 * short + 2


def test_equal_rows_are_counted_not_gathered(spark):
    """A third of all rows are one row, with a null id and text."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, null, concat('t', id)) AS text", "id % 2 AS slot", "'x' AS size")
    placed = sharding.ring_shards(rows.select("doc_id", "text"), "doc_id", 7, ties=("text",), lot=50)
    got = placed.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()), key=str)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert sorted(map(len, by_shard.values())) == [428] * 3 + [429] * 4
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    # stacks of 50, not a row for each
    stacks = sharding._stacked(rows.select("doc_id", "text"), ["doc_id", "text"], 50)
    assert [tuple(r) for r in stacks.filter("doc_id is null").selectExpr("count(*)", "sum(_ring_m)", "max(_ring_m)").collect()] == [(20, 1000, 50)]
    assert sharding.op6_sharding(spark, rows).selectExpr("count(*)", "count(distinct shard, slot)").first() == (3000, 3000)


@pytest.mark.parametrize("lot", [40, 100_000])
def test_a_hot_key_is_cut_into_lots(spark, lot):
    rows = [(None, f"text {i}") for i in range(900)] + [(i, f"text {i}") for i in range(600)] + [(None, "same")] * 200
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    out = sharding.ring_shards(df, "k", 7, ties=("t",), lot=lot).collect()
    assert Counter((r.k, r.t) for r in out) == Counter(rows)
    n = Counter(r.shard for r in out)
    assert max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n[s])) for s in n)
    again = sharding.ring_shards(df.repartition(5), "k", 7, ties=("t",), lot=lot).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_one_more_shard_without_slack(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    old, new = ({r.k: r.shard for r in sharding.ring_shards(df, "k", n).collect()} for n in (16, 17))
    # one in seventeen must move
    assert sum(old[k] != new[k] for k in old) < 0.2 * 10_000


def test_shards_differ_by_one_and_slots_have_no_gap(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}", None) for i in range(1003)] + [(None, None, None), (5, "t5", None), (5, "t5", None)]
    out = sharding.op6_sharding(spark, docs(spark, rows).withColumn("shard", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    n = Counter(r.shard for r in out)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    again = sharding.op6_sharding(spark, docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.op6_sharding(spark, docs(spark, [])).collect() == []


def test_ring_is_the_greedy_walk(spark):
    df = spark.range(400).withColumnRenamed("id", "k")
    got = {r.k: r.shard for r in sharding.ring_shards(df, "k", 5, vnodes=8, slack=0.1).collect()}
    pos = {r.k: r.p for r in df.select("k", sharding._position(F.lit(7), F.col("k")).alias("p")).collect()}
    nodes = sorted((r.lo, r.shard) for r in sharding._nodes(spark, 5, 8, 7).collect())
    arc = lambda p: sum(x <= p for x, _ in nodes) % 40
    load, cap = Counter(), -(-440 // 5)
    pieces = {r.piece: r for r in sharding.ring_pieces(spark, 5, 8, 7).collect()}
    piece = lambda p: next(k for k, r in pieces.items() if r.lo <= p <= r.hi)
    for k in sorted(pos, key=lambda k: (arc(pos[k]), piece(pos[k]), pos[k])):
        a = arc(pos[k])
        shard = next(s for i in range(40) if load[s := nodes[(a + i) % 40][1]] < cap)
        load[shard] += 1
        assert got[k] == shard


def test_one_more_shard_moves_few_keys(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    old, new = ({r.k: r.shard for r in sharding.ring_shards(df, "k", n, slack=0.25).collect()} for n in (10, 11))
    assert sum(old[k] != new[k] for k in old) < 0.35 * 3000
