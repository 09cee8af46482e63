import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from tidemark.llm import mixing, similar, simhash
from tidemark.llm.common import written

WORDS = {"en": "the and of with that this from have".split(), "de": "der die das und nicht ein mit auch".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(9)
    bench = [(i, " ".join(f"bench{i}x{k}" for k in range(20))) for i in range(3)]
    rows = []
    for i in range(150):
        lang = rnd.choice(["en", "de"])
        text = " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "er", "t"]) + rnd.choice("abcdefgh") for _ in range(rnd.randint(40, 200)))
        rows.append((i, text, lang, f"s{i % 3}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0") for i in range(10)]  # copies
    rows += [(300 + i, rows[20 + i][1] + "  ", rows[20 + i][2], "s1") for i in range(5)]
    rows += [(400 + i, " ".join(rows[30 + i][1].split()[:30]) + " " + bench[i][1] + " " + rows[40 + i][1][:100], rows[30 + i][2], "s2") for i in range(3)]
    rows += [(500, None, None, None), (501, "123 456 ...", "en", "s1"), (502, "", "de", None)]
    return [(*r, len(r[1] or "")) for r in rows], bench


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_does_what_it_says(spark, sf_dir):
    docs, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), {r[0]: r for r in corpus()[0]}
    kept = {r.doc_id: r for r in cp.language_stage(spark, docs, sf_dir).collect()}
    assert set(kept) == set(rows) - {500, 501, 502}
    docs = docs.filter(docs.doc_id.isin(list(kept)))

    fp = {i: simhash.fingerprint(r.text, 4, 42) for i, r in kept.items()}
    low = {i: i for i in fp}
    for _ in fp:
        low = {i: min(low[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4) for i in fp}
    unique = {r.doc_id: tuple(r) for r in cp.near_dedup_stage(spark, docs, sf_dir).collect()}
    assert set(unique) == {i for i in low if low[i] == i} and len(unique) == len(kept) - 15
    assert all(unique[i] == rows[i] for i in unique)
    docs = docs.filter(docs.doc_id.isin(list(unique)))

    clean = {r.doc_id for r in cp.decontamination_stage(spark, docs, sf_dir).collect()}
    assert clean == set(unique) - {400, 401, 402}
    docs = docs.filter(docs.doc_id.isin(list(clean)))

    taken = {r.doc_id: r.taken for r in mixing.op1_mixing(spark, docs).collect()}
    mixed = cp.mixing_stage(spark, docs, sf_dir)
    assert mixed.columns == cp.COLUMNS
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        own = iter(rows[r.doc_id][1].split())
        assert all(w in own for w in r.text.split()) and r.n_chars == len(r.text)  # a subsequence of its words
    assert got == Counter({i: n for i, n in taken.items() if n})

    out = cp.sharding_stage(spark, mixed, sf_dir).collect()
    n = Counter(r.shard for r in out)
    assert len(out) == mixed.count() and max(n.values()) - min(n.values()) <= 1


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == [*cp.COLUMNS, "shard", "slot"] and out.count() > 100


def test_cut_text_keeps_what_is_between():
    assert mixing.cut_text(" a  b\tc d\n", [(0, 2), (2, 3)]) == "a  b\tc"
    assert mixing.cut_text("a b c d", [(3, 4), (0, 1)]) == "a\nd"


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_rows_are_told_apart_where_ids_are_not(spark, sf_dir):
    bench = corpus()[1][0][1]
    long = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(8)]
    texts = [(None, long[0]), (None, long[1]), (7, long[2]), (7, long[3]), (8, long[4]), (9, long[4]), (9, long[5]), (None, long[6]), (None, long[6])]
    docs = spark.createDataFrame([(i, t, "en", f"s{len(t) % 2}", len(t)) for i, t in texts], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in cp.near_dedup_stage(spark, docs, sf_dir).collect())
    assert got == Counter([(None, long[0]), (None, long[1]), (7, long[2]), (7, long[3]), (8, long[4]), (9, long[5]), (None, long[6])])

    texts = [(None, long[0]), (None, bench), (7, long[2]), (7, bench + " " + long[3]), (8, long[4]), (8, long[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in cp.decontamination_stage(spark, docs, sf_dir).collect())
    assert got == Counter([(None, long[0]), (7, long[2]), (8, long[4]), (8, long[4])])

    sizes = {(None, 40): long[0], (None, 60): long[1], (7, 1): long[2], (7, 50): long[3], (7, 2): long[4]}
    texts = [(i, " ".join(t.split()[:n])) for (i, n), t in sizes.items()] + [(7, "w3x0 w3x1")] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA).repartition(3)
    want, got = Counter(), Counter()
    for r in mixing.op1_mixing(spark, docs).collect():
        want[r.doc_id] += r.taken
    for r in cp.mixing_stage(spark, docs, sf_dir).collect():
        got[r.doc_id] += len(r.text.split())
        assert any(i == r.doc_id and r.text in t for i, t in texts)
    assert got == want


@pytest.mark.parametrize("bucket, together", [(64, 4096), (2, 4096), (64, 3)])
def test_near_dedup_is_brute_force_jaccard(spark, bucket, together):
    rnd, texts = random.Random(3), [None, "", " \n", "one two", "One  two"]
    passage = " ".join(f"p{k}" for k in range(30))
    for i in range(25):
        base = [f"b{i}w{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 150))]
        for _ in range(6):
            near = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 20)):
                near[rnd.randrange(len(near))] = f"x{rnd.randint(0, 9999)}"
            texts.append(" ".join(near) + (" " + passage if i % 3 == 0 else ""))

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in texts]
    link = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    low = list(range(len(sets)))
    for _ in range(len(sets)):
        for a, b in link:
            low[a] = min(low[a], low[b])
    want = {i for i, x in enumerate(low) if i == x}
    assert len(want) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    # with many fingerprints of each set no link is missed; small bounds take the other ways for larger groups
    got = {r.row: r.component for r in similar.similar_groups(docs, seeds=6, reach=24, total=384, bucket=bucket, together=together).collect()}
    assert {i for i, c in got.items() if i == c} == want and got == dict(enumerate(low))


def test_a_large_group_of_near_copies_meets_in_blocks(spark):
    """Copies that each differ from one text at several places, so that most pairs of them are no link."""
    rnd = random.Random(8)
    base, texts = [f"b{rnd.randint(0, 400)}" for _ in range(140)], []
    for _ in range(220):
        near = list(base)
        for _ in range(rnd.randint(0, 7)):
            near[rnd.randrange(len(near))] = f"x{rnd.randint(0, 99999)}"
        texts.append(" ".join(near))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    low, changed = list(range(len(sets))), True
    link = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in link:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert 5 < len(set(low)) < 150
    docs = written(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3), "test")
    groups = written(similar.similar_groups(docs, seeds=6, reach=24, total=384, together=20, block=8), "test")
    assert {r.row: r.component for r in groups.collect()} == dict(enumerate(low))
    found, every = similar.measured_recall(docs, groups, sample=50)
    assert found == every > 100


def test_members_of_many_lists_are_one_row_each():
    """Near copies meet at most of their keys; what is listed of them does not grow with the keys, and at the keys all meet again."""
    rnd = random.Random(4)
    base = rnd.getrandbits(63)
    fps = sorted({base ^ sum(1 << k for k in rnd.sample(range(63), 3)) for _ in range(120)})
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), 2)), pa.array(fps)], ["seed", "fp"])
    keyed = pa.Table.from_batches(similar._emit_keys(iter([rows]))).sort_by("key")
    met = pa.Table.from_batches(similar._meetings(12, 2048)(iter(keyed.to_batches()))).to_pylist()
    marked = [(r["seed"], r["a"]) for r in met if r["b"] is None]
    assert len(marked) == len(set(marked)) <= len(fps) < keyed.num_rows / 20
    assert all((r["a"] ^ r["b"]).bit_count() <= 12 for r in met if r["b"] is not None)

    members = pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(np.arange(len(fps)) + k) for k in range(3))], ["seed", "fp", "node", "n", "comp"])
    again = pa.Table.from_batches(similar._lists_again(iter([members])))
    assert sorted((r["list"], fps[r["node"]]) for r in again.to_pylist()) == sorted((r["key"], r["fp"]) for r in keyed.to_pylist())
    assert all(r["n"] == r["node"] + 1 and r["comp"] == r["node"] + 2 for r in again.slice(0, 50).to_pylist())


def test_pairs_beyond_the_first_hubs_are_found(spark, monkeypatch):
    rnd, texts = random.Random(6), []
    for i in range(3):
        base = [f"b{i}w{rnd.randint(0, 400)}" for _ in range(120)]
        for _ in range(25):
            near = list(base)
            for _ in range(rnd.randint(0, 5)):
                near[rnd.randrange(len(near))] = f"x{rnd.randint(0, 99999)}"
            texts.append(" ".join(near))
    docs = written(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3), "test")
    got = []
    for hubs in (1, 64):
        monkeypatch.setattr(similar, "HUBS", hubs)
        groups = written(similar.similar_groups(docs, seeds=6, reach=24, total=384), "test")
        got.append({r.row: r.component for r in groups.collect()})
        found, every = similar.measured_recall(docs, groups, sample=80)
        assert found == every > 100
    assert got[0] == got[1]
