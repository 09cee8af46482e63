import math

import numpy as np
import pytest

from tidemark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def by_hand(rows):
    ok = {}
    for i, v, label, _ in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            ok[i] = (label, x / np.sqrt(x @ x))
    links = {i: {j for j in ok if j != i and ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]) and ok[i][1] @ ok[j][1] >= 0.98} if i in ok else set() for i, *_ in rows}
    low = {i: i for i in links}
    for _ in low:
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in low}
    return {i: (len(links[i]), low[i], low[i] == i) for i in links}


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, make = [], lambda v: [float(x) for x in v]
    for label in range(3):
        for _ in range(120):
            rows.append(make(rng.standard_normal(16)) + [label])
    for label, many in ((0, 60), (1, 5), (2, 1)):  # a group that saturates its lists
        base = rng.standard_normal(16)
        rows += [make(base + 0.02 * rng.standard_normal(16)) + [label] for _ in range(many)]
    for i in range(0, 60, 3):
        rows.append(make(np.array(rows[i][:16]) + 0.05 * rng.standard_normal(16)) + [rows[i][16]])
    rows += [rows[0], rows[0], [2 * x for x in rows[1][:16]] + [rows[1][16]]]
    table = [(i, r[:16], r[16], "clash") for i, r in enumerate(rows)]
    n = len(table)
    odd = [None, [], [0.0] * 16, [None] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    table += [(n + i, v, 0, "clash") for i, v in enumerate(odd)] + [(n + 20, rows[0][:16], None, "clash"), (n + 21, rows[0][:16], None, "clash")]
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    out, recall = embeddings.near_duplicate_vectors(df, block=25)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert recall == pytest.approx(1.0) and got == by_hand(table)


def test_empty(spark):
    assert embeddings.op10_embeddings(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_lost_links_are_not_returned(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(16)], 0, "clash") for i in range(80)]
    rows += [(80 + i, [2.0 * x + 0.01 * k for k, x in enumerate(rows[i][1])], 0, "clash") for i in range(3)]
    whole = embeddings.descend
    monkeypatch.setattr(embeddings, "descend", lambda *a, **b: tuple(x.filter("false") for x in whole(*a, **b)))
    with pytest.raises(RuntimeError, match="audited links"):
        embeddings.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), audit=20, attempts=1)
