"""Checks row by row, the quarantine in one pass, the ledger of batches and differences by digests."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import constraints as cs
from tidemark.operators import dataset as ds
from tidemark.operators import sinks as sk

TABLES = {"regime": cs.REGIME_SNAPSHOT, "label": cs.LABEL, "markout": cs.MARKOUT, "policy": cs.POLICY}


def good_and_bad(name, text):
    """A value that keeps a column's own check and one that breaks it."""
    if " IN (" in text:
        first = text.split("(")[1].split(",")[0].strip(" ')")
        return (int(first), 77) if first.lstrip("-").isdigit() else (first, "other")
    if "<= 1" in text:
        return 0.5, 1.5
    return (1.0, 0.0) if text.endswith("> 0") else (0.0, -1.0)


OTHERS = {
    "window_order": [("window_start_us", 1, 3), ("window_end_us", 2, 2)], "book_order": [("btc_bid_price", 1.0, 9.0), ("btc_ask_price", 2.0, 2.0)], "missing_features_list": [("missing_features_list", "[]", "{}")], "degradation_reasons": [("degradation_reasons", '["a"]', "none")],
    "terminal_reason_code": [("terminal_reason_code", "x", "x" * 201)], "retryable_or_terminal": [("retryable", True, True), ("is_terminal", False, True)], "retries_if_retryable": [("max_retries", 3, 0)], "cooldown_if_retryable": [("cooldown_seconds", 60, 0)],
}


@pytest.mark.parametrize("name", TABLES)
def test_each_check_is_broken_by_one_row(spark, name):
    checks = TABLES[name]
    good, breaks = {}, {}
    for rule, text in checks.items():
        for column, ok, bad in OTHERS.get(rule, [(rule, *good_and_bad(rule, text))]):
            good.setdefault(column, ok)
            breaks.setdefault(rule, {})[column] = bad
    if name == "policy":
        breaks = {r: {c: int(v) if isinstance(v, float) else v for c, v in b.items()} for r, b in breaks.items()}
        good |= {"max_retries": 3, "cooldown_seconds": 60}
    rows = [("good", good), ("null", dict.fromkeys(good)), *((rule, good | b) for rule, b in breaks.items())]
    kinds = {c: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "double" for c, v in good.items()}
    df = spark.createDataFrame([(n, *(r[c] for c in good)) for n, r in rows], "row string, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
    got = {r.row: r.v for r in df.select("row", cs.violated(checks).alias("v")).collect()}
    assert got["good"] == [] and got["null"] == []
    for rule in checks:
        assert rule in got[rule], rule
        assert len(got[rule]) == 1 or name == "policy" or rule in ("btc_bid_price", "btc_ask_price")


def test_checks_are_read_from_a_schema(spark):
    ddl = """CREATE TABLE t (id TEXT CHECK (id ~ '^ev_[0-9a-f]{4}$'), n INTEGER NOT NULL CHECK (n >= 0), -- CHECK (n < 0)
      q TEXT CHECK (q IN ('a)', 'b')), j JSONB, CONSTRAINT one CHECK (n = 0 OR (id IS NULL AND n > 1)), CHECK (n < 9), CHECK (j IS NULL OR jsonb_typeof(j) = 'array'))"""
    found = cs.checks_of_schema(ddl)
    assert list(found) == ["id", "n", "q", "one", "n_2", "j"]
    df = spark.createDataFrame([("ev_00ff", 0, "a)", "[1]"), ("ev_XX", -1, "c", "{}"), (None, 12, None, None), ("ev_00ff", 5, "b", " []")], "id string, n int, q string, j string")
    assert [r.v for r in df.select(cs.violated(found).alias("v")).collect()] == [[], ["id", "n", "q", "one", "j"], ["n_2"], ["one"]]


def test_quarantine_in_one_pass(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id % 10 - 1 AS n", "if(id % 4 = 0, 'x', 'ok') AS q").repartition(3)
    checks = cs.checks(at_least_zero=["n"], one_of={"q": ["ok"]})
    assert sk.write_checked(rows, checks, f"{tmp_path}/t") == {"rows": 1000, "quarantined": 300, "n": 100, "q": 250}
    held = spark.read.parquet(f"{tmp_path}/t")
    assert {r.quarantined: r["count"] for r in held.groupBy("quarantined").count().collect()} == {"true": 300, "false": 700}
    assert held.filter("quarantined = 'false' and size(violated) > 0").isEmpty()


def test_a_batch_is_taken_once_and_a_torn_one_never(spark, tmp_path):
    schema = "id long, v string"
    batch = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], schema)
    table = sk.BatchLedger(spark, f"{tmp_path}/t")
    shape = batch(1).schema
    assert table.read(shape).collect() == []
    table.write(batch(1, 2), 0)
    table.write(batch(1, 2), 0)
    table.stage(batch(7, 8), 1)  # the writer dies before it commits
    again = sk.BatchLedger(spark, f"{tmp_path}/t")
    assert sorted(r.id for r in again.read(shape).collect()) == [1, 2]
    again.write(batch(7, 8), 1)  # and the batch comes again
    late = again.stage(batch(9), 1)
    assert not again.commit(1, late)  # two writers: the second to commit has no effect
    again.write(batch(3), 2)
    assert sorted(r.id for r in table.read(shape).collect()) == [1, 2, 3, 7, 8]
    assert table.clean() == 2 and sorted(r.id for r in table.read(shape).collect()) == [1, 2, 3, 7, 8]
    assert table.clean() == 0


def test_difference_of_two_runs(spark):
    rnd = random.Random(4)
    a = [(rnd.choice((None, rnd.randrange(200))), rnd.choice((None, "x", "y"))) for _ in range(300)]
    b = a[20:] + [(1, "new"), (None, None), a[25], a[25]]
    rnd.shuffle(b)
    x, y = (spark.createDataFrame(r, "k long, v string").repartition(3) for r in (a, b))
    want = Counter(a) - Counter(b), Counter(b) - Counter(a)
    for leaves in (1, 7, 4096):
        got = ds.regression_diff(x, y.select("v", "k"), ["k"], leaves=leaves).collect()
        assert sorted(((r.k, r.v, r.n, r.side) for r in got), key=str) == sorted([(*k, n, s) for c, s in zip(want, ("only_a", "only_b"), strict=True) for k, n in c.items()], key=str)
    assert ds.regression_diff(x, x.repartition(5), ["k"]).collect() == []
    assert ds.regression_diff(x.limit(0), x.limit(0), ["k"]).collect() == []


def test_one_changed_row_is_one_range(spark):
    a = spark.range(20_000).selectExpr("id", "id * 3 AS v")
    b = a.withColumn("v", F.when(F.col("id") == 777, 0).otherwise(F.col("v")))
    assert len(ds.differing_leaves(a, b, ["id"])) == 1
    assert sorted(map(tuple, ds.regression_diff(a, b, ["id"]).collect())) == [(777, 0, 1, "only_b"), (777, 2331, 1, "only_a")]
