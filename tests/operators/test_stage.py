"""Intermediate tables go when a query's rows are kept, of that thread's query alone."""

import os
from concurrent.futures import ThreadPoolExecutor

from tidemark.operators.stage import kept_only, shared_path, staged


def test_only_the_rows_stay(spark):
    made = []

    def query(s, n):
        path = shared_path(s, "own")
        s.range(int(n)).write.parquet(path)
        made.append(path)
        half = staged(s.read.parquet(path).filter("id % 2 = 0"), "half")
        return half.selectExpr("id * 2 AS x")

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda n: kept_only(query)(spark, n), ("10", "6")))
    assert [sorted(r.x for r in g.collect()) for g in got] == [[0, 4, 8, 12, 16], [0, 4, 8]]
    assert len(made) == 2 and not any(os.path.exists(p) for p in made)
    assert kept_only(query).__name__ == "query"
