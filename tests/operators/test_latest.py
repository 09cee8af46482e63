import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import windows as plans


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Events of three symbols, of which one is silent for the last two days and one for the last hour."""
    at = str(tmp_path_factory.mktemp("latest"))
    rows = [(1, 0, "a", 1.0), (2, 60, "a", 2.0), (3, 2 * 86400, "b", 3.0), (4, 2 * 86400 + 3600, "c", 4.0), (5, 2 * 86400 + 3000, "c", 5.0)]
    made = spark.createDataFrame(rows, "event_id long, at long, event_type string, value double")
    made.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), F.lit(7).cast("long").alias("user_id"), "event_type", "value", F.lit('{"k": 5}').alias("props")).coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("query, want", [("latest_per_symbol", {"a": 2, "b": 3, "c": 4}), ("latest_of_active", {"c": 4})])
def test_silent_symbols_have_a_newest_tick_too(spark, sf_dir, query, want):
    got = {tuple(r) for r in plans.queries()[query](spark, sf_dir).collect()}
    assert {r[0]: r[1] for r in got} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet/*.parquet')")
    assert set(con.execute(plans.oracle_sql()[query]).fetchall()) == got
