"""Tables of the research dataset: assembly, audits, retries, upserts and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quotes import dataset_bucket, trades_bucket

#: Reason, retryable, terminal, retries, cooldown in seconds, priority.
RETRY_POLICY = (
    ("bad_invalid_book", False, True, 0, 0, 10),
    ("bad_sigma", False, True, 0, 0, 10),
    ("bad_time_inconsistency", False, True, 0, 0, 10),
    ("bad_missing_quotes", True, False, 3, 300, 50),
    ("bad_stale_data", True, False, 5, 600, 50),
    ("bad_labeler_exception", True, False, 3, 900, 50),
)
USABLE = ("degraded_low_density", "degraded_high_lag", "degraded_unstable_window")


def retry_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RETRY_POLICY, "reason_code string, retryable boolean, is_terminal boolean, max_retries int, cooldown_seconds int, priority int")


#: Columns of the clean dataset that labels, barrier and markout bring.
LABEL_FACTS = ("sigma", "anchor_lag_ms", "coverage_ms")
MARKOUT_FACTS = ("ret_h", "mfe_h", "mae_h", "forward_lag_ratio", "points_used")


def clean_dataset(events: DataFrame, features: DataFrame, labels: DataFrame, markouts: DataFrame, barrier: DataFrame, horizon: int = 30) -> DataFrame:
    """One row for each event with features, a usable label and a markout at the horizon. The whitelist keeps ok labels, whose reason is null.

    ``labels`` has LABEL_FACTS as well; ``barrier`` (event_id, tb_label, good_event) may lack an event, whose two are null then.
    """
    usable = labels.filter((F.col("label_quality") == "ok") | F.col("reason_code").isin(*USABLE))
    at = markouts.filter(F.col("horizon_min") == horizon).select("event_id", *MARKOUT_FACTS)
    joined = events.select("event_id", "symbol", "us").join(features, "event_id").join(usable, "event_id").join(at, "event_id")
    joined = joined.join(barrier.select("event_id", "tb_label", "good_event"), "event_id", "left")
    based = joined.withColumn("dataset_bucket", dataset_bucket(F.col("label_quality"), F.col("reason_code"))).withColumn("n_trades_bucket", trades_bucket(F.col("n_trades")))
    return based.withColumn("needs_downweight", F.col("dataset_bucket") == "degraded_low_density").withColumn("is_n_trades_sweet_spot", F.col("n_trades_bucket").isin(*SWEET_SPOT)).withColumn("is_usable", F.lit(True))


#: Trades buckets that are the sweet spot, and all in their order.
SWEET_SPOT = ("Q2_6_9", "Q3_10_19")
TRADES_ORDER = ("Q1_le_5", "Q2_6_9", "Q3_10_19", "Q4_19_plus", "OUT_OF_RANGE")
#: Dataset buckets in their order.
BUCKET_ORDER = ("ok_only", "other_degraded", "degraded_low_density", "other_unknown")


def good_rate(good: Column) -> Column:
    """The share of good events; null counts as none."""
    return F.avg(F.when(good, 1.0).otherwise(0.0))


def bucket_profile(clean: DataFrame) -> DataFrame:
    """Per bucket, with its place in order: rows, share of good events by the barrier, mean return and best return, rows to be weighted down and rows of the sweet spot."""
    told = clean.groupBy("dataset_bucket").agg(
        F.count(F.lit(1)).alias("n"), good_rate(F.col("good_event")).alias("good_rate"), F.avg("ret_h").alias("avg_ret"), F.avg("mfe_h").alias("avg_mfe"),
        F.count_if("needs_downweight").alias("n_downweight"), F.count_if("is_n_trades_sweet_spot").alias("n_sweet"),
    )
    return told.withColumn("place", F.array_position(F.array(*map(F.lit, BUCKET_ORDER)), F.col("dataset_bucket")))


def trades_profile(clean: DataFrame) -> DataFrame:
    """Per bucket of trades, with its place in order: rows, share of good events and mean return."""
    told = clean.groupBy("n_trades_bucket").agg(F.count(F.lit(1)).alias("n"), good_rate(F.col("good_event")).alias("good_rate"), F.avg("ret_h").alias("avg_ret"))
    return told.withColumn("place", F.array_position(F.array(*map(F.lit, TRADES_ORDER)), F.col("n_trades_bucket")))


def clean_view_asserts(clean: DataFrame) -> DataFrame:
    """One row of counters, each zero or positive as the view promises, and whether all hold. What is unknown is never counted as wrong."""
    bucket, trades, low = F.col("dataset_bucket"), F.col("n_trades_bucket").isin(*SWEET_SPOT), F.col("dataset_bucket") == "degraded_low_density"
    must_be_zero = {
        "duplicates": F.count(F.lit(1)) - F.countDistinct("event_id"),
        "unknown": F.count_if(bucket == "other_unknown"),
        "low_not_downweight": F.count_if(low & ~F.col("needs_downweight")),
        "downweight_not_low": F.count_if(~low & F.col("needs_downweight")),
        "sweet_bucket_not_flag": F.count_if(trades & ~F.col("is_n_trades_sweet_spot")),
        "sweet_flag_not_bucket": F.count_if(~trades & F.col("is_n_trades_sweet_spot")),
        "unusable": F.count_if(~F.coalesce("is_usable", F.lit(False))),
        "ok_bucket_other_label": F.count_if((bucket == "ok_only") & (F.col("label_quality") != "ok")),
        "low_bucket_other_reason": F.count_if(low & (F.col("reason_code") != "degraded_low_density")),
        "other_bucket_other_reason": F.count_if((bucket == "other_degraded") & ~F.col("reason_code").isin("degraded_high_lag", "degraded_unstable_window")),
    }
    n = clean.agg(*(c.alias(name) for name, c in must_be_zero.items()), F.count_if(F.col("label_quality") == "ok").alias("ok_rows"))
    return n.withColumn("passed", (sum((F.col(c) for c in must_be_zero), F.lit(0)) == 0) & (F.col("ok_rows") > 0))


def retry_classify(labels: DataFrame, policy: DataFrame, now_us: Column) -> DataFrame:
    """``labels`` (event_id, label_quality, reason_code, retry_count) with the state that the next attempt sees."""
    p = policy.select(F.col("reason_code").alias("p_reason"), "retryable", "max_retries", "cooldown_seconds")
    j = labels.join(p, F.col("reason_code") == F.col("p_reason"), "left")
    done, count = F.col("label_quality").isin("ok", "degraded"), F.col("retry_count") + 1
    none = F.coalesce(F.col("reason_code") == "", F.lit(True))
    waits = ~done & ~none & F.coalesce(F.col("retryable"), F.lit(False)) & (count <= F.col("max_retries"))
    code = F.when(none, "bad_labeler_exception").when(F.coalesce(F.col("retryable"), F.lit(False)), F.substring(F.concat(F.lit("retry_exhausted:"), "reason_code"), 1, 200)).otherwise(F.col("reason_code"))
    return j.select(
        "event_id", F.when(done, "done").when(waits, "retry_wait").otherwise("terminal").alias("worker_status"), (~F.coalesce(waits, F.lit(False))).alias("is_terminal"), F.coalesce(waits, F.lit(False)).alias("is_retryable"),
        F.when(done, F.col("retry_count")).otherwise(count).alias("retry_count"), F.when(waits, now_us + F.col("cooldown_seconds") * 1_000_000).alias("next_retry_us"), F.when(~done & ~F.coalesce(waits, F.lit(False)), code).alias("terminal_reason_code"),
    )


def numbered_attempts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Attempts (event_id, started_us, finished_us, result_quality, error_class, error_message) to store beside ``stored`` (event_id, attempt_n): numbered on from an event's last, in order of their start.

    A clock that went back gives no duration; a quality that is none is null; a message of over 500 characters, and a class of over 100, is cut and ends in three dots.
    Of attempts of one event that start at once, that which finishes first comes first. Only the largest number of each event that has a new attempt is looked up.
    """
    last = stored.join(new.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.max("attempt_n").alias("_last"))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(F.col(c)).alias(c)
    order = Window.partitionBy("event_id").orderBy("started_us", "finished_us", "error_class", "error_message")
    numbered = new.join(last, "event_id", "left").withColumn("attempt_n", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int"))
    quality = F.when(F.col("result_quality").isin("ok", "degraded", "bad"), F.col("result_quality")).alias("result_quality")
    return numbered.select("event_id", "attempt_n", "started_us", F.greatest(F.lit(0).cast("long"), F.expr("(finished_us - started_us) div 1000")).alias("duration_ms"), quality, cut("error_class", 100), cut("error_message", 500))


def oldest_pending(pending: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` events of ``pending_events`` that were confirmed first, ties by event_id."""
    return pending.orderBy("us", "event_id").limit(n)


def pending_events(events: DataFrame, labels: DataFrame, policy: DataFrame, now_us: int, maturity_us: int) -> DataFrame:
    """Mature events never labelled, or waiting for a retry that is due and left. An event at exactly max_retries is never taken, though its state still says retry_wait."""
    lab = labels.select("event_id", "worker_status", "is_retryable", "retry_count", "next_retry_us", "quality_reason_code", F.lit(True).alias("labelled"))
    p = policy.select(F.col("reason_code").alias("p_reason"), "max_retries")
    j = events.filter(F.col("us") < now_us - maturity_us).join(lab, "event_id", "left").join(p, F.col("quality_reason_code") == F.col("p_reason"), "left")
    again = (F.col("worker_status") == "retry_wait") & F.col("is_retryable") & (F.col("next_retry_us") <= now_us) & (F.col("retry_count") < F.coalesce("max_retries", F.lit(0)))
    open_ = F.col("worker_status").isNull() | ~F.col("worker_status").isin("done", "terminal")
    return j.filter((F.col("labelled").isNull() | again) & open_).select("event_id", "symbol", "us", F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "quality_reason_code")


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key ``owners`` lacks; those with a null key have no owner."""
    return rows.join(owners.select(key), key, "left_anti")


def overdue_retries(labels: DataFrame, policy: DataFrame, now_us: int, n: int = 20) -> DataFrame:
    """The ``n`` labels in retry_wait whose time came first, of those whose time has come."""
    p = policy.select(F.col("reason_code").alias("quality_reason_code"), "max_retries")
    due = labels.filter((F.col("worker_status") == "retry_wait") & (F.col("next_retry_us") <= now_us)).join(p, "quality_reason_code")
    return due.orderBy("next_retry_us", "event_id").limit(n).select("event_id", "quality_reason_code", "retry_count", "next_retry_us", "max_retries")


def upsert_latest(target: DataFrame, batch: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """``target`` with the columns ``owned`` taken from ``batch`` where it has the key; other columns survive, new keys are added."""
    t, b = target.withColumn("_in", F.lit(True)), batch.select(key, *(F.col(c).alias(f"_{c}") for c in batch.columns if c != key), F.lit(True).alias("_new"))
    j = t.join(b, key, "full")
    pick = lambda c: F.when(F.col("_new") & (F.lit(c in owned) | F.col("_in").isNull()), F.col(f"_{c}")).otherwise(F.col(c)) if f"_{c}" in b.columns else F.col(c)
    return j.select(*(F.col(c) if c == key else pick(c).alias(c) for c in target.columns))


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``target`` and the rows of ``batch`` whose key it lacks, one for each key."""
    return target.unionByName(batch.dropDuplicates([key]).join(target.select(key), key, "left_anti"))


#: Key ranges of the digests that two runs are compared by, and the digests that one node of the tree has below it.
LEAVES, FAN = 4096, 64


def range_digests(rows: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """(node, leaf, digest, n): an order-free digest of the rows of each range of key hashes, the same for the same bag of rows. A row's digest is of its columns in the order of their names."""
    columns = sorted(rows.columns)
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    # exact sums of two halves tell bags apart, where equal rows would cancel each other in exclusive ones
    half = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    leaf = F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")
    told = rows.select(leaf.alias("leaf"), half(0).alias("a"), half(1).alias("b")).groupBy("leaf").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    return told.select((F.col("leaf") / FAN).cast("int").alias("node"), "leaf", F.concat_ws("-", "a", "b").alias("digest"), "n")


def differing_leaves(a: DataFrame, b: DataFrame, keys: list[str], leaves: int = LEAVES) -> list[int]:
    """Key ranges whose bags of rows differ: nodes of FAN ranges first, then the ranges of those that differ. At most ``leaves`` numbers."""
    x, y = range_digests(a, keys, leaves), range_digests(b, keys, leaves)
    both = x.select("node", "leaf", F.col("digest").alias("d"), "n").join(y.select("node", "leaf", F.col("digest").alias("e"), F.col("n").alias("m")), ["node", "leaf"], "full")
    nodes = both.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("leaf", "d", "n"))).alias("l"), F.sort_array(F.collect_list(F.struct("leaf", F.col("e").alias("d"), F.col("m").alias("n")))).alias("r"), F.collect_list(F.when(~(F.col("d").eqNullSafe(F.col("e")) & F.col("n").eqNullSafe(F.col("m"))), F.col("leaf"))).alias("other"))
    return sorted(leaf for r in nodes.filter(~F.col("l").eqNullSafe(F.col("r"))).select("other").collect() for leaf in r.other)


def regression_diff(a: DataFrame, b: DataFrame, keys: list[str], *, leaves: int = LEAVES) -> DataFrame:
    """Rows only in one of two runs, with the side and how often.

    Runs are compared by digests of key ranges, which costs no shuffle of rows; rows of ranges that differ alone are compared one by one. Columns
    must be the same, in any order; rows with a null key are compared too.
    """
    b = b.select(*(F.col(f"`{c}`") for c in a.columns))
    other = differing_leaves(a, b, keys, leaves)
    leaf = F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")
    # a set of numbers as bits, so that the filter stays short whatever their number
    bits = [0] * (-(-leaves // 63))
    for x in other:
        bits[x // 63] |= 1 << x % 63
    wanted = F.array(*(F.lit(x).cast("long") for x in bits))
    some = lambda rows: rows.filter(F.expr("true") if len(other) == leaves else F.getbit(F.get(wanted, (leaf / 63).cast("int")), (leaf % 63).cast("int")) == 1)
    sided = some(a).withColumn("_w", F.lit(1)).union(some(b).withColumn("_w", F.lit(-1)))
    net = sided.groupBy(*(F.col(f"`{c}`") for c in a.columns)).agg(F.sum("_w").alias("_w")).filter("_w <> 0")
    return net.select(*(F.col(f"`{c}`") for c in a.columns), F.abs("_w").cast("long").alias("n"), F.when(F.col("_w") > 0, "only_a").otherwise("only_b").alias("side"))


def quality_ratio(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("label_quality").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))
