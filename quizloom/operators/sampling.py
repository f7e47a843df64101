"""Hash-seeded sampling, splits, sets and positions.

Every draw is a hash of (seed, key), so a sample or split is a pure function
of the data and does not depend on partitioning or task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.hashing import u


def hash_order(seed, *keys) -> Column:
    """L1: seeded shuffle key."""
    return u(seed, *[F.col(k) if isinstance(k, str) else k for k in keys])


def top_n_by_hash(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """The n distinct keys with the smallest hash (a sampling operator:
    the limit is the feature).  TakeOrderedAndProject keeps n rows per task; the hash is a column, so that a
    row's is worked out once and not in each comparison."""
    return (df.select(key).distinct().withColumn("_hash", hash_order(seed, F.lit("ids"), key))
            .orderBy("_hash", key).limit(n).drop("_hash"))


def holdout_split(df: DataFrame, key: str, n_valid: int, seed=42) -> DataFrame:
    """L3: fixed-size holdout: the n smallest-hash keys are 'valid', the rest 'train'.

    The valid id set is bounded by ``n_valid`` (a parameter), so it is broadcast.
    """
    valid = top_n_by_hash(df, key, n_valid, seed).withColumn("_v", F.lit(True))
    return (df.join(F.broadcast(valid), key, "left")
            .withColumn("split", F.when(F.col("_v"), F.lit("valid")).otherwise(F.lit("train"))).drop("_v"))


def sample_groups(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """L5 + J5: keep all rows of n hash-sampled groups (semi-join on a bounded id list)."""
    return df.join(F.broadcast(top_n_by_hash(df, key, n, seed)), key, "left_semi")


def n_per_group(df: DataFrame, key: str, order_key: Column, n: int = 1) -> DataFrame:
    """N rows per group by hash order.  n = 1 is a ``min_by`` aggregate
    (map-side combine, so a hot group never lands whole in one task)."""
    if n == 1:
        cols = [c for c in df.columns if c != key]
        best = df.groupBy(key).agg(F.min_by(F.struct(*cols), order_key).alias("_b"))
        return best.select(key, *[F.col("_b")[c].alias(c) for c in cols]).select(*df.columns)
    w = Window.partitionBy(key).orderBy(order_key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def oversample(df: DataFrame, need: int, count: int) -> DataFrame:
    """Replicate every row ceil(2 * need / count) times, with a replica id for seeding."""
    reps = max(1, -(-2 * need // max(count, 1)))
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def weighted_keys(weight: Column, uni: Column) -> Column:
    """Efraimidis-Spirakis race key ``-ln(u)/w``; the k smallest keys are a
    weighted sample without replacement."""
    return -F.log(uni) / weight


def global_position(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """W9 helper: 0-based position in a global order without a single-task window.

    Rows are range-partitioned by the order and numbered within each partition.  The
    numbered rows are written once and both the offsets and the result read that table:
    range boundaries are sampled, so two exchanges of the same rows need not agree.
    """
    from quizloom.sources.files import stored
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = df.repartitionByRange(buckets, *order_cols).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    p = stored(p.withColumn("_rn", F.row_number().over(w) - 1), "positions")
    cnt = p.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    off = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return p.join(F.broadcast(off), "_pid").withColumn("position", (F.col("_off") + F.col("_rn")).cast("long")) \
        .drop("_pid", "_rn", "_off")


def debug_subset(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)
