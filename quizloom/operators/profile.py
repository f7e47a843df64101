"""Column profiling in one pass over the long (record, var, value) form.

A1 distinct values, A2 weights, A3 type inference, A4 FLOAT_RATIO, A6 distinct
thresholds, A8 numeric shape, F11 suppression rules.  All columns are profiled
by the same two aggregations (``groupBy(var, value)`` then ``groupBy(var)``),
never one job per column; the second runs on the (small) distinct-value table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.missing import is_missing

# Profiling thresholds.
MAX_CATEGORICAL_FLOATS = 20        # <= this many distinct floats -> all keys categorical
MAX_STRINGS_BEFORE_RULES = 20      # > this many string keys -> date/text suppression rules apply
DATE_LIKE = r"date|time|dat_ou"
# Free-text column names that are never profiled.
TEXT_COLUMNS = ["Unique ID", "record_id", "sepsisinkcd", "othernonsurgprocedure", "operationname",
                "gramposot", "gramnegot", "bacposspecot", "fugusot"]
CUM_BUCKETS = 64


def unpivot_long(df: DataFrame, id_col: str, vars_: list[str]) -> DataFrame:
    """Wide row -> (id, var, value) rows; values as text."""
    return df.select(id_col, *[F.col(v).cast("string").alias(v) for v in vars_]).unpivot(
        id_col, vars_, "var", "value")


def col_values(long: DataFrame) -> DataFrame:
    """A1: one row per (var, value) with its row count; missing values collapse to value = null.

    Map-side partial aggregation makes this a combine-then-shuffle of at most
    (#distinct values) rows per task.
    """
    v = F.when(~is_missing("value"), F.col("value"))
    return long.groupBy("var", v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def col_stats(values: DataFrame, text_columns=TEXT_COLUMNS) -> DataFrame:
    """Per-column statistics and the keep/skip decision."""
    d = F.col("value").try_cast("double")
    present = F.col("value").isNotNull()
    s = values.groupBy("var").agg(
        F.sum(F.when(present, 1).otherwise(0)).cast("long").alias("n_keys"),
        F.max(F.when(~present, 1).otherwise(0)).alias("has_missing"),
        F.count(d).cast("long").alias("n_float_keys"),
        F.count_distinct(d).cast("long").alias("n_float_distinct"),
        F.sum(F.when(d >= 0, 1).otherwise(0)).cast("long").alias("n_pos_keys"),
        F.sum(F.when(F.floor(d) == d, 1).otherwise(0)).cast("long").alias("n_int_keys"),
        F.sum(F.when(present, F.col("n")).otherwise(0)).cast("long").alias("n_rows"),
        F.min(d).alias("num_min"), F.max(d).alias("num_max"),
    )
    numeric = F.col("n_float_distinct") > MAX_CATEGORICAL_FLOATS
    n_str = F.col("n_keys") - F.when(numeric, F.col("n_float_keys")).otherwise(0)
    date_like = F.col("var").rlike(DATE_LIKE) | (F.col("var") == "tzdt")
    texty = F.col("var").endswith("desc") | F.col("var").isin(*text_columns)
    keep = ((F.col("n_keys") + F.col("has_missing")) > 1) & ~((n_str > MAX_STRINGS_BEFORE_RULES) & (date_like | texty))
    return s.select(
        "var", "n_keys", "n_rows", "num_min", "num_max",
        numeric.alias("is_numeric"),
        n_str.cast("long").alias("n_vocab"),
        F.when(numeric, F.col("n_float_keys") / F.col("n_keys")).otherwise(F.lit(0.0)).alias("float_ratio"),
        (numeric & (F.col("n_pos_keys") > F.col("n_float_keys") * 0.95)).alias("drop_negative"),
        (numeric & (F.col("n_int_keys") > F.col("n_float_keys") * 0.9)).alias("round_int"),
        keep.alias("keep"),
    )


def bucket_of(c, buckets: int = CUM_BUCKETS):
    """Stable bucket of a text key (md5 based so SQL can reproduce it)."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, 7), 16, 10).cast("long"), F.lit(buckets))


def group_cumsum(df: DataFrame, group: str, key: str, weight: str, buckets: int = CUM_BUCKETS) -> DataFrame:
    """Exclusive running sum of ``weight`` per ``group`` in (bucket(key), key) order -> column ``lo``.

    Rows of one group are spread over ``buckets`` window partitions so a group
    holding a third of all distinct keys still sorts in parallel; the bucket
    offsets come from a (group x buckets)-row table.
    """
    b = df.withColumn("_b", bucket_of(F.col(key), buckets))
    w_in = Window.partitionBy(group, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = b.withColumn("_lo_in", F.coalesce(F.sum(weight).over(w_in), F.lit(0)))
    tot = b.groupBy(group, "_b").agg(F.sum(weight).alias("_tot"))
    w_b = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_tot").over(w_b), F.lit(0))).drop("_tot")
    return (inner.join(off, [group, "_b"])
            .withColumn("lo", (F.col("_off") + F.col("_lo_in")).cast("long"))
            .drop("_b", "_off", "_lo_in"))


def vocab_table(values: DataFrame, stats: DataFrame) -> DataFrame:
    """VOCAB/WEIGHTS in long form: string keys of kept columns, with their weight
    and cumulative count ``lo`` (for exact weighted draws)."""
    kept = stats.where("keep").select("var", "is_numeric")
    v = (values.where(F.col("value").isNotNull())
         .join(F.broadcast(kept), "var")               # one row per column: schema sized
         .where(~F.col("is_numeric") | F.col("value").try_cast("double").isNull())
         .select("var", "value", "n"))
    # per-column totals: one row per column (broadcast), no per-column window task
    tot = v.groupBy("var").agg(F.sum("n").alias("_tot"))
    v = v.join(F.broadcast(tot), "var").withColumn("weight", F.col("n") / F.col("_tot")).drop("_tot")
    return group_cumsum(v, "var", "value", "n")


def all_vocab_table(values: DataFrame, stats: DataFrame) -> DataFrame:
    """ALL_VOCAB in long form with a dense index ``idx`` per column (uniform draws)."""
    kept = stats.where("keep").select("var")
    v = (values.where(F.col("value").isNotNull()).join(F.broadcast(kept), "var")
         .select("var", "value", F.lit(1).alias("one")))
    return group_cumsum(v, "var", "value", "one").withColumnRenamed("lo", "idx").drop("one")


def profile_summary(stats: DataFrame, vocab: DataFrame, all_vocab: DataFrame) -> DataFrame:
    """One row per kept column: FLOAT_RATIO, shape flags and the sizes the draws
    need.  VOCAB/ALL_VOCAB stay in long form (``vocab_table``/``all_vocab_table``)
    so no column's vocabulary is ever gathered into one row."""
    vv = vocab.groupBy("var").agg(F.sum("n").cast("long").alias("vocab_total"))
    na = all_vocab.groupBy("var").agg(F.count(F.lit(1)).cast("long").alias("n_all"))
    return (stats.where("keep").drop("keep")
            .join(vv, "var", "left").join(na, "var", "left")
            .fillna(0, ["vocab_total", "n_all"]))
