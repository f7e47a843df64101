"""Sampling, set, filter and join plans (L*, U*, F*, J*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.hashing import u
from quizloom.operators import notes as N
from quizloom.operators import sampling as S
from quizloom.sources.registry import registry
from quizloom.sources.tables import table

SEED = 42


def holdout_split(spark, sf):
    """L3: 1000 hash-smallest records are 'valid', the rest 'train'."""
    reg = registry(spark, sf).select("record_id")
    return S.holdout_split(reg, "record_id", 1000, SEED)


def sample_groups(spark, sf):
    """L5 + J5: every event of 20 hash-sampled users."""
    ev = table(spark, sf, "events").select("event_id", "user_id")
    return S.sample_groups(ev, "user_id", 20, SEED)


def one_per_group(spark, sf):
    """One order per customer by hash order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.n_per_group(o, "o_custkey", u(SEED, "one", F.col("o_orderkey")), 1)


def oversample_dedupe(spark, sf):
    """L7 + U2: replicate to >= 2x need with a replica id in the seed, then keep
    one row per distinct message (the smallest (doc_id, replica))."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    count = d.count()
    rep = S.oversample(d, need=count, count=count)
    tag = F.chr(F.lit(65) + F.floor(u(SEED, "rep", F.col("doc_id"), F.col("replica")) * 2).cast("int"))
    m = rep.withColumn("message", F.concat(tag, F.lit(": "), F.col("text")))
    best = m.groupBy(F.md5("message").alias("msg_md5")).agg(F.min(F.struct("doc_id", "replica")).alias("k"))
    return best.select("msg_md5", F.col("k.doc_id").alias("doc_id"), F.col("k.replica").alias("replica"))


def weighted_draw(spark, sf):
    """3 lines per order drawn without replacement, weight = extended price
    (exponential-race keys; the group is one order's lines)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    key = S.weighted_keys(F.col("l_extendedprice"),
                          u(SEED, "wd", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")))
    w = Window.partitionBy("l_orderkey").orderBy(key, "l_linenumber", "l_partkey", "l_suppkey")
    return li.withColumn("rank", F.row_number().over(w)).where("rank <= 3").drop("l_extendedprice")


def shuffle_head(spark, sf):
    """L1 + L2: seeded shuffle, first 100 (TakeOrderedAndProject)."""
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.orderBy(u(SEED, "shuf", F.col("o_orderkey")), "o_orderkey").limit(100)


def union_tasks(spark, sf):
    """Union of task datasets with different columns (by name, missing -> null)."""
    from quizloom.plans.timeseries_qa import horizon_question, outcome_question
    h = horizon_question(spark, sf).withColumn("task", F.lit("horizon"))
    o = outcome_question(spark, sf)
    return h.unionByName(o, allowMissingColumns=True)


def set_diff(spark, sf):
    """Customers without an urgent order (anti-join on distinct keys)."""
    c = table(spark, sf, "customer").select("c_custkey").distinct()
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


def cohort_filter(spark, sf):
    """status != 'P' (pandas keeps nulls) and urgent priority."""
    reg = registry(spark, sf)
    return reg.where(~F.col("status").eqNullSafe("P") & (F.col("priority") == "1-URGENT")).select("record_id")


def temporal_cohort(spark, sf):
    """order date before first shipment, and the (sometimes missing) last
    shipment missing or after the first."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("fu"), F.max("l_shipdate").alias("ev0"))
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    ev = F.when(u(SEED, "ev", F.col("o_orderkey")) < 0.3, F.lit(None)).otherwise(F.col("ev0"))
    return j.where((F.col("o_orderdate") < F.col("fu")) & (ev.isNull() | (F.col("fu") < ev))).select("o_orderkey")


def token_len_filter(spark, sf):
    """F6 + L8: texts under the token limit, shuffled, first n: never fewer than there are."""
    n, limit = 100, 2000
    d = table(spark, sf, "documents").select("doc_id", "text")
    k = u(SEED, "tl", F.col("doc_id"))
    return d.where(N.token_count("text") < limit).select("doc_id").orderBy(k, "doc_id").limit(n)


def drop_null_cols(spark, sf):
    """drop columns that are null in every row (one aggregate for all columns)."""
    reg = registry(spark, sf).withColumn("never_set", F.lit(None).cast("string"))
    counts = reg.agg(*[F.count(c).alias(c) for c in reg.columns]).first().asDict()
    return reg.select(*[c for c in reg.columns if counts[c] > 0])


def left_lookup(spark, sf):
    """Left join on differently named keys, right side pruned."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name")


def positional_zip(spark, sf):
    """Row i of one table with row i of another (explicit positions)."""
    p = S.global_position(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"])
    s = S.global_position(table(spark, sf, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])
    return p.join(s, "position").select("position", "p_name", "s_name")


def first_rows(df: DataFrame, n: int, order: list) -> DataFrame:
    """L2 for any ``n``: rows are numbered by ranges, so that no task holds ``n`` of them."""
    return S.global_position(df, order).where(F.col("position") < n).drop("position")


def within_limits(df: DataFrame, want: int, limits: list, order: list) -> DataFrame:
    """F6 + L8: ``want`` rows in ``order``.  Only of a table with more rows than that: the first 4 * ``want``, and of
    those the rows under every limit, one limit after the other.  Which case holds is a subquery of the plan."""
    spare = df.agg((F.count("*") > want).alias("spare")).scalar()
    first = first_rows(df.where(spare), 4 * want, order)
    for size, limit in limits:
        first = first.where(size < limit)
    return first_rows(first, want, order).unionByName(df.where(~spare))


def _limited(spark, sf, want: int):
    d = table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL") \
        .withColumn("prompt", F.concat_ws("\n", F.lit("Read the note."), F.substring_index("text", "\n", 1))) \
        .withColumn("_u", u(SEED, "two", F.col("doc_id")))
    limits = [(N.token_count("prompt"), 120), (N.token_count("text"), 900)]
    return within_limits(d, want, limits, ["_u", "doc_id"]).select("doc_id", N.token_count("text").cast("long").alias("n_tokens"))


def two_limits(spark, sf):
    """more notes than asked for: a prompt limit, then a text limit."""
    return _limited(spark, sf, 60)


def two_limits_short(spark, sf):
    """fewer notes than asked for: none is filtered."""
    return _limited(spark, sf, 100_000_000)
