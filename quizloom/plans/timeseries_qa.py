"""Time-series question plans over ``events`` (W3/W4/W7, M11-M13, T5) and the
order outcome chain (J3/J4, M13) and two-target outcome union (M14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.functions.hashing import u
from quizloom.operators import timeseries as ts
from quizloom.operators.distractors import choose_distractors
from quizloom.plans.registry_qa import build_profile
from quizloom.sources.files import stored
from quizloom.sources.tables import table

SEED = 42


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_type", "value")


def horizon_label(spark, sf) -> DataFrame:
    return ts.horizon_labels(ts.slot_flags(events(spark, sf)))


def prefix_prompts(spark, sf) -> DataFrame:
    return ts.prefix_prompts(ts.sections(events(spark, sf)))


def horizon_question(spark, sf) -> DataFrame:
    ev = events(spark, sf)
    pre = ts.prefix_prompts(ts.sections(ev))
    lab = ts.horizon_labels(ts.slot_flags(ev))
    return ts.horizon_questions(pre, lab, u(SEED, "coin", F.col("user_id"), F.col("slot_idx")))


def horizon_sample(spark, sf, n_ids: int = 1000) -> DataFrame:
    """L5 + L6: questions of ``n_ids`` hash-sampled users, one question per user."""
    q = horizon_question(spark, sf)
    ids = (q.select("user_id").distinct()
           .orderBy(u(SEED, "ids", F.col("user_id")), "user_id").limit(n_ids))     # top-n by hash: the sampling feature
    q = q.join(F.broadcast(ids), "user_id", "left_semi")                          # n_ids rows, bounded by the parameter
    w = Window.partitionBy("user_id").orderBy(u(SEED, "one", F.col("user_id"), F.col("slot_idx")))
    return q.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trajectory_text(spark, sf) -> DataFrame:
    return ts.trajectory_text(ts.trajectory(events(spark, sf)))


def stay_having(traj: DataFrame) -> DataFrame:
    """F8 + A13: users whose span >= 48 h and who have a row exactly 24 h before their last."""
    ends = traj.groupBy("user_id").agg(F.max("charttime").alias("last_time"), F.min("charttime").alias("first_time"))
    day_before = traj.select("user_id", (F.col("charttime") + 86400).alias("last_time"))
    return ends.where(F.col("last_time") - F.col("first_time") >= 48 * 3600).join(day_before, ["user_id", "last_time"], "left_semi")


def forecast_question(spark, sf, seed: int = SEED) -> DataFrame:
    """Per kept user and feature, predict the last row's value from the
    history that ends 24 h earlier; distractors from the trajectory profile."""
    traj = stored(ts.trajectory(events(spark, sf)), "trajectory")   # read for profile, users, last rows and texts
    feats = [v for v, _ in ts.TRAJ_FEATURES]
    wide = traj.select(F.concat_ws("|", "user_id", "charttime").alias("record_id"),
                       *[F.col(v).cast("string").alias(v) for v in feats])
    prof = build_profile(wide, feats, gm_method="terciles")
    keep = stay_having(traj).select("user_id")
    t = traj.join(keep, "user_id", "left_semi")
    last = t.groupBy("user_id").agg(*[F.max_by(v, "charttime").alias(v) for v in feats])    # A14
    arr = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("string").alias("label_raw")) for v in feats])
    q = (last.select("user_id", F.explode(arr).alias("_t")).select("user_id", "_t.*")
         .where(F.col("label_raw").isNotNull())
         .withColumn("qid", F.concat_ws("|", F.col("user_id").cast("string"), F.col("var"))))
    q = choose_distractors(stored(q, "targets"), prof.summary, prof.gm, prof.vocab, prof.all_vocab, seed=seed)
    # no shuffle: label inserted into the sorted choices at a hash position
    q = q.withColumn("label_idx", F.floor(u(seed, "pos", F.col("qid")) * (F.size("choices") + 1)).cast("int"))
    q = q.withColumn("options", F.expr("array_insert(choices, label_idx + 1, label)")).where(F.size("options") >= 2)
    text = ts.trajectory_text(t, cutoff_seconds=86400)
    names = F.create_map(*[x for v, n in ts.TRAJ_FEATURES for x in (F.lit(v), F.lit(n))])
    question = F.format_string("\nQ. What will the %s value likely be 24 hours after the last records?",
                               F.element_at(names, F.col("var")))
    opts = F.expr("array_join(transform(options, (c, i) -> concat('\\n', char(65 + i), '. ', c)), '')")
    return q.join(text, "user_id").select(
        "user_id", F.concat(F.col("text"), question, opts).alias("user_message"),
        F.expr("char(65 + label_idx)").alias("label_0"), F.element_at(names, F.col("var")).alias("task"),
        F.col("options").alias("choices_0"))


# ---------------------------------------------------------------- order outcome chain
OUTCOME_DAYS = 30
QUESTION_OUTCOME = "Q. Is the order likely to ship within 30 days?\nA. Yes\nB. No"


def outcome_chain(spark, sf) -> DataFrame:
    """J3 + J4 + C10: orders ⋈ customer ⋈ nation with the outcome label
    (first ship date - order date <= 30 days; a negative gap counts)."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
         .join(li, o.o_orderkey == li.l_orderkey))
    gap = F.datediff(F.col("first_ship").cast("date"), F.col("o_orderdate").cast("date"))
    return j.select("o_orderkey", "o_orderdate", "c_mktsegment", "n_name",
                    F.coalesce(gap <= OUTCOME_DAYS, F.lit(False)).alias("label"))


def outcome_question(spark, sf) -> DataFrame:
    """What is known when the order is placed (one block per line, at onset) + binary outcome
    question.  Ship dates lie after that cut and would tell the answer, so they stay out."""
    ch = outcome_chain(spark, sf)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    feats = [("l_quantity", "Quantity"), ("l_extendedprice", "Extended price"), ("l_discount", "Discount"), ("l_tax", "Tax")]
    from quizloom.functions.text import format_number
    block = F.concat(F.lit("\n[Time: Onset+0h]\n"),
                     *[F.concat(F.lit(f"{n}: "), format_number(F.col(v).cast("string")), F.lit("\n")) for v, n in feats])
    blocks = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", block.alias("b")))).alias("bs"))
    head = F.concat(F.lit("[Patient Information]\nSegment: "), F.col("c_mktsegment"), F.lit("\nNation: "), F.col("n_name"),
                    F.lit("\n"))
    return ch.join(blocks, ch.o_orderkey == blocks.l_orderkey).select(
        F.col("o_orderkey").alias("record_id"),
        F.concat(head, F.array_join(F.transform("bs", lambda x: x["b"]), ""), F.lit(QUESTION_OUTCOME)).alias("user_message"),
        F.when(F.col("label"), "A").otherwise("B").alias("label_0"),
        F.lit("ship30").alias("task"), F.array(F.lit("Yes"), F.lit("No")).alias("choices_0"))


def slot_wide(spark, sf):
    """A wide table of slot columns: a user's days 1 to 3 by slots of eight hours, events and last value of each."""
    e = table(spark, sf, "events").select("user_id", "value", "event_id", F.pmod(F.dayofmonth("ts"), F.lit(3)).alias("d"),
                                          F.floor(F.hour("ts") / 8).alias("t"))
    cells = []
    for d in range(1, 4):
        day = F.col("d") == d - 1
        cells.append(F.nullif(F.count(F.when(day, 1)), F.lit(0)).alias(f"d{d}_events"))
        for t in range(1, 4):
            here = day & (F.col("t") == t - 1)
            cells += [F.max(F.when(here, F.col("event_id"))).alias(f"d{d}_{t}_last_event"),
                      F.round(F.max(F.when(here, F.col("value"))), 4).alias(f"d{d}_{t}_top")]
    return e.groupBy("user_id").agg(*cells)


def slot_rows(spark, sf):
    """Slot columns read into (day, slot, variable) rows."""
    return ts.slot_rows(slot_wide(spark, sf), "user_id")


def slot_round_trip(spark, sf):
    """The wide table, from its rows again."""
    wide = slot_wide(spark, sf)
    return ts.slot_table(ts.slot_rows(wide, "user_id"), "user_id", {c: k for c, k in wide.dtypes if c != "user_id"})
