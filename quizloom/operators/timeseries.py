"""Time-ordered operators over an event history.

``events(user_id, ts, event_type, value)`` plays an ICU stay: the user is the
stay, ``error`` events are the clinical event, and 8-hour slots from the user's
own first event on form the slot grid.  Per-user state is never gathered
unbounded: events are first aggregated to (user, slot) or (user, hour) rows,
so a user's group holds at most one row per slot/hour of the time span,
however many raw events it has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.text import format_number

# Slot grid of the horizon task.
SLOT_SECONDS = 8 * 3600
N_SLOTS = 24                       # 8 days x 3 slots of flags
TEXT_DAYS = 7                      # text covers days 1..7
HORIZON = 6                        # 6 slots = 48 hours, current slot included
EVENT = "error"
QUESTION_HORIZON = "Q. Would an error occur in the next 48 hours?"


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_slots(events: DataFrame) -> DataFrame:
    """``slot_idx``, the 0-based 8-hour slot since the user's own first one (day 1 starts there).

    The first slot is a partial aggregate joined back, so no user is gathered in one task.
    """
    slot = F.floor(epoch_micros(F.col("ts")) / F.lit(SLOT_SECONDS * 1_000_000))
    first = events.groupBy("user_id").agg(F.min(slot).alias("_origin"))
    return events.join(first, "user_id").withColumn("slot_idx", (slot - F.col("_origin")).cast("int")).drop("_origin")


def slot_header(day: Column, t: Column) -> Column:
    """``[Day d HH:00 - HH:00]``."""
    return F.format_string("[Day %d %02d:00 - %02d:00]", day, (t - 1) * 8, t * 8)


def slot_flags(events: DataFrame) -> DataFrame:
    """(user_id, slot_idx, flag) on the full 24-slot grid; a slot with no rows has a null flag."""
    ev = with_slots(events.select("user_id", "ts", "event_type"))
    flags = (ev.where(F.col("slot_idx").between(0, N_SLOTS - 1))
             .groupBy("user_id", "slot_idx").agg(F.max((F.col("event_type") == EVENT).cast("int")).alias("flag")))
    grid = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(N_SLOTS - 1))).alias("slot_idx"))
    return grid.join(flags, ["user_id", "slot_idx"], "left")


def horizon_labels(flags: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Any event in slots [s, s + horizon) (clipped at the grid end).

    ``label_strict``: a null flag anywhere in the frame makes the label false
    (the reference's NaN sum); ``label_ignore``: nulls are skipped.
    """
    w = Window.partitionBy("user_id").orderBy("slot_idx").rowsBetween(0, horizon - 1)
    s = F.sum("flag").over(w)
    nulls = F.count(F.lit(1)).over(w) - F.count("flag").over(w)
    return flags.select("user_id", "slot_idx",
                        ((nulls == 0) & (s >= 1)).alias("label_strict"),
                        F.coalesce(s >= 1, F.lit(False)).alias("label_ignore"))


def sections(events: DataFrame) -> DataFrame:
    """(user_id, sec_ord, header, body) for every slot section and daily section of days 1..7.

    Slot section (d, t): one line per non-event type, ``type: sum(value)``;
    daily section ``[Day d]``: ``type count: n``.  ``body`` is null when empty.
    """
    last_slot = TEXT_DAYS * 3 - 1
    ev = (with_slots(events).where(F.col("slot_idx").between(0, last_slot) & (F.col("event_type") != EVENT)))
    sl = (ev.groupBy("user_id", "slot_idx", "event_type").agg(F.sum("value").alias("v"))
          .groupBy("user_id", "slot_idx")
          .agg(F.sort_array(F.collect_list(F.struct("event_type", F.format_string("%s: %.2f", "event_type", "v").alias("line"))))
               .alias("ls")))
    sl = sl.select("user_id", (F.floor(F.col("slot_idx") / 3) * 4 + F.col("slot_idx") % 3).cast("int").alias("sec_ord"),
                   F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"))
    dl = (ev.withColumn("day", (F.floor(F.col("slot_idx") / 3) + 1).cast("int"))
          .groupBy("user_id", "day", "event_type").agg(F.count(F.lit(1)).alias("n"))
          .groupBy("user_id", "day")
          .agg(F.sort_array(F.collect_list(F.struct("event_type", F.format_string("%s count: %d", "event_type", "n").alias("line"))))
               .alias("ls")))
    dl = dl.select("user_id", ((F.col("day") - 1) * 4 + 3).cast("int").alias("sec_ord"),
                   F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"))
    grid = events.select("user_id").distinct().select(
        "user_id", F.explode(F.sequence(F.lit(0), F.lit(TEXT_DAYS * 4 - 1))).alias("sec_ord"))
    day = (F.floor(F.col("sec_ord") / 4) + 1).cast("int")
    k = (F.col("sec_ord") % 4).cast("int")
    header = F.when(k == 3, F.format_string("[Day %d]", day)).otherwise(slot_header(day, k + 1))
    return grid.join(sl.unionByName(dl), ["user_id", "sec_ord"], "left").select(
        "user_id", "sec_ord", header.alias("header"), "body")


def prefix_prompts(secs: DataFrame) -> DataFrame:
    """W4 + W5 + W7: the expanding text up to each question section.

    Questions: slot sections t = 1, 2 (not day 1 slot 1) on leaving the slot;
    the t = 3 question after the daily section.  Every section up to and
    including the question's own must be non-empty (stop at first gap).
    """
    w = Window.partitionBy("user_id").orderBy("sec_ord").rowsBetween(Window.unboundedPreceding, 0)
    txt = F.concat(F.lit("\n"), F.col("header"), F.lit("\n"), F.col("body"), F.lit("\n"))
    k = F.col("sec_ord") % 4
    day = F.floor(F.col("sec_ord") / 4)
    slot_idx = F.when(k == 3, day * 3 + 2).otherwise(day * 3 + k).cast("int")
    is_q = (k == 3) | ((k < 2) & (F.col("sec_ord") != 0))
    s = (secs.withColumn("_ok", F.min(F.col("body").isNotNull().cast("int")).over(w))
         .withColumn("prefix", F.array_join(F.collect_list(txt).over(w), "")))
    return s.where(is_q & (F.col("_ok") == 1)).select("user_id", slot_idx.alias("slot_idx"), "prefix")


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (whitespace at both ends)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def horizon_questions(prefix: DataFrame, labels: DataFrame, coin: Column) -> DataFrame:
    """Binary horizon question, option order flipped by a hash coin."""
    q = prefix.join(labels, ["user_id", "slot_idx"])
    yes_first = coin > 0.5
    opts = F.when(yes_first, F.lit("\nA.yes\nB.no")).otherwise(F.lit("\nA.no\nB.yes"))
    lab = F.col("label_strict")
    return q.select(
        "user_id", "slot_idx",
        strip_ws(F.concat(F.col("prefix"), F.lit("\n" + QUESTION_HORIZON), opts)).alias("user_message"),
        F.when(yes_first, F.when(lab, "A").otherwise("B")).otherwise(F.when(lab, "B").otherwise("A")).alias("label_0"),
        F.when(yes_first, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(F.lit("no"), F.lit("yes"))).alias("choices_0"))


# ---------------------------------------------------------------- hourly trajectory
# Trajectory features (display name, aggregate over the hour's events).
TRAJ_FEATURES = [("events", "Events"), ("errors", "Errors"), ("purchases", "Purchases"),
                 ("total_value", "Total value"), ("max_value", "Max value")]
STATIC = [("first_event", "First event"), ("first_value", "First value")]


def trajectory(events: DataFrame) -> DataFrame:
    """(user_id, charttime epoch s, onset epoch s, features...) one row per active hour."""
    hour = F.floor(epoch_micros(F.col("ts")) / F.lit(3_600_000_000)).cast("long")
    ev = events.select("user_id", "ts", "event_type", "value", hour.alias("hour"))
    rows = ev.groupBy("user_id", "hour").agg(
        F.count(F.lit(1)).cast("double").alias("events"),
        F.sum((F.col("event_type") == "error").cast("int")).cast("double").alias("errors"),
        F.sum((F.col("event_type") == "purchase").cast("int")).cast("double").alias("purchases"),
        F.round(F.sum("value"), 2).alias("total_value"),
        F.max("value").alias("max_value"))
    per_user = ev.groupBy("user_id").agg(
        F.coalesce(F.min(F.when(F.col("event_type") == EVENT, F.col("hour"))), F.min("hour")).alias("onset_hour"),
        F.min_by("event_type", F.struct("ts", "event_type", "value")).alias("first_event"),
        F.min_by("value", F.struct("ts", "event_type", "value")).alias("first_value"))
    return rows.join(per_user, "user_id").select(
        "user_id", (F.col("hour") * 3600).alias("charttime"), (F.col("onset_hour") * 3600).alias("onset"),
        *[v for v, _ in STATIC + TRAJ_FEATURES])


def time_block(charttime: Column, onset: Column) -> Column:
    """W8 + C5: ``\\n[Time: Onset+Hh]\\n`` and the formatted feature lines of one row."""
    h = F.floor((charttime - onset) / 3600).cast("long")
    hs = F.when(h < 0, h.cast("string")).otherwise(F.concat(F.lit("+"), h.cast("string")))
    lines = [F.when(F.col(v).isNotNull(), F.concat(F.lit(f"{name}: "), format_number(F.col(v).cast("string")), F.lit("\n")))
             for v, name in TRAJ_FEATURES]
    return F.concat(F.lit("\n[Time: Onset"), hs, F.lit("h]\n"), F.concat_ws("", *lines))


def static_header(first_row: Column | None = None) -> Column:
    return F.concat(F.lit("[Patient Information]\n"),
                    *[F.concat(F.lit(f"{name}: "), format_number(F.col(v).cast("string")), F.lit("\n")) for v, name in STATIC])


def trajectory_text(traj: DataFrame, cutoff_seconds: int | None = None) -> DataFrame:
    """Per-user text = static header + time blocks in time order.

    With ``cutoff_seconds`` (F9) rows within that many seconds of the user's
    last row are left out.
    """
    block = F.struct("charttime", time_block(F.col("charttime"), F.col("onset")).alias("b"))
    t = traj.groupBy("user_id").agg(F.max("charttime").alias("_last"), F.sort_array(F.collect_list(block)).alias("_bs"),
                                    *[F.first(v).alias(v) for v, _ in STATIC])
    blocks = F.col("_bs")
    if cutoff_seconds is not None:
        blocks = F.filter(blocks, lambda x: F.col("_last") - x["charttime"] >= cutoff_seconds)
    return t.select("user_id", F.concat(static_header(), F.array_join(F.transform(blocks, lambda x: x["b"]), "")).alias("text"))


# Forms of slot columns (day and slot, day alone).
SLOT_NAME, DAY_NAME = r"d(\d+)_(\d+)_(.+)", r"d(\d+)_(.+)"


def slot_columns(columns: list[str]) -> list[tuple[str, int | None, int | None, str]]:
    """(column, day, slot, variable) read off the names; a name of neither form has no day."""
    out = []
    for c in columns:
        if m := re.fullmatch(SLOT_NAME, c):
            out.append((c, int(m[1]), int(m[2]), m[3]))
        elif m := re.fullmatch(DAY_NAME, c):
            out.append((c, int(m[1]), None, m[2]))
        else:
            out.append((c, None, None, c))
    return out


def slot_rows(df: DataFrame, id_col: str) -> DataFrame:
    """A wide table with slot columns as rows (id, day, slot, variable, value), nulls left out; values as text.

    One pass over the wide rows: a row's cells become an array, whose length the schema bounds.
    """
    known = [x for x in slot_columns([c for c in df.columns if c != id_col]) if x[1] is not None]
    cells = F.array(*[F.struct(F.lit(d).cast("int").alias("day"), F.lit(t).cast("int").alias("slot"), F.lit(v).alias("variable"),
                               F.col(c).cast("string").alias("value")) for c, d, t, v in known])
    return df.select(id_col, F.inline(F.filter(cells, lambda x: x["value"].isNotNull())))


def slot_table(rows: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """P32 back: the wide table with ``columns`` (name to type), for the ids that have a row."""
    def cell(c, d, t, v):
        at = (F.col("day") == d) & F.col("slot").eqNullSafe(F.lit(t).cast("int")) & (F.col("variable") == v)
        return F.max(F.when(at, F.col("value"))).cast(columns[c]).alias(c)
    return rows.groupBy(id_col).agg(*[cell(*x) for x in slot_columns(list(columns)) if x[1] is not None])
