"""Question rows over a wide registry.

A question row is the wide record plus (var, label_raw): produced by a narrow
``explode`` of the record's eligible columns, so the record never has to be
re-joined to its questions.  Distractors come from ``choose_distractors``;
``assemble`` shuffles them, inserts the label at a hash-drawn position and
renders the prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions.hashing import u, u_digits
from quizloom.functions.missing import is_missing
from quizloom.operators.distractors import spark_u_sql

# Question templates.
QUESTION_SECTIONED = "Q{}. What would be the masked value of '{}' in section {}?"
QUESTION_FLAT = "Q{}. What would be the masked value of '{}'?"


def explode_targets(reg: DataFrame, id_col: str, vars_: list[str], prof: DataFrame,
                    exclude=("Unique ID",)) -> DataFrame:
    """F3 + M2: one row per (record, profiled column with a usable value).

    Eligible = not null, not "", not "NA" (the reference's victim rule) and the
    column has a profile.  ``prof`` is one row per column (broadcast).
    """
    cand = [v for v in vars_ if v not in exclude and v != id_col]
    arr = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("string").alias("label_raw")) for v in cand])
    t = reg.select("*", F.explode(arr).alias("_t")).select("*", "_t.var", "_t.label_raw").drop("_t")
    t = t.where(F.col("label_raw").isNotNull() & ~F.col("label_raw").isin("", "NA"))
    t = t.join(F.broadcast(prof.select("var")), "var", "left_semi")
    return t.withColumn("qid", F.concat_ws("|", F.col(id_col).cast("string"), F.col("var")))


def assemble(q: DataFrame, text: Column, col_dict, seed: int = 42, sectioned: bool = True,
             q_index: int = 1) -> DataFrame:
    """prompt = record text + question + lettered options; label letter.

    Adds ``options`` (label inserted), ``label_idx``, ``label_0`` (letter) and
    ``user_message``.  ``col_dict`` is the (var, name, section) list.
    """
    names = F.create_map(*[x for v, n, s in col_dict for x in (F.lit(v), F.lit(n))])
    secs = F.create_map(*[x for v, n, s in col_dict for x in (F.lit(v), F.lit(s))])
    options, pos = shuffle_insert(F.col("choices"), F.col("label"), F.col("qid"), seed)
    q = q.withColumn("options", options).withColumn("label_idx", pos)
    if sectioned:
        question = F.format_string(QUESTION_SECTIONED.replace("{}", "%s"), F.lit(str(q_index)),
                                   F.element_at(names, F.col("var")), F.element_at(secs, F.col("var")))
    else:
        question = F.format_string(QUESTION_FLAT.replace("{}", "%s"), F.lit(str(q_index)),
                                   F.element_at(names, F.col("var")))
    return (q.withColumn("label_0", F.expr("char(65 + label_idx)"))
            .withColumn("user_message", F.concat(text, F.lit("\n"), question, F.lit("\n"), render_options(F.col("options")))))


def shuffle_insert(choices: Column, label: Column, qid: Column, seed: int = 42):
    """(options, label_idx): all distractors in hash order, label at a hash position."""
    # The digits that make up a uniform order as the uniforms do.
    sh = F.sort_array(F.transform(choices, lambda c: F.struct(u_digits(seed, "shuffle", qid, c).alias("k"), c.alias("v"))))["v"]
    pos = F.floor(u(seed, "pos", qid) * (F.size(choices) + 1)).cast("int")
    return F.array_insert(sh, pos + 1, label), pos


def render_options(options: Column, sep: str = "\n") -> Column:
    """All options, lettered."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.chr(F.lit(65) + i), F.lit(". "), o)), sep)
