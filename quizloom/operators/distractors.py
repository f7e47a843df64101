"""M5-M9: distractor generation for one masked value per question row.

Semantics (per question, n = ``n_choices``):
1. label is canonicalised (C1); when FLOAT_RATIO = 0 and |VOCAB| <= n every
   other VOCAB entry is a choice;
2. otherwise k_cat = min(Binomial(n-1, 1-FLOAT_RATIO), |VOCAB| - [label is text]),
   drawn by weight without replacement, and k_num = n-1-k_cat numeric values
   come from the Gaussian component picked by responsibility (an arithmetic
   ladder), or a uniform draw from ALL_VOCAB when the density is zero or the
   component is too sharp;
3. "nan" is dropped, trailing zeros stripped, duplicates and the label removed,
   the rest sorted.

Every draw is a hash uniform of (seed, tag, qid, j).  Weighted draws without
replacement are exact: draw j picks position r in the cumulative-count line of
the column's VOCAB with the label and earlier picks cut out (the "skip" method
over sorted excluded intervals), then finds the item by an equi-join on
(var, block) - no question is ever paired with a whole vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions.text import canonical_float, strip_zeros
from quizloom.sources.files import stored

# Question-set defaults.
N_CHOICES = 5
DIFFICULTY = 2.0
SHARP_STD = 0.1


def spark_u_sql(seed, tag: str, *parts: str) -> str:
    """Hash uniform as a Spark SQL expression (same formula as functions.hashing.u)."""
    key = "concat_ws('|', " + ", ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({p} AS STRING)" for p in parts]) + ")"
    return f"((CAST(CAST(conv(substr(md5({key}), 1, 13), 16, 10) AS BIGINT) AS DOUBLE) + 0.5D) / 4503599627370496.0D)"


def lookup_table(vocab: DataFrame, all_vocab: DataFrame) -> DataFrame:
    """(var, value, idx, lo, n): ALL_VOCAB index plus VOCAB cumulative interval."""
    return all_vocab.select("var", "value", "idx").join(
        vocab.select("var", "value", "lo", "n"), ["var", "value"], "left")


def block_size():
    return F.greatest(F.lit(1), F.ceil(F.col("vocab_total") / F.greatest(F.col("n_vocab"), F.lit(1)))).cast("long")


def vocab_blocks(lookup: DataFrame, prof: DataFrame) -> DataFrame:
    """VOCAB items exploded over the fixed-size blocks their interval covers.

    Block size per column = ceil(total count / #items), so the table has at most
    ~2x as many rows as the vocabulary and a block holds few items on average.
    """
    p = prof.select("var", block_size().alias("bs"))
    v = lookup.where(F.col("lo").isNotNull()).join(F.broadcast(p), "var")
    return v.select(
        F.col("var").alias("b_var"),
        F.explode(F.sequence(F.floor(F.col("lo") / F.col("bs")).cast("long"),
                             F.floor((F.col("lo") + F.col("n") - 1) / F.col("bs")).cast("long"))).alias("b_blk"),
        F.col("value").alias("b_value"), F.col("idx").alias("b_idx"),
        F.col("lo").alias("b_lo"), F.col("n").alias("b_n"))


@dataclass
class DrawTables:
    """What the draws of all questions share: ``kinds`` (a row a column, known while the plan is built), ``columns``
    (the same as a table), ``labels`` and ``blocks`` of VOCAB and ``spare``, ALL_VOCAB of the columns that may fall back."""
    kinds: dict
    columns: DataFrame
    labels: DataFrame
    blocks: DataFrame
    spare: DataFrame


def draw_tables(prof: DataFrame, gm: DataFrame, vocab: DataFrame, all_vocab: DataFrame, n_choices: int = N_CHOICES) -> DrawTables:
    """Written once for all draws.  What a value's text says (number, canonical and stripped text) is worked out here
    for VOCAB's values, not for each question: reading a text as a number costs most where it is none."""
    few = prof.where(f"float_ratio = 0 AND n_vocab <= {n_choices}").select("var")
    # At most ``n_choices`` values a column.
    whole = vocab.join(F.broadcast(few), "var", "left_semi").groupBy("var").agg(F.collect_list(strip_zeros("value")).alias("whole"))
    columns = stored(prof.select("var", "float_ratio", "n_vocab", "vocab_total", "n_all", "drop_negative", "round_int", "num_min", "num_max",
                                 block_size().alias("bs")).join(gm, "var").join(whole, "var", "left"), "draw-columns")
    kinds = {r["var"]: r.asDict() for r in columns.collect()}                 # one row per column
    labels = stored(vocab.select("var", F.col("value").alias("label_raw"), F.col("lo").alias("lab_lo"), F.col("n").alias("lab_n"),
                                 F.col("value").try_cast("double").alias("lab_d"), strip_zeros(canonical_float("value")).alias("lab_text")),
                    "vocab-labels")
    # Exploding hides the size of the blocks from Spark: they are written once (at most ~2x the vocabulary).
    blocks = stored(vocab_blocks(lookup_table(vocab, all_vocab), prof).withColumn("b_value", strip_zeros("b_value")), "vocab-blocks")
    numeric = [v for v, k in kinds.items() if k["float_ratio"] > 0]
    spare = stored(all_vocab.where(F.col("var").isin(numeric)), "spare-vocab") if any(may_fall(kinds[v]) for v in numeric) else all_vocab
    return DrawTables(kinds, columns.drop("num_min", "num_max"), labels, blocks, spare)


def may_fall(kind: dict) -> bool:
    """Whether a question of a column may fall back to ALL_VOCAB: a component is sharp, or none surely has a
    density at both ends of the column's values."""
    if kind["float_ratio"] <= 0:
        return False
    ends = (kind["num_min"], kind["num_max"])
    seen = any(w >= 1e-6 and SHARP_STD <= d <= 1e50 and all(abs(x - m) <= 30 * d for x in ends)
               for m, d, w in zip(kind["gm_means"], kind["gm_stds"], kind["gm_weights"]))
    return not (seen and all(d >= SHARP_STD for d in kind["gm_stds"]))


def alike(tables: DrawTables, targets: list[str] | None = None) -> list[tuple[bool, bool, list[str]]]:
    """(numbers, falls, columns): the columns whose questions take the same steps.  With ``targets`` the labels are
    among the profiled values; without, any number may come and may fall back."""
    groups: dict = {}
    for v, k in sorted(tables.kinds.items()):
        if targets is None or v in targets:
            share = (k["float_ratio"] > 0) + (k["float_ratio"] >= 1)
            groups.setdefault((share, share > 0 and (targets is None or may_fall(k))), []).append(v)
    return [(share > 0, falls, vs) for (share, falls), vs in sorted(groups.items())]


def choose_distractors(q: DataFrame, prof: DataFrame, gm: DataFrame, vocab: DataFrame, all_vocab: DataFrame,
                       seed: int = 42, n_choices: int = N_CHOICES, difficulty: float = DIFFICULTY,
                       tables: DrawTables | None = None, targets: list[str] | None = None) -> DataFrame:
    """Add ``label`` (canonical text) and ``choices`` (sorted distractors) to ``q``.

    ``q`` needs ``qid`` (unique text key), ``var`` and ``label_raw``, and the same rows each time it is read.
    ``prof``, ``gm`` are one row per column (broadcast: schema sized); ``vocab`` and
    ``all_vocab`` are the long profile tables, stored as Parquet: Spark picks each join
    by their real size.  The label is found in them by its raw text, since "3" is
    canonically "3.0" but stands as "3" in the vocabulary.  ``tables``: their ``draw_tables``, if at hand;
    ``targets``: the columns in ``q``, if its labels are values of the profiled rows.

    Questions of columns that take the same steps go through those steps alone: texts draw from VOCAB, numbers have a
    ladder, and whether a row falls back to ALL_VOCAB is known before any draw.  So only the rows that do are joined
    with that table, which grows with the distinct numbers; all others meet VOCAB alone and are not moved.
    """
    tables = tables or draw_tables(prof, gm, vocab, all_vocab, n_choices)
    groups = alike(tables, targets)
    parts = []
    for numbers, falls, columns in groups:
        kinds = [tables.kinds[v] for v in columns]
        part = q if len(groups) == 1 and targets is not None else q.where(F.col("var").isin(columns))
        base = question_sizes(part, tables, seed, n_choices, numbers, any(k["n_vocab"] for k in kinds))
        drawn = [k["n_vocab"] for k in kinds if k["float_ratio"] < 1 and (numbers or k["n_vocab"] >= n_choices)]
        rounds = min(max(drawn, default=0), n_choices - 1)
        if not numbers:
            parts.append((vocab_draws(base, tables.blocks, seed, rounds), None))
            continue
        fb = F.coalesce("_fb", F.lit(False))
        stays = base.where(~fb) if falls else base
        parts.append((numeric_ladder(vocab_draws(stays, tables.blocks, seed, rounds), seed, difficulty, n_choices), "num_vals"))
        if falls:
            parts.append((fallback_draws(vocab_draws(base.where(fb), tables.blocks, seed, rounds), tables.spare, seed, n_choices), "fb_vals"))
    found = []
    for part, numbers in parts:
        raw = F.concat(numbers or "whole", "cat_vals")
        not_these = F.array("label", F.lit("nan"), F.lit(None).cast("string"))
        found.append(part.select(*q.columns, "label", F.sort_array(F.array_except(raw, not_these)).alias("choices")))
    if not found:                                                             # no column is profiled
        return q.where(F.lit(False)).select(*q.columns, F.col("label_raw").alias("label"), F.array("label_raw").alias("choices"))
    return reduce(DataFrame.unionByName, found)


def question_sizes(q: DataFrame, tables: DrawTables, seed: int, n_choices: int, numbers: bool = True, texts: bool = True) -> DataFrame:
    """How many values a row draws from VOCAB (``k_cat``) and as numbers (``k_num``), and what needs no draw
    (``whole``); with ``numbers`` the value and deviation of its ladder, and whether it falls back to ALL_VOCAB
    (``_fb``).  Without ``texts`` the columns have no VOCAB."""
    base = q.join(F.broadcast(tables.columns.drop(*(["whole"] if numbers else ["gm_means", "gm_stds", "gm_weights"]))), "var")
    if texts:
        base = base.join(tables.labels, ["var", "label_raw"], "left")
    else:
        base = base.selectExpr("*", "CAST(NULL AS BIGINT) AS lab_lo", "CAST(NULL AS BIGINT) AS lab_n",
                               "CAST(NULL AS DOUBLE) AS lab_d", "CAST(NULL AS STRING) AS lab_text")
    known = F.col("lab_lo").isNotNull()
    base = (base.withColumn("label_d", F.when(known, F.col("lab_d")).otherwise(F.col("label_raw").try_cast("double")))
            .withColumn("label", F.when(known, F.col("lab_text")).otherwise(strip_zeros(
                F.coalesce(F.col("label_d").cast("string"), F.col("label_raw"))))))

    nm1 = n_choices - 1
    draws = " + ".join(f"CASE WHEN {spark_u_sql(seed, 'binom', 'qid', str(j))} < 1 - float_ratio THEN 1 ELSE 0 END"
                       for j in range(nm1))
    # A uniform lies strictly between 0 and 1: the two ends of FLOAT_RATIO need no draw.
    binom = f"CASE WHEN float_ratio <= 0 THEN {nm1} WHEN float_ratio >= 1 THEN 0 ELSE {draws} END"
    base = base.selectExpr(
        "*",
        f"(float_ratio = 0 AND n_vocab <= {n_choices}) AS _b1",
        "CASE WHEN lab_lo IS NULL THEN 0 ELSE 1 END AS _in_vocab",
        f"{binom} AS _binom",
    ).selectExpr(
        "*",
        "CASE WHEN _b1 THEN n_vocab - _in_vocab "
        "ELSE least(_binom, n_vocab - CASE WHEN label_d IS NULL THEN 1 ELSE 0 END) END AS _kref",
        # Every other value of a small VOCAB is a choice, if there is room for all.
        f"(_b1 AND n_vocab - _in_vocab <= {nm1}) AS _all",
    ).selectExpr(
        "*",
        "CASE WHEN _all THEN 0 ELSE greatest(least(_kref, n_vocab - _in_vocab), 0) END AS k_cat",
        f"CASE WHEN _b1 THEN 0 ELSE {nm1} - _kref END AS k_num",
    )
    spent = ["gm_means", "gm_stds", "gm_weights", "_kref", "_binom", "_in_vocab", "_b1", "_all", "lab_d", "lab_text"]
    if not numbers:
        whole = F.when(F.col("_all"), F.col("whole")).otherwise(F.array().cast("array<string>"))
        return base.withColumn("whole", whole).drop(*spent, "label_d", "float_ratio", "n_all", "drop_negative", "round_int", "k_num")
    ux = spark_u_sql(seed, "gmx", "qid")
    x = (f"CASE WHEN label_d IS NOT NULL THEN label_d ELSE gm_means[CASE WHEN {ux} < gm_weights[0] THEN 0 "
         f"WHEN {ux} < gm_weights[0] + gm_weights[1] THEN 1 ELSE 2 END] END")
    pdf = ("CASE WHEN gm_stds[{i}] > 0 THEN exp(-pow((v.x - gm_means[{i}]) / gm_stds[{i}], 2) / 2) "
           "/ (gm_stds[{i}] * sqrt(2 * pi())) * gm_weights[{i}] ELSE 0D END")
    # Functions of one value: Spark writes a column out wherever a filter uses it, which here would be many times over.
    comp = ("transform(array(array({})), s -> named_struct('total', s[0] + s[1] + s[2], 'at', "
            "CASE WHEN v.u * (s[0] + s[1] + s[2]) < s[0] THEN 0 WHEN v.u * (s[0] + s[1] + s[2]) < s[0] + s[1] THEN 1 ELSE 2 END))[0]")
    got = (f"transform(array(named_struct('x', {x}, 'u', {spark_u_sql(seed, 'comp', 'qid')})), v -> "
           f"transform(array({comp.format(', '.join(pdf.format(i=i) for i in range(3)))}), c -> named_struct('x', v.x, 'std', gm_stds[c.at], "
           f"'fb', c.total = 0 OR gm_stds[c.at] < {SHARP_STD}))[0])[0]")
    return (base.selectExpr("*", f"CASE WHEN k_num > 0 THEN {got} END AS _num")
            .selectExpr("*", "_num.x AS _x", "_num.std AS _std", "_num.fb AS _fb").drop("_num", *spent))


def vocab_draws(base: DataFrame, blocks: DataFrame, seed: int, rounds: int) -> DataFrame:
    """``cat_vals`` and ``cat_idx``: ``k_cat`` values of VOCAB by weight, without the label and without replacement.
    ``rounds``: the most that a row draws."""
    cur = base.selectExpr(
        "*",
        "CAST(CASE WHEN lab_lo IS NULL THEN array() ELSE array(named_struct('lo', lab_lo, 'n', lab_n)) END "
        "AS array<struct<lo:bigint,n:bigint>>) AS _excl",
        "coalesce(lab_n, 0L) AS _excl_tot",
        "CAST(array() AS array<string>) AS cat_vals",
        "CAST(array() AS array<bigint>) AS cat_idx",
    ).drop("lab_lo", "lab_n")
    # A row that is not drawing in round j gets a negative, salted block key:
    # it matches nothing and spreads over partitions instead of piling on null.
    for j in range(rounds):
        r = f"CAST(floor({spark_u_sql(seed, 'cat', 'qid', str(j))} * (vocab_total - _excl_tot)) AS BIGINT)"
        rp = f"aggregate(sort_array(_excl), {r}, (acc, e) -> CASE WHEN e.lo <= acc THEN acc + e.n ELSE acc END)"
        active = F.col("k_cat") > j
        cur = (cur.withColumn("_rp", F.when(active, F.expr(rp)))
               .withColumn("_blk", F.when(active, F.floor(F.col("_rp") / F.col("bs")).cast("long")).otherwise(-1 - _salt())))
        cur = cur.join(blocks, (cur["var"] == blocks["b_var"]) & (cur["_blk"] == blocks["b_blk"])
                       & (blocks["b_lo"] <= cur["_rp"]) & (cur["_rp"] < blocks["b_lo"] + blocks["b_n"]), "left")
        hit = F.col("b_lo").isNotNull()
        cur = (cur.withColumns({
                    "_excl": F.when(hit, F.concat("_excl", F.array(
                        F.struct(F.col("b_lo").alias("lo"), F.col("b_n").alias("n"))))).otherwise(F.col("_excl")),
                    "_excl_tot": F.col("_excl_tot") + F.coalesce("b_n", F.lit(0)),
                    "cat_vals": F.when(hit, F.concat("cat_vals", F.array("b_value"))).otherwise(F.col("cat_vals")),
                    "cat_idx": F.when(hit, F.concat("cat_idx", F.array("b_idx"))).otherwise(F.col("cat_idx"))})
               .drop("_rp", "_blk", *blocks.columns))
    return cur


def _salt():
    return F.pmod(F.xxhash64("qid"), F.lit(1 << 20)).cast("long")


def numeric_ladder(cur: DataFrame, seed: int, difficulty: float, n_choices: int) -> DataFrame:
    """``num_vals`` (null: none): ``k_num`` steps of the component's deviation around the value, its own place left out."""
    order = f"CASE WHEN k_num > 0 AND NOT _fb THEN CAST(floor({spark_u_sql(seed, 'order', 'qid')} * (k_num + 1)) AS INT) END"
    nums = []
    for i in range(n_choices + 1):                                            # k_num is at most ``n_choices``
        v = f"(_x + {float(difficulty)} * ({i} - _order) * _std)"
        nums.append(f"CASE WHEN {i} <= k_num AND {i} != _order AND (NOT drop_negative OR {v} >= 0) THEN CASE WHEN round_int "
                    f"THEN CAST(CAST(bround({v}, 0) AS BIGINT) AS STRING) "
                    # C2 of a number with one decimal
                    f"ELSE regexp_replace(CAST(CAST(bround({v}, 1) AS DECIMAL(38, 1)) AS STRING), '[.]0$', '') END END")
    return cur.selectExpr("*", f"{order} AS _order").selectExpr("*", f"array({', '.join(nums)}) AS num_vals")


def fallback_draws(cur: DataFrame, all_vocab: DataFrame, seed: int, n_choices: int) -> DataFrame:
    """``fb_vals`` (null: none): M7, a uniform draw without replacement from ALL_VOCAB minus label and picks."""
    own = all_vocab.select("var", F.col("value").alias("label_raw"), F.col("idx").alias("lab_idx"))
    cur = cur.join(own, ["var", "label_raw"], "left")
    cur = (cur.selectExpr("*", "CASE WHEN lab_idx IS NULL THEN cat_idx ELSE concat(array(lab_idx), cat_idx) END AS _eidx")
           .selectExpr("*", "greatest(least(k_num, n_all - size(_eidx)), 0) AS _kfb"))
    ufb = spark_u_sql(seed, "fb", "qid", "j")
    draw = (f"aggregate(sequence(0, _kfb - 1), CAST(array() AS array<bigint>), (acc, j) -> concat(acc, array("
            f"aggregate(sort_array(concat(_eidx, acc)), CAST(floor({ufb} * (n_all - size(_eidx) - j)) AS BIGINT), "
            f"(a, e) -> CASE WHEN e <= a THEN a + 1 ELSE a END))))")
    cur = cur.selectExpr("*", f"CASE WHEN _kfb > 0 THEN {draw} ELSE CAST(array() AS array<bigint>) END AS _fb_idx")
    av = all_vocab.select(F.col("var").alias("a_var"), F.col("idx").alias("a_idx"), F.col("value").alias("a_value"))
    found = []
    for j in range(n_choices - 1):
        key = F.when(F.size("_fb_idx") > j, F.col("_fb_idx")[j]).otherwise(-1 - _salt())
        cur = cur.withColumn("_fk", key)
        cur = cur.join(av, (cur["var"] == av["a_var"]) & (cur["_fk"] == av["a_idx"]), "left")
        cur = cur.withColumn(f"_fv{j}", F.col("a_value")).drop("_fk", *av.columns)
        found.append(F.col(f"_fv{j}"))
    return cur.withColumn("fb_vals", F.array(*[strip_zeros(v) for v in found]))
