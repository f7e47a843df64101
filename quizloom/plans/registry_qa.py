"""Registry -> profile -> masked multiple-choice questions (the flagship plan)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions.hashing import u, u_digits
from quizloom.functions.text import canonical_float, strip_zeros
from quizloom.operators import gmm, profile
from quizloom.operators import mutual_info as mi_ops
from quizloom.operators.distractors import DrawTables, alike, choose_distractors, draw_tables
from quizloom.operators.mutual_info import MI_CUTOFF
from quizloom.operators.neighbour_mi import mutual_info_knn
from quizloom.operators.questions import assemble, explode_targets, render_options
from quizloom.operators.serialize import serialize_flat, serialize_sections
from quizloom.sources import profile_store as store
from quizloom.sources.files import scratch_path, stored
from quizloom.sources.registry import COL_DICT, VARS, col_dict, registry


@dataclass
class Profile:
    long: DataFrame
    values: DataFrame
    stats: DataFrame
    vocab: DataFrame
    all_vocab: DataFrame
    summary: DataFrame
    gm: DataFrame
    tables: DrawTables | None = None


def build_profile(reg: DataFrame, vars_=VARS, id_col: str = "record_id", gm_method: str | None = "em",
                  materialize: bool | str = True) -> Profile:
    """Profile tables of ``reg``.  ``materialize``: True writes every profile
    table to the checkpoint folder, "values" only the value counts, False none."""
    long = profile.unpivot_long(reg, id_col, list(vars_))
    values = profile.col_values(long)
    if materialize:
        # The one pass over the data: (var, value, n).  Every other profile table
        # derives from it, so it is written once to the checkpoint folder.
        values = stored(values, "col-values")
    # The other tables are column- or vocabulary-sized and are read many times by the question plan: each is
    # written once as Parquet (survives executor loss, has sizes for the join choice) before the next derives from it.
    kept = stored if materialize is True else lambda df, name: df
    stats = kept(profile.col_stats(values), "stats")
    vocab = kept(profile.vocab_table(values, stats), "vocab")
    all_vocab = kept(profile.all_vocab_table(values, stats), "all-vocab")
    summary = kept(profile.profile_summary(stats, vocab, all_vocab), "summary")
    if gm_method is None:
        return Profile(long, values, stats, vocab, all_vocab, summary, None)
    mixture = gmm.gmm_profile if gm_method == "em" else gmm.tercile_mixture
    gm = kept(mixture(values, stats), "mixture")
    return Profile(long, values, stats, vocab, all_vocab, summary, gm)


def correlated(reg: DataFrame, prof: Profile, cutoff: float = MI_CUTOFF) -> DataFrame:
    """(var, correlated): per target the columns with MI above the cutoff; one row per column."""
    return mi_ops.correlated_columns(mi_ops.mutual_info(reg, prof.stats, prof.values), cutoff).select(
        F.col("target").alias("var"), "correlated")


def dated_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with its date in minutes since the beginning of the record's year."""
    return mi_ops.dates_as_minutes(registry(spark, sf_dir), ["order_date"], F.date_trunc("year", F.col("order_date").cast("date")))


def mi_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + F10: MI in bins of equal shares, dates as minutes, pairs with a class of under three rows left out."""
    reg = stored(dated_registry(spark, sf_dir), "registry")
    prof = build_profile(reg, gm_method=None, materialize="values")
    m = mi_ops.mutual_info(reg, prof.stats, prof.values, quantiles=True, min_class=3)
    return m.select("target", "feature", F.round("mi", 6).alias("mi"), "n_rows")


KNN_ROWS = 400


def mi_knn(spark: SparkSession, sf_dir: str, rows: int = KNN_ROWS) -> DataFrame:
    """MI with continuous columns by nearest neighbours on ``rows`` records drawn by hash (the sample is
    the estimator's parameter), dates as minutes."""
    reg = stored(dated_registry(spark, sf_dir), "registry")
    prof = build_profile(reg, gm_method=None, materialize="values")
    disc, cont = mi_ops.column_kinds(prof.stats, prof.values)
    m = mutual_info_knn(reg, "record_id", disc, list(cont), rows)
    return m.select("target", "feature", F.round("mi", 6).alias("mi"), "n_rows")


def stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, joined once and written: profile, information and questions all read it."""
    return stored(registry(spark, sf_dir), "registry")


def records(reg: DataFrame) -> DataFrame:
    """(record_id, rows): a keyed record with its rows (one, unless the key repeats).  A question drawn on a row
    of it carries ``rows`` to its text, so question rows never move to meet their record.  Only records whose key
    repeats are brought together."""
    keyed = reg.where("record_id IS NOT NULL")
    row = F.struct(*VARS)
    again = stored(keyed.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id"), "repeated-keys")
    if again.isEmpty():
        return keyed.select("record_id", F.array(row).alias("rows"))
    many = stored(keyed.join(again, "record_id", "left_semi").groupBy("record_id").agg(F.collect_list(row).alias("rows")), "repeated")
    return keyed.join(again, "record_id", "left_anti").select("record_id", F.array(row).alias("rows")).unionByName(many)


def each_row(df: DataFrame, field: str = "rows") -> DataFrame:
    """``df`` once for each of its record's rows, with the registry's columns."""
    return df.select("*", F.explode(field).alias("_r")).select("*", "_r.*").drop("_r", field)


def record_targets(recs: DataFrame, prof: Profile, targets: list[str]) -> DataFrame:
    """(record_id, rows, var, label_raw, qid): a row for each target of each of the record's rows."""
    wide = recs.select("record_id", "rows", F.explode("rows").alias("_r")).select("record_id", "rows", "_r.*")
    return explode_targets(wide, "record_id", targets, prof.summary).select("record_id", "rows", "var", "label_raw", "qid")


def tables_of(prof: Profile, n_choices: int = 5) -> DrawTables:
    """The tables that the draws share, written at the first draw."""
    if prof.tables is None:
        prof.tables = draw_tables(prof.summary, prof.gm, prof.vocab, prof.all_vocab, n_choices)
    return prof.tables


def draw(q: DataFrame, prof: Profile, seed: int, n_choices: int = 5, targets: list[str] | None = None) -> DataFrame:
    """Distractors of questions on the profiled rows' own values, of the columns ``targets``."""
    return choose_distractors(q, prof.summary, prof.gm, prof.vocab, prof.all_vocab, seed=seed, n_choices=n_choices,
                              tables=tables_of(prof, n_choices), targets=targets or VARS)


def draw_records(recs: DataFrame, prof: Profile, targets: list[str], seed: int, n_choices: int = 5) -> DataFrame:
    """A question for each target of each record, drawn; only columns that take the same steps are made together."""
    groups = [vs for _, _, vs in alike(tables_of(prof, n_choices), targets)] or [list(targets)]
    return reduce(DataFrame.unionByName, [draw(record_targets(recs, prof, vs), prof, seed, n_choices, vs) for vs in groups])


def with_choices(df: DataFrame, field: str = "rows") -> DataFrame:
    """``each_row`` of the questions that have choices.  A filter on the choices would work them out twice."""
    return df.select("*", F.explode(F.when(F.size("choices") > 0, F.col(field))).alias("_r")).select("*", "_r.*").drop("_r", field)


#: Candidates told apart by one word of a record's bit set.
WORD = 62


def asked_targets(recs: DataFrame, prof: Profile, targets: list[str]) -> DataFrame:
    """``recs`` with ``asked``: the distinct (var, label_raw) of a record that may be asked."""
    kept = [v for v in targets if v in tables_of(prof).kinds]
    cells = F.flatten(F.transform("rows", lambda r: F.array(
        *[F.struct(F.lit(v).alias("var"), r[v].alias("label_raw")) for v in kept])))
    return recs.withColumn("asked", F.array_distinct(F.filter(
        cells, lambda x: x["label_raw"].isNotNull() & ~x["label_raw"].isin("", "NA"))))


def usable_targets(recs: DataFrame, prof: Profile, targets: list[str], seed: int, n_choices: int = 5) -> DataFrame:
    """``recs`` with ``usable``: the distinct (var, label_raw) of a record that have distractors.

    All questions are drawn, but only a bit of each leaves its task: a record's candidates are numbered, and the
    numbers of those with distractors come back as a bit set (a map of words, for candidates beyond the first word).
    """
    recs = asked_targets(recs, prof, targets)
    q = recs.select("record_id", F.posexplode("asked").alias("at", "x")).select("record_id", "at", "x.*")
    q = q.withColumn("qid", F.concat_ws("|", F.col("record_id").cast("string"), F.col("var")))
    bit = F.when(F.size("choices") > 0, F.expr(f"shiftleft(1L, at % {WORD})")).otherwise(F.lit(0).cast("long"))
    bits = draw(q, prof, seed, n_choices, targets).groupBy(
        "record_id", F.expr(f"CAST(at DIV {WORD} AS INT)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    bits = bits.where("bits != 0").groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    has = f"(shiftright(coalesce(try_element_at(bits, CAST(i DIV {WORD} AS INT)), 0L), i % {WORD}) & 1L) = 1L"
    return recs.join(bits, "record_id").withColumn("usable", F.expr(f"filter(asked, (x, i) -> {has})")).drop("asked", "bits")


def question_rows(got: DataFrame, *carried: str) -> DataFrame:
    """A row for each of a record's picks ``p``, in their order ``at``."""
    return got.select("record_id", *carried, F.posexplode("p").alias("at", "x")).select(
        "record_id", *carried, "at", F.col("x.var").alias("var"), F.col("x.label_raw").alias("label_raw"),
        F.concat_ws("|", F.col("record_id").cast("string"), F.col("x.var")).alias("qid"))


def first_picks(recs: DataFrame, prof: Profile, targets: list[str], seed: int, draw_picks, pick, n_choices: int = 5):
    """Picks among a record's usable targets, without drawing those that are not picked.

    ``pick`` adds picks ``p`` to records by an array of candidates, ``draw_picks`` draws them: one row a record,
    with ``ok`` if every pick has distractors.  Picks among all that are asked are the picks among the usable ones
    if all of them are usable, for what is not picked decides nothing.  The other records' targets are all drawn.
    """
    first = stored(draw_picks(stored(pick(asked_targets(recs, prof, targets), "asked"), "picked")), "drawn")
    rest = stored(first.where("NOT ok").select("record_id"), "unsettled")
    first = first.where("ok")
    if rest.isEmpty():
        return first
    again = stored(recs.join(rest, "record_id", "left_semi"), "unsettled-records")
    second = draw_picks(stored(pick(usable_targets(again, prof, targets, seed, n_choices), "usable"), "picked-again"))
    return first.unionByName(stored(second, "drawn-again"))


def picked_targets(recs: DataFrame, prof: Profile, targets: list[str], seed: int, n_choices: int = 5) -> DataFrame:
    """M1: one random usable target per record, with its choices, before any text is made."""
    def pick(r, field):
        first = F.array_min(F.transform(field, lambda x: F.struct(
            u_digits(seed, "pick", F.col("record_id"), x["var"]).alias("u"), x["var"].alias("var"), x["label_raw"].alias("label_raw"))))
        return r.select("record_id", F.slice("rows", 1, 1).alias("rows"), F.array_compact(F.array(first)).alias("p"))

    return first_picks(recs, prof, targets, seed, lambda got: draw(
        question_rows(got, "rows"), prof, seed, n_choices, targets).withColumn("ok", F.size("choices") > 0), pick, n_choices)


def mcq_questions(reg: DataFrame, prof: Profile, targets: list[str] | None = None, seed: int = 42,
                  n_choices: int = 5, sectioned: bool = True, pick_one: bool = False) -> DataFrame:
    """M1-M3: in a sectioned text the columns correlated with the target are left out, since they
    would tell the masked value.  ``reg`` is stored (it is read for information and for questions)."""
    drawn = (picked_targets if pick_one else draw_records)(records(reg), prof, targets or VARS, seed, n_choices)
    q = with_choices(drawn)
    if sectioned:
        corr = stored(correlated(reg, prof), "correlated")                 # one row per column
        q = q.join(F.broadcast(corr), "var", "left")
        text = serialize_sections(COL_DICT, F.col("var"), F.col("correlated"))
    else:
        text = serialize_flat(COL_DICT, F.col("var"))
    return assemble(q, text, COL_DICT, seed=seed, sectioned=sectioned)


def mcq_all_targets(spark: SparkSession, sf_dir: str, gm_method: str = "em", seed: int = 42,
                    targets: list[str] | None = None, pick_one: bool = False, sectioned: bool = True) -> DataFrame:
    """M2: one question per (record, profiled column) (M1 with ``pick_one``)."""
    reg = stored_registry(spark, sf_dir)
    prof = build_profile(reg, gm_method=gm_method)
    q = mcq_questions(reg, prof, targets=targets, seed=seed, pick_one=pick_one, sectioned=sectioned)
    return q.select("record_id", F.col("var").alias("task"), "user_message", "label_0",
                    F.col("options").alias("choices_0"))


# Outcome questions of the two-target union.
OUTCOME_TARGETS = [("status", "Q. What will the order status be?"),
                   ("priority", "Q. What will the order priority be?")]


def outcome_union(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """M14 + P6 + T1 + U1: per target, flat text without both outcome columns,
    the question, and the label inserted (no shuffle) into the sorted choices;
    the two question sets are unioned."""
    reg = stored_registry(spark, sf_dir)
    prof = build_profile(reg, gm_method="terciles")
    recs = records(reg)
    targets = [t for t, _ in OUTCOME_TARGETS]
    kept = [c for c in COL_DICT if c[0] not in targets]
    text = serialize_flat(kept)
    parts = []
    for t, question in OUTCOME_TARGETS:
        q = draw_records(recs, prof, [t], seed)
        q = q.withColumn("label_idx", F.floor(u(seed, "pos", F.col("qid")) * (F.size("choices") + 1)).cast("int"))
        q = q.withColumn("options", F.expr("array_insert(choices, label_idx + 1, label)"))
        q = each_row(q).select(
            "record_id", F.concat(text, F.lit("\n" + question + "\n"), render_options(F.col("options"))).alias("user_message"),
            F.expr("char(65 + label_idx)").alias("label_0"), F.lit(t).alias("task"), F.col("options").alias("choices_0"))
        parts.append(q)
    return parts[0].unionByName(parts[1])


def pick_targets(candidates, k: int):
    """M4: of a record's candidate targets in order, the first ``k`` of which none is correlated with an earlier
    one: one fold with a growing exclusion set.  A candidate is a struct with ``var`` and ``correlated``."""
    none = F.slice(candidates, 1, 0)
    start = F.struct(none.alias("picked"), F.transform(none, lambda x: x["var"]).alias("out"))

    def step(acc, x):
        take = (F.size(acc["picked"]) < k) & ~F.array_contains(acc["out"], x["var"])
        return F.struct(F.when(take, F.concat(acc["picked"], F.array(x))).otherwise(acc["picked"]).alias("picked"),
                        F.when(take, F.concat(acc["out"], F.array(x["var"]), x["correlated"])).otherwise(acc["out"]).alias("out"))
    return F.aggregate(candidates, start, step)["picked"]


def mcq_multi(spark: SparkSession, sf_dir: str, seed: int = 42, cutoff: float = MI_CUTOFF, k: int = 2) -> DataFrame:
    """M4: ``k`` questions a record; each target excludes itself and its correlated columns (MI > cutoff)
    from the next ones; the text masks all targets and leaves out every column correlated with one (T2).
    Records without ``k`` such targets are skipped."""
    from quizloom.operators.questions import shuffle_insert
    from quizloom.operators.serialize import targets_array
    reg = stored_registry(spark, sf_dir)
    prof = build_profile(reg, gm_method="terciles")
    corr = stored(correlated(reg, prof, cutoff), "correlated")             # one row per column
    related = F.broadcast(corr.agg(F.map_from_entries(F.collect_list(F.struct("var", "correlated"))).alias("_corr")))
    near = lambda v: F.coalesce(F.try_element_at("_corr", v), F.array().cast("array<string>"))

    def pick(r, field):
        # A record of one row has a column once, so the label decides no order there.
        label = lambda x: F.when(F.size("rows") > 1, strip_zeros(canonical_float(x["label_raw"])))
        asked = F.sort_array(F.transform(field, lambda x: F.struct(
            u_digits(seed, "pick", F.col("record_id"), x["var"]).alias("u"), x["var"].alias("var"),
            label(x).alias("label"), x["label_raw"].alias("label_raw"), near(x["var"]).alias("correlated"))))
        return r.crossJoin(related).withColumn("p", pick_targets(asked, k)).select("record_id", "rows", "p")

    def draw_picks(got):
        d = draw(question_rows(got), prof, seed).select("record_id", F.struct("at", "var", "qid", "label", "choices").alias("x"))
        return d.groupBy("record_id").agg(F.sort_array(F.collect_list("x")).alias("q")).withColumn(
            "ok", F.forall("q", lambda x: F.size(x["choices"]) > 0)).join(
            got.select("record_id", "rows", F.col("p.correlated").alias("_near")), "record_id")

    picked = first_picks(records(reg), prof, VARS, seed, draw_picks, pick).where(F.size("q") == k).withColumnRenamed("q", "p")
    for i in range(k):
        x = F.col("p")[i]
        options, at = shuffle_insert(x["choices"], x["label"], x["qid"], seed)
        picked = picked.withColumns({f"choices_{i}": options, f"_i{i}": at, f"_v{i}": x["var"]})
    qq = each_row(picked.withColumn("victims", F.transform("p", lambda x: x["var"])).withColumn("_drop", F.flatten("_near")).drop("p"))
    text = serialize_sections(COL_DICT, targets_array(F.col("victims")), F.col("_drop"))
    names = F.create_map(*[x for v, n, s in COL_DICT for x in (F.lit(v), F.lit(n))])
    secs = F.create_map(*[x for v, n, s in COL_DICT for x in (F.lit(v), F.lit(s))])
    parts = [text]
    for i in range(k):
        parts += [F.format_string(f"Q{i + 1}. What would be the masked value of '%s' in section %s?",
                                  F.element_at(names, F.col(f"_v{i}")), F.element_at(secs, F.col(f"_v{i}"))),
                  render_options(F.col(f"choices_{i}"))]
    return qq.select("record_id", F.concat_ws("\n", *parts).alias("user_message"),
                     *[F.expr(f"char(65 + _i{i})").alias(f"label_{i}") for i in range(k)], *[f"choices_{i}" for i in range(k)], "victims")


# ---------------------------------------------------------------- profiles that are stored and merged
def profile_batch(spark: SparkSession, reg: DataFrame, path: str) -> str:
    """The mergeable profile of one batch of records, written below ``path``."""
    values = stored(profile.col_values(profile.unpivot_long(reg, "record_id", VARS)), "col-values")
    store.write_profile(path, values, store.value_pairs(reg, values, VARS), col_dict(spark))
    return path


def merged_store(spark: SparkSession, sf_dir: str, batches: int = 3) -> store.StoredProfile:
    """The registry in ``batches``, profiled batch by batch, the stored profiles merged."""
    reg = registry(spark, sf_dir)
    paths = [profile_batch(spark, reg.where(F.pmod("record_id", F.lit(batches)) == i), scratch_path(spark, f"profile-{i}"))
             for i in range(batches)]
    return store.read_merged(spark, paths)


def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary from merged profiles, with the dictionary's names: no record is read again."""
    got = merged_store(spark, sf_dir)
    stats = profile.col_stats(got.values)
    summary = profile.profile_summary(stats, profile.vocab_table(got.values, stats), profile.all_vocab_table(got.values, stats))
    return summary.join(got.dictionary.select("var", "display_name", "section"), "var").select(
        "var", "display_name", "section", "n_keys", "n_rows", "n_vocab", "vocab_total", F.round("float_ratio", 6).alias("float_ratio"),
        "is_numeric", "drop_negative", "round_int")


def merged_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discrete MI matrix from merged contingency counts."""
    got = merged_store(spark, sf_dir)
    m = store.mi_of_pairs(got.pairs, got.values)
    return m.select("target", "feature", F.round("mi", 6).alias("mi"), "n_rows")
