"""Registered queries (name -> (spark, sf_dir) -> DataFrame) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.plans import registry_qa
from quizloom.plans.oracle import mcq_sql
from quizloom.session import configure

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        def run(spark, sf_dir):
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


@register("mcq_all_targets", mcq_sql.mcq_sql())
def _mcq_all_targets(spark, sf):
    """M2 + M5-M10 + T2: every (record, profiled column) question; tercile mixture."""
    return registry_qa.mcq_all_targets(spark, sf, gm_method="terciles")


@register("mcq_all_targets_em", mcq_sql.with_em(mcq_sql.mcq_sql()))
def _mcq_all_targets_em(spark, sf):
    """Flagship: as mcq_all_targets with the EM-fitted Gaussian mixture (A5)."""
    return registry_qa.mcq_all_targets(spark, sf, gm_method="em")


# ---------------------------------------------------------------- profiling / MI
from quizloom.operators import gmm as _gmm  # noqa: E402
from quizloom.operators import mutual_info as _mi  # noqa: E402
from quizloom.plans.oracle import stats_sql  # noqa: E402
from quizloom.sources.registry import registry as _registry  # noqa: E402


def _prof(spark, sf, gm_method="terciles"):
    reg = _registry(spark, sf)
    return reg, registry_qa.build_profile(reg, gm_method=gm_method, materialize="values")


@register("col_values", stats_sql.COL_VALUES)
def _col_values(spark, sf):
    """A1: distinct values per column with row counts, one aggregation for all columns."""
    _, p = _prof(spark, sf)
    return p.values.select("var", "value", F.col("n").cast("long").alias("n"))


@register("col_profile", stats_sql.COL_PROFILE)
def _col_profile(spark, sf):
    """VOCAB/WEIGHTS (long form), FLOAT_RATIO, kept columns."""
    _, p = _prof(spark, sf)
    v = p.vocab.select("var", "value", F.col("n").alias("vn"), "weight")
    return (p.summary.join(v, "var", "left")
            .select("var", "value", F.col("vn").cast("long").alias("n"), F.round("weight", 6).alias("weight"),
                    "n_keys", "n_vocab", F.round("float_ratio", 6).alias("float_ratio"), "is_numeric"))


@register("numeric_shape", stats_sql.NUMERIC_SHAPE)
def _numeric_shape(spark, sf):
    """Share >= 0 (> 95 %) and share integral (> 90 %) of the numeric vocabulary."""
    _, p = _prof(spark, sf)
    return p.summary.where("is_numeric").select("var", "n_keys", "num_min", "num_max", "drop_negative", "round_int")


@register("gmm_terciles", stats_sql.GM_TERCILES)
def _gmm_terciles(spark, sf):
    """A5 (closed form): tercile mixture, the SQL-checkable mixture and EM start."""
    _, p = _prof(spark, sf)
    r = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return p.gm.select("var", r("gm_means").alias("gm_means"), r("gm_stds").alias("gm_stds"),
                       r("gm_weights").alias("gm_weights"))


@register("gmm_profile", mcq_sql.with_em(stats_sql.GM_TERCILES).replace("gm_weights, lambda x: round(x, 6)", "gm_weights, lambda x: x"))
def _gmm_profile(spark, sf):
    """A5: 3-component Gaussian mixture per numeric column (EM as rounds of a Spark aggregation)."""
    reg = _registry(spark, sf)
    p = registry_qa.build_profile(reg, gm_method="em", materialize="values")
    r = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return p.gm.select("var", r("gm_means").alias("gm_means"), r("gm_stds").alias("gm_stds"), "gm_weights")


def _mi_table(spark, sf, only_discrete):
    reg = registry_qa.stored_registry(spark, sf)
    p = registry_qa.build_profile(reg, gm_method=None, materialize="values")
    return _mi.mutual_info(reg, p.stats, p.values, only_discrete=only_discrete)


@register("mi_discrete", stats_sql.MI_DISCRETE)
def _mi_discrete(spark, sf):
    """A9 + A11: discrete-discrete MI matrix (long form), nulls as their own code."""
    m = _mi_table(spark, sf, True)
    return m.select("target", "feature", F.round("mi", 6).alias("mi"), "n_rows")


@register("mi_binned", stats_sql.MI_BINNED)
def _mi_binned(spark, sf):
    """A10a + A11: MI with continuous columns in 16 equal-width bins."""
    m = _mi_table(spark, sf, False)
    return m.select("target", "feature", F.round("mi", 6).alias("mi"), "n_rows")


@register("correlated_cols", stats_sql.CORRELATED.format(cutoff=_mi.MI_CUTOFF))
def _correlated(spark, sf):
    """Features with MI > 0.5 per target."""
    return _mi.correlated_columns(_mi_table(spark, sf, False), _mi.MI_CUTOFF)


register("mi_quantile", stats_sql.mi_quantile_sql())(registry_qa.mi_quantile)
register("mi_knn", stats_sql.mi_knn_sql(registry_qa.KNN_ROWS))(registry_qa.mi_knn)


# ---------------------------------------------------------------- question variants
_CAT = ["status", "priority", "segment", "nation", "line_count"]
_NUM = ["total_price", "acct_bal", "ship_days"]
for _name, _targets, _doc in [
    ("mcq_categorical", _CAT, "M5: categorical columns - whole VOCAB when small, weighted draw otherwise."),
    ("mcq_numeric", _NUM, "M6 + M9: numeric ladder around the label from the responsible component."),
    ("mcq_fallback", ["discount"], "M7: sharp components (std < 0.1) fall back to a uniform ALL_VOCAB draw."),
    ("mcq_mixed", ["quantity"], "M8: mixed text/number column - binomial split of categorical and numeric."),
    ("mcq_fixed", ["segment"], "M3: fixed target list; records whose target is ineligible are skipped."),
]:
    def _mk(targets):
        return lambda spark, sf: registry_qa.mcq_all_targets(spark, sf, gm_method="terciles", targets=targets)
    _f = _mk(_targets)
    _f.__doc__ = _doc
    register(_name, mcq_sql.mcq_sql(targets=_targets))(_f)


@register("mcq_random_target", mcq_sql.mcq_sql(pick_one=True))
def _mcq_random(spark, sf):
    """M1: one random usable target per record."""
    return registry_qa.mcq_all_targets(spark, sf, gm_method="terciles", pick_one=True)


@register("mcq_flat", mcq_sql.mcq_sql(sectioned=False))
def _mcq_flat(spark, sf):
    """T1 + M10 (flat template): every target, flat ``name: value`` text."""
    return registry_qa.mcq_all_targets(spark, sf, gm_method="terciles", sectioned=False)


# ---------------------------------------------------------------- time series / outcomes
from quizloom.operators import timeseries as _ts  # noqa: E402
from quizloom.plans import timeseries_qa as _tq  # noqa: E402
from quizloom.plans.oracle import timeseries_sql as _tsql  # noqa: E402

register("horizon_label", _tsql.HORIZON_LABEL)(lambda spark, sf: _tq.horizon_label(spark, sf))
register("prefix_prompts", _tsql.PREFIX_PROMPTS)(lambda spark, sf: _tq.prefix_prompts(spark, sf))
register("horizon_question", _tsql.HORIZON_QUESTION)(lambda spark, sf: _tq.horizon_question(spark, sf))
register("horizon_sample", _tsql.HORIZON_SAMPLE)(lambda spark, sf: _tq.horizon_sample(spark, sf))
register("trajectory_text", _tsql.TRAJECTORY_TEXT)(lambda spark, sf: _tq.trajectory_text(spark, sf))
register("stay_having", _tsql.STAY_HAVING)(
    lambda spark, sf: _tq.stay_having(_ts.trajectory(_tq.events(spark, sf))))
register("forecast_question", _tsql.FORECAST_QUESTION)(lambda spark, sf: _tq.forecast_question(spark, sf))
register("slot_rows", _tsql.SLOT_ROWS)(_tq.slot_rows)
register("slot_round_trip", _tsql.SLOT_ROUND_TRIP)(_tq.slot_round_trip)
register("outcome_chain", _tsql.OUTCOME_CHAIN)(lambda spark, sf: _tq.outcome_chain(spark, sf))
register("outcome_question", _tsql.OUTCOME_QUESTION)(lambda spark, sf: _tq.outcome_question(spark, sf))


# ---------------------------------------------------------------- notes, chat, scoring
from quizloom.plans import text_qa as _tx  # noqa: E402
from quizloom.plans.oracle import text_sql as _txs  # noqa: E402

for _name, _sql in [
    ("note_category", _txs.NOTE_CATEGORY), ("note_tokens", _txs.NOTE_TOKENS), ("redact_regex", _txs.REDACT_REGEX),
    ("redact_list", _txs.REDACT_LIST), ("split_header", _txs.SPLIT_HEADER), ("strip_after_sep", _txs.STRIP_AFTER_SEP),
    ("chat_messages", _txs.CHAT_MESSAGES), ("chat_prompts", _txs.CHAT_PROMPTS), ("sys_fold", _txs.SYS_FOLD),
    ("boxed_answer", _txs.BOXED_ANSWER), ("cut_delims", _txs.CUT_DELIMS), ("budget_trim", _txs.BUDGET_TRIM),
    ("prompt_parts", _txs.PROMPT_PARTS), ("exact_match", _txs.EXACT_MATCH), ("accuracy_report", _txs.ACCURACY_REPORT),
    ("reward_mean", _txs.REWARD_MEAN), ("truncation_rate", _txs.TRUNCATION_RATE),
    ("answer_inputs", _txs.ANSWER_INPUTS), ("finish_rate", _txs.FINISH_RATE), ("blind_pairs", _txs.BLIND_PAIRS),
]:
    register(_name, _sql)(getattr(_tx, _name))


# ---------------------------------------------------------------- cleaning / recoding
from quizloom.plans import cleaning_qa as _cq  # noqa: E402
from quizloom.plans.oracle import cleaning_sql as _cs  # noqa: E402

for _name, _fn, _sql in [
    ("registry_view", _cq.registry_view, _cs.REGISTRY_VIEW), ("unpivot_long", _cq.unpivot, _cs.UNPIVOT),
    ("recode_codes", _cq.recode_codes, _cs.RECODE_CODES), ("multi_code", _cq.multi_code, _cs.MULTI_CODE),
    ("sentinel_na", _cq.sentinel_na, _cs.SENTINEL_NA), ("gate_fill", _cq.gate_fill, _cs.GATE_FILL),
    ("mask_overlay", _cq.mask_overlay, _cs.MASK_OVERLAY), ("case_collision", _cq.case_collision, _cs.CASE_COLLISION),
    ("date_minutes", _cq.date_minutes, _cs.DATE_MINUTES), ("family_reset", _cq.family_reset, _cs.FAMILY_RESET),
    ("binary_labels", _cq.binary_labels, _cs.BINARY_LABELS), ("ordinal_codes", _cq.ordinal_codes, _cs.ORDINAL_CODES),
    ("leakage_guard", _cq.leakage_guard, _cs.LEAKAGE_GUARD),
    ("csv_roundtrip", _cq.csv_roundtrip, _cs.CSV_ROUNDTRIP), ("read_split", _cq.read_split, _cs.READ_SPLIT),
    ("section_hoist", _cq.section_hoist, _cs.SECTION_HOIST),
    ("serialize_until_gap", _cq.serialize_until_gap, _cs.SERIALIZE_UNTIL_GAP),
    ("serialize_flat", _cq.serialize_flat_text, _cs.SERIALIZE_FLAT),
]:
    register(_name, _sql)(_fn)


# ---------------------------------------------------------------- sampling, sets, filters, joins
from quizloom.plans import sampling_qa as _sq  # noqa: E402
from quizloom.plans.oracle import sampling_sql as _ss  # noqa: E402

for _name in ["holdout_split", "sample_groups", "one_per_group", "oversample_dedupe", "weighted_draw", "shuffle_head",
              "union_tasks", "set_diff", "cohort_filter", "temporal_cohort", "token_len_filter", "left_lookup",
              "positional_zip", "drop_null_cols"]:
    register(_name, getattr(_ss, _name.upper()))(getattr(_sq, _name))


# ---------------------------------------------------------------- codebook
from quizloom.plans import codebook_qa as _cb  # noqa: E402
from quizloom.plans.oracle import codebook_sql as _cbs  # noqa: E402

for _name in ["codebook_ranges", "codebook_list", "header_ffill", "header_levels", "block_segments", "sheet_blocks", "name_align",
              "appearance_codes"]:
    register(_name, getattr(_cbs, _name.upper()))(getattr(_cb, _name))


register("outcome_union", mcq_sql.outcome_union_sql())(lambda spark, sf: registry_qa.outcome_union(spark, sf))

for _name in ["mv_reconcile", "edu_merge", "script_translate"]:
    register(_name, getattr(_cs, _name.upper()))(getattr(_cq, _name))

register("mcq_multi", stats_sql.mcq_multi_sql(_mi.MI_CUTOFF))(lambda spark, sf: registry_qa.mcq_multi(spark, sf))
register("mcq_multi_three", stats_sql.mcq_multi_sql(_mi.MI_CUTOFF, 3))(lambda spark, sf: registry_qa.mcq_multi(spark, sf, k=3))
register("merged_profile", stats_sql.MERGED_PROFILE)(registry_qa.merged_profile)
register("merged_mi", stats_sql.MI_DISCRETE)(registry_qa.merged_mi)
register("note_pipeline", _txs.NOTE_PIPELINE)(lambda spark, sf: _tx.note_pipeline(spark, sf))
for _name in ["two_limits", "two_limits_short"]:
    register(_name, getattr(_ss, _name.upper()))(getattr(_sq, _name))
for _name in ["residual_codes", "single_value", "unit_names"]:
    register(_name, getattr(_cs, _name.upper()))(getattr(_cq, _name))
register("metadata_override", _cbs.METADATA_OVERRIDE)(_cb.metadata_override)


# ---------------------------------------------------------------- smaller cleaning, filter and source plans
from quizloom.plans import extra_qa as _ex  # noqa: E402
from quizloom.plans.oracle import extra_sql as _exs  # noqa: E402

for _name in ["wrong_codes", "drop_identifying", "row_sections", "fill_blank", "tokens_to_null", "patched_dict", "class_minimum",
              "flexible_dates", "parallel_explode", "map_of_pairs", "debug_subset", "csv_literal", "stored_profile"]:
    register(_name, getattr(_exs, _name.upper()))(getattr(_ex, _name))


# ---------------------------------------------------------------- column rules
from quizloom.plans import rules_qa as _rq  # noqa: E402
from quizloom.plans.oracle import rules_sql as _rqs  # noqa: E402

for _name in ["residual_columns", "fill_rules", "education_merge", "known_cohort", "dictionary_file"]:
    register(_name, getattr(_rqs, _name.upper()))(getattr(_rq, _name))
