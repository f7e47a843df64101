"""Smaller cleaning, filter and source plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.functions.missing import UNINFORMATIVE_TOKENS, null_if_tokens
from quizloom.operators import profile
from quizloom.operators import recode as R
from quizloom.operators import sampling as S
from quizloom.plans import registry_qa
from quizloom.plans.codebook_qa import codebook
from quizloom.sources.files import read_delimited, scratch_path, stored, write_delimited
from quizloom.sources.registry import VARS, registry
from quizloom.sources.tables import table

# Fixture corrections, identifying columns and sections by row range.
WRONG_CODES = {"Brand#11": "brand_11", "Brand#23": "brand_23"}
IDENTIFYING = ["c_name", "c_phone", "c_address"]
ROW_SECTIONS = [(0, 50, "Intake"), (50, 120, "Course"), (120, None, "Outcome")]
IDENTIFYING_VARS = ["v1", "v3", "v20", "v33"]
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyyMMdd"]


def wrong_codes(spark, sf):
    """Misspelt codes of the metadata are put right before anything joins on them."""
    cb = codebook(spark, sf).select("var", "sheet")
    return cb.select("var", R.correct_codes("sheet", WRONG_CODES).alias("sheet"))


def drop_identifying(spark, sf):
    """Identifying columns go, whether all of them are there or not."""
    return R.drop_identifying(table(spark, sf, "customer"), IDENTIFYING)


def row_sections(spark, sf):
    """Sections of a codebook by ranges of its rows."""
    return codebook(spark, sf).select("var", "ord", R.section_by_rows("ord", ROW_SECTIONS).alias("section"))


def fill_blank(spark, sf):
    """Missing text as an empty string."""
    return R.fill_missing(registry(spark, sf), VARS, "")


def tokens_to_null(spark, sf):
    """P36 + A1: uninformative tokens become null before the values are counted."""
    reg = registry(spark, sf)
    raw = reg.select("record_id", *[F.when(F.col(v).isNull(), F.when(F.pmod("record_id", F.lit(2)) == 0, "Unknown")).otherwise(F.col(v)).alias(v)
                                    for v in VARS])
    clean = raw.select("record_id", *[null_if_tokens(v, UNINFORMATIVE_TOKENS).alias(v) for v in VARS])
    values = profile.col_values(profile.unpivot_long(clean, "record_id", VARS))
    return values.select("var", "value", F.col("n").cast("long").alias("n"))


def patched_dict(spark, sf):
    """The codebook's dictionary with entries replaced, added and removed, identifying columns left out."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    var, named = F.concat(F.lit("v"), F.col("p_partkey").cast("string")), F.upper("p_name")
    entries = p.where(F.pmod("p_partkey", F.lit(10)) > 0).select(
        var.alias("var"), F.col("p_name").alias("display_name"), F.concat(F.lit("["), F.col("p_brand"), F.lit("]")).alias("section"))
    size = F.col("p_size")
    action = F.when(size <= 5, "replace").when(size <= 10, "add").when(size >= 48, "remove")
    changes = p.where(action.isNotNull()).select(
        var.alias("var"), F.when(size < 48, named).alias("display_name"),
        F.when(F.pmod(size, 2) == 0, F.lit("[Patched]")).when(size.between(6, 10), F.lit("[Added]")).alias("section"), action.alias("action"))
    return R.patch_dictionary(entries, changes, IDENTIFYING_VARS)


def class_minimum(spark, sf, least: int = 3):
    """A7 + F10: per column its rarest class, and whether every class has at least ``least`` rows."""
    values = profile.col_values(profile.unpivot_long(registry(spark, sf), "record_id", VARS)).where("value IS NOT NULL")
    return values.groupBy("var").agg(F.min("n").cast("long").alias("min_class"), F.count("*").alias("n_classes"),
                                     (F.min("n") >= least).alias("usable"))


def flexible_dates(spark, sf):
    """Timestamps read in whichever of several formats fits."""
    e = table(spark, sf, "events").select("event_id", "ts")
    kind = F.pmod("event_id", F.lit(4))
    text = (F.when(kind == 0, F.date_format("ts", DATE_FORMATS[0])).when(kind == 1, F.date_format("ts", DATE_FORMATS[1]))
            .when(kind == 2, F.date_format("ts", DATE_FORMATS[2])).otherwise(F.concat(F.lit("at "), F.date_format("ts", "HH:mm"))))
    return e.select("event_id", text.alias("raw"), F.date_format(R.any_datetime(text, DATE_FORMATS), "yyyy-MM-dd HH:mm:ss").alias("dt"))


def parallel_explode(spark, sf):
    """C11 + C12: parallel arrays, then a struct of arrays, back to rows in step."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    packed = li.groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.struct(
        F.col("r")["l_linenumber"].alias("line"), F.col("r")["l_partkey"].alias("part"), F.col("r")["l_quantity"].alias("qty")).alias("s"))
    return R.rows_of_arrays(packed, "s", ["line", "part", "qty"])


def map_of_pairs(spark, sf):
    """A map from (key, value) pairs of a group, looked up by key."""
    values = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    m = values.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    return m.select("l_orderkey", *[F.try_element_at("m", F.lit(k)).alias(f"n_{k.lower()}") for k in ("A", "N", "R")])


def debug_subset(spark, sf, n: int = 50):
    """The first n records by key (a debugging switch: the limit is the feature)."""
    return S.debug_subset(registry(spark, sf).select("record_id", "status"), "record_id", n)


def csv_literal(spark, sf):
    """Blanks and "NA" survive as values under the literal policy."""
    reg = registry(spark, sf).select(F.col("record_id").cast("string").alias("record_id"), F.coalesce("status", F.lit("")).alias("status"),
                                     F.coalesce("segment", F.lit("NA")).alias("segment"))
    path = scratch_path(spark, "literal-csv")
    write_delimited(reg, path)
    return read_delimited(spark, path, reg.columns, na_policy="literal")


def stored_profile(spark, sf):
    """The profile written as a Parquet table and read back."""
    reg = registry(spark, sf)
    prof = registry_qa.build_profile(reg, gm_method=None, materialize="values")
    back = stored(prof.summary, "profile-summary")
    return back.select("var", "n_keys", "n_vocab", F.round("float_ratio", 6).alias("float_ratio"), "is_numeric")
