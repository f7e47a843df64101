"""Cleaning / recoding plans over the fixture registry (P-operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.functions.hashing import u
from quizloom.operators import recode as R
from quizloom.operators.profile import unpivot_long
from quizloom.sources.registry import COL_DICT, VARS, registry
from quizloom.sources.tables import table

# Fixture code tables.
STATUS_CODES = [("status", "F", "Finished"), ("status", "O", "Open"), ("status", "P", "Pending")]
MULTI_CODES = {1: "Alpha", 2: "Beta", 3: "Gamma"}
PRIORITY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def registry_view(spark, sf):
    """P1 + P2 + P4 + P31: dictionary-ordered, lower-cased columns + constant split column."""
    reg = R.lower_columns(registry(spark, sf).withColumnsRenamed({"record_id": "Record_ID"}))
    return R.select_by_dict(reg, "record_id", COL_DICT).withColumn("split_2020", F.lit("valid"))


def unpivot(spark, sf):
    """Wide -> (record_id, var, value)."""
    return unpivot_long(registry(spark, sf), "record_id", VARS)


def recode_codes(spark, sf):
    """Codebook recode in long form."""
    codes = spark.createDataFrame(STATUS_CODES, "var string, code string, label string")
    return R.recode_long(unpivot_long(registry(spark, sf), "record_id", VARS), codes)


def _mc_raw():
    """Multi-code text from the record's own columns; every branch of P10 has rows."""
    n, p = F.col("line_count"), F.col("priority")
    return (F.when(p == "1-URGENT", F.concat_ws(",", n, F.substring(p, 1, 1))).when(p == "2-HIGH", F.concat(n, F.lit(",,")))
            .when(p == "3-MEDIUM", n).when(F.col("status") == "F", F.lit("No")).when(F.col("status") == "O", F.lit("NA,"))
            .otherwise(F.lit("")))


def multi_code(spark, sf):
    """P10: multi-code recode with quarantine of unknown codes."""
    reg = registry(spark, sf).select("record_id", _mc_raw().alias("raw"))
    mapped, unknown = R.multi_code("raw", MULTI_CODES)
    return reg.select("record_id", "raw", mapped.alias("mapped"), unknown.alias("unknown"))


def _sent_raw():
    x = u("sent", F.col("record_id"))
    return (F.when(x < 0.05, F.lit("999")).when(x < 0.08, F.lit("9999.0")).when(x < 0.1, F.lit(" "))
            .otherwise(F.col("line_count")))


def sentinel_na(spark, sf):
    """P12 + P25/P36: sentinels -> NA, blanks -> null, then token normalisation."""
    reg = registry(spark, sf).select("record_id", _sent_raw().alias("raw"))
    s = R.sentinel_na("raw")
    return reg.select("record_id", "raw", s.alias("cleaned"), R.token_norm(s).alias("normalized"))


def gate_fill(spark, sf):
    """Segment missing -> "no" only when the gate (status F) is "yes"."""
    reg = registry(spark, sf)
    gate = F.when(F.col("status") == "F", "yes").otherwise("no")
    return reg.select("record_id", gate.alias("gate"), R.gate_fill("segment", gate).alias("segment"))


def mask_overlay(spark, sf):
    """Value -> "N/A" where a keyed 0/1 mask table says unobserved."""
    reg = registry(spark, sf)
    long = unpivot_long(reg, "record_id", VARS)
    mask = long.select("record_id", "var", (u("obs", F.col("var"), F.col("record_id")) >= 0.2).cast("int").alias("observed"))
    j = long.join(mask, ["record_id", "var"])
    return j.select("record_id", "var", F.when(F.col("observed") == 0, F.lit("N/A")).otherwise(F.col("value")).alias("value"))


def case_collision(spark, sf):
    """Case-insensitive collisions lower-cased."""
    reg = registry(spark, sf).select(
        "record_id", F.when(u("case", F.col("record_id")) < 0.2, F.lower("segment")).otherwise(F.col("segment")).alias("segment"))
    return R.case_collisions(reg, "segment")


def date_minutes(spark, sf):
    """P20 + P21 + P22: date + time -> timestamp, minutes since first shipment, years."""
    reg = registry(spark, sf)
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("anchor"))
    hh = F.floor(u("hh", F.col("record_id")) * 24).cast("int")
    t = F.when(u("tm", F.col("record_id")) < 0.05, F.lit("")).otherwise(F.format_string("%02d:%02d", hh, F.pmod(F.col("record_id"), 60)))
    dt = R.combine_datetime("order_date", t)
    j = reg.join(li, reg.record_id == li.l_orderkey, "left")
    return j.select("record_id", F.date_format(dt, "yyyy-MM-dd HH:mm").alias("dt"),
                    R.minutes_since(dt, F.col("anchor").cast("timestamp")).alias("minutes"),
                    R.days_to_years(F.col("ship_days").try_cast("double")).alias("years"))


def family_reset(spark, sf):
    """Status 0 resets the (value, detail, status) family."""
    reg = registry(spark, sf).select(
        "record_id", F.col("discount").alias("disc"), F.col("line_count").alias("disc_c"),
        F.when(u("fam", F.col("record_id")) < 0.3, F.lit(0)).otherwise(F.lit(1)).alias("disc_s"))
    return R.family_reset(reg, ["disc"])


def binary_labels(spark, sf):
    """P11 + P14: 1/0 -> Yes/No, truthiness form, presence flags."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    flag = F.when(u("bl", F.col("o_orderkey")) < 0.1, F.lit(None)).otherwise((F.col("o_orderstatus") == "F").cast("int"))
    o = o.withColumn("flag", flag)
    return o.select("o_orderkey", R.binary_label("flag").alias("yes_no"),
                    R.binary_label("flag", "Female", "Male", truthiness=True).alias("truthy"),
                    R.presence_flag("flag").alias("present"))


def ordinal_codes(spark, sf):
    """Declared-order codes, missing = -1."""
    reg = registry(spark, sf)
    return reg.select("record_id", R.ordinal_code("priority", PRIORITY_ORDER).alias("priority_code"))


def leakage_guard(spark, sf):
    """Drop post-outcome columns by name rule, keep the target."""
    reg = registry(spark, sf)
    kept = R.drop_by_rule(reg, contains=("ship", "quantity"), keep=("ship_days",))
    return kept


def csv_roundtrip(spark, sf):
    """Registry written as CSV (nulls as "NA"), read back with a declared
    schema and the default NA-token policy."""
    from quizloom.sources.files import read_delimited, scratch_path, write_delimited
    reg = registry(spark, sf).select("record_id", *VARS)
    path = scratch_path(spark, "registry-csv")
    write_delimited(reg, path)
    back = read_delimited(spark, path, ["record_id"] + VARS, na_policy="default")
    return back.withColumn("record_id", F.col("record_id").cast("long"))


def read_split(spark, sf):
    """S4 + S5 + F5: write records partitioned by holdout split, read 'valid' back (partition pruning)."""
    from quizloom.operators.sampling import holdout_split
    from quizloom.sources.files import read_split as rs
    from quizloom.sources.files import scratch_path, write_splits
    reg = registry(spark, sf)
    path = scratch_path(spark, "splits")
    write_splits(holdout_split(reg, "record_id", 1000), path)
    return rs(spark, path, "valid")


def section_hoist(spark, sf):
    """Sectioned text with the customer section moved first under a new heading."""
    from quizloom.operators.serialize import serialize_hoisted
    reg = registry(spark, sf)
    return reg.select("record_id", serialize_hoisted(COL_DICT, "[Customer/Profile]", "[Baseline/Customer Information]")
                      .alias("text"))


def serialize_until_gap(spark, sf):
    """T4: sectioned text that stops at the first empty section; masked target = nation."""
    from quizloom.operators.serialize import serialize_until_gap as sug
    reg = registry(spark, sf).where(F.col("nation").isNotNull())
    return reg.select("record_id", sug(COL_DICT, F.lit("nation")).alias("text"))


def serialize_flat_text(spark, sf):
    """Flat ``name: value`` record text (no mask)."""
    from quizloom.operators.serialize import serialize_flat
    return registry(spark, sf).select("record_id", serialize_flat(COL_DICT).alias("text"))


# Ordinal merge table of the fixture (edu1, edu2) -> label; None = any.
EDU_TABLE = {(0, None): "None", (1, 0): "Primary", (1, 1): "Middle", (2, 0): "High", (2, 1): "College", (3, None): "Graduate"}
ACCENTED = "[À-ÿ]"


def mv_reconcile(spark, sf):
    """P17."""
    reg = registry(spark, sf).select("record_id", F.col("line_count").alias("a"), F.substring("priority", 1, 1).alias("b"))
    x, y = R.reconcile_ranges("a", "b")
    return reg.select("record_id", "a", "b", x.alias("mv_a"), y.alias("mv_b"))


def edu_merge(spark, sf):
    """P18."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return c.select("c_custkey", R.merge_ordinal(F.pmod("c_custkey", 5), F.pmod("c_nationkey", 2), EDU_TABLE).alias("edu"))


def script_translate(spark, sf):
    """P24 + S3 + J6: every line of each document, translated through a dictionary
    derived from the data when it contains an accented letter."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    dic = (d.select(F.col("line").alias("source")).distinct().where(F.col("source").rlike(ACCENTED))
           .select("source", F.concat(F.lit("tr:"), F.lower("source")).alias("target")))
    return R.translate_if_script(d, "line", dic, ACCENTED)


# Fixture codebooks of the residual recode.
YES_CODES = {1: "Yes"}
NUM_CODES = {1: "One", 2: "Two", 10: "Ten"}
NUM_ALIASES = {11: 10}


def residual_codes(spark, sf):
    """Yes-type and numbered codebooks with the residual fallbacks."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code"))
    ya, yb = R.residual_recode("code", YES_CODES)
    na, _ = R.residual_recode("code", NUM_CODES, NUM_ALIASES)
    return c.select("c_custkey", "code", ya.alias("yes_label"), yb.alias("bad"), na.alias("num_label"))


def single_value(spark, sf):
    """Single-valued daily column filled from its pivot column."""
    reg = registry(spark, sf)
    d = reg.select("record_id",
                   F.when(F.col("status") == "F", F.lit("Yes"))
                   .when(u("sv", F.col("record_id")) < 0.3, F.lit("NA")).otherwise(F.lit("")).alias("d1_icud1"),
                   F.when(u("piv", F.col("record_id")) < 0.2, F.lit("NA")).otherwise(F.lit("Y")).alias("na_icud1"))
    return R.single_value_fill(d, "d1_icud1", "na_icud1")


def unit_names(spark, sf):
    """Display names with whitelisted, rewritten units."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    unit = F.element_at(F.array(F.lit("kg"), F.lit("kg/m2"), F.lit("furlong"), F.lit("103/uL")),
                        (F.pmod("p_size", 4) + 1).cast("int"))
    return p.select("p_partkey", R.name_with_unit(F.concat(F.lit(" "), F.col("p_name")), unit).alias("display"))
