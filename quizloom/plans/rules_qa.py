"""Plans of column rules: residual codes, fills, merged codes, cohorts with known outcomes, dictionary files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.functions.hashing import u
from quizloom.operators import recode as R
from quizloom.plans.sampling_qa import SEED, temporal_cohort
from quizloom.sources.files import read_dictionary, scratch_path, write_dictionary
from quizloom.sources.registry import registry
from quizloom.sources.tables import table

# Codebooks and rules of the fixture's columns.
MEDIUM_CODES, COUNT_CODES, STATE_CODES, NONE_CODES = {1: "Yes"}, {3: "three", 4: "four or more"}, {1: "alive", 2: "moved"}, {8: "NA"}
EDUCATION = {("0", None): "none", ("1", None): "none", ("2", None): "no school", ("3", "1"): "0-3 years", ("3", "2"): "4-6 years",
             ("3", "3"): "7 years or more"}
FILL_RULES = [("status", None, None, "no"), ("priority", "segment", "BUILDING", "no"), ("nation", "segment", "None", "unknown")]


def residual_columns(spark, sf):
    """Each column by its codebook and its own rules: a code that is null, an alias, a text, a codebook of one NA."""
    c = table(spark, sf, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(13)).cast("string").alias("code"))
    state = F.when(F.pmod("c_custkey", F.lit(5)) == 0, "not known").otherwise(F.col("code"))
    medium, bad = R.residual_recode("code", MEDIUM_CODES, null_codes=(2,))
    return c.select("c_custkey", medium.alias("medium"), bad.alias("bad"), R.residual_recode("code", COUNT_CODES, {5: 4})[0].alias("count"),
                    R.residual_recode(state, STATE_CODES, texts={"not known": "Unconfirmed"})[0].alias("state"),
                    R.residual_recode("code", NONE_CODES)[0].alias("kept"))


def fill_rules(spark, sf):
    """Gaps and the word None filled by a rule table, with and without a gate."""
    none = lambda c: F.when(F.col(c).isNull() & (F.pmod("record_id", F.lit(2)) == 0), "None").otherwise(F.col(c)).alias(c)
    reg = registry(spark, sf).select("record_id", none("status"), none("priority"), none("segment"), none("nation"))
    return R.fill_by_rules(reg, FILL_RULES)


def education_merge(spark, sf):
    """Two codes as one ordinal label; blanks, refusals and unknown pairs."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k = F.pmod("c_custkey", F.lit(7))
    a = F.when(k == 5, "").when(k == 6, F.when(F.pmod("c_nationkey", F.lit(2)) == 0, "999")).otherwise(k.cast("string"))
    b = F.when(F.pmod("c_nationkey", F.lit(6)) == 5, "999").when(F.pmod("c_nationkey", F.lit(6)) == 0, " ").otherwise(
        F.pmod("c_nationkey", F.lit(6)).cast("string"))
    label, bad = R.merge_pair(a, b, EDUCATION)
    return c.select("c_custkey", label.alias("edu"), bad.alias("bad"))


def known_cohort(spark, sf):
    """the temporal cohort of records whose outcomes are known: neither blank nor coded 9."""
    reg = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    grade = F.when(u(SEED, "grade", F.col("o_orderkey")) < 0.1, "9").when(u(SEED, "grade", F.col("o_orderkey")) < 0.2, "").otherwise(
        F.substring("o_orderpriority", 1, 1))
    event = F.when(u(SEED, "event", F.col("o_orderkey")) < 0.15, "").otherwise("seen")
    return R.known_outcomes(temporal_cohort(spark, sf).join(reg.select("o_orderkey", grade.alias("grade"), event.alias("event")), "o_orderkey"),
                            {"grade": ["", "9"], "event": [""]})


def dictionary_file(spark, sf):
    """S3 + J6: a translation dictionary written as JSON, read back and applied to a column."""
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    words = p.where(F.pmod("p_partkey", F.lit(3)) > 0).select(F.col("p_type").alias("source"), F.lower("p_type").alias("target")).distinct()
    path = scratch_path(spark, "dictionary")
    write_dictionary(words, path)
    read = read_dictionary(spark, path)
    return p.join(read, p["p_type"] == read["source"], "left").select("p_partkey", F.coalesce("target", "p_type").alias("type"))
