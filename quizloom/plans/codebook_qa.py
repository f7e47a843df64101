"""Codebook plans over a codebook rendered from ``part`` (one sheet per brand)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.operators import codebook as C
from quizloom.operators.scan import first_codes
from quizloom.sources.tables import table


def codebook(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    rng = (F.when(F.pmod(F.col("p_size"), 4) == 0, F.concat(F.lit("[1]"), F.col("p_type"), F.lit("\n[2]"), F.col("p_name")))
           .when(F.pmod(F.col("p_size"), 4) == 1, F.concat(F.lit("Codes\n1 = "), F.col("p_type"), F.lit("\n2 = "), F.col("p_name")))
           .when(F.pmod(F.col("p_size"), 4) == 2, F.when(F.pmod(k, 2) == 0, F.concat(F.lit("[1] "), F.col("p_name")))
                 .otherwise(F.concat(F.lit("1 = "), F.col("p_name"))))
           .otherwise(F.concat(F.when(F.pmod(k, 2) == 0, F.lit("Title\n[A]")).otherwise(F.lit("[01]")), F.col("p_type"),
                               F.lit("\npassed over"), F.when(F.pmod(k, 3) == 0, F.lit("\n[x] void")).otherwise(F.lit("\n[2] two\n[2] last")))))
    coding = (F.when(F.pmod(k, 4) == 0, F.concat(F.lit("1="), F.col("p_type"), F.lit(",2="), F.col("p_brand")))
              .when(F.pmod(k, 4) == 1, F.concat(F.lit("1."), F.col("p_type"), F.lit(",2."), F.col("p_name")))
              .when(F.pmod(k, 4) == 2, F.concat(F.lit("1-"), F.col("p_type"), F.lit(",02-x")))
              .otherwise(F.when(F.col("p_size") > 25, F.concat(F.lit("1=x=y,2="), F.col("p_type"))).otherwise(F.col("p_name"))))
    return p.select(F.col("p_brand").alias("sheet"), k.alias("ord"), F.concat(F.lit("v"), k.cast("string")).alias("var"),
                    F.when(F.pmod(k, 7) == 0, F.concat(F.lit("Section "), F.col("p_type"))).alias("heading"),
                    rng.alias("range_text"), coding.alias("coding_text"))


def codebook_ranges(spark, sf):
    return C.parse_ranges(codebook(spark, sf))


def codebook_list(spark, sf):
    return C.parse_coding_list(codebook(spark, sf))


def header_ffill(spark, sf):
    return C.header_ffill(codebook(spark, sf))


def block_segments(spark, sf):
    return C.block_segments(codebook(spark, sf))


def name_align(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_size")
    a = p.where("p_size < 25").select(F.col("p_brand").alias("name"))
    b = p.where("p_size >= 25").select(F.regexp_replace("p_brand", "Brand#", "brand-").alias("name"))
    return C.align_names(a, b, "name")


def metadata_override(spark, sf, from_ord: int = 100):
    """For codebook rows at or after ``from_ord`` the range text is taken
    from the decision (coding) column."""
    cb = codebook(spark, sf)
    return cb.select("var", F.when(F.col("ord") >= from_ord, F.col("coding_text")).otherwise(F.col("range_text"))
                     .alias("range_text"))


# Translations of the fixture's headings.
HEADING_WORDS = {"Domain 2": "Second domain", "  Part 1\n ": "First part"}


def heading_rows(spark, sf):
    """Sheets of headings on two levels: not every row has one, some have blanks and line breaks."""
    k = F.col("p_partkey")
    no = lambda n, m: F.pmod(F.floor(k / n), F.lit(m)).cast("string")
    return table(spark, sf, "part").select(
        F.concat(F.lit("S"), F.floor(k / 500).cast("string")).alias("sheet"), k.alias("ord"),
        F.when(F.pmod(k, 37) == 5, F.concat(F.lit("Domain "), no(37, 4))).alias("domain"),
        F.when(F.pmod(k, 11) == 3, F.concat(F.lit("  Part "), no(11, 3), F.lit("\n "))).when(
            F.pmod(k, 11) == 8, F.concat(F.lit("Part\nof "), F.col("p_brand"))).alias("section"))


def header_levels(spark, sf):
    """Domain and section carried down on their own, translated and trimmed."""
    return C.header_levels(heading_rows(spark, sf), words=HEADING_WORDS)


def sheet_cells(spark, sf):
    """Sheets of cells: titles whose names come again, two layouts of headers, blank rows, rows outside
    blocks, blocks that nothing closes."""
    k, b = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    at, odd, open_ = F.pmod(k, 10), F.pmod(b, 2) == 1, F.pmod(b, 5) == 4
    def cell(title, head, odd_head, value):
        body = F.when(at == 1, F.when(odd, odd_head).otherwise(head)).otherwise(value)
        return F.when(at == 0, title).when((at == 8) & ~open_, F.lit(None)).otherwise(body)
    none, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    return table(spark, sf, "part").select(
        F.concat(F.lit("S"), F.floor(k / 400).cast("string")).alias("sheet"), k.alias("ord"),
        cell(F.concat(F.lit("Block "), F.pmod(b, 7).cast("string")), F.lit("name"), F.lit("code"), text("p_name")).alias("c0"),
        cell(none, F.lit("size"), F.lit("label"), F.when(F.pmod(k, 3) > 0, text("p_size"))).alias("c1"),
        cell(none, F.lit("type"), F.lit("name"), text("p_type")).alias("c2"),
        cell(none, F.lit("size"), none, F.when(F.pmod(k, 4) > 0, text("p_brand"))).alias("c3"))


def sheet_blocks(spark, sf):
    """Blocks with their own headers, closed by blank rows."""
    return C.sheet_blocks(sheet_cells(spark, sf), ["c0", "c1", "c2", "c3"])


def appearance_codes(spark, sf):
    """A text column's values numbered in the order in which rows first have them."""
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("pair"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    return first_codes(li, "pair", "row")
