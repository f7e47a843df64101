"""Codebook parsing and layout operators.

A codebook is (sheet, ord, var, heading, range_text, coding_text).  Codes are read inside
their own row; running values go down a sheet by ranges of its rows, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.operators.scan import running

# The forms of a coding line.
SINGLE = r"\[(\d)\] (.*)"
BRACKET = r"\[([A-Z0-9]+)\](.*)"
EQUALS = r"(\d+)\s?=\s?(.*)"
# Separators tried in order for comma-list codings.
LIST_SEPARATORS = ["=", ".", "-"]


def _translated(label, words: dict | None):
    """The label's entry in a translation table, or the label."""
    if not words:
        return label
    table = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, label), label)


def _code(text):
    """Digits as a number's text (``01`` is 1), other codes as they are."""
    return F.when(text.rlike(r"^\d+$"), text.cast("decimal(38,0)").cast("string")).otherwise(text)


def _last_wins(entries):
    """Of entries with one code the last."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["code"] == e["code"]))


def parse_ranges(cb: DataFrame, words: dict | None = None) -> DataFrame:
    """``[k]label`` / ``k = label`` lines -> (var, code, label), labels translated by ``words``.

    A text of one line is only read as ``[k] text`` and means {k: Yes, 0: No}.  Of several
    lines the first may be a title; a later one that begins like a code (``[`` or a digit)
    and isn't one voids the variable, and lines that begin otherwise are passed over.
    """
    text = F.coalesce("range_text", F.lit(""))
    lines = F.split(text, "\n")

    def entry(line, i):
        is_b, is_e = line.startswith("["), line.rlike(r"^\d")
        b, e = is_b & line.rlike(BRACKET), is_e & line.rlike(EQUALS)
        code = F.when(b, F.regexp_extract(line, BRACKET, 1)).when(e, F.regexp_extract(line, EQUALS, 1))
        label = F.when(b, F.regexp_extract(line, BRACKET, 2)).when(e, F.regexp_extract(line, EQUALS, 2))
        return F.struct(_code(code).alias("code"), _translated(F.trim(label), words).alias("label"),
                        ((is_b | is_e) & code.isNull() & (i > 0)).alias("bad"))

    k = F.regexp_extract(text, SINGLE, 1)
    pair = lambda c, x: F.struct(c.alias("code"), F.lit(x).alias("label"))
    single = F.when(k == "", F.array().cast("array<struct<code:string,label:string>>")).when(
        k == "0", F.array(pair(F.lit("0"), "No"))).otherwise(F.array(pair(k, "Yes"), pair(F.lit("0"), "No")))
    p = cb.select("var", "range_text", F.transform(lines, entry).alias("p"))
    good = F.transform(F.filter("p", lambda e: e["code"].isNotNull()), lambda e: F.struct(e["code"].alias("code"), e["label"].alias("label")))
    several = F.when(~F.exists("p", lambda e: e["bad"]), good)
    p = p.select("var", F.when(F.instr(text, "\n") > 0, several).otherwise(single).alias("e"))
    return p.select("var", F.explode(_last_wins(F.col("e"))).alias("e")).select("var", "e.code", "e.label")


def parse_coding_list(cb: DataFrame, overrides: dict[str, dict] | None = None, words: dict | None = None) -> DataFrame:
    """``1=A,2=B`` -> codes.  The text needs a comma; of ``=``, ``.`` and ``-`` the first that cuts
    every part in exactly two is the separator; none does -> no codes.  ``overrides`` gives the
    codes of whole texts by hand, ``words`` translates labels."""
    parts = F.split("coding_text", ",")
    cut = lambda s: F.transform(parts, lambda x: F.split(x, F.lit("\\Q" + s + "\\E")))
    chosen = None
    for s in LIST_SEPARATORS:
        fits = F.forall(cut(s), lambda x: F.size(x) == 2)
        chosen = F.when(fits, cut(s)) if chosen is None else chosen.when(fits, cut(s))
    entries = F.transform(F.when(F.instr("coding_text", ",") > 0, chosen), lambda x: F.struct(
        _code(F.trim(x[0])).alias("code"), F.trim(_translated(x[1], words)).alias("label")))
    for text, codes in (overrides or {}).items():
        own = F.array(*[F.struct(F.lit(str(k)).alias("code"), F.lit(v).alias("label")) for k, v in codes.items()])
        entries = F.when(F.col("coding_text") == text, own).otherwise(entries)
    e = cb.select("var", entries.alias("e"))
    return e.select("var", F.explode(_last_wins(F.col("e"))).alias("e")).select("var", "e.code", "e.label")


def header_ffill(cb: DataFrame) -> DataFrame:
    """W1, one level: section headings carried down each sheet as ``[sheet/heading]``."""
    h = F.col("h")
    return running(cb, "sheet", "ord", last={"h": F.col("heading")}).select(
        "var", F.when(h.isNotNull(), F.concat(F.lit("["), F.col("sheet"), F.lit("/"), h, F.lit("]"))).alias("header"))


def header_levels(cb: DataFrame, levels: tuple[str, str] = ("domain", "section"), words: dict | None = None) -> DataFrame:
    """W1, two levels, each carried down on its own: ``[domain/section]`` (``None`` before the first of a level).

    A heading is looked up in ``words`` as it stands, then trimmed, its line breaks made spaces.
    """
    clean = lambda c: F.replace(F.regexp_replace(_translated(F.col(c), words), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    names = [f"_{c}" for c in levels]
    filled = running(cb, "sheet", "ord", last={n: F.when(F.col(c).isNotNull(), clean(c)) for n, c in zip(names, levels)})
    shown = [F.coalesce(F.col(n), F.lit("None")) for n in names]
    return filled.select("sheet", "ord", F.concat(F.lit("["), shown[0], F.lit("/"), shown[1], F.lit("]")).alias("header"))


def block_segments(cb: DataFrame) -> DataFrame:
    """W2, numbers only: a heading row starts a block; a name keeps its first block."""
    b = running(cb, "sheet", "ord", total={"block": F.col("heading").isNotNull().cast("int")})
    return b.groupBy("sheet", "var").agg(F.min("block").alias("block"))


def sheet_blocks(rows: DataFrame, cells: list[str]) -> DataFrame:
    """The blocks of sheets of cells as (sheet, section, ord, name, value), nulls left out.

    A row with nothing but its first cell is a title.  The row after it holds the block's column names,
    the rows after that its records, up to the first blank row or the end of the sheet.  A title
    that meets another title before a blank row is void.  Of several blocks of a sheet with one title
    the first counts.  Rows outside blocks, and cells under no name, go.  Blocks have different columns, so
    a record is a row for each of its names; of a name that a header has twice, the last counts.
    """
    empty = [F.col(c).isNull() for c in cells]
    blank = F.lit(True)
    for e in empty:
        blank = blank & e
    title = ~empty[0]
    for e in empty[1:]:
        title = title & e
    r = running(rows.withColumns({"_title": title, "_blank": blank}), "sheet", "ord",
                last={"_at": F.when(title, F.col("ord")), "_gap": F.when(blank, F.col("ord"))})
    r = r.where(F.col("_at").isNotNull())
    inside = (F.col("ord") > F.col("_at")) & (F.coalesce("_gap", F.col("_at") - 1) < F.col("_at"))
    blocks = r.groupBy("sheet", "_at").agg(
        F.max(F.when(F.col("_title"), F.col(cells[0]))).alias("section"), F.max("_blank").alias("_closed"),
        F.min_by(F.array(*cells), F.when(inside, F.col("ord"))).alias("names"), F.min(F.when(inside, F.col("ord"))).alias("_head"))
    ends = blocks.groupBy("sheet").agg(F.max("_at").alias("_end"))
    first = blocks.join(ends, "sheet").where(F.col("_closed") | (F.col("_at") == F.col("_end"))) \
        .groupBy("sheet", "section").agg(F.min_by(F.struct("_at", "names", "_head"), "_at").alias("b")) \
        .select("sheet", "section", "b.*")
    records = r.where(inside).select("sheet", "_at", "ord", F.array(*cells).alias("cells")).join(first, ["sheet", "_at"]) \
        .where(F.col("ord") > F.col("_head"))
    pairs = records.select("sheet", "section", "ord", F.posexplode(F.arrays_zip("names", "cells")).alias("_p", "_c")).where(
        F.col("_c.names").isNotNull())
    return pairs.groupBy("sheet", "section", "ord", F.col("_c.names").alias("name")).agg(
        F.max_by("_c.cells", "_p").alias("value")).where("value IS NOT NULL")


def align_names(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """(A minus B, sorted) zipped by position with (B minus A, sorted)."""
    from quizloom.operators.sampling import global_position
    only_a = a.select(col).distinct().join(b.select(col).distinct(), col, "left_anti")
    only_b = b.select(col).distinct().join(a.select(col).distinct(), col, "left_anti")
    pa = global_position(only_a, [col]).withColumnRenamed(col, "name_a")
    pb = global_position(only_b, [col]).withColumnRenamed(col, "name_b")
    return pa.join(pb, "position").select("name_a", "name_b")
