"""Projection, cleaning and recoding operators (Column expressions and
broadcast joins against small code tables; no per-row Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions.missing import UNINFORMATIVE_TOKENS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_columns(df: DataFrame) -> DataFrame:
    """P1."""
    return df.toDF(*[c.lower() for c in df.columns])


def select_by_dict(df: DataFrame, id_col: str, col_dict: list) -> DataFrame:
    """Keep only mapped columns, in dictionary order."""
    return df.select(id_col, *[v for v, *_ in col_dict if v in df.columns])


def drop_by_rule(df: DataFrame, contains=(), prefixes=(), regex: str | None = None, keep=()) -> DataFrame:
    """Drop columns by name rule (driver-side on names only), keeping ``keep``."""
    import re
    drop = [c for c in df.columns if c not in keep and (any(s in c for s in contains) or any(c.startswith(p) for p in prefixes)
                                                       or (regex is not None and re.search(regex, c)))]
    return df.drop(*drop)


def recode_long(long: DataFrame, codes: DataFrame) -> DataFrame:
    """(var, code) -> label; unmapped values kept.  The join follows the code table's size."""
    c = codes.select("var", F.col("code").alias("value"), "label")
    return long.join(c, ["var", "value"], "left").withColumn(
        "value", F.coalesce("label", "value")).drop("label")


def multi_code(v, mapping: dict) -> tuple[Column, Column]:
    """P10: every trailing comma is stripped, then the whole value decides: blank -> null, "NA"
    stays, a code -> its label, ``"3,1"`` -> sorted codes mapped and joined by ", ", "No" stays.
    Returns (mapped, unknown): anything else yields null and unknown = true (quarantine
    instead of failing the job)."""
    m = F.create_map(*[x for k, lab in mapping.items() for x in (F.lit(str(k)), F.lit(lab))])
    s = F.regexp_replace(_c(v).cast("string"), ",+$", "")
    parts = F.transform(F.array_sort(F.split(s, ",")), lambda p: F.try_element_at(m, F.trim(p)))
    several = s.contains(",") & ~F.exists(parts, lambda x: x.isNull())
    one = F.try_element_at(m, s)
    mapped = (F.when(s == "", F.lit(None)).when(s == "NA", s).when(one.isNotNull(), one)
              .when(several, F.array_join(parts, ", ")).when(s == "No", s))
    return mapped, F.coalesce(mapped.isNull() & (s != ""), F.lit(False))


def sentinel_na(v, sentinels=(999, 9999)) -> Column:
    """Blank -> null; sentinel numbers (numeric or digit text) -> "NA"."""
    v = _c(v)
    d = F.trim(v).try_cast("double")
    return F.when(v.isNull() | (F.trim(v) == ""), F.lit(None)).when(d.isin(*sentinels), F.lit("NA")).otherwise(v)


def fill_by_rules(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """P15 by a rule table of (column, gate, gate value, fill): a missing value or the word ``None`` becomes ``fill``
    where the gate has its value, or anywhere if the rule has no gate.  Gates are read before any fill."""
    def filled(c, gate, value, fill):
        gap = F.col(c).isNull() | (F.col(c) == "None")
        return F.when(gap & (F.coalesce(F.col(gate) == value, F.lit(False)) if gate else F.lit(True)), F.lit(fill)).otherwise(F.col(c))
    return df.withColumns({c: filled(c, gate, value, fill) for c, gate, value, fill in rules})


def gate_fill(target, gate, gate_value: str = "yes", fill: str = "no") -> Column:
    """Missing -> ``fill`` only where the gate column equals ``gate_value``."""
    return F.when(_c(target).isNull() & (_c(gate) == gate_value), F.lit(fill)).otherwise(_c(target))


def binary_label(c, yes="Yes", no="No", truthiness: bool = False) -> Column:
    """1/0 -> labels; truthiness form maps null and any non-zero to ``yes``."""
    c = _c(c)
    if truthiness:
        return F.when(c.isNull() | (c != 0), F.lit(yes)).otherwise(F.lit(no))
    return F.when(c == 1, F.lit(yes)).when(c == 0, F.lit(no)).otherwise(c.cast("string"))


def presence_flag(c, null_as: str = "No") -> Column:
    """P14: "yes", "1", "True" -> "Yes"; null -> ``null_as``; anything else "No"."""
    c = _c(c).cast("string")
    return F.when(c.isNull(), F.lit(null_as)).when(c.isin("yes", "1", "True", "1.0"), F.lit("Yes")).otherwise(F.lit("No"))


def token_norm(c) -> Column:
    """P25 + P36: uninformative tokens -> null, Yes/No -> yes/no."""
    c = _c(c)
    return (F.when(c.isin(*UNINFORMATIVE_TOKENS), F.lit(None))
            .when(c == "Yes", F.lit("yes")).when(c == "No", F.lit("no")).otherwise(c))


def family_reset(df: DataFrame, stems: list[str]) -> DataFrame:
    """For each stem, status 0 => (value, detail, status) := (0, null, null)."""
    for s in stems:
        z = F.col(f"{s}_s") == 0
        df = df.withColumns({s: F.when(z, F.lit("0")).otherwise(F.col(s)),
                             f"{s}_c": F.when(z, F.lit(None)).otherwise(F.col(f"{s}_c")),
                             f"{s}_s": F.when(z, F.lit(None)).otherwise(F.col(f"{s}_s"))})
    return df


def combine_datetime(d, t, fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    """P20: date + time text -> timestamp; null when either part is blank."""
    d, t = _c(d), _c(t)
    blank = d.isNull() | t.isNull() | (F.trim(d) == "") | (F.trim(t) == "")
    return F.when(~blank, F.try_to_timestamp(F.concat_ws(" ", d, t), F.lit(fmt)))


def minutes_since(ts, anchor) -> Column:
    """Whole minutes since the anchor, floored like Python ``//``."""
    return F.floor((F.unix_seconds(_c(ts)) - F.unix_seconds(_c(anchor))) / 60).cast("long")


def days_to_years(days) -> Column:
    """Half-even rounding of days / 365.25."""
    return F.bround(_c(days) / 365.25, 0)


def case_collisions(df: DataFrame, col: str) -> DataFrame:
    """Lower-case values of ``col`` whose lower-case form has more than one spelling.

    The collision table has one row per colliding value; the join follows its size."""
    g = (df.where(F.col(col).isNotNull()).groupBy(F.lower(col).alias("_lk"))
         .agg(F.count_distinct(col).alias("_nd")).where("_nd > 1").select("_lk"))
    j = df.join(g, F.lower(df[col]) == g["_lk"], "left")
    return j.withColumn(col, F.when(F.col("_lk").isNotNull(), F.lower(col)).otherwise(F.col(col))).drop("_lk")


def ordinal_code(c, order: list[str]) -> Column:
    """Declared-order integer code; missing or unlisted = -1."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(m, _c(c)), F.lit(-1))


def reconcile_ranges(a, b, range_a=("1", "2"), range_b=("3", "4")) -> tuple[Column, Column]:
    """(a, b) whose codes belong to two exclusive ranges: a code in the wrong column moves
    to the right one and the other becomes "NA" (a is looked at first); no code: unchanged."""
    a, b, na = _c(a).cast("string"), _c(b).cast("string"), F.lit("NA")
    cases = [(a.isin(*range_b), na, a), (a.isin(*range_a), a, na), (b.isin(*range_b), na, b), (b.isin(*range_a), b, na)]
    left, right = None, None
    for is_it, x, y in cases:
        left = F.when(is_it, x) if left is None else left.when(is_it, x)
        right = F.when(is_it, y) if right is None else right.when(is_it, y)
    return left.otherwise(a), right.otherwise(b)


def merge_ordinal(a, b, table: dict) -> Column:
    """(a, b) pair -> ordinal label by a declared table; ``None`` in the
    key matches any b; an unknown pair gives null (quarantine)."""
    expr = None
    for (ka, kb), lab in table.items():
        cond = (_c(a) == ka) if kb is None else ((_c(a) == ka) & (_c(b) == kb))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def merge_pair(a, b, table: dict, refused: str = "999") -> tuple[Column, Column]:
    """P18 in full: codes (as text) to an ordinal label, and whether the pair is unknown (label null).

    A blank first code gives null; a refused one on either side "NA"; so does a blank second code where the
    table tells the first one's labels apart by the second.
    """
    x, y = F.coalesce(F.trim(_c(a)), F.lit("")), F.coalesce(F.trim(_c(b)), F.lit(""))
    split = sorted({ka for ka, kb in table if kb is not None})
    label = merge_ordinal(x, y, table)
    done = (x == "") | (x == refused) | (y == refused) | (x.isin(*split) & (y == ""))
    out = F.when(x == "", F.lit(None)).when(done, F.lit("NA")).otherwise(label)
    return out, ~done & label.isNull()


def translate_if_script(df: DataFrame, col: str, dictionary: DataFrame, script_class: str) -> DataFrame:
    """P24 + S3 + J6: values containing the script are replaced whole by their
    dictionary entry; others are kept and don't take part in the join's key."""
    d = dictionary.select(F.col("source").alias("_src"), F.col("target").alias("_tgt"))
    j = df.join(d, df[col] == d["_src"], "left")
    hit = F.col(col).rlike(script_class) & F.col("_tgt").isNotNull()
    return j.withColumn(col, F.when(hit, F.col("_tgt")).otherwise(F.col(col))).drop("_src", "_tgt")


# Units shown after a display name, and unit spellings rewritten.
ACTIVE_UNITS = ["cm", "kg", "kg/m2", "mmHg", "/min", "℃", "mmol/L", "∙103/uL", "%", "/uL", "g/dL", "mg/dL", "U/L",
                "INR", "mg/L", "ng/mL", "mcg/mL", "pg/mL", "103/uL", "mL", "Days", "Minutes"]
UNIT_REWRITES = {"kg/m2": "kg/m^2", "∙103/uL": "10^3/uL", "103/uL": "10^3/uL"}


def name_with_unit(name, unit) -> Column:
    """``name (unit)`` when the unit is whitelisted (rewritten if listed), else the trimmed name."""
    n, u_ = F.trim(_c(name)), _c(unit)
    rew = F.create_map(*[x for k, v in UNIT_REWRITES.items() for x in (F.lit(k), F.lit(v))])
    shown = F.coalesce(F.try_element_at(rew, u_), u_)
    return F.when(u_.isin(*ACTIVE_UNITS), F.concat(n, F.lit(" ("), shown, F.lit(")"))).otherwise(n)


def residual_recode(x, mapping: dict, aliases: dict | None = None, null_codes: tuple = (),
                    texts: dict | None = None) -> tuple[Column, Column]:
    """Code -> label with the residual rules: a yes-type codebook maps 0 ->
    "no" and 9 -> "NA" (anything else is bad: null + flag); otherwise aliases
    (e.g. 11 -> 10) resolve first, 9 -> "NA", anything else null.

    A column's own rules: ``null_codes`` of a yes-type codebook are null without a flag, ``texts`` gives the
    labels of whole texts.  A codebook of one entry that says "NA" leaves other values as they are.
    """
    if len(mapping) == 1 and "NA" in mapping.values():
        return F.when(F.trim(_c(x).cast("string")) == str(next(iter(mapping))), F.lit("NA")).otherwise(_c(x)), F.lit(False)
    m = F.create_map(*[y for k, v in mapping.items() for y in (F.lit(str(k)), F.lit(v))])
    xs = F.trim(_c(x).cast("string"))
    direct = F.try_element_at(m, xs)
    if mapping.get(1) in ("yes", "Yes"):
        res = F.when(direct.isNotNull(), direct).when(xs == "0", F.lit("no")).when(xs == "9", F.lit("NA"))
        bad = direct.isNull() & ~xs.isin("0", "9", *[str(c) for c in null_codes])
        return res, bad
    al = F.create_map(*[y for k, v in (aliases or {}).items() for y in (F.lit(str(k)), F.lit(str(v)))])
    via = F.try_element_at(m, F.try_element_at(al, xs))
    res = F.when(direct.isNotNull(), direct).when(via.isNotNull(), via)
    for text, label in (texts or {}).items():
        res = res.when(xs == text, F.lit(label))
    return res.when(xs == "9", F.lit("NA")), F.lit(False)


def single_value_fill(df: DataFrame, col: str, pivot: str) -> DataFrame:
    """A column with exactly one value besides "" and "NA" keeps it; other
    rows become "" where the pivot column is "NA", else "No".  The one-value test
    is one aggregate (A6) over the column."""
    row = (df.where(F.col(col).isNotNull() & ~F.col(col).isin("", "NA"))
           .agg(F.count_distinct(col).alias("nd"), F.min(col).alias("key")).first())   # one summary row
    if row["nd"] != 1:
        return df
    key = row["key"]
    return df.withColumn(col, F.when(F.col(col) == key, F.col(col)).when(F.col(pivot) == "NA", F.lit(""))
                         .otherwise(F.lit("No")))


def correct_codes(c, mapper: dict) -> Column:
    """Wrong codes -> right ones; others kept."""
    m = F.create_map(*[x for k, v in mapper.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(c)), _c(c))


def drop_identifying(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns that are there (case ignored)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def section_by_rows(ord_col, ranges: list[tuple]) -> Column:
    """Label of the range [from, to) that holds a row number; an open end is ``None``."""
    o, expr = _c(ord_col), None
    for lo, hi, label in ranges:
        inside = (o >= lo) if hi is None else ((o >= lo) & (o < hi))
        expr = F.when(inside, F.lit(label)) if expr is None else expr.when(inside, F.lit(label))
    return expr


def fill_missing(df: DataFrame, cols: list[str], value: str = "") -> DataFrame:
    """Null -> ``value`` in text columns."""
    return df.fillna(value, subset=cols)


def patch_dictionary(dictionary: DataFrame, changes: DataFrame, identifying: list[str] = ()) -> DataFrame:
    """(var, display_name, section, added) after ``changes`` (var, display_name, section, action).

    ``replace`` gives a known column a new name and section (a null keeps the old), ``add`` does so too and
    brings in an unknown column, ``remove`` takes a column out; a replacement of an unknown column is
    passed over.  Columns that identify a person go whatever the changes say.
    """
    c = changes.select("var", F.col("display_name").alias("_n"), F.col("section").alias("_s"), F.col("action").alias("_a"))
    both = dictionary.select("var", "display_name", "section", F.lit(True).alias("_known")).join(c, "var", "full")
    known, action = F.col("_known").isNotNull(), F.coalesce("_a", F.lit(""))
    both = both.where((action != "remove") & (known | (action == "add")) & ~F.col("var").isin(*identifying))
    return both.select("var", F.coalesce("_n", "display_name").alias("display_name"), F.coalesce("_s", "section").alias("section"),
                       (~known).alias("added"))


def any_datetime(c, formats: list[str]) -> Column:
    """The first format that reads the text; none -> null."""
    return F.coalesce(*[F.try_to_timestamp(_c(c), F.lit(f)) for f in formats])


def rows_of_arrays(df: DataFrame, struct: str, fields: list[str]) -> DataFrame:
    """A struct of parallel arrays -> one row for each position."""
    rest = [c for c in df.columns if c != struct]
    zipped = F.arrays_zip(*[F.col(f"{struct}.{f}").alias(f) for f in fields])
    return df.select(*rest, F.inline(zipped)).toDF(*rest, *fields)


def known_outcomes(df: DataFrame, unknown: dict[str, list[str]]) -> DataFrame:
    """rows whose outcome columns are all there and none of the values that stand for "not known"."""
    for c, values in unknown.items():
        df = df.where(F.col(c).isNotNull() & ~F.col(c).isin(*values))
    return df
