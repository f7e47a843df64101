"""Record -> text, with the masked target shown as ``[MASK]``.

The record stays a wide row; each serialiser is one Column expression over the
column dictionary (schema sized), evaluated per question row inside
whole-stage codegen - no per-row Python and no re-grouping of long rows.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[MASK]"


def _present(c: str) -> Column:
    # The serialisers skip null and "" only; a literal "NA" is printed.
    return F.col(c).isNotNull() & (F.col(c).cast("string") != F.lit(""))


def _value(c: str, target: Column | None, strip: bool) -> Column:
    """``target``: a column name Column (one masked target) or an array Column
    of names (several masked targets)."""
    v = F.col(c).cast("string")
    v = F.trim(v) if strip else v
    if target is None:
        return v
    hit = F.array_contains(target, F.lit(c)) if vars(target).get("_is_array", False) else (target == F.lit(c))
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(MASK)).otherwise(v)


def targets_array(col: Column) -> Column:
    """Mark an array Column of target names for multi-target masking."""
    col._is_array = True
    return col


def _skip(c: str, drop: Column | None) -> Column:
    if drop is None:
        return F.lit(False)
    return F.coalesce(F.array_contains(drop, F.lit(c)), F.lit(False))


def serialize_flat(col_dict, target: Column | None = None) -> Column:
    """``name: value`` per present mapped column, in dictionary order."""
    lines = [F.when(_present(c), F.concat(F.lit(f"{name}: "), _value(c, target, True)))
             for c, name, _ in col_dict]
    return F.concat_ws("\n", *lines)


def _section_blocks(col_dict, target, drop, hoist=None):
    runs = [(sec, list(items)) for sec, items in groupby(col_dict, key=lambda t: t[2])]
    blocks = []
    for sec, items in runs:
        lines = [F.when(_present(c) & ~_skip(c, drop), F.concat(F.lit(f"{name.strip()}: "), _value(c, target, False)))
                 for c, name, _ in items]
        any_line = F.greatest(*[(_present(c) & ~_skip(c, drop)).cast("int") for c, _, _ in items]) \
            if len(items) > 1 else (_present(items[0][0]) & ~_skip(items[0][0], drop)).cast("int")
        header = hoist[1] if hoist and sec == hoist[0] else sec
        blocks.append((sec, F.when(any_line == 1, F.concat_ws("\n", F.lit(header), *lines)), lines))
    return blocks


def serialize_sections(col_dict, target: Column | None = None, drop: Column | None = None) -> Column:
    """Sections in dictionary order, ``\\n{header}\\n`` before each non-empty
    section, correlated columns (``drop``) left out."""
    return F.concat_ws("\n\n", *[b for _, b, _ in _section_blocks(col_dict, target, drop)])


def serialize_hoisted(col_dict, hoist_section: str, new_header: str,
                      target: Column | None = None, drop: Column | None = None) -> Column:
    """As T2, but ``hoist_section``'s lines go first under ``new_header``."""
    blocks = _section_blocks(col_dict, target, drop)
    hoisted = [F.concat_ws("\n", *lines) for sec, _, lines in blocks if sec == hoist_section]
    rest = [b for sec, b, _ in blocks if sec != hoist_section]
    if not hoisted:
        return F.concat_ws("\n\n", *rest)
    body = F.concat_ws("\n\n", *rest)
    h = hoisted[0]
    return F.when(h != F.lit(""), F.concat(F.lit(new_header + "\n"), h, F.lit("\n\n"), body)).otherwise(body)


def serialize_until_gap(col_dict, target: Column | None = None, drop: Column | None = None) -> Column:
    """T4: sections in order, stopping at the first empty section.

    A stop before the last section drops the empty header and keeps the text
    only if it contains the mask (else ""); an empty *last* section leaves its
    bare header, and a complete walk returns the text unchecked (as read).
    """
    blocks = _section_blocks(col_dict, target, drop)
    secs = [sec for sec, _, _ in blocks]
    bs = [b for _, b, _ in blocks]
    k_last = len(bs) - 1
    full = F.concat_ws("\n\n", *bs[:k_last], F.coalesce(bs[k_last], F.lit(secs[k_last])))
    expr = None
    for k in range(k_last):
        prefix = F.concat_ws("\n\n", *bs[:k]) if k else F.lit("")
        stop = F.when(prefix.contains(MASK), prefix).otherwise(F.lit(""))
        expr = F.when(bs[k].isNull(), stop) if expr is None else expr.when(bs[k].isNull(), stop)
    return full if expr is None else expr.otherwise(full)
