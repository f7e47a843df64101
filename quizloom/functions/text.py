"""Number/text canonicalisation shared by profile, distractors and serialisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_float(c) -> Column:
    """``str(float(x))`` for numeric text, the text itself otherwise."""
    c = _c(c)
    d = c.try_cast("double")
    return F.when(d.isNotNull(), d.cast("string")).otherwise(c)


def strip_zeros(c) -> Column:
    """``12.00`` -> ``12``, ``1.50`` -> ``1.5``, ``100`` stays, ``0.0`` -> ``0``."""
    c = _c(c)
    step1 = F.regexp_replace(c, r"(\d)\.0+$", "$1")
    # Text without a point is what it is.
    return F.when(c.contains("."), F.regexp_replace(step1, r"(\.\d*?[1-9])0+$", "$1")).otherwise(c)


def format_number(c) -> Column:
    """Text as is; integral -> ``%d``; else ``%.3f``."""
    c = _c(c)
    d = c.try_cast("double")
    return (
        F.when(d.isNull(), c)
        .when(F.floor(d) == d, F.format_string("%d", d.cast("long")))
        .otherwise(F.format_string("%.3f", d))
    )


def letter(idx) -> Column:
    """``chr(65 + idx)``."""
    return F.chr(F.lit(65) + _c(idx))
