"""One missing-value predicate for the four kinds of missing that coexist.

null, the empty string, the literal ``NA`` and ``N/A`` (and NaN for doubles)
are all "missing" after the source has applied its NA policy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as missing.
MISSING_TOKENS = ["", "NA", "N/A"]
# pandas' default NA strings for delimited reads.
DEFAULT_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                     "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Uninformative tokens nulled before statistics.
UNINFORMATIVE_TOKENS = ["NA", "Not measurable", "Unknown", "Not necessary", "N/A", ""]


def is_missing(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return c.isNull() | s.isin(*MISSING_TOKENS) | F.lower(s).isin("nan")


def null_if_tokens(c, tokens=DEFAULT_NA_TOKENS) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.isin(*tokens), c)
