"""Hash-seeded uniforms: the only source of randomness in the library.

``u(seed, *parts)`` maps a key tuple to a double in (0, 1) from the first 52
bits of an MD5 digest.  The same formula in SQL is
``(CAST(CAST('0x' || substr(md5(k), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 2^52`` (doubles)
with ``k = concat_ws('|', seed, parts...)``; both engines agree bit for bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(2**52)
DEFAULT_SEED = 42


def _as_col(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def hash_key(seed, *parts) -> Column:
    return F.concat_ws("|", _as_col(seed), *[_as_col(p) for p in parts])


def u_digits(seed, *parts) -> Column:
    """The hexadecimal digits that ``u(seed, *parts)`` is made of; as text they order as the uniforms do."""
    return F.substring(F.md5(hash_key(seed, *parts)), 1, 13)


def u(seed, *parts) -> Column:
    """Uniform in (0, 1), a pure function of (seed, parts)."""
    return (F.conv(u_digits(seed, *parts), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(TWO52)


def u_at_least(least: float, seed, *parts) -> Column:
    """``u(seed, *parts) >= least`` by the digits alone: no step of ``u`` rounds, so they order as the numbers do."""
    first = max(0, math.ceil(least * TWO52 - 0.5))
    if first >= TWO52:
        return F.lit(False)
    return F.md5(hash_key(seed, *parts)) >= F.lit(f"{first:013x}")


def sql_u(seed, *parts: str) -> str:
    """The same uniform as a DuckDB/ANSI SQL expression (parts are SQL expressions)."""
    key = "concat_ws('|', " + ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"
    return f"((CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"
