"""Mutual information with continuous columns by nearest neighbours.

A bounded hash sample of the records (``rows``, the operator's parameter) is turned into one
group for each ordered pair of columns of which one at least is continuous; a group is one
task's work and holds at most ``rows`` values.  Target and feature as in the binned form: rows
without the target are left out, a missing feature is -1.

* One side discrete: the distance to the k-th neighbour of the same class, and how many of all
  rows are nearer (classes of one row are left out).
* Both continuous: the distance to the k-th neighbour in the plane of both (the larger of the two
  distances), and how many rows are nearer on either axis alone.

Continuous values are divided by their standard deviation and moved by up to 1e-10 of their
scale, by hash, so that equal values are told apart the same way in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions.hashing import u
from quizloom.functions.missing import is_missing
from quizloom.operators.sampling import top_n_by_hash
from quizloom.sources.files import stored

NEIGHBOURS = 3
SAMPLE_ROWS = 2000
JITTER = 1e-10
EULER = 0.5772156649015329
#: Rows whose distances to all others are held at once.
BLOCK = 256


def digamma(n: np.ndarray) -> np.ndarray:
    """Digamma of positive whole numbers: a harmonic number less Euler's constant."""
    n = np.asarray(n, np.int64)
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, max(2, n.max(initial=1) + 1)))])
    return harmonic[n - 1] - EULER


def scaled(x: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    deviation = x.std()
    x = x / (deviation if deviation > 0 else 1.0)
    return x + JITTER * max(1.0, np.abs(x).mean()) * (uniform - 0.5)


def _blocks(n: int):
    return (slice(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK))


def mi_mixed(classes: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS) -> float:
    """MI in nats of a discrete and a continuous column."""
    names, which, size = np.unique(classes, return_inverse=True, return_counts=True)
    kept = size[which] > 1
    which, x = which[kept], x[kept]
    if not len(x):
        return 0.0
    radius = np.zeros(len(x))
    near = np.minimum(k, size[which] - 1)
    for c in np.unique(which):
        own = np.flatnonzero(which == c)
        at = near[own[0]]
        for b in _blocks(len(own)):
            d = np.abs(x[own[b], None] - x[own][None, :])
            radius[own[b]] = np.partition(d, at, axis=1)[:, at]  # its own distance, 0, comes first
    ordered = np.sort(x)
    inside = np.empty(len(x), np.int64)
    for b in _blocks(len(x)):
        inside[b] = (np.abs(ordered[None, :] - x[b, None]) < radius[b, None]).sum(axis=1)
    mi = (digamma([len(x)])[0] + digamma(near).mean() - digamma(size[which]).mean()
          - digamma(np.maximum(inside, 1)).mean())
    return max(0.0, float(mi))


def mi_continuous(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> float:
    """MI in nats of two continuous columns."""
    n = len(x)
    k = min(k, n - 1)
    in_x, in_y = np.empty(n, np.int64), np.empty(n, np.int64)
    for b in _blocks(n):
        dx, dy = np.abs(x[b, None] - x[None, :]), np.abs(y[b, None] - y[None, :])
        radius = np.partition(np.maximum(dx, dy), k, axis=1)[:, k, None]
        in_x[b], in_y[b] = (dx < radius).sum(axis=1), (dy < radius).sum(axis=1)
    mi = digamma([n])[0] + digamma([k])[0] - digamma(np.maximum(in_x, 1)).mean() - digamma(np.maximum(in_y, 1)).mean()
    return max(0.0, float(mi))


def mutual_info_knn(df: DataFrame, id_col: str, discrete: dict[str, list], continuous: list[str], rows: int = SAMPLE_ROWS,
                    k: int = NEIGHBOURS, least: int = 3, seed: int = 42) -> DataFrame:
    """(target, feature, mi, n_rows) for ordered pairs with a continuous column.

    ``discrete``: values of each discrete column (their place is the code; another value is missing);
    ``continuous``: columns read as numbers.  A pair needs ``least`` rows with a target and, on a
    discrete side, ``least`` rows in the rarest class among them (F10).
    """
    names = sorted([*discrete, *continuous])
    # Written: in one plan, the filter on the exploded cells moves below the join and works out every record's cells.
    drawn = stored(df.join(F.broadcast(top_n_by_hash(df, id_col, rows, seed)), id_col, "left_semi"), "drawn")

    def cell(v):
        c = F.col(v).cast("string")
        if v in discrete:
            codes = F.array(*[F.lit(x) for x in discrete[v]])
            x = F.when(~is_missing(c), F.nullif(F.array_position(codes, c), F.lit(0)) - 1).cast("double")
        else:
            x = F.when(~is_missing(c), c.try_cast("double"))
        return F.struct(F.lit(v).alias("v"), F.lit(v in discrete).alias("d"), x.alias("x"), u(seed, "knn", F.col(id_col), F.lit(v)).alias("u"))

    cells = drawn.select(F.col(id_col).alias("id"), F.array(*[cell(v) for v in names]).alias("c"))
    pairs = cells.select("id", F.explode("c").alias("t"), "c").where(F.col("t.x").isNotNull()) \
        .select("id", "t", F.explode("c").alias("f")).where((F.col("t.v") != F.col("f.v")) & ~(F.col("t.d") & F.col("f.d")))
    pairs = pairs.select(F.col("t.v").alias("target"), F.col("f.v").alias("feature"), "id", F.col("t.d").alias("td"), F.col("f.d").alias("fd"),
                         F.col("t.x").alias("tx"), F.coalesce("f.x", F.lit(-1.0)).alias("fx"), F.col("t.u").alias("tu"), F.col("f.u").alias("fu"))

    def measure(key, table):
        table = table.sort_by("id")
        t, f, tu, fu = (table.column(c).to_numpy() for c in ("tx", "fx", "tu", "fu"))
        td, fd = table.column("td")[0].as_py(), table.column("fd")[0].as_py()
        few = any(d and np.unique(x, return_counts=True)[1].min() < least for d, x in ((td, t), (fd, f)))
        mi = None
        if len(t) >= least and not few:
            t, f = t if td else scaled(t, tu), f if fd else scaled(f, fu)
            mi = mi_mixed(t, f, k) if td else mi_mixed(f, t, k) if fd else mi_continuous(t, f, k)
        return pa.table({"target": pa.array([key[0].as_py()]), "feature": pa.array([key[1].as_py()]),
                         "mi": pa.array([mi], pa.float64()), "n_rows": pa.array([len(t)], pa.int64())})

    return pairs.groupBy("target", "feature").applyInArrow(
        measure, "target string, feature string, mi double, n_rows long").where("mi IS NOT NULL")
