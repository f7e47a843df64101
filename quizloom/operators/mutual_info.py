"""All-pairs mutual information over mixed-type columns.

Each column becomes an integer code on the wide row (discrete columns: <= 30
distinct values, code = rank of the value; continuous numeric columns: one of
``BINS`` equal-width bins; missing = -1, its own category).  Tasks count the
codes of every column pair (i < j: a schema-sized count) batch by batch, and one
``groupBy(pair, codes)`` sums them: every contingency table at once, no row shuffled.
MI(target <- feature) drops rows whose target is missing, keeps a missing
feature as a category, and needs >= 3 rows; both directions come from the
same unordered pair counts.  MI is in nats, as ``mutual_info_score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.missing import is_missing

# MI thresholds.
MAX_DISCRETE = 30
BINS = 16
MIN_ROWS = 3
MI_CUTOFF = 0.5


def column_kinds(stats: DataFrame, values: DataFrame) -> tuple[dict, dict]:
    """Driver-side column metadata (one row per column, plus <= 30 values for
    each discrete column): {var: [values]} and {var: (min, max)}."""
    st = {r["var"]: r for r in stats.where("keep").collect()}
    discrete_vars = [v for v, r in st.items() if r["n_keys"] <= MAX_DISCRETE]
    continuous = {v: (r["num_min"], r["num_max"]) for v, r in st.items()
                  if v not in discrete_vars and r["is_numeric"] and r["n_vocab"] == 0}
    disc = {}
    if discrete_vars:
        for r in (values.where(F.col("var").isin(discrete_vars) & F.col("value").isNotNull())
                  .groupBy("var").agg(F.sort_array(F.collect_list("value")).alias("vals")).collect()):
            disc[r["var"]] = list(r["vals"])
    return disc, continuous


def quantile_cuts(stats: DataFrame, values: DataFrame, cont: dict, bins: int = BINS) -> dict[str, list[float]]:
    """{var: lower bounds of its bins}: at most ``bins`` numbers a column.  A value is in the share of the rows
    in which its first row falls."""
    from quizloom.operators.gmm import ordered_counts
    rows = ordered_counts(values, stats).where(F.col("var").isin(list(cont)))
    cuts = rows.groupBy("var", F.floor(F.col("lo") * bins / F.col("n_tot")).alias("b")).agg(F.min("x").alias("x"))
    return {r["var"]: list(r["cuts"]) for r in
            cuts.groupBy("var").agg(F.sort_array(F.collect_list("x")).alias("cuts")).collect()}


def _up_to(cuts: list[float], x, before: int = 0):
    """How many of the ascending ``cuts`` are up to ``x``, by halving (none for null)."""
    if not cuts:
        return F.lit(before)
    m = len(cuts) // 2
    return F.when(x >= F.lit(cuts[m]), _up_to(cuts[m + 1:], x, before + m + 1)).otherwise(_up_to(cuts[:m], x, before))


def code_columns(df: DataFrame, vars_order: list[str], disc: dict, cont: dict) -> list:
    """(var_index, code) struct per column, in a fixed column order.  ``cont`` has (least, greatest) for
    equal-width bins, or the list of the bins' lower bounds."""
    out = []
    for i, v in enumerate(vars_order):
        c = F.col(v).cast("string")
        if v in disc:
            m = F.create_map(*[x for k, val in enumerate(disc[v]) for x in (F.lit(val), F.lit(k))])
            code = F.when(is_missing(c), F.lit(-1)).otherwise(F.coalesce(F.element_at(m, c), F.lit(-1)))
        elif isinstance(cont[v], list):
            # Searched in a function of one value: written out for each column, the row's code grows too long to be compiled.
            code = F.transform(F.array(c.try_cast("double")), lambda x: _up_to(cont[v], x))[0] - 1
        else:
            lo, hi = cont[v]
            x = c.try_cast("double")
            width = (hi - lo) if hi is not None and lo is not None and hi > lo else None
            if width is None:
                code = F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
            else:
                b = F.floor((x - F.lit(lo)) / F.lit(width) * F.lit(BINS)).cast("int")
                code = F.when(x.isNull(), F.lit(-1)).otherwise(F.least(b, F.lit(BINS - 1)))
        out.append(F.struct(F.lit(i).alias("i"), code.cast("int").alias("c")))
    return out


_PAIRS = "vi int, vj int, ci int, cj int, n long"


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vi, vj, ci, cj, n) of each batch of code columns: the codes are numbered, and a pair of numbers is one count."""
    for batch in batches:
        numbered = [np.unique(c.to_numpy(zero_copy_only=False), return_inverse=True) for c in batch.columns]
        for i, (a, in_a) in enumerate(numbered[:-1] if batch.num_rows else []):
            found = []
            for j, (b, in_b) in enumerate(numbered[i + 1:], i + 1):
                n = np.bincount(in_a * len(b) + in_b)
                at = np.flatnonzero(n)
                found.append((np.full(len(at), i), np.full(len(at), j), a[at // len(b)], b[at % len(b)], n[at]))
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*found), kinds)],
                                             names=["vi", "vj", "ci", "cj", "n"])


def pair_counts(df: DataFrame, vars_order: list[str], disc: dict, cont: dict) -> DataFrame:
    """(vi, vj, ci, cj, n) for every unordered column pair i < j.

    A row's codes are computed once; what leaves a task is a count for each pair of codes.
    """
    if len(vars_order) < 2:
        return df.sparkSession.createDataFrame([], _PAIRS)
    coded = df.select(*[c["c"].alias(f"c{i}") for i, c in enumerate(code_columns(df, vars_order, disc, cont))])
    return coded.mapInArrow(count_pairs, _PAIRS).groupBy("vi", "vj", "ci", "cj").agg(F.sum("n").alias("n"))


def mi_from_counts(pc: DataFrame, vars_order: list[str], discrete: list[str] = (), min_class: int = 0) -> DataFrame:
    """Directional MI(target <- feature) from the unordered pair counts.

    F10: with ``min_class`` a pair counts only if the rarest class of each ``discrete`` side, among the
    rows with a target (a missing feature is a class), has that many rows; read off the pair's margins.
    """
    ways = [F.struct(*[F.col(c).alias(x) for x, c in zip(("t", "f", "ct", "cf"), way)])
            for way in (("vi", "vj", "ci", "cj"), ("vj", "vi", "cj", "ci"))]
    d = pc.select("n", F.inline(F.array(*ways))).where(F.col("ct") != -1)    # both ways of one count, not counted twice
    tf = Window.partitionBy("t", "f")
    d = (d.withColumn("n_tf", F.sum("n").over(tf))
         .withColumn("nt", F.sum("n").over(Window.partitionBy("t", "f", "ct")))
         .withColumn("nf", F.sum("n").over(Window.partitionBy("t", "f", "cf"))))
    term = F.col("n") / F.col("n_tf") * F.log(F.col("n") * F.col("n_tf") / (F.col("nt") * F.col("nf")))
    kinds = F.array(*[F.lit(v in discrete) for v in vars_order])
    rarest = F.least(*[F.min(F.when(F.element_at(kinds, F.col(side) + 1), F.col(margin))) for side, margin in (("t", "nt"), ("f", "nf"))])
    mi = d.groupBy("t", "f").agg(F.sum(term).alias("mi"), F.first("n_tf").alias("n_rows"), rarest.alias("rarest")).where(
        (F.col("n_rows") >= MIN_ROWS) & (F.coalesce("rarest", F.lit(min_class)) >= min_class))
    names = F.array(*[F.lit(v) for v in vars_order])
    return mi.select(F.element_at(names, F.col("t") + 1).alias("target"), F.element_at(names, F.col("f") + 1).alias("feature"),
                     F.greatest(F.col("mi"), F.lit(0.0)).alias("mi"), F.col("n_rows").cast("long").alias("n_rows"))


def mutual_info(df: DataFrame, stats: DataFrame, values: DataFrame, only_discrete: bool = False,
                quantiles: bool = False, min_class: int = 0) -> DataFrame:
    """Long MI matrix (target, feature, mi, n_rows) over all usable columns, in equal-width bins
    or bins of equal shares of the rows (``quantiles``)."""
    disc, cont = column_kinds(stats, values)
    if only_discrete:
        cont = {}
    if quantiles and cont:
        cont = quantile_cuts(stats, values, cont)
    order = sorted(list(disc) + list(cont))
    return mi_from_counts(pair_counts(df, order, disc, cont), order, list(disc), min_class)


def dates_as_minutes(df: DataFrame, columns: list[str], anchor) -> DataFrame:
    """Date columns as whole minutes since each record's own anchor (as text, like every column here)."""
    minutes = lambda c: F.floor((F.unix_timestamp(F.col(c).try_cast("timestamp")) - F.unix_timestamp(anchor.cast("timestamp"))) / 60)
    return df.withColumns({c: minutes(c).cast("string") for c in columns})


def correlated_columns(mi: DataFrame, cutoff: float = MI_CUTOFF) -> DataFrame:
    """Per target, the sorted features with MI > cutoff (missing pair = not correlated)."""
    return (mi.where(F.col("mi") > cutoff).groupBy("target")
            .agg(F.array_sort(F.collect_list("feature")).alias("correlated")))
