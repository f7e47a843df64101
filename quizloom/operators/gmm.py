"""A5: 3-component 1-D Gaussian mixture per numeric column.

The data work is a per-column histogram over ``MAX_BINS`` equal shares of the rows in value order
(one rule at every size: a value that fills a share keeps a bin of its own, rarer neighbours
share one).  EM then runs ``ROUNDS`` times as a Spark aggregation over all columns' histograms at
once: a bin's responsibilities from the column's parameters, and the sums of those as the next
parameters.  Values are taken in deviations from the column's mean.  Initialisation is
deterministic (weighted quantiles), and so is the result, to ``DIGITS`` decimals of a deviation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BINS = 2048
N_COMPONENTS = 3
ROUNDS = 30
#: Rounds planned together; their parameters (a row a column) are written between.
PLANNED = 10
DIGITS = 7
REG_COVAR = 1e-6
EPS = 2.0 ** -49
_K = range(N_COMPONENTS)


def numeric_histogram(values: DataFrame, stats: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """(var, x, n): mean value and row count of each bin of the numeric columns.

    A value's bin is the share its first row falls in.  Built from the distinct-value counts
    (A1), not from rows: one pass over the data serves the whole profile.
    """
    rows = ordered_counts(values, stats)
    return (rows.groupBy("var", F.floor(F.col("lo") * max_bins / F.col("n_tot")).alias("k"))
            .agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").cast("double").alias("n"))
            .drop("k"))


def em_start(hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(var, z, n) with values in deviations, and (var, center, spread, reg, m0.., v0.., w0..) to begin with:
    means at the 1/6, 3/6 and 5/6 quantiles, the whole variance, equal weights."""
    total = hist.groupBy("var").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("center"), F.sum("n").alias("tot"))
    spread = hist.join(F.broadcast(total), "var").groupBy("var").agg(
        F.sqrt(F.sum(F.col("n") * (F.col("x") - F.col("center")) * (F.col("x") - F.col("center"))) / F.sum("n")).alias("spread"))
    shape = total.join(spread, "var").withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0))
    h = hist.join(F.broadcast(shape), "var").withColumn("z", (F.col("x") - F.col("center")) / F.col("spread"))
    up_to = F.sum("n").over(Window.partitionBy("var").orderBy("z"))     # at most MAX_BINS bins
    at = h.withColumn("share", up_to / F.col("tot")).groupBy("var").agg(
        *[F.min(F.when(F.col("share") >= (2 * k + 1) / 6, F.col("z"))).alias(f"m{k}") for k in _K], F.max("z").alias("top"))
    start = shape.join(at, "var").select(
        "var", "center", "spread", (F.lit(REG_COVAR) / F.col("spread") / F.col("spread")).alias("reg"),
        *[F.coalesce(f"m{k}", "top").alias(f"m{k}") for k in _K],
        *[(1 + F.lit(REG_COVAR) / F.col("spread") / F.col("spread")).alias(f"v{k}") for k in _K],
        *[F.lit(1 / N_COMPONENTS).alias(f"w{k}") for k in _K])
    return h.select("var", "z", "n"), start


def em_round(h: DataFrame, params: DataFrame) -> DataFrame:
    """One EM step for all columns: ``params`` is a row a column."""
    z = F.col("z")
    logs = [F.lit(-0.5) * (z - F.col(f"m{k}")) * (z - F.col(f"m{k}")) / F.col(f"v{k}") - 0.5 * F.log(2 * math.pi * F.col(f"v{k}"))
            + F.log(F.greatest(F.col(f"w{k}"), F.lit(1e-300))) for k in _K]
    j = h.join(F.broadcast(params), "var").withColumns({f"l{k}": logs[k] for k in _K})
    j = j.withColumn("top", F.greatest(*[F.col(f"l{k}") for k in _K]))
    j = j.withColumn("lse", F.col("top") + F.log(sum(F.exp(F.col(f"l{k}") - F.col("top")) for k in _K)))
    j = j.withColumns({f"r{k}": F.exp(F.col(f"l{k}") - F.col("lse")) * F.col("n") for k in _K})
    s = j.groupBy("var").agg(*[F.first(c).alias(c) for c in ("center", "spread", "reg")], *[x for k in _K for x in (
        F.sum(f"r{k}").alias(f"a{k}"), F.sum(F.col(f"r{k}") * z).alias(f"b{k}"), F.sum(F.col(f"r{k}") * z * z).alias(f"c{k}"))])
    s = s.withColumns({f"k{k}": F.col(f"a{k}") + EPS for k in _K}).withColumns({f"m{k}": F.col(f"b{k}") / (F.col(f"a{k}") + EPS) for k in _K})
    spread = lambda k: (F.col(f"c{k}") - 2 * F.col(f"m{k}") * F.col(f"b{k}") + F.col(f"m{k}") * F.col(f"m{k}") * F.col(f"a{k}")) / F.col(f"k{k}")
    return s.select("var", "center", "spread", "reg", *[f"m{k}" for k in _K],
                    *[(F.greatest(spread(k), F.lit(0.0)) + F.col("reg")).alias(f"v{k}") for k in _K],
                    *[(F.col(f"k{k}") / sum(F.col(f"k{i}") for i in _K)).alias(f"w{k}") for k in _K])


def em_fit(hist: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(var, gm_means, gm_stds, gm_weights) after ``rounds`` steps over (var, x, n)."""
    from quizloom.sources.files import stored
    h, params = em_start(stored(hist, "histogram"))
    h = stored(h, "deviations")
    for i in range(rounds):
        if i % PLANNED == 0:
            params = stored(params, "mixture-step")
        params = em_round(h, params)
    weights = [F.round(f"w{k}", DIGITS) for k in _K[:-1]]                  # the last makes their sum 1
    return params.select(
        "var", F.array(*[F.col("center") + F.col("spread") * F.round(f"m{k}", DIGITS) for k in _K]).alias("gm_means"),
        F.array(*[F.col("spread") * F.round(F.sqrt(f"v{k}"), DIGITS) for k in _K]).alias("gm_stds"),
        F.array(*weights, F.round(1 - sum(weights), DIGITS)).alias("gm_weights"))


def gmm_profile(values: DataFrame, stats: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """(var, gm_means, gm_stds, gm_weights) for every kept column; zeros for
    columns without numeric keys (as the reference's profile)."""
    fitted = em_fit(numeric_histogram(values, stats, max_bins))
    zeros = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    kept = stats.where("keep").select("var")
    return (kept.join(fitted, "var", "left")
            .select("var",
                    F.coalesce("gm_means", zeros).alias("gm_means"),
                    F.coalesce("gm_stds", zeros).alias("gm_stds"),
                    F.coalesce("gm_weights", zeros).alias("gm_weights")))


def ordered_counts(values: DataFrame, stats: DataFrame, buckets: int = 256) -> DataFrame:
    """(var, x, n, lo, n_tot): for each numeric value its rows, those below it and those in all.

    The value order is computed without a per-column sort in one task: rows are
    range-bucketed by value, sorted within (var, bucket), and bucket offsets come
    from a (var x buckets) table.
    """
    num = stats.where("keep AND is_numeric").select("var", "num_min", "num_max")
    h = (values.where(F.col("value").isNotNull())
         .select("var", F.col("value").try_cast("double").alias("x"), "n")
         .where(F.col("x").isNotNull() & ~F.isnan("x"))
         .groupBy("var", "x").agg(F.sum("n").cast("long").alias("n"))
         .join(F.broadcast(num), "var"))
    width = (F.col("num_max") - F.col("num_min")) / buckets
    h = h.withColumn("_b", F.when(width > 0, F.least(F.floor((F.col("x") - F.col("num_min")) / width),
                                                      F.lit(buckets - 1))).otherwise(0).cast("long"))
    w_in = Window.partitionBy("var", "_b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_lo_in", F.coalesce(F.sum("n").over(w_in), F.lit(0)))
    tot = h.groupBy("var", "_b").agg(F.sum("n").alias("_t"))
    w_b = Window.partitionBy("var").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_t").over(w_b), F.lit(0))).drop("_t")
    totals = tot.groupBy("var").agg(F.sum("_t").cast("long").alias("n_tot"))
    return h.join(off, ["var", "_b"]).join(totals, "var").select(
        "var", "x", "n", (F.col("_off") + F.col("_lo_in")).alias("lo"), "n_tot")


def tercile_mixture(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Closed-form 3-component mixture: rows split into ntile(3) by value, each
    tercile's weight, mean and std (+ reg).  Used where the mixture must be
    reproducible by SQL, and as a deterministic EM start."""
    h = ordered_counts(values, stats)
    base, extra = F.floor(F.col("n_tot") / 3), F.col("n_tot") % 3
    b1 = base + F.when(extra >= 1, 1).otherwise(0)
    b2 = b1 + base + F.when(extra >= 2, 1).otherwise(0)
    bounds = [F.lit(0), b1, b2, F.col("n_tot")]
    parts = []
    for k in range(3):
        c = F.greatest(F.lit(0), F.least(F.col("lo") + F.col("n"), bounds[k + 1]) - F.greatest(F.col("lo"), bounds[k]))
        parts.append(h.select("var", "n_tot", "x", F.lit(k).alias("k"), c.alias("c")).where(F.col("c") > 0))
    p = parts[0].unionByName(parts[1]).unionByName(parts[2])
    m = p.groupBy("var", "k").agg(F.sum("c").alias("cnt"), (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("mean"),
                                  F.first("n_tot").alias("n_tot"))
    v = (p.join(m.select("var", "k", "mean"), ["var", "k"])
         .groupBy("var", "k").agg((F.sum(F.col("c") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")))).alias("ss")))
    comp = m.join(v, ["var", "k"]).select(
        "var", "k", "mean", F.sqrt(F.col("ss") / F.col("cnt") + REG_COVAR).alias("std"), (F.col("cnt") / F.col("n_tot")).alias("w"))
    arr = comp.groupBy("var").agg(F.sort_array(F.collect_list(F.struct("k", "mean", "std", "w"))).alias("_c"))
    # fewer than 3 rows -> missing components are zeros
    full = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(
        F.try_element_at(F.filter("_c", lambda s: s["k"] == i), F.lit(1)), F.struct(i.alias("k"), F.lit(0.0).alias("mean"),
                                                             F.lit(0.0).alias("std"), F.lit(0.0).alias("w"))))
    fitted = arr.select("var", full.alias("_c")).select(
        "var", F.transform("_c", lambda s: s["mean"]).alias("gm_means"),
        F.transform("_c", lambda s: s["std"]).alias("gm_stds"),
        F.transform("_c", lambda s: s["w"]).alias("gm_weights"))
    zeros = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    kept = stats.where("keep").select("var")
    return (kept.join(fitted, "var", "left")
            .select("var", F.coalesce("gm_means", zeros).alias("gm_means"),
                    F.coalesce("gm_stds", zeros).alias("gm_stds"),
                    F.coalesce("gm_weights", zeros).alias("gm_weights")))
