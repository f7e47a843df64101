"""Mutual information, mixtures and stored profiles against plain Python and closed forms."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.functions.hashing import u
from quizloom.operators import gmm, mutual_info, neighbour_mi, profile, sampling
from quizloom.sources import profile_store
from quizloom.sources.files import scratch_path


# ---------------------------------------------------------------- nearest neighbours
def _psi(n):
    return sum(1.0 / i for i in range(1, n)) - 0.5772156649015329


def _plain(t, f, t_discrete, f_discrete, k=3):
    """Row by row, over all other rows."""
    n = len(t)
    if t_discrete or f_discrete:
        c, x = (t, f) if t_discrete else (f, t)
        rows = [i for i in range(n) if sum(c[i] == d for d in c) > 1]
        ks, ms, sizes = [], [], []
        for i in rows:
            own = sorted(abs(x[i] - x[j]) for j in rows if j != i and c[j] == c[i])
            kk = min(k, len(own))
            ks.append(_psi(kk))
            sizes.append(_psi(len(own) + 1))
            ms.append(_psi(max(1, sum(abs(x[i] - x[j]) < own[kk - 1] for j in rows))))
        return max(0.0, _psi(len(rows)) + np.mean(ks) - np.mean(sizes) - np.mean(ms))
    a, b = [], []
    for i in range(n):
        r = sorted(max(abs(t[i] - t[j]), abs(f[i] - f[j])) for j in range(n) if j != i)[min(k, n - 1) - 1]
        a.append(_psi(max(1, sum(abs(t[i] - t[j]) < r for j in range(n)))))
        b.append(_psi(max(1, sum(abs(f[i] - f[j]) < r for j in range(n)))))
    return max(0.0, _psi(n) + _psi(min(k, n - 1)) - np.mean(a) - np.mean(b))


def test_knn_agrees_with_a_plain_version(spark):
    rng = np.random.default_rng(1)
    n = 90
    x = rng.normal(size=n).round(1)  # ties
    rows = [(i, str(x[i]), str(round(2 * x[i] + rng.normal(), 2)) if i % 7 else None, "abc"[rng.integers(0, 3)] if i % 5 else "NA",
             "two" if i == 1 else "one") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x string, y string, c string, rare string")
    got = {(r.target, r.feature): (r.mi, r.n_rows) for r in neighbour_mi.mutual_info_knn(
        df, "id", {"c": ["a", "b", "c"], "rare": ["one", "two"]}, ["x", "y"], rows=1000).collect()}
    noise = {(r.id, v): r[v] for r in df.select("id", *[u(42, "knn", F.col("id"), F.lit(v)).alias(v) for v in "xy"]).collect() for v in "xy"}
    columns = {"x": [float(r[1]) for r in rows], "y": [None if r[2] is None else float(r[2]) for r in rows],
               "c": [None if r[3] == "NA" else "abc".index(r[3]) for r in rows]}
    want = {}
    for t in columns:
        for f in columns:
            if t != f and "c" != t or t != f and "c" != f:
                ids = [i for i in range(n) if columns[t][i] is not None]
                side = {}
                for v in (t, f):
                    z = np.array([-1.0 if columns[v][i] is None else columns[v][i] for i in ids], float)
                    if v != "c":
                        z = z / z.std()
                        z = z + 1e-10 * max(1.0, np.abs(z).mean()) * (np.array([noise[i, v] for i in ids]) - 0.5)
                    side[v] = z
                want[t, f] = (_plain(side[t], side[f], t == "c", f == "c"), len(ids))
    assert set(got) == set(want)  # pairs with a class of one row are left out
    for pair, (mi, rows_) in want.items():
        assert got[pair][0] == pytest.approx(mi, abs=1e-9) and got[pair][1] == rows_, pair


@pytest.mark.parametrize("rho", [0.0, 0.6, 0.9])
def test_knn_of_correlated_normals(rho):
    rng = np.random.default_rng(7)
    estimates = []
    for _ in range(4):
        x, e = rng.normal(size=(2, 6000))
        estimates.append(neighbour_mi.mi_continuous(x, rho * x + math.sqrt(1 - rho * rho) * e))
    assert np.mean(estimates) == pytest.approx(-0.5 * math.log(1 - rho * rho), abs=0.02)


def test_knn_odd_tables(spark):
    kind = "id long, x string, y string"
    empty = neighbour_mi.mutual_info_knn(spark.createDataFrame([], kind), "id", {}, ["x", "y"])
    assert empty.collect() == []
    same = spark.createDataFrame([(i, "5", None) for i in range(20)], kind)
    got = neighbour_mi.mutual_info_knn(same, "id", {}, ["x", "y"]).collect()
    assert [(r.target, r.feature) for r in got] == [("x", "y")] and math.isfinite(got[0].mi)


def test_knn_works_out_the_cells_of_drawn_records_only(spark):
    """No filter on the cells is moved to the scan of all records, and ids are ordered by a hash worked out before."""
    df = spark.read.parquet(_written(spark.createDataFrame(
        [(i, str(i * 37 % 101), "ab"[i % 2]) for i in range(300)], "id long, x string, c string")))
    got = neighbour_mi.mutual_info_knn(df, "id", {"c": ["a", "b"]}, ["x"], rows=50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "Relation [id#" in plan
    assert {(r.target, r.feature): r.n_rows for r in got.collect()} == {("x", "c"): 50, ("c", "x"): 50}
    top = sampling.top_n_by_hash(df, "id", 50)
    order = next(x for x in top._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in x)
    assert "md5" not in order
    want = df.select("id").distinct().orderBy(u(42, F.lit("ids"), F.col("id")), "id").limit(50)
    assert [r.id for r in top.collect()] == [r.id for r in want.collect()]


def _written(df):
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return path


# ---------------------------------------------------------------- bins, dates, class minimum
def test_quantile_bins_hold_equal_shares(spark):
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(size=3200) * 2)
    df = spark.createDataFrame([(i, repr(float(v))) for i, v in enumerate(x)], "id long, x string")
    values = profile.col_values(profile.unpivot_long(df, "id", ["x"]))
    cuts = mutual_info.quantile_cuts(profile.col_stats(values), values, {"x": None})["x"]
    counts = np.diff([*np.searchsorted(np.sort(x), cuts), len(x)])
    assert len(cuts) == 16 and set(counts) == {200}
    coded = df.select(mutual_info.code_columns(df, ["x"], {}, {"x": cuts})[0].alias("s")).select("s.c")
    assert {r.c: r["count"] for r in coded.groupBy("c").count().collect()} == dict.fromkeys(range(16), 200)


def test_pairs_are_counted_in_one_pass_over_the_rows(spark):
    """Equal to a plain count; the rows are read once for both directions, and no row is shuffled or exploded."""
    rng = np.random.default_rng(11)
    cuts = sorted(float(x) for x in rng.normal(size=9).round(2))
    x = [None if i % 7 == 0 else cuts[i % 9] if i % 5 == 0 else float(rng.normal()) for i in range(400)]
    x[:5] = [float("nan"), math.inf, -math.inf, cuts[0], cuts[-1]]
    words = [["p", "q", "r", "NA", None][i] for i in rng.integers(0, 5, 400)]
    y = [str(i) for i in rng.integers(0, 50, 400)]
    df = spark.read.parquet(_written(spark.createDataFrame(
        [(None if a is None else str(a).replace("nan", "NaN").replace("inf", "Infinity"), b, c) for a, b, c in zip(x, words, y)],
        "x string, w string, y string").repartition(3)))
    disc, cont = {"w": ["p", "q", "r"]}, {"x": cuts, "y": [0.0, 10.0, 20.0]}
    pc = mutual_info.pair_counts(df, ["w", "x", "y"], disc, cont)
    at = lambda bounds, v: -1 if v is None else len(bounds) - 1 if math.isnan(v) else sum(c <= v for c in bounds) - 1
    codes = [("pqr".index(b) if b in ("p", "q", "r") else -1, at(cuts, a), at(cont["y"], float(c))) for a, b, c in zip(x, words, y)]
    want = Counter((i, j, c[i], c[j]) for c in codes for i in range(3) for j in range(i + 1, 3))
    assert {(r.vi, r.vj, r.ci, r.cj): r.n for r in pc.collect()} == want
    plan = mutual_info.mi_from_counts(pc, ["w", "x", "y"], ["w"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Generate explode" not in plan
    for few in (["w"], []):
        assert mutual_info.pair_counts(df, few, disc, cont).collect() == []
    assert mutual_info.pair_counts(df.where("w = 'none'"), ["w", "x", "y"], disc, cont).collect() == []


def test_dates_count_minutes_from_each_records_anchor(spark):
    df = spark.createDataFrame([(1, "2020-03-01 12:30:59", "2020-03-01"), (2, "2020-02-29", "2020-03-01"), (3, "no date", "2020-03-01"),
                                (4, None, "2020-03-01"), (5, "2020-03-02", None)], "id long, d string, anchor string")
    got = mutual_info.dates_as_minutes(df, ["d"], F.col("anchor")).orderBy("id").collect()
    assert [r.d for r in got] == ["750", "-1440", None, None, None]


def test_pairs_with_a_rare_class_are_left_out(spark):
    """The rarest class counts among rows with a target only; a missing feature is a class."""
    rows = [("a", "x", "p")] * 5 + [("b", "y", "p")] * 5 + [("a", "z", "q")] * 2 + [(None, "z", "q")] * 4 + [("b", "x", None)] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, t string, f string, g string")
    values = profile.col_values(profile.unpivot_long(df, "id", ["t", "f", "g"]))
    stats = profile.col_stats(values)
    whole = {(r.target, r.feature): r.mi for r in mutual_info.mutual_info(df, stats, values).collect()}
    got = {(r.target, r.feature): r.mi for r in mutual_info.mutual_info(df, stats, values, min_class=3).collect()}
    assert len(whole) == 6
    # t <- f: z has two rows with a target; t <- g: q has two; f and g as targets keep all their rows
    assert set(got) == {("f", "t"), ("f", "g"), ("g", "t"), ("g", "f")} and all(whole[k] == v for k, v in got.items())


# ---------------------------------------------------------------- mixture
def _em_plain(x, n, rounds):
    center = (x * n).sum() / n.sum()
    spread = math.sqrt((n * (x - center) ** 2).sum() / n.sum())
    z, reg = (x - center) / spread, 1e-6 / spread**2
    share = np.cumsum(n) / n.sum()
    m = np.array([z[np.searchsorted(share, q)] for q in (1 / 6, 3 / 6, 5 / 6)])
    v, w = np.full(3, 1 + reg), np.full(3, 1 / 3)
    for _ in range(rounds):
        p = w * np.exp(-0.5 * (z[:, None] - m) ** 2 / v) / np.sqrt(2 * np.pi * v)
        r = p / p.sum(axis=1, keepdims=True) * n[:, None]
        m = (r * z[:, None]).sum(axis=0) / r.sum(axis=0)
        v = (r * (z[:, None] - m) ** 2).sum(axis=0) / r.sum(axis=0) + reg
        w = r.sum(axis=0) / n.sum()
    return center + spread * m, spread * np.sqrt(v), w


def test_mixture_by_aggregation(spark):
    """Three groups are found again, and every step is the textbook's."""
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.normal(-40, 2, 400), rng.normal(3, 1, 300), rng.normal(60, 5, 500)])).round(3)
    values, counts = np.unique(x, return_counts=True)
    hist = spark.createDataFrame([("a", float(v), float(c)) for v, c in zip(values, counts)] + [("const", 5.0, 30.0)], "var string, x double, n double")
    got = {r["var"]: r for r in gmm.em_fit(hist).collect()}
    for name, want, tol in zip(("gm_means", "gm_stds", "gm_weights"), _em_plain(values, counts.astype(float), gmm.ROUNDS), (1e-4, 1e-4, 1e-6)):
        assert got["a"][name] == pytest.approx(list(want), abs=tol)
    assert sorted(got["a"].gm_means) == pytest.approx([-40, 3, 60], abs=1) and sum(got["a"].gm_weights) == pytest.approx(1)
    assert got["const"].gm_means == [5.0] * 3 and all(math.isfinite(s) for s in got["const"].gm_stds)


# ---------------------------------------------------------------- stored profiles
def test_merged_profiles_equal_the_profile_of_all(spark):
    rng = np.random.default_rng(9)
    rows = [(i, str(rng.integers(0, 4)), rng.choice(["x", "y", "NA", None]), str(rng.integers(0, 25)) if i < 60 else str(100 + i))
            for i in range(240)]
    df = spark.createDataFrame([(i, a, None if b is None else str(b), c) for i, a, b, c in rows], "record_id long, a string, b string, wide string")
    columns = ["a", "b", "wide"]
    words = spark.createDataFrame([("a", 0, "old", "s")], "var string, ord int, display_name string, section string")
    paths = []
    for k, part in enumerate((df.where("record_id < 60"), df.where("record_id >= 60"))):
        values = profile.col_values(profile.unpivot_long(part, "record_id", columns))
        paths.append(scratch_path(spark, "profile"))
        profile_store.write_profile(paths[-1], values, profile_store.value_pairs(part, values, columns),
                                    words.withColumn("display_name", F.lit(f"name {k}")))
    got = profile_store.read_merged(spark, paths)
    whole = profile.col_values(profile.unpivot_long(df, "record_id", columns))
    same = lambda x, y: sorted(map(tuple, x.collect()), key=repr) == sorted(map(tuple, y.collect()), key=repr)
    assert same(got.values.select("var", "value", "n"), whole.select("var", "value", "n"))
    # "wide" has few values in the first batch only: it is no discrete column of the whole
    mi = mutual_info.mutual_info(df, profile.col_stats(whole), whole, only_discrete=True)
    rounded = lambda x: x.select("target", "feature", F.round("mi", 9), "n_rows")
    assert same(rounded(profile_store.mi_of_pairs(got.pairs, got.values)), rounded(mi))
    assert [r.display_name for r in got.dictionary.collect()] == ["name 1"]
