"""Golden rows for scalar functions and small operators (FIXTURES §4)."""

import math

from pyspark.sql import functions as F

from quizloom.functions.hashing import sql_u, u, u_at_least
from quizloom.functions.text import canonical_float, strip_zeros
from quizloom.operators import notes as N
from quizloom.operators import timeseries as ts


def test_strip_zeros_golden(spark):
    df = spark.createDataFrame([("12.00",), ("1.50",), ("100",), ("0.0",), ("1.0500",)], "v string")
    got = [r[0] for r in df.select(strip_zeros("v")).collect()]
    assert got == ["12", "1.5", "100", "0", "1.05"]


def test_canonical_float(spark):
    df = spark.createDataFrame([("1",), ("abc",), ("-112",), ("12.50",)], "v string")
    assert [r[0] for r in df.select(canonical_float("v")).collect()] == ["1.0", "abc", "-112.0", "12.5"]


def test_hash_digits_order_as_the_uniforms(spark):
    ids = spark.range(400).withColumn("u", u(42, "x", F.col("id")))
    some = [r.u for r in ids.limit(20).collect()]
    at = [-1.0, 0.0, 1e-20, 0.05, 0.1, 0.5, 0.999, 1 - 2**-53, 1.0, 2.0, *some, *[math.nextafter(x, 1) for x in some],
          *[math.nextafter(x, 0) for x in some]]
    wrong = [F.sum((u_at_least(x, 42, "x", F.col("id")) != (F.col("u") >= x)).cast("int")) for x in at]
    assert set(ids.agg(*wrong).first()) == {0}


def test_hash_uniform_matches_duckdb(spark):
    import duckdb
    s = spark.range(5).select(u(42, "x", F.col("id")).alias("u")).collect()
    con = duckdb.connect()
    d = con.execute(f"SELECT {sql_u(42, repr('x'), 'i')} FROM range(5) t(i)").fetchall()
    assert [r[0] for r in s] == [r[0] for r in d]
    assert all(0 < r[0] < 1 for r in s)


def test_horizon_label_golden(spark):
    # slot 0: event now -> yes; user 2: event only 6 slots later -> no; user 3: a null in frame -> no (strict)
    rows = [(1, i, 1 if i == 5 else 0) for i in range(24)] + [(2, i, 1 if i == 11 else 0) for i in range(24)] + \
           [(3, i, None if i == 7 else (1 if i == 8 else 0)) for i in range(24)]
    flags = spark.createDataFrame(rows, "user_id long, slot_idx int, flag int")
    lab = {(r.user_id, r.slot_idx): (r.label_strict, r.label_ignore) for r in ts.horizon_labels(flags).collect()}
    assert lab[(1, 5)][0] is True
    assert lab[(2, 5)][0] is False          # event at 11 is outside [5, 11)
    assert lab[(2, 6)][0] is True
    assert lab[(3, 4)] == (False, True)     # null at 7 makes strict false, ignore sees event at 8


def test_split_header_occurrences(spark):
    df = spark.createDataFrame([("a X b", "Z"), ("a X b", "X"), ("a X b X c", "X"), ("X a X b X", "X"),
                                ("p **H** q", "**H**")], "t string, h string")
    got = [r[0] for r in df.select(N.split_at_header("t", "h")).collect()]
    sep = "*" * 50
    assert got[0] is None
    assert got[1] == "a " + sep + "\nX\n b"
    assert got[2] == "a \nX\n b " + sep + "\nX\n c"
    assert got[3] is None
    assert got[4] is not None and sep in got[4]


def test_boxed_and_cut(spark):
    df = spark.createDataFrame([("so \\boxed{C} and \\boxed{A}",), ("none",), ("B. Q: x",)], "g string")
    r = df.select(N.boxed_letter("g"), N.cut_at_delimiters("g")).collect()
    assert [x[0] for x in r] == ["C", "", ""]
    assert r[2][1] == "B"


def test_mi_identical_and_independent(spark):
    from quizloom.operators import mutual_info as M
    rows = [(i, str(i % 3), str(i % 3), str((i // 3) % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    disc = {"a": ["0", "1", "2"], "b": ["0", "1", "2"], "c": ["0", "1"]}
    mi = {(r.target, r.feature): r.mi for r in M.mi_from_counts(M.pair_counts(df, ["a", "b", "c"], disc, {}), ["a", "b", "c"]).collect()}
    assert math.isclose(mi[("a", "b")], math.log(3), rel_tol=1e-9)
    assert abs(mi[("a", "c")]) < 1e-12
