"""Hand-written rows for coding rules, text rules, positions and options."""

import pytest
from pyspark.sql import functions as F

from quizloom.operators import codebook as C
from quizloom.operators import notes as N
from quizloom.operators import questions as Q
from quizloom.operators import recode as R
from quizloom.operators.sampling import global_position


def test_multi_code(spark):
    rows = [("", None, False), ("NA", "NA", False), ("No", "No", False), ("1,,", "One", False), ("2, 1", "Two, One", False),
            ("3,1", None, True), ("x", None, True), (None, None, False), (",", None, False), ("2,1", "One, Two", False), ("NA,", "NA", False)]
    mapped, unknown = R.multi_code("v", {1: "One", 2: "Two"})
    got = spark.createDataFrame([(v,) for v, *_ in rows], "v string").select("v", mapped, unknown).collect()
    # " 1" sorts before "2": codes are sorted as they are written
    want = [(v, "One, Two" if v == "2, 1" else m, u) for v, m, u in rows]
    assert [tuple(r) for r in got] == want


def test_range_pair_moves_codes(spark):
    rows = [("3", None, "NA", "3"), ("4", "2", "NA", "4"), (None, "1", "1", "NA"), ("1", "4", "1", "NA"), ("9", "3", "NA", "3"),
            ("9", None, "9", None), (None, None, None, None)]
    a, b = R.reconcile_ranges("a", "b")
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select("a", "b", a, b).collect()
    assert [tuple(r) for r in got] == rows


def _codes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["var"], {})[r["code"]] = r["label"]
    return out


def test_ranges(spark):
    rows = {"title": "Title\n[1]One", "one_equals": "1 = X", "tight": "[1]NoSpace", "single": "[1] yes", "zero": "[0] no",
            "letters": "[A] a\n[B] b", "equals": "1 = a\n2=b", "void": "[1]a\n[x]b", "passed": "[1]a\nnote\n\n[2]b", "last": "[1]a\n[01]b",
            "none": "free text", "null": None, "kor": "[1]예\n[2]아니오"}
    cb = spark.createDataFrame(list(rows.items()), "var string, range_text string")
    assert _codes(C.parse_ranges(cb, {"예": "yes"})) == {
        "title": {"1": "One"}, "single": {"1": "Yes", "0": "No"}, "zero": {"0": "No"}, "letters": {"A": "a", "B": "b"},
        "equals": {"1": "a", "2": "b"}, "passed": {"1": "a", "2": "b"}, "last": {"1": "b"}, "kor": {"1": "yes", "2": "아니오"}}


def test_coding_list(spark):
    rows = {"plain": "plain-text", "list": "1=a, 02 = b", "second": "1=x=y,2=z", "dots": "1.a,2.b=c", "dash": "1-a,2-b", "none": "a,b",
            "null": None, "manual": "see note", "word": "1=ja,2=nein"}
    cb = spark.createDataFrame(list(rows.items()), "var string, coding_text string")
    got = _codes(C.parse_coding_list(cb, {"see note": {1: "by hand"}}, {"ja": "yes"}))
    assert got == {"list": {"1": "a", "2": "b"}, "dots": {"1": "a", "2": "b=c"}, "dash": {"1": "a", "2": "b"},
                   "manual": {"1": "by hand"}, "word": {"1": "yes", "2": "nein"}}


def test_tokens_and_redaction_beyond_ascii(spark):
    df = spark.createDataFrame([("café naïve",), ("안녕 세계",), ("a, b!",), ("",)], "t string")
    assert [r[0] for r in df.select(N.token_count("t")).collect()] == [2, 2, 4, 0]
    names = spark.createDataFrame([("ann@x joann@x: joann and ann",)], "t string")
    assert names.select(N.redact_captured("t", r"(\w+)@x")).first()[0] == "[NAME]@x [NAME]@x: [NAME] and [NAME]"


def test_positions_are_dense_at_100k_rows_with_payload(spark):
    df = spark.range(100_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 50).alias("payload"))
    got = global_position(df, ["k"])
    s = got.agg(F.count_distinct("position"), F.min("position"), F.max("position"), F.count("payload")).first()
    assert tuple(s) == (100_000, 0, 99_999, 100_000)
    first = [r.k for r in got.orderBy("position").limit(50).collect()]
    assert first == [r.k for r in df.orderBy("k").limit(50).collect()]


@pytest.mark.parametrize("n", [1, 4, 11, 25])
def test_no_option_is_lost(spark, n):
    df = spark.createDataFrame([(f"q{i}", "L", [f"c{j:02d}" for j in range(n)]) for i in range(30)], "qid string, label string, choices array<string>")
    options, pos = Q.shuffle_insert(F.col("choices"), F.col("label"), F.col("qid"))
    for r in df.select(options.alias("o"), pos.alias("p"), Q.render_options(options).alias("t")).collect():
        assert sorted(r.o) == sorted(["L"] + [f"c{j:02d}" for j in range(n)]) and r.o[r.p] == "L"
        assert r.t.split("\n")[r.p] == f"{chr(65 + r.p)}. L" and len(r.t.split("\n")) == n + 1


def test_answer_input(spark):
    rows = [("p:", " one  two\n three, four", 0), ("", "", 1), (None, "a", 2), ("a b c d ", "e f", 3), ("a b", " c  ", 4)]
    df = spark.createDataFrame(rows, "p string, g string, k int")
    ask = N.answer_phrase(0)  # seven tokens
    got = {r.k: tuple(r.a) for r in df.select("k", N.answer_input("p", "g", 12, 0).alias("a")).collect()}  # room for four
    assert got == {0: (7, True, "p: one  two" + ask), 1: (0, False, ask), 2: (1, False, "a" + ask),
                   3: (6, True, "a b c d" + ask), 4: (3, False, "a b c  " + ask)}
    none = df.select(N.answer_input("p", "g", 3, 0).alias("a")).collect()
    assert {r.a["input"] for r in none} == {ask} and all(r.a["cut"] for r in none)
    only = df.where("k = 2").select(N.answer_input("p", "g", 12).alias("a")).first()
    assert only.a["input"] == "aTherefore, the answer is "
    long = spark.createDataFrame([("x " * 50_000, "y")], "p string, g string").select(N.answer_input("p", "g", 11_000, 1).alias("a")).first()
    assert long.a["n_tokens"] == 50_001 and long.a["input"] == ("x " * 10_992)[:-1] + N.answer_phrase(1)


def test_finish_flag(spark):
    df = spark.createDataFrame([("length",), ("stop",), (None,), ("Length",)], "r string")
    assert [r[0] for r in df.select(N.truncated("r")).collect()] == [True, False, False, False]
