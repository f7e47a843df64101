"""Sheets, slot columns, first appearance, stages, target folds and column rules on small tables."""

import pytest
from pyspark.sql import functions as F

from quizloom.operators import codebook, recode, scan, timeseries
from quizloom.plans.registry_qa import pick_targets
from quizloom.plans.sampling_qa import within_limits
from quizloom.sources.files import read_dictionary, scratch_path
from quizloom.sources.stages import Stage, input_print, run_stages


def test_running_values_over_many_ranges(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("one sheet").alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 997 == 5, F.col("id")).alias("x"))
    df = df.unionByName(df.where("o < 50").withColumn("g", F.lit("small"))).repartition(7)
    got = scan.running(df, "g", "o", last={"l": F.col("x")}, total={"t": F.col("x").isNotNull().cast("int")}, ranges=16)
    assert got.columns == ["g", "o", "x", "l", "t"] and got.count() == n + 50
    wrong = got.where(~F.col("l").eqNullSafe(F.when(F.col("o") >= 5, F.floor((F.col("o") - 5) / 997) * 997 + 5))
                      | (F.col("t") != F.when(F.col("o") >= 5, F.floor((F.col("o") - 5) / 997) + 1).otherwise(0)))
    assert wrong.count() == 0


def test_one_large_sheet_is_many_tasks(spark):
    """A million rows of one sheet: no range holds more than a few times its share."""
    df = spark.range(1_000_000).select(F.lit("s").alias("sheet"), F.col("id").alias("ord"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("h"))
    got = scan.running(df, "sheet", "ord", last={"x": F.col("h")}, ranges=20)
    assert got.where(F.col("x") != F.floor(F.col("ord") / 1000) * 1000).count() == 0
    sizes = [r["count"] for r in df.repartitionByRange(20, "sheet", "ord").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200_000


def test_running_odd_groups(spark):
    kind = "g string, o long, x string"
    assert scan.running(spark.createDataFrame([], kind), "g", "o", last={"l": F.col("x")}).collect() == []
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 1, "v")], kind)
    assert sorted(map(tuple, scan.running(df, "g", "o", last={"l": F.col("x")}).collect()), key=repr) == sorted(
        [("a", 1, None, None), ("a", 2, None, None), ("b", 1, "v", "v")], key=repr)


def test_two_levels_are_carried_on_their_own(spark):
    rows = [("s", 1, None, None), ("s", 2, "D\n1 ", None), ("s", 3, None, " p"), ("s", 4, "xx", None), ("s", 5, None, "q\nr"), ("t", 1, None, "z")]
    got = codebook.header_levels(spark.createDataFrame(rows, "sheet string, ord long, domain string, section string"), words={"xx": "Two "})
    assert {(r.sheet, r.ord): r.header for r in got.collect()} == {
        ("s", 1): "[None/None]", ("s", 2): "[D 1/None]", ("s", 3): "[D 1/p]", ("s", 4): "[Two/p]", ("s", 5): "[Two/q r]", ("t", 1): "[None/z]"}


def _blocks(spark, rows, width=3):
    cells = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "sheet string, ord long, " + ", ".join(f"{c} string" for c in cells))
    return {(r.section, r.ord, r.name): r.value for r in codebook.sheet_blocks(df, cells).collect()}


def test_blocks_have_their_own_headers(spark):
    n = None
    got = _blocks(spark, [
        ("before", "any", "block"), ("A", n, n), ("x", "y", n), ("1", "2", "no name"), (n, "3", n), (n, n, n), ("stray", "row", n),
        ("B", n, n), ("y", "x", "y"), ("4", "5", "6"), ("A", n, n), ("x", "z", n), ("7", "8", n), (n, n, n),   # B is void; A comes again
        ("C", n, n), (n, n, n), ("D", n, n), ("k", "l", "k"), ("9", "10", "11")])                            # C is empty; D ends the sheet
    assert got == {("A", 3, "x"): "1", ("A", 3, "y"): "2", ("A", 4, "y"): "3", ("D", 18, "k"): "11", ("D", 18, "l"): "10"}


def test_blocks_of_odd_sheets(spark):
    assert _blocks(spark, []) == {}
    assert _blocks(spark, [(None, None, None)] * 3) == {}
    assert _blocks(spark, [("only title", None, None)]) == {}


def test_slot_columns_there_and_back(spark):
    names = ["id", "d1_2_hr", "d1_3_hr", "d2_1_bp_max", "d2_dialysis", "d10_1_hr", "age", "d_1"]
    assert timeseries.slot_columns(names[1:]) == [
        ("d1_2_hr", 1, 2, "hr"), ("d1_3_hr", 1, 3, "hr"), ("d2_1_bp_max", 2, 1, "bp_max"), ("d2_dialysis", 2, None, "dialysis"),
        ("d10_1_hr", 10, 1, "hr"), ("age", None, None, "age"), ("d_1", None, None, "d_1")]
    kind = "id long, d1_2_hr double, d1_3_hr double, d2_1_bp_max int, d2_dialysis string, d10_1_hr double, age int, d_1 int"
    wide = spark.createDataFrame([(1, 70.5, None, 120, "Yes", None, 50, 1), (2, None, 80.25, None, None, 1e-3, 60, 2)], kind)
    rows = timeseries.slot_rows(wide, "id")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([
        (1, 1, 2, "hr", "70.5"), (1, 2, 1, "bp_max", "120"), (1, 2, None, "dialysis", "Yes"), (2, 1, 3, "hr", "80.25"), (2, 10, 1, "hr", "0.001")], key=repr)
    types = {c: k for c, k in wide.dtypes if c.startswith("d") and c != "d_1"}
    back = timeseries.slot_table(rows, "id", types)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.select("id", *types).collect()))


def test_codes_by_first_appearance_of_many_values(spark):
    n = 100_000
    df = spark.range(3 * n).select(F.concat(F.lit("v"), (F.col("id") * 7919 % n).cast("string")).alias("v"), F.col("id").alias("row"))
    got = scan.first_codes(df.repartition(6).unionByName(spark.createDataFrame([(None, -1)], "v string, row long")), "v", "row")
    assert got.count() == n
    assert got.where(F.col("value") != F.concat(F.lit("v"), (F.col("code") * 7919 % n).cast("string"))).count() == 0


def test_stages_are_taken_up_where_they_stopped(spark, tmp_path):
    data, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(data)
    broken = {"on": True}

    def add(df, by):
        return df.withColumn("id", F.col("id") + by)

    def fail(df, most):
        if broken["on"]:
            raise RuntimeError("stopped")
        return df.where(F.col("id") < most)

    def run(by=5, most=10):
        stages = [Stage("add", add, {"by": by}), Stage("cut", fail, {"most": most}), Stage("again", add, {"by": 1})]
        df, ran = run_stages(spark, spark.read.parquet(data), input_print(spark, data), stages, root)
        return sorted(r.id for r in df.collect()), ran

    with pytest.raises(RuntimeError):
        run()
    broken["on"] = False
    assert run() == ([6, 7, 8, 9, 10], ["cut", "again"])      # the finished stage isn't run again
    assert run() == ([6, 7, 8, 9, 10], [])
    assert run(most=8) == ([6, 7, 8], ["cut", "again"])       # from the changed parameter on
    assert run(by=6)[1] == ["add", "cut", "again"]
    spark.range(3).write.mode("append").parquet(data)         # changed input
    assert run()[1] == ["add", "cut", "again"]


def test_targets_by_one_fold(spark):
    kind = "array<struct<var: string, correlated: array<string>>>"
    df = spark.createDataFrame([(1, [("a", ["c"]), ("b", []), ("c", []), ("d", ["b"])]), (2, [("a", ["b", "c", "d"]), ("b", []), ("c", []), ("d", [])]), (3, [])],
                               f"id int, c {kind}")
    for k, want in ((1, ["a", "a", ""]), (2, ["ab", "a", ""]), (3, ["abd", "a", ""]), (9, ["abd", "a", ""])):
        got = df.orderBy("id").select(F.array_join(F.transform(pick_targets(F.col("c"), k), lambda x: x["var"]), "").alias("p")).collect()
        assert [r.p for r in got] == want


def test_limits_hold_only_where_rows_are_spare(spark):
    df = spark.createDataFrame([(i, i % 4, 10 * (i % 3)) for i in range(100)], "id long, a long, b long")
    limits = [(F.col("a"), 3), (F.col("b"), 20)]
    got = sorted(r.id for r in within_limits(df, 10, limits, ["id"]).collect())
    assert got == [i for i in range(40) if i % 4 < 3 and 10 * (i % 3) < 20][:10]
    assert sorted(r.id for r in within_limits(df, 100, limits, ["id"]).collect()) == list(range(100))
    assert within_limits(df.limit(0), 5, limits, ["id"]).collect() == []


def test_dictionary_changes(spark):
    d = spark.createDataFrame([("a", "A", "s"), ("b", "B", "s"), ("c", "C", "s"), ("name", "Name", "s")], "var string, display_name string, section string")
    changes = spark.createDataFrame([("a", "A2", None, "replace"), ("b", None, None, "remove"), ("x", "X", "t", "add"), ("y", "Y", "t", "replace"),
                                     ("phone", "Phone", "t", "add"), ("c", None, "u", "add")], "var string, display_name string, section string, action string")
    got = recode.patch_dictionary(d, changes, ["name", "phone"])
    assert sorted(map(tuple, got.collect())) == [("a", "A2", "s", False), ("c", "C", "u", False), ("x", "X", "t", True)]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('{"k": "v", "a b": "c"}\n\n{"k": "u", "é\\"": "q\\n"}\n', encoding="utf-8")
    assert {r.source: r.target for r in read_dictionary(spark, str(tmp_path / "d")).collect()} == {"k": "u", "a b": "c", 'é"': "q\n"}
    (tmp_path / "bad.json").write_text("no object\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        read_dictionary(spark, str(tmp_path / "bad.json")).collect()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
