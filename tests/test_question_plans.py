"""Question plans: rows stay where they are drawn, and picks agree with the questions of all targets."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quizloom.plans import registry_qa as R
from quizloom.sources.files import stored
from quizloom.sources.registry import VARS


@pytest.fixture(scope="module")
def made(spark):
    """40 records; one comes in 20 different rows (over 62 candidates), one has no key."""
    n = F.col("id")
    text = {"status": F.when(n % 3 == 0, "O").otherwise("F"), "priority": F.concat(F.lit("p"), (n % 7).cast("string")),
            "order_date": F.lit("2020-01-01"), "total_price": F.format_string("%.2f", n * 37.5 + 10), "line_count": (n % 5).cast("string"),
            "ship_days": (n * 3 % 41).cast("string"), "quantity": F.when(n % 4 == 0, "unknown").otherwise((n * 7).cast("string")),
            "discount": F.format_string("%.3f", n / 1000), "segment": F.when(n % 5 > 0, F.concat(F.lit("s"), (n % 2).cast("string"))),
            "nation": F.concat(F.lit("n"), (n % 9).cast("string")), "acct_bal": F.format_string("%.2f", n * -11.25)}
    reg = spark.range(60).select(F.when(n < 39, n).when(n < 59, F.lit(39)).alias("record_id"), *[text[v].alias(v) for v in VARS])
    reg = stored(reg, "registry")
    return reg, R.build_profile(reg, gm_method="terciles")


def _u(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def test_question_rows_are_not_moved(made):
    reg, prof = made
    plan = R.mcq_questions(reg, prof, sectioned=False)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_pick_is_the_first_usable_target(made):
    reg, prof = made
    every = R.mcq_questions(reg, prof, sectioned=False).select("record_id", "var").distinct().collect()
    want = {}
    for r in every:
        want.setdefault(r.record_id, []).append(r["var"])
    want = {i: min(vs, key=lambda v: _u(42, "pick", i, v)) for i, vs in want.items()}
    got = R.mcq_questions(reg, prof, sectioned=False, pick_one=True).select("record_id", "var", "choices").collect()
    assert len(got) == len(want) == 40 and all(r.choices for r in got)
    assert {r.record_id: r["var"] for r in got} == want


def test_usable_targets_beyond_one_word(made):
    reg, prof = made
    recs = R.records(reg)
    assert {r.record_id: len(r.rows) for r in recs.collect()}[39] == 20
    drawn = R.draw(R.record_targets(recs, prof, VARS), prof, 42).where(F.size("choices") > 0)
    want = {tuple(r) for r in drawn.select("record_id", "var", "label_raw").distinct().collect()}
    usable = R.usable_targets(recs, prof, VARS, 42).select("record_id", F.explode("usable").alias("x")).select("record_id", "x.*")
    got = [tuple(r) for r in usable.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    asked = recs.select(F.size(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.array(*[r[v] for v in VARS])))))).collect()
    assert max(a[0] for a in asked) > R.WORD


def test_fallback_draws_meet_all_vocab_only_where_needed(made):
    reg, prof = made
    q = R.draw(R.record_targets(R.records(reg), prof, ["discount"]), prof, 42).collect()
    known = {r.discount.rstrip("0").rstrip(".") for r in reg.select("discount").collect()}
    assert q and all(len(r.choices) == 4 and r.label not in r.choices and set(r.choices) <= known for r in q)


def test_small_vocabularies_and_numbers_take_no_draw_from_vocab(made):
    reg, prof = made
    recs = R.records(reg)
    joins = lambda v: R.draw_records(recs, prof, [v], 42)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert R.tables_of(prof).kinds["status"]["n_vocab"] == 2 and R.tables_of(prof).kinds["nation"]["n_vocab"] == 9
    assert joins("nation") == joins("status") + 4
    assert joins("total_price") == joins("status") - 1          # not even the label is looked up
    for r in R.draw_records(recs, prof, ["status"], 42).collect():
        assert {r.label, *r.choices} == {"O", "F"} and r.choices == [x for x in ("F", "O") if x != r.label]


def test_only_records_that_need_it_have_all_targets_drawn(made, monkeypatch):
    reg, prof = made
    seen = []
    usable = R.usable_targets
    monkeypatch.setattr(R, "usable_targets", lambda recs, *a: seen.append(recs.count()) or usable(recs, *a))
    recs = R.records(reg)
    got = R.picked_targets(recs, prof, R.VARS, 42).where(F.size("choices") > 0)
    assert got.select("record_id").distinct().count() == 40
    assert sum(seen) < 40                                       # before, all 40 records


def test_records_of_repeated_keys(made):
    reg, _ = made
    got = {r.record_id: len(r.rows) for r in R.records(reg).collect()}
    assert got == {**{i: 1 for i in range(39)}, 39: 20}
