"""Rules and review operators on small cases, against plain Python."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.operators import review as V


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("raw", "want"), [("'L1 [a]/L2 [a/b]'", "a/b"), ("L2 x/y: note", "x/y"), ("L3/z, w", "z"), (None, ""), ("/p", "p")])
def test_domain_id(spark, raw, want):
    assert one(spark, R.domain_id(F.lit(raw).cast("string")))[0] == want


@pytest.mark.parametrize(("question", "want"), [("对比 A 和 B 的区别", "high"), ("什么是 A", "low"), ("什么是参数", "medium"), ("A", "medium"), ("参数 A", "high")])
def test_complexity_of_fixed_marks(spark, question, want):
    assert one(spark, R.complexity(F.lit(question)))[0] == want


def test_redaction_precisions(spark):
    text = F.lit("heat to 250°C for 3-5 kg, 0.5g")
    got = one(spark, *[R.redacted_parameters(text, ["g", "kg", "°C"], p) for p in ("EXACT", "INTERVAL", "LEVEL")])
    assert list(got) == ["heat to 250°C for 3-5 kg, 0.5g", "heat to [225.0-275.0°C] for [3-5kg], [0.45-0.55g]", "heat to [高°C] for [中kg], [低g]"]


def test_density_score(spark):
    got = one(spark, *[R.density_score(F.lit(x)) for x in (0.0, 2.5, 5.0, 15.0, 20.0, 100.0)])
    assert [round(x, 4) for x in got] == [0, 0.5, 1, 1, 0.8, 0.4]


def test_headers(spark):
    assert one(spark, R.table_headers(F.array(*map(F.lit, ["a", " ", "a", "b", "a"]))))[0] == ["a", "col_1", "a_2", "b", "a_3"]


def test_promotion_is_refused_where_a_key_kind_is_gone(spark):
    old = spark.createDataFrame([("x",)] * 8 + [("y",)] * 2, "kind string")
    out = V.promotion_check(old, old.where("kind = 'x'"), "kind").first()
    assert (out["n_old"], out["n_new"], out["removed"], out["moved_too_far"], out["key_kind_lost"], out["safe"]) == (10, 8, ["y"], False, True, False)


def test_queue_actions_that_do_not_fit_change_nothing(spark):
    items = spark.createDataFrame([(1, "done", "SME", None, "t", ""), (2, "pending", "SME", None, "t", ""), (3, "reviewing", "SME", "ann", "t", "r")], "id int, status string, role string, claimed_by string, due string, reason string")
    acts = spark.createDataFrame([(1, "claim", "bob", "", ""), (2, "claim", "bob", "", ""), (3, "escalate", "bob", "late", "DG")], "id int, action string, actor string, note string, to_role string")
    out = {r["id"]: tuple(r)[1:] for r in V.act_on_queue(items, acts, "id").collect()}
    assert out == {1: ("done", "SME", None, "t", ""), 2: ("reviewing", "SME", "bob", "t", ""), 3: ("escalated", "DG", None, None, "r | late")}
