"""Scopes reach the scan, trends, versions of titles and category paths of odd rows."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import catalog, governance, observability, versions


def test_scopes_reach_the_scan(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 5, "ann"), (2, None, "bob"), (3, 7, None)], "id long, dept long, owner string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    cases = [
        ((governance.ALL,), {1, 2, 3}, None),
        ((governance.CUSTOM, None, None, [5, 9]), {1}, "In(dept, [5,9])"),
        ((governance.CUSTOM, None, None, []), set(), None),
        ((governance.DEPT, None, 7), {3}, "EqualTo(dept,7)"),
        ((governance.DEPT, "ann"), set(), None),
        ((governance.DEPT_AND_CHILD, None, 5, None, [5, 7]), {1, 3}, "In(dept, [5,7])"),
        ((governance.DEPT_AND_CHILD, "ann"), set(), None),
        ((governance.SELF, "bob"), {2}, "EqualTo(owner,bob)"),
        ((governance.SELF, "anonymous"), set(), None),
        ((9, "ann"), {1}, "EqualTo(owner,ann)"),
    ]
    for (level, *more), want, pushed in cases:
        user, dept, custom, below = [*more, None, None, None, None][:4]
        out = rows.where(governance.data_scope(level, F.col("dept"), F.col("owner"), user, dept, custom, below))
        assert {r["id"] for r in out.collect()} == want, (level, more)
        if pushed:
            out.explain("formatted")
            assert pushed in next(x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x)


def test_trend_of_the_last_buckets(spark):
    rows = [("a", n, 1.0 if n < 10 else 0.5 if n < 44 else 0.2) for n in range(47)] + [("b", n, 0.3) for n in range(3)] + [(None, 1, 0.5)]
    out = {r["k"]: tuple(r)[1:] for r in observability.bucket_trend(spark.createDataFrame(rows, "k string, n long, v double"), ["k"], ["n"], "v", last=4).collect()}
    assert out == {"a": (47, 4, 0.3714, 0.5, -0.1286, True), "b": (3, 1, 0.3, 0.3, 0.0, False), None: (1, 1, 0.5, 0.5, 0.0, False)}


def test_versions_of_titles_are_strings(spark):
    titles = ["plan v9", "plan v10", "plan 2024-01-05", "plan", "other V2", None, "v3", "20240101"]
    out = versions.titled_versions(spark.createDataFrame(list(enumerate(titles)), "id long, title string"), F.col("title"), "id")
    assert [tuple(r) for r in out.orderBy("base", "place").collect()] == [(0, "plan", "9", 1, True), (2, "plan", "2024-01-05", 2, False), (1, "plan", "10", 3, False), (3, "plan", "1.0", 4, False)]


def test_category_paths_of_odd_rows(spark):
    domains = spark.createDataFrame([(0, "reg", "制度规范", "", "制度、规定"), (1, "reg/fin", "财务管理", "reg", "报销，预算。发票管理"), (2, "tech", "技术文档", "", "规定；接口")], "place int, domain_id string, name string, parent_id string, description string")
    docs = [
        (1, ["差旅报销"], "", "", "reg/fin", "制度规范/财务管理/费用报销"),
        (2, ["技术文档", "接口"], "", "", "tech", "技术文档/接口"),
        (3, ["规定"], "", "", "tech", "技术文档/规定"),
        (4, [" ", ""], "", "会议", "reg", "制度规范"),
        (5, None, None, None, "", "未分类"),
        (6, ["无关", "别的", "三"], "nowhere", "", "", "无关/别的"),
        (7, ["财务管理", "制度规范"], "reg/fin", "", "reg/fin", "制度规范/财务管理"),
        (8, ["大发票管理处"], "", "", "reg/fin", "制度规范/财务管理/大发票管理处"),
    ]
    rows = spark.createDataFrame([d[:4] for d in docs], "doc_id long, topics array<string>, domain_id string, doc_type string")
    got = {r["id"]: (r["domain_id"], r["path"]) for r in catalog.category_paths(rows, domains, {"差旅报销": "费用报销"}, {"会议": "reg"}).collect()}
    assert got == {d[0]: d[4:] for d in docs} | {1: got[1]}
    assert got[1] == ("reg/fin", "制度规范/财务管理/费用报销") or got[1] == ("", "费用报销")
    with pytest.raises(ValueError, match="at most"):
        catalog.category_paths(rows, spark.range(catalog.DOMAINS + 1).select(F.col("id").alias("place"), F.col("id").cast("string").alias("domain_id"), F.lit("n").alias("name"), F.lit("").alias("parent_id"), F.lit("").alias("description")), {}, {})
