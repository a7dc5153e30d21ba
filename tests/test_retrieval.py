"""The whole retrieval: settings of intents, branches and what stands in for them, row security, reranking, odd rows."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retrieval as R

DOCS = "doc_id long, text string, path string, level int"
VECTORS = "doc_id long, vector array<double>, text string"
ASKED = "query_id long, query string, query_vector array<double>, target string, path string"
TREE = [("a/x", "xx", ""), ("a/none", "nn", ""), ("z", "zz", "")]
ONE = {"vector": 1.0, "graph": 0.0, "catalog": 0.0, "keyword": 0.0}


@pytest.fixture
def run(spark):
    def of(queries, docs=None, strategies=None, vectors=None, **more):
        docs = [(1, "red", "a/x", 0), (2, "blue", "a/y", 0), (3, "red red", "b", 0), (4, None, "a/x", 5), (5, "", None, 0)] if docs is None else docs
        vectors = [(d[0], [1.0, 0.1 * d[0]], None) for d in docs] if vectors is None else vectors
        rules = spark.createDataFrame([("many", "many"), ("odd", "odd")], "label string, keyword string")
        domains = spark.createDataFrame(TREE, "domain_id string, name string, description string")
        out = R.retrieve(spark.createDataFrame(docs, DOCS), spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(queries, ASKED), F.col("level") < 3, rules, strategies or {"many": (10, ONE)}, domains, **more)
        rows = sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"]))
        return {q: [(r["doc_id"], r["rank"]) for r in rows if r["query_id"] == q] for q in {r["query_id"] for r in rows}}, rows

    return of


def asked(id, text, target=None):
    return (id, text, [1.0, 0.0], target, None)


def test_branch_then_parent_then_all(run):
    got, rows = run([asked(100, "many xx"), asked(101, "many nn"), asked(102, "many zz"), asked(103, "many")])
    assert got == {100: [(1, 1)], 101: [(1, 1), (2, 2)], 102: [(1, 1), (2, 2), (3, 3), (5, 4)], 103: [(1, 1), (2, 2), (3, 3), (5, 4)]}
    assert {r["query_id"]: (r["intent"], r["branch"]) for r in rows} == {100: ("many", "a/x"), 101: ("many", "a/none"), 102: ("many", "z"), 103: ("many", None)}


def test_own_id_does_not_fill_a_branch(run):
    got, _ = run([asked(1, "many xx")])
    assert got == {1: [(2, 1)]}  # document 1 is the branch's only readable one, so the parent stands in


def test_security_comes_before_the_cut(run):
    docs = [(i, "t", "b", 5 if i < 90 else 0) for i in range(1, 95)]
    got, _ = run([asked(1000, "plain")], docs)
    assert [d for d, _ in got[1000]] == [90, 91, 92, 93, 94]


def test_settings_and_reranking(run):
    docs = [(i, "word other" if i == 7 else "none", "b", 0) for i in range(1, 9)]
    got, rows = run([asked(1000, "many word")], docs, {"many": (2, ONE)})
    assert [d for d, _ in got[1000]] == [1, 2]  # six candidates for two results: 7 is none of them
    got, rows = run([asked(1000, "many word")], docs, {"many": (3, ONE)}, more=3)
    assert [d for d, _ in got[1000]] == [1, 2, 3] and rows[0]["score"] == pytest.approx(0.995, abs=1e-4)
    got, _ = run([asked(1000, "odd word")], docs, {"odd": (7, {"vector": 0.0, "graph": 0.0, "catalog": 0.0, "keyword": 1.0})})
    assert got[1000][0] == (7, 1) and len(got[1000]) == 7
    few, rows = run([asked(1000, "many word")], docs, {"many": (8, ONE)})
    assert len(few[1000]) == 8 and rows[6]["score"] == pytest.approx(1 / (1 + 0.49) ** 0.5, abs=1e-4)  # all candidates are results: no boost
    assert run([asked(1000, "odd")], docs)[1][0]["intent"] == "odd" and len(run([asked(1000, "odd")], docs)[0][1000]) == 5  # an intent without settings


def test_odd_rows(run, spark):
    got, _ = run([asked(100, None), (101, "many", None, None, None), asked(102, "")])
    assert got == {100: [(1, 1), (2, 2), (3, 3), (5, 4)], 101: [(1, 1), (2, 2), (3, 3), (5, 4)], 102: [(1, 1), (2, 2), (3, 3), (5, 4)]}
    got, _ = run([asked(100, "many")], vectors=[(1, None, None), (2, [1.0], None), (3, [1.0, 1.0], None), (77, [1.0, 0.0], None)])
    assert got == {100: [(3, 1), (1, 2), (2, 3)]}
    assert run([])[0] == {} and run([asked(1, "many")], docs=[], vectors=[])[0] == {}
