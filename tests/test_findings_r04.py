"""Findings of the fourth review."""

import math
from collections import Counter
from itertools import combinations

import duckdb
import pytest

from corpusmill import catalogue_graph
from corpusmill.operators import communities, graph, search


@pytest.mark.parametrize("v", [0.215, 0.233, 0.259, 0.295, 0.313, 0.3])
def test_fused_scores_are_rounded_as_their_sql_does(spark, v):
    hits = spark.createDataFrame([(1, 2, v)], "query_id long, doc_id long, score double")
    none, paths = spark.createDataFrame([], "query_id long, doc_id long, score double"), spark.createDataFrame([(2, "de/src1")], "doc_id long, path string")
    sql = f"SELECT round(0.15::DOUBLE * 0.1 + 0.25::DOUBLE * 0.1::DOUBLE + 0.25::DOUBLE * 0.0::DOUBLE + 0.35::DOUBLE * {v}::DOUBLE, 4)"
    got = search.hybrid(hits, none, paths, search.F.lit("en/src1")).first()["score"]
    assert got == duckdb.sql(sql).fetchall()[0][0] == math.floor((0.15 * 0.1 + 0.25 * 0.1 + 0.25 * 0.0 + 0.35 * v) * 1e4 + 0.5) / 1e4


@pytest.mark.parametrize("few", [50, 10**6])
def test_no_pair_of_documents_is_shuffled(spark, few):
    docs = {1: range(0, 900, 2), 2: range(30), 3: (5, 5, 700), 4: (8,), None: (1, 2)}  # the first has three parts
    rows = [(f"d{d:03}", e) for e, ds in docs.items() for d in ds] + [(None, 2)]
    out = graph.shared_entities(spark.createDataFrame(rows, "doc string, entity long"), pairs_a_task=few * 100)
    want = Counter(p for e, ds in docs.items() if e for p in combinations(sorted({f"d{d:03}" for d in ds}), 2))
    assert sorted(out.collect()) == sorted((*p, n) for p, n in want.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(range#" not in plan, plan


def test_communities_go_on_until_nothing_is_gained(spark, tmp_path):
    rows = [(p, s % 90) for p in range(90) for s in (p, p + 1)]  # a ring
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue_graph.part_supplier_communities(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(catalogue_graph.ORACLE_SQL["part_supplier_communities"]).fetchall())
    edges = spark.createDataFrame([(p * 2, s * 2 + 1, 1) for p, s in rows], "a long, b long, w long")
    assert communities.modularity(edges, found) > communities.modularity(edges, communities.communities(edges, 4, 2)) + 0.01


@pytest.mark.parametrize("weight", [1, 10**9])
def test_blocks_of_a_level_give_what_one_task_gives(spark, weight):
    rows = [(a, b, weight * (1 + a % 2)) for a in range(60) for b in range(a % 7, a, 9) if (a * b) % 5 < 2 or a // 10 == b // 10] + [(3, 3, weight), (99, 99, weight)]
    edges = spark.createDataFrame(rows, "a long, b long, w long")
    alone, dealt = (sorted(map(tuple, communities.communities(edges, 6, 1, block=n).collect())) for n in (10**6, 100))
    assert alone == dealt and 1 < len({c for _, c in alone}) < len(alone)
