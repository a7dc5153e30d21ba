"""Vector and keyword indexes against plain Python, and what they read."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import search, vectors
from corpusmill.operators.keyword_index import KeywordIndex
from corpusmill.sources.tables import fresh_path

VECTORS = "vec_id long, embedding array<float>, tag int"


def rows_of(n=400, dim=8, seed=1):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in draw.normal(size=dim)], i % 5) for i in range(n)]
    return [*rows, *[(n + i, rows[3][1], 1) for i in range(90)], (900, [0.0] * dim, 0), (901, None, 1), (902, [1.0] * (dim + 1), 2), (903, [], 3)]


def brute(rows, queries, k, keep=lambda r: True):
    unit = lambda v: np.array(v or [], float) / (np.linalg.norm(v or [0.0]) or 1.0)
    out = {}
    for q, qv in queries:
        scored = []
        for i, v, t in rows:
            if i != q and keep((i, v, t)):
                a, b = unit(v), unit(qv)
                scored.append((-round(min(max(float(a @ b), 0.0), 1.0), 6) if len(a) == len(b) else -0.0, i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_nearest_and_index_give_the_exact_rows(spark):
    rows = rows_of()
    df, q = spark.createDataFrame(rows, VECTORS).repartition(3), [(r[0], r[1]) for r in rows if r[0] % 20 == 0 and r[1]]
    queries = spark.createDataFrame(q, "query_id long, query_vector array<float>")
    assert got(vectors.nearest(df, queries, k=7)) == got(vectors.nearest(df, queries, k=7, query_bytes=100)) == brute(rows, q, 7)
    allowed = df.where("vec_id % 3 = 0").select("vec_id")
    assert got(vectors.nearest(df, queries, k=7, where=F.col("tag") < 3, allowed=allowed)) == brute(rows, q, 7, lambda r: r[2] < 3 and r[0] % 3 == 0)
    path = fresh_path(spark, "index")
    n = vectors.build_index(df, path, 9, keep=("tag",))
    assert spark.read.parquet(f"{path}/lists").count() == len(rows)
    assert got(vectors.search_index(spark, path, queries, k=7, n_probe=n)) == brute(rows, q, 7)
    assert got(vectors.search_index(spark, path, queries, k=7, n_probe=n, where=F.col("tag") < 3, allowed=allowed.withColumnRenamed("vec_id", "id"), query_bytes=100)) == brute(rows, q, 7, lambda r: r[2] < 3 and r[0] % 3 == 0)
    few = vectors.search_index(spark, path, queries, k=7, n_probe=2)
    assert few.groupBy("query_id").count().where("count > 7").count() == 0
    assert vectors.nearest(df.limit(0), queries).count() == vectors.nearest(df, queries.limit(0)).count() == 0


def test_probes_of_clustered_vectors_find_nine_of_ten(spark):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(12, 16)) * 3
    rows = [(i, [float(x) for x in centers[i % 12] + draw.normal(size=16)], 0) for i in range(1200)]
    df = spark.createDataFrame(rows, VECTORS)
    queries = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    path = fresh_path(spark, "index")
    n = vectors.build_index(df, path, 24, sample=500)
    report = vectors.recall_against(vectors.nearest(df, queries), vectors.search_index(spark, path, queries, n_probe=n // 4))
    assert vectors.probes_for(spark, path, 0.9, sample=60) <= n // 4 and vectors.probes_for(spark, path, 1.0, sample=60) <= n
    assert report.agg(F.sum("n_found") / F.sum("n_true")).first()[0] >= 0.9


def bm25(docs, query, k=10):
    tokens = lambda t: re.findall("[a-z]{2,}", (t or "").lower())
    rows = [(i, Counter(tokens(t)), len(tokens(t))) for i, t in docs]
    n, mean = len(rows), sum(r[2] for r in rows) / len(rows)
    df = Counter(w for _, c, _ in rows for w in c)
    scores = []
    for i, c, length in rows:
        s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * length / mean)) for w in tokens(query) if c[w])
        if s > 0:
            scores.append((-round(s, 8), i))
    return [i for _, i in sorted(scores)[:k]]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("at", "on", "is")]
    return [(i, " ".join(draw.choices(words, weights=range(1, 31), k=draw.randint(0, 40)))) for i in range(300)] + [(300, None), (301, "")]


def test_keyword_index_equals_one_pass_over_the_texts(spark, corpus, monkeypatch):
    queries = [(1, "aat bon"), (2, "jis jis iat"), (3, "nothing known"), (4, "")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    want = {q: bm25(corpus, t) for q, t in queries if bm25(corpus, t)}
    rename = lambda df: df.withColumnRenamed("doc_id", "id")
    assert got(rename(search.bm25(docs, asked))) == want
    index = KeywordIndex(spark, fresh_path(spark, "keywords"))
    assert index.search(asked).count() == 0
    for k in range(4):
        index.add(docs.where(f"doc_id % 4 = {k}"))
        sizes = [s["n_postings"] for s in index.segments()]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))  # few levels
    index.add(docs.limit(0))
    assert sum(s["n_docs"] for s in index.segments()) == len(corpus)
    assert got(rename(index.search(asked))) == want == got(rename(index.search(asked, terms_a_pass=1)))
    full = {(r["query_id"], r["doc_id"]): r["score"] for r in search.bm25(docs, asked, k=None).collect()}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in index.search(asked, k=None).collect()} == full
    some = docs.select("doc_id").where("doc_id % 3 = 0").crossJoin(asked.select("query_id"))
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in search.bm25(docs, asked, k=None, only=some).collect()} == {x: s for x, s in full.items() if x[1] % 3 == 0}
    monkeypatch.setattr(search, "TERMS", 1)
    assert got(rename(search.bm25(docs, asked))) == want


def test_a_search_reads_postings_of_the_asked_folders_alone(spark, corpus, capsys):
    index = KeywordIndex(spark, fresh_path(spark, "keywords"))
    index.add(spark.createDataFrame(corpus, "doc_id long, text string"))
    index.search(spark.createDataFrame([(1, "aat bon")], "query_id long, query string")).explain("formatted")
    plan = capsys.readouterr().out
    assert "text" not in "".join(x for x in plan.splitlines() if "ReadSchema" in x) and "bucket#" in "".join(x for x in plan.splitlines() if "PartitionFilters" in x)


def test_a_failed_batch_leaves_no_trace_in_a_search(spark, corpus):
    docs, asked = spark.createDataFrame(corpus, "doc_id long, text string"), spark.createDataFrame([(1, "aat bon")], "query_id long, query string")
    index = KeywordIndex(spark, fresh_path(spark, "keywords"))
    index.add(docs.where("doc_id < 150"))
    before = index.search(asked).collect()

    def fails(*_):
        raise RuntimeError("lost")

    broken = KeywordIndex(spark, index.path)
    broken._commit = fails
    with pytest.raises(RuntimeError):
        broken.add(docs.where("doc_id >= 150"))
    assert sorted(index.search(asked).collect()) == sorted(before)
    index.add(docs.where("doc_id >= 150"))
    assert {r["rank"]: r["doc_id"] for r in index.search(asked).collect()} == dict(enumerate(bm25(corpus, "aat bon"), 1))


def test_a_document_of_no_text_has_no_density(spark, tmp_path):
    from corpusmill import catalogue

    spark.createDataFrame([(1, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert catalogue.corpus_rows(spark, str(tmp_path)).first()["density"] == 0 == catalogue.all_corpus_rows(spark, str(tmp_path)).first()["density"]
