"""Queries on vector and keyword indexes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue as C
from .operators import vectors
from .operators.keyword_index import KeywordIndex
from .sources.tables import fresh_path, read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ranked(df, *names):
    return df.select(*names, F.col("rank").cast("long").alias("rank"))


def _index(spark, d):
    e = read(spark, d, "embeddings")
    path = fresh_path(spark, "vectors")
    return path, vectors.build_index(e, path, vectors.lists_of(e.count()), keep=("label",))


@query(f"WITH {C.near_sql('TRUE', 10)} SELECT query_id, id, score, rank FROM near")
def ivf_all_lists(spark, d):
    """The index with as many probes as lists gives the exact rows."""
    path, n = _index(spark, d)
    return ranked(vectors.search_index(spark, path, C.query_vectors(spark, d), n_probe=n), "query_id", "id", "score")


@query(f"WITH {C.near_sql('label IN (1, 2, 3)', 10)} SELECT query_id, id, score, rank FROM near")
def ivf_filtered(spark, d):
    """A condition on a kept column holds before the k best are taken."""
    path, n = _index(spark, d)
    return ranked(vectors.search_index(spark, path, C.query_vectors(spark, d), n_probe=n, where=F.col("label").isin(1, 2, 3)), "query_id", "id", "score")


@query("SELECT count(*) AS n_queries, 10::BIGINT AS k, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, d):
    """Whether the index, with the probes that a sample of its vectors asks for, finds at least 0.9 of the exact ten, over all queries."""
    path, _ = _index(spark, d)
    q = C.query_vectors(spark, d)
    found, exact = vectors.search_index(spark, path, q, n_probe=vectors.probes_for(spark, path)), vectors.nearest(read(spark, d, "embeddings"), q)
    report = vectors.recall_against(exact, found)
    return report.agg(F.count("*").alias("n_queries"), F.lit(10).cast("long").alias("k"), (F.sum("n_found") >= 0.9 * F.sum("n_true")).alias("reached"))


@query("""WITH c AS (SELECT vec_id AS id, vec_id // 4 AS doc, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT doc, generate_subscripts(v, 1) AS place, unnest(v) AS x FROM c), m AS (SELECT doc, place, avg(x) AS x FROM x GROUP BY ALL), dv AS (SELECT doc, list(x ORDER BY place) AS v FROM m GROUP BY doc),
q AS (SELECT id AS query_id, v AS qv FROM c WHERE id % 20 = 0),
s AS (SELECT query_id, doc, round(greatest(least(list_cosine_similarity(v, qv), 1.0::DOUBLE), 0.0::DOUBLE), 6) AS score FROM dv, q WHERE doc <> query_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM s) WHERE r <= 20),
f AS (SELECT query_id, id, round(greatest(least(list_cosine_similarity(c.v, qv), 1.0::DOUBLE), 0.0::DOUBLE), 6) AS score FROM best JOIN c USING (doc) JOIN q USING (query_id) WHERE id <> query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def coarse_then_fine(spark, d):
    """Documents first, by the mean of their chunks, from an index; then chunks of the documents found."""
    chunks = read(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 4).cast("long"))
    path, q = fresh_path(spark, "documents"), C.query_vectors(spark, d)
    n = vectors.build_index(vectors.document_vectors(chunks, "doc"), path, 32, "doc", "vector")
    found = vectors.search_index(spark, path, q, k=20, n_probe=n)
    return ranked(vectors.coarse_then_fine(found, chunks, q), "query_id", "id", "score")


@query(f"WITH {C.BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_incremental(spark, d):
    """Three batches added one after the other; the search reads postings alone."""
    index, docs = KeywordIndex(spark, fresh_path(spark, "keywords")), read(spark, d, "documents")
    for part in ("doc_id % 5 < 3", "doc_id % 5 = 3", "doc_id % 5 = 4"):
        index.add(docs.where(part))
    return ranked(index.search(C.query_texts(spark, d)), "query_id", "doc_id", "score")


@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY label, embedding) AS first FROM embeddings WHERE label <> 3)
SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM e x JOIN e y ON x.label = y.label AND x.id < y.id WHERE x.id = x.first AND y.id = y.first AND round(list_cosine_similarity(x.v, y.v), 6) >= 0.3
UNION ALL SELECT first, id, 1.0::DOUBLE FROM e WHERE id <> first""")
def alike_vectors(spark, d):
    """Merge candidates by vectors, of one label, but for a guarded one; 0.3, as no given vectors reach the usual 0.92."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return vectors.alike_vectors(rows, "label", least=0.3, n_lists=16, guarded=spark.createDataFrame([(3,)], "label int"))
