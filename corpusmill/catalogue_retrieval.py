"""The whole retrieval on the given tables, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue as C
from . import catalogue_documents as V
from .functions import scores as S
from .operators import governance
from .operators.retrieval import retrieve
from .sources.tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: Branches with documents, without any, and without any above them either.
BRANCHES = [("en/src1", "er", "tha, ock, ght"), ("en", "an", "the, ing, ou"), ("de/none", "en", "sch, ich, ung"), ("xx/none", "ar", "os, ado, ela"), ("fr", "ou", "eu, que, les")]
#: intent: results, weights.
STRATEGIES = {"howto": (3, {"vector": 0.35, "graph": 0.2, "catalog": 0.2, "keyword": 0.25}), "compare": (8, {"vector": 0.4, "graph": 0.25, "catalog": 0.1, "keyword": 0.25}), "lookup": (4, {"vector": 0.25, "graph": 0.4, "catalog": 0.15, "keyword": 0.2})}
SOURCES = ["src0", "src1", "src2", "src3"]
WEIGHTS = ", ".join(str((i, k, *(w[c] for c in S.FUSION))) for i, (k, w) in ({"general": (5, S.FUSION)} | STRATEGIES).items())
ROUTE = V.ORACLE_SQL["route_domains"].replace(", ".join(map(str, V.DOMAINS)), ", ".join(map(str, BRANCHES)))
BM25 = C.BM25.replace("item_id AS query_id", "item_id * 20 AS query_id").replace("WHERE item_id % 20 = 0", "WHERE item_id * 20 IN (SELECT vec_id FROM embeddings)")


@query(rf"""WITH {BM25},
dp AS (SELECT doc_id, lang || '/' || source AS path, lower(coalesce(text, '')) AS low FROM documents WHERE doc_id % 4 <= 2 AND (doc_id % 4 < 2 OR doc_id % 3 = 0 OR source = 'src1') AND source IN ({', '.join(f"'{x}'" for x in SOURCES)})),
qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, e.label AS ql, coalesce(b.text, '') AS query FROM embeddings e LEFT JOIN benchmark b ON item_id * 20 = vec_id WHERE vec_id % 20 = 0),
it AS (SELECT item_id * 20 AS query_id, label FROM ({C.INTENT}) WHERE label <> 'other'),
ro AS (SELECT query_id * 20 AS query_id, domain_id AS branch FROM ({ROUTE}) WHERE place = 1 AND score >= 0.5),
sg AS (SELECT * FROM (VALUES {WEIGHTS}) t(intent, k, wv, wg, wc, wk)),
pl AS (SELECT qs.*, branch, regexp_extract(coalesce(branch, ''), '^(.*)/[^/]*$', 1) AS above, coalesce(it.label, 'general') AS intent FROM qs LEFT JOIN it USING (query_id) LEFT JOIN ro USING (query_id)),
vs AS (SELECT pl.*, doc_id, path, low, round(greatest(least(list_cosine_similarity(embedding::DOUBLE[], qv), 1.0::DOUBLE), 0.0::DOUBLE), 6) AS vector, CASE WHEN ql = e.label THEN 0.75::DOUBLE ELSE 0.1::DOUBLE END AS graph,
  CASE WHEN path = branch OR starts_with(path, branch || '/') THEN 1 WHEN above <> '' AND (path = above OR starts_with(path, above || '/')) THEN 2 ELSE 3 END AS tier FROM pl, embeddings e JOIN dp ON doc_id = vec_id WHERE vec_id <> query_id),
ti AS (SELECT query_id, min(tier) AS tier FROM vs GROUP BY 1),
h AS (SELECT vs.*, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, doc_id) AS p FROM vs JOIN ti USING (query_id, tier)),
f AS (SELECT h.*, k, count(*) OVER (PARTITION BY h.query_id) AS n, round(wc::DOUBLE * CASE WHEN path = 'en/src1' THEN 1.0 WHEN starts_with(path, 'en/') THEN 0.4 ELSE 0.1 END + wg::DOUBLE * graph + wk::DOUBLE * coalesce(bm.score, 0.0::DOUBLE) + wv::DOUBLE * vector, 4) AS base
  FROM h JOIN sg USING (intent) LEFT JOIN bm ON bm.query_id = h.query_id AND bm.doc_id = h.doc_id WHERE p <= 3 * k),
r AS (SELECT *, CASE WHEN n > k THEN round(base + 0.02::DOUBLE * len(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: w <> '')), lambda w: contains(low, w))), 4) ELSE base END AS score FROM f)
SELECT query_id, intent, coalesce(branch, '') AS branch, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= k""")
def retrieval(spark, d):
    """Every due query by its intent and branch, over what one asker may read."""
    e = read(spark, d, "embeddings")
    docs = C.levelled(spark, d).drop("source").join(read(spark, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id").withColumn("path", C.path_of())
    texts = read(spark, d, "benchmark").select((F.col("item_id") * 20).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    queries = C.query_vectors(spark, d).join(texts, "query_id", "left").withColumn("target", F.lit("en/src1"))
    may = governance.may_read(F.lit("confidential"), F.lit("src1"), F.col("level"), F.col("dept")) & governance.data_scope(governance.CUSTOM, F.col("source"), F.col("lang"), custom=SOURCES)

    def graph(hits):
        label = lambda key, name: e.select(F.col("vec_id").alias(key), F.col("label").alias(name))
        same = hits.join(label("doc_id", "dl"), "doc_id").join(label("query_id", "ql"), "query_id")
        return same.select("query_id", "doc_id", S.graph_score((F.col("dl") == F.col("ql")).cast("int"), F.lit(0), F.lit(1), F.lit(1)).alias("graph"))

    rules = spark.createDataFrame(C.INTENTS, "label string, keyword string")
    domains = spark.createDataFrame(BRANCHES, "domain_id string, name string, description string")
    out = retrieve(docs, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), queries, may, rules, STRATEGIES, domains, graph)
    return out.fillna("", ["branch"])
