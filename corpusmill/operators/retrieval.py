"""The whole retrieval for a stated set of queries of one asker: intent, branch, secured vectors, fusion, reranking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import FUSION, catalog_weight, fused
from ..sources.tables import saved
from .documents import route_domains
from .search import bm25, keyword_class, rerank
from .vectors import nearest_in

GENERAL = "general"
# Results of a query without an intent, candidates for each result, and the least score of a route.
RESULTS, MORE, FLOOR = 5, 3, 0.5


def under(path: str, branch: str) -> bool:
    return path == branch or path.startswith(f"{branch}/")


def retrieve(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    readable: Column,
    rules: DataFrame,
    strategies: dict[str, tuple[int, dict[str, float]]],
    domains: DataFrame,
    graph: Callable[[DataFrame], DataFrame] | None = None,
    floor: float = FLOOR,
    more: int = MORE,
) -> DataFrame:
    """query_id, intent, branch (null: none), doc_id, score, rank: the best documents that the asker may read.

    docs: doc_id (unique), text, path (its place in the catalog: the number of different paths is that of a catalog's
    nodes, and they are counted to the driver) and what `readable` looks at. vectors: doc_id, vector. queries: query_id,
    query, query_vector, target (a path to favour, or null). readable: a condition on docs' columns, such as may_read and
    data_scope; it holds before any vector is compared.

    1. The rules (label, keyword) give a query its intent, `strategies` the intent's number of results and weights; without
       either it has RESULTS and FUSION. 2. The domain that fits best, if its score reaches `floor`, is the query's branch.
    3. The nearest vectors, `more` for each result, are taken in the branch, or in its parent where the branch has nothing
       to read, or else in all. 4. Vector, keyword, catalog and graph scores are fused. graph: from hits (query_id, doc_id,
       score) to query_id, doc_id, graph, 0.1 where it has none. 5. With more candidates than results they are reranked by the
       query's words in their texts. Ties go by doc_id.

    A null text or query has no words, and a null path is in no branch. A document without a vector is not found, one
    whose vector is null or of another length scores 0, and a query's own id is never found. A condition that is null is
    not met. Empty tables give no rows.
    """
    spark = docs.sparkSession
    settings = [(label, k, *(weights[c] for c in FUSION)) for label, (k, weights) in ({GENERAL: (RESULTS, FUSION)} | strategies).items()]
    table = spark.createDataFrame(settings, f"intent string, k int, {', '.join(f'w_{c} double' for c in FUSION)}")
    intents = keyword_class(queries, rules, "query_id", "query", GENERAL).select("query_id", F.col("label").alias("intent"))
    known = [r[0] for r in settings]
    intents = intents.withColumn("strategy", F.when(F.col("intent").isin(known), F.col("intent")).otherwise(GENERAL))
    intents = intents.join(F.broadcast(table.withColumnRenamed("intent", "strategy")), "strategy").drop("strategy")
    routes = route_domains(queries.select("query_id", "query"), domains, top=1).where(F.col("score") >= floor).select("query_id", F.col("domain_id").alias("branch"))
    asked = saved(queries.select("query_id", "query", "query_vector", "target").join(intents, "query_id").join(routes, "query_id", "left"), "asked")

    seen = docs.where(readable).select("doc_id", "path")
    rows = saved(vectors.select("doc_id", "vector").join(seen, "doc_id"), "readable")
    counts = {r["path"]: r["count"] for r in rows.groupBy("path").count().collect()}  # one row for each node of the catalog
    numbers = {path: i for i, path in enumerate(sorted(counts, key=lambda p: (p is not None, p)))}
    listed = spark.createDataFrame(list(numbers.items()), "path string, list int")
    among = rows.join(F.broadcast(listed), rows["path"].eqNullSafe(listed["path"])).select(F.col("doc_id").alias("id"), "vector", "list")

    def lists(block: list[tuple]) -> list[set[int]]:
        ids = [q for q, _ in block]
        branches = dict(asked.where(F.col("query_id").isin(ids)).select("query_id", "branch").collect())
        own: dict = {}
        for id, path in rows.where(F.col("doc_id").isin(ids)).select("doc_id", "path").collect():
            own.setdefault(id, Counter())[path] += 1
        out = []
        for q in ids:
            branch = branches.get(q)
            tiers = [branch, branch.rpartition("/")[0]] if branch else []
            places = [[p for p in counts if p is not None and t and under(p, t)] for t in tiers] + [list(counts)]
            found = next((ps for ps in places if sum(counts[p] - own.get(q, {}).get(p, 0) for p in ps) > 0), [])
            out.append({numbers[p] for p in found})
        return out

    most = max(k for _, k, *_ in settings)
    near = nearest_in(among, asked, most * more, lists).withColumnRenamed("id", "doc_id")
    hits = saved(near.join(asked.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k") * more).select("query_id", "doc_id", "score"), "hits")
    keyword = bm25(docs.select("doc_id", "text"), queries.select("query_id", "query"), k=None, only=hits).select("query_id", "doc_id", F.col("score").alias("keyword"))
    key = ["query_id", "doc_id"]
    scores = hits.withColumnRenamed("score", "vector").join(seen, "doc_id").join(keyword, key, "left").fillna(0.0, ["keyword"])
    scores = scores.withColumn("graph", F.lit(0.1)) if graph is None else scores.join(graph(hits).select(*key, "graph"), key, "left").fillna(0.1, ["graph"])
    scores = scores.join(asked.drop("query", "query_vector"), "query_id")
    score = fused({"vector": F.col("vector"), "keyword": F.col("keyword"), "catalog": catalog_weight(F.col("path"), F.col("target")), "graph": F.col("graph")}, {c: F.col(f"w_{c}") for c in FUSION})
    scores = scores.select(*key, "k", score.alias("score"), F.count("*").over(Window.partitionBy("query_id")).alias("n"))
    scores = saved(scores, "fused")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).alias("rank")
    plain = scores.where("n <= k").select(*key, "score", place)
    ranked = rerank(scores.where("n > k"), docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"))).select(*key, "score", "rank")
    final = plain.unionByName(ranked).join(asked.select("query_id", "k", "intent", "branch"), "query_id").where(F.col("rank") <= F.col("k"))
    return final.select("query_id", "intent", "branch", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
