"""Search: BM25, exact cosine top-k, fusion of scores, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import catalog_weight, fused, rounded
from ..functions.text import search_tokens
from ..sources.tables import ROWS, saved
from .keyword_index import TERMS, postings_of
from .vectors import nearest  # noqa: F401  the exact search is part of this module's surface

K1, B = 1.5, 0.75
#: Pairs of a stated query and a term up to which they, and the document frequencies (no more than those), are broadcast.
BROADCAST_TERMS = 200_000


def ranked_scores(postings: DataFrame, df: DataFrame, terms: DataFrame, n: Column, mean: Column, k: int | None, only: DataFrame | None = None, pairs_a_task: int = ROWS) -> DataFrame:
    """query_id, doc_id, score and, with k, rank, from postings (doc_id, length, term, tf), df (term, df) and terms (query_id, term, times).

    n: number of documents; mean: their mean length. only: the (query_id, doc_id) asked for, with k None; the best scores are then made in as
    many tasks as hold pairs_a_task of a query's term and a posting each, however many the session asks for.
    """
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    def summed(rows: DataFrame, on: list[str]) -> DataFrame:
        scored = rows.join(df, "term").join(terms, on).withColumns({"n": n, "mean": mean})
        return scored.groupBy("query_id", "doc_id").agg(rounded(F.sum(part), 8).alias("raw"))

    score = rounded(F.col("raw") / F.col("best")).alias("score")
    if only is not None:  # the best score takes all documents, dealt once by document and not once for each query; the rest only those asked for
        spark = postings.sparkSession
        pairs = df.join(terms, "term").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]  # rows that the sums take
        tasks = max(-(-pairs // pairs_a_task), int(spark.conf.get("spark.sql.shuffle.partitions")))
        best = summed(postings.repartition(tasks, "doc_id"), ["term"]).groupBy("query_id").agg(F.max("raw").alias("best"))
        asked = summed(postings.join(only.select("query_id", "doc_id").distinct(), "doc_id"), ["query_id", "term"])
        return asked.join(best, "query_id").select("query_id", "doc_id", score)
    scores = summed(postings, ["term"])
    if k is None:
        best = scores.groupBy("query_id").agg(F.max("raw").alias("best"))
        return scores.join(best, "query_id").select("query_id", "doc_id", score)
    first = Window.partitionBy("query_id").orderBy(F.desc("raw"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = scores.withColumns({"rank": F.row_number().over(first), "best": F.first("raw").over(first)})  # tasks pass on k rows a query
    return out.where(F.col("rank") <= k).select("query_id", "doc_id", score, "rank")


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score (over the query's best), rank of the k best documents of each query; k None: all, without rank.

    queries: query_id, query; a stated set. A term that a query repeats counts again. Texts are read and tokenised once,
    and of the tokens only the queries' terms are kept, by a broadcast list of at most TERMS of them a pass; a document
    leaves a row for each of those, and one with its length. That small table is written, and sizes, document
    frequencies and scores come from it. Terms and frequencies are broadcast up to BROADCAST_TERMS of them, by their
    count and not by the size of their files; more are joined as their sizes say. only: the (query_id, doc_id) whose scores are asked for (k None). allowed: the
    doc_id that may be found; statistics are those of all documents.
    """
    terms = saved(queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "terms")
    wanted = terms.select("term").distinct()
    passes = max(1, -(-wanted.count() // TERMS))
    counted = []
    for p in range(passes):  # a pass takes TERMS of the stated queries' terms at most
        some = [r[0] for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == p).collect()]
        counted.append(postings_of(docs, id_col, text_col, some).where(F.lit(p == 0) | (F.col("term") != "")))
    counts = saved(reduce(DataFrame.union, counted), "postings")
    stats = counts.where("term = ''").agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean")).first()
    postings = counts.where("term <> ''")
    df = saved(postings.groupBy("term").agg(F.count("*").alias("df")), "df")
    if terms.count() <= BROADCAST_TERMS:
        df, terms = F.broadcast(df), F.broadcast(terms)
    seen = postings if allowed is None else postings.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    return ranked_scores(seen, df, terms, F.lit(stats["n"]), F.lit(stats["mean"] or 1.0), k, only)


def hybrid(hits: DataFrame, keyword: DataFrame, paths: DataFrame, query_path: Column, k: int = 10, graph: DataFrame | None = None) -> DataFrame:
    """Vector hits (query_id, doc_id, score) with BM25 scores, catalog weights and graph scores, fused.

    graph: query_id, doc_id, graph; a hit without one has 0.1.

    Keyword scores never add candidates; hits without a row in paths (doc_id, path) are dropped.
    """
    rows = hits.select("query_id", "doc_id", F.col("score").alias("vector")).join(paths, "doc_id")
    rows = rows.join(keyword.select("query_id", "doc_id", F.col("score").alias("keyword")), ["query_id", "doc_id"], "left").fillna(0.0, ["keyword"])
    rows = rows.withColumn("graph", F.lit(0.1)) if graph is None else rows.join(graph, ["query_id", "doc_id"], "left").fillna(0.1, ["graph"])
    score = fused({"vector": F.col("vector"), "keyword": F.col("keyword"), "catalog": catalog_weight(F.col("path"), query_path), "graph": F.col("graph")})
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame, boost: float = 0.02) -> DataFrame:
    """hits (query_id, doc_id, score) with the boost added for each distinct query word that the text contains."""
    words = queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")).alias("words"))
    rows = hits.select("query_id", "doc_id", "score").join(docs.select("doc_id", F.lower("text").alias("text")), "doc_id").join(words, "query_id")
    n = F.size(F.filter("words", lambda w: F.contains(F.col("text"), w)))
    score = F.round(F.col("score") + boost * n, 4)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.select("query_id", "doc_id", score.alias("score")).withColumn("rank", rank)


def keyword_class(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str, default: str, base: float = 0.5) -> DataFrame:
    """id, label, hits, confidence: the rule set (label, keyword) with the most keywords contained; base and .05 a hit.

    Each text is looked at once with all rules at hand, so no text is repeated and nothing is shuffled.
    """
    sets = rules.where("keyword <> ''").groupBy("label").agg(F.collect_set(F.lower("keyword")).alias("words"))
    sets = sets.agg(F.array_sort(F.collect_list(F.struct("label", "words"))).alias("sets"))
    low = texts.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).join(F.broadcast(sets))
    counted = F.transform("sets", lambda s: F.struct((-F.size(F.filter(s["words"], lambda w: F.contains(F.col("text"), w)))).alias("n"), s["label"].alias("label")))
    best = low.select(id_col, F.array_min(counted).alias("b")).select(id_col, (-F.col("b.n")).alias("hits"), F.col("b.label").alias("found"))
    label = F.when(F.col("hits") > 0, F.col("found")).otherwise(default).alias("label")
    return best.select(id_col, label, F.col("hits").cast("long").alias("hits"), F.round(F.least(base + 0.05 * F.col("hits"), F.lit(0.99)), 4).alias("confidence"))
