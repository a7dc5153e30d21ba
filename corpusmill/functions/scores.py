"""Column functions that score documents, paths and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int = 4) -> Column:
    """x rounded at x * 10**digits as a double, halves away from zero, as SQL engines do; Spark's own round goes by the decimal digits."""
    return F.round(x * 10.0**digits) / 10.0**digits


def kpi_retain(density: Column, age_days: Column, redundancy: Column) -> Column:
    """How much a document is worth keeping: density (0 to 10) and freshness over redundancy; no age counts as oldest."""
    fresh = 1 - F.least(F.coalesce(age_days.cast("double"), F.lit(730.0)) / 730, F.lit(1.0))
    return F.round((clamp(density / 10) * 0.6 + fresh * 0.4) / (clamp(redundancy) + 1), 4)


#: The default decision thresholds.
THRESHOLDS = {"discard": 0.20, "archive": 0.45, "floor": 0.80, "low": 0.30, "high": 0.55, "review": 0.60}


def retain_decision(kpi: Column, proposed: Column, confidence: Column, t: dict[str, float] = THRESHOLDS) -> Column:
    """decision, needs_review, rule: the first of five rules that holds.

    R1 both signals say discard; R2 a sure discard; R3 a middling value with low confidence, for review; R4 a low value
    or a proposal to archive; R5 else keep.
    """
    kpi, confidence = clamp(kpi), clamp(confidence)
    out = lambda d, review, rule: F.struct(d.alias("decision"), F.lit(review).alias("needs_review"), F.lit(rule).alias("rule"))
    discard = proposed == "DISCARD"
    return (
        F.when((kpi < t["discard"]) & discard, out(F.lit("DISCARD"), False, "R1"))
        .when(discard & (confidence >= t["floor"]), out(F.lit("DISCARD"), False, "R2"))
        .when(kpi.between(t["low"], t["high"]) & (confidence < t["review"]), out(proposed, True, "R3"))
        .when((kpi < t["archive"]) | (proposed == "ARCHIVE"), out(F.lit("ARCHIVE"), False, "R4"))
        .otherwise(out(F.lit("KEEP"), False, "R5"))
    )


def catalog_weight(doc_path: Column, query_path: Column) -> Column:
    """1 for the same path, .7 below or above it, .4 for a shared parent, .3 for a shared root, .1 else; .5 without one."""
    a, b = F.coalesce(doc_path, F.lit("")), F.coalesce(query_path, F.lit(""))
    parent = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    root = lambda p: F.substring_index(p, "/", 1)
    below = F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))
    same_parent = (parent(a) != "") & (parent(a) == parent(b))
    return F.when((a == "") | (b == ""), 0.5).when(a == b, 1.0).when(below, 0.7).when(same_parent, 0.4).when(root(a) == root(b), 0.3).otherwise(0.1)


#: The weights of vector, graph, catalog and keyword scores.
FUSION = {"vector": 0.35, "graph": 0.25, "catalog": 0.15, "keyword": 0.25}


def fused(scores: dict[str, Column], weights: dict[str, float] = FUSION) -> Column:
    return rounded(reduce(lambda a, b: a + b, [weights[k] * scores[k] for k in sorted(scores)]))


def graph_score(n_direct: Column, n_near: Column, n_query: Column, n_doc: Column) -> Column:
    """How close a document's entities are to the query's: shared ones, else neighbours, else almost nothing."""
    none = F.least(0.1 * n_doc, F.lit(0.5))
    return F.when(n_doc == 0, 0.0).when(n_query == 0, none).when(n_direct > 0, F.least(F.lit(1.0), 0.5 + 0.25 * n_direct)).when(n_near > 0, F.least(F.lit(0.6), 0.3 + 0.15 * n_near)).otherwise(0.1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, between 0 and 1; 0 for other lengths or no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), clamp(F.coalesce(value, F.lit(0.0)))).otherwise(0.0)


def overlap_score(kind: Column, n_docs: Column) -> Column:
    """Weight of an overlap kind by the size of its group, full from five documents on."""
    # Duplicate 1, version .8, partial .5, conflict .3, others .4.
    weight = F.when(kind == "duplicate", 1.0).when(kind == "version", 0.8).when(kind == "partial", 0.5).when(kind == "conflict", 0.3).otherwise(0.4)
    return weight * (0.6 + 0.4 * F.least(n_docs / 5.0, F.lit(1.0)))
