"""Category paths of documents from their topics, a taxonomy of domains and synonyms.

The taxonomy, the synonyms and the hints are stated and small (DOMAINS rows at most); they are one broadcast row, so each
document is looked at once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Domains that a taxonomy may have.
DOMAINS = 10_000
# What a topic scores that is a domain's name, has one in it or is in one, is a keyword of one, or shares a
# part with such a keyword of KEYWORD letters or more; the marks between the keywords of a description; the path of
# documents that nothing says anything of.
EXACT, PART, WORD, NEAR, KEYWORD = 10, 5, 3, 2, 3
MARKS, UNKNOWN = r"[，、。；：（）(),.;:\s]+", "未分类"


def _gathered(domains: DataFrame) -> DataFrame:
    """One row: domains (place, id, name, parts), keywords (place, word, id), in the order of `place`."""
    if domains.count() > DOMAINS:
        raise ValueError(f"a taxonomy has {DOMAINS} domains at most")
    up = domains.select(F.col("domain_id").alias("parent_id"), F.col("name").alias("parent"))
    rows = domains.join(up, "parent_id", "left")
    parts = F.array_compact(F.array(F.when(F.col("parent") != "", F.col("parent")), F.col("name")))
    words = rows.select("place", "domain_id", F.posexplode(F.split("description", MARKS)).alias("at", "word")).where(F.length(F.trim("word")) >= 2)
    # A keyword belongs to the last domain that has it, and keeps the place where it was first seen.
    words = words.groupBy(F.trim("word").alias("word")).agg(F.min(F.struct("place", "at")).alias("first"), F.max_by("domain_id", F.struct("place", "at")).alias("domain_id"))
    words = words.agg(F.array_sort(F.collect_list(F.struct("first", "word", "domain_id"))).alias("keywords"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("place", "domain_id", "name", parts.alias("parts")))).alias("domains")).join(words)


def category_paths(docs: DataFrame, domains: DataFrame, synonyms: dict[str, str], hints: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """id, domain_id, path of each document. docs: an id, topics (array), domain_id, doc_type; domains: place (unique), domain_id, name (unique), parent_id, description.

    Topics are trimmed and replaced by their synonyms; blank ones don't count. The domain is the given one, if the
    taxonomy has it; else the one whose name or keywords score most with a topic (ties: the earlier topic, then the
    earlier domain or keyword); else the hint for the type. The path is the domain's parent, its name and the first topic
    of two or more letters that is in neither; without a domain the first two topics; without topics UNKNOWN.
    """
    table = lambda d: F.create_map(*[F.lit(x) for pair in (d or {"": ""}).items() for x in pair])
    trimmed = F.filter(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    topics = F.transform(trimmed, lambda t: F.coalesce(F.try_element_at(table(synonyms), t), t))
    rows = docs.select(F.col(id_col).alias("id"), topics.alias("topics"), F.coalesce("domain_id", F.lit("")).alias("given"), F.coalesce("doc_type", F.lit("")).alias("kind")).join(F.broadcast(_gathered(domains)))

    def scored(t: Column, at: Column) -> Column:
        """Of a topic: (-score, topic, place, domain) of all that it scores with."""
        hit = lambda score, place, domain: F.struct(F.lit(-score).alias("score"), at.alias("topic"), place.alias("place"), domain.alias("domain"))
        none = F.array().cast("array<struct<score:int,topic:int,place:int,domain:string>>")
        exact = F.transform(F.filter("domains", lambda d: d["name"] == t), lambda d: hit(EXACT, F.lit(0), d["domain_id"]))
        part = F.transform("domains", lambda d, k: F.when(F.contains(d["name"], t) | F.contains(t, d["name"]), hit(PART, k, d["domain_id"])))
        word = F.transform(F.filter("keywords", lambda w: w["word"] == t), lambda w: hit(WORD, F.lit(0), w["domain_id"]))
        near = F.transform("keywords", lambda w, k: F.when((F.length(w["word"]) >= KEYWORD) & (F.contains(w["word"], t) | F.contains(t, w["word"])), hit(NEAR, k, w["domain_id"])))
        return F.when(F.size(exact) > 0, exact).otherwise(F.coalesce(F.array_compact(F.concat(part, word, near)), none))

    best = F.array_min(F.flatten(F.transform("topics", scored)))["domain"]
    known = lambda d: F.exists("domains", lambda x: x["domain_id"] == d)
    domain = F.when(known(F.col("given")), F.col("given")).otherwise(F.coalesce(best, F.try_element_at(table(hints), F.col("kind")), F.lit("")))
    placed = rows.withColumn("domain_id", domain)
    parts = F.get(F.transform(F.filter("domains", lambda d: d["domain_id"] == F.col("domain_id")), lambda d: d["parts"]), F.lit(0))
    sub = lambda p: F.slice(F.filter("topics", lambda t: ~F.array_contains(p, t) & (F.length(t) >= 2)), 1, 1)
    under = let(parts, lambda p: F.array_join(F.concat(p, sub(p)), "/"))
    path = F.when(parts.isNotNull(), under).when(F.size("topics") > 0, F.array_join(F.slice("topics", 1, 2), "/")).otherwise(F.lit(UNKNOWN))
    return placed.select("id", "domain_id", path.alias("path"))
