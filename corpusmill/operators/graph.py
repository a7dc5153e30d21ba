"""The entity graph: merging, shared entities, degrees, bounded paths, components, entity resolution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt, saved
from .names import alike_names


def merge_nodes(mentions: DataFrame, name: Column) -> DataFrame:
    """Mentions (doc_id, at, name, type) as nodes by normalised name: the type of the first mention, the number of documents."""
    rows = mentions.withColumn("node", name)
    return rows.groupBy("node").agg(F.min_by("type", "at").alias("type"), F.count_distinct("doc_id").alias("n_docs"))


def merge_edges(relations: DataFrame, keys: list[str]) -> DataFrame:
    """Relations as edges with their number of occurrences as weight."""
    return relations.groupBy(*keys).agg(F.count("*").alias("weight"))


#: Documents of an entity whose pairs are made in one place, and pairs of one task.
SHARED, PAIRS = 200, 4_000_000


def shared_entities(bridge: DataFrame, most: int | None = None, pairs_a_task: int = PAIRS) -> DataFrame:
    """Pairs of documents (a < b) and how many entities they share. bridge: doc, entity.

    An entity that n documents have makes n squared pairs, which is the result asked for; most leaves out entities of
    more documents than that, which say little about any two of them. Rows with a null are left out.

    The pairs are counted beforehand from the sizes of entities, and documents are cut into as many ranges as hold
    about pairs_a_task each at most. No pair is shuffled: an entity's sorted documents go once, as a list, to each range that any of them is in,
    and the pairs whose first document is in a range are made and summed there. Documents near each other that share
    entities thus cost little more than their rows. The documents of an entity with more than SHARED are dealt to parts of
    about so many, and each part's list is put beside those of all the others.
    """
    rows = bridge.select("doc", "entity").where("doc is not null and entity is not null")
    rows = dealt(rows, "doc", "entity").distinct()
    if most is not None:
        rare = rows.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") <= most)
        rows = rows.join(rare.select("entity"), "entity", "left_semi")
    rows = saved(rows.select("doc", "entity"), "bridge")
    n = saved(rows.groupBy("entity").agg(F.count("*").alias("n")), "sizes")
    made = n.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0  # twice the pairs, as early ranges have up to twice as many as the mean
    tasks = math.ceil(made / pairs_a_task) or 1
    sizes = n.select("entity", F.ceil(F.col("n") / SHARED).cast("int").alias("parts")).where("parts > 1")
    rows = rows.repartitionByRange(tasks, "doc").withColumn("range", F.spark_partition_id()).join(sizes, "entity", "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc"), F.col("parts"))).otherwise(0).cast("int")
    rows = rows.select("entity", part.alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), "doc", "range")
    lists = rows.repartition(tasks, "entity", "part").groupBy("entity", "part", "parts").agg(F.sort_array(F.collect_list(F.struct("doc", "range"))).alias("at"))
    lists = lists.select("entity", "part", "parts", F.col("at.doc").alias("docs"), F.col("at.range").alias("ranges"))
    each = lists.withColumn("range", F.explode(F.array_distinct("ranges")))
    start, firsts = F.array_position("ranges", F.col("range")).cast("int"), F.size(F.filter("ranges", lambda r: r == F.col("range")))
    own = each.select("range", F.slice("docs", start, F.size("docs")).alias("docs"), firsts.alias("firsts"), F.lit(0).alias("skip"))
    large = each.where("parts > 1").select("entity", "part", "range", F.slice("docs", start, firsts).alias("docs"))
    others = lists.where("parts > 1").select("entity", F.col("part").alias("other"), F.col("docs").alias("seconds")).join(large, "entity").where("part <> other")
    later = F.filter("seconds", lambda b: b > F.col("docs")[0])
    others = others.select("range", F.concat("docs", later).alias("docs"), F.size("docs").alias("firsts"), F.size("docs").alias("skip"))
    beside = F.transform(F.slice("docs", 1, F.col("firsts")), lambda a, i: F.struct(a.alias("a"), F.slice("docs", F.greatest(i + 2, F.col("skip") + 1), F.size("docs")).alias("b")))
    pairs = own.union(others).repartitionById(tasks, "range").select("range", F.inline(beside)).select("range", "a", F.explode("b").alias("b")).where("a < b")
    return pairs.groupBy("range", "a", "b").agg(F.count("*").alias("n_shared")).select("a", "b", "n_shared")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node, degree, centrality (degree over the other nodes), size (5 and 17 times the share of the largest).

    edges: a, b; direction, loops and repeats don't count.
    """
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    deg = one.select("a").union(one.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    total = deg.agg(F.count("*").alias("n"), F.max("degree").alias("most"))
    out = deg.join(F.broadcast(total))
    return out.select("node", "degree", F.round(F.try_divide(F.col("degree").cast("double"), (F.col("n") - 1).cast("double")), 6).alias("centrality"), F.round(5 + 17.0 * F.col("degree") / F.col("most"), 4).alias("size"))


def hops(edges: DataFrame, starts: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """start, node, hops: the nodes within so many hops of each start (node), with the least number of hops.

    One join a hop, each on the frontier alone; the seen nodes are written after it, which ends the lineage.
    """
    step = edges.select("a", "b") if directed else edges.select("a", "b").union(edges.select("b", "a"))
    step = step.where("a <> b").distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("hops"))
    for n in range(1, most + 1):
        front = seen.where(F.col("hops") == n - 1)
        new = front.join(step, front["node"] == step["a"]).select("start", F.col("b").alias("node")).distinct()
        new = new.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(n).cast("long"))
        seen = saved(seen.union(new), "hops")
    return seen


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links lead to) of all nodes of links (a, b), by contraction.

    In a round each node is renamed to the smallest name around it and links inside one name go, so that few rounds are
    needed. Each round's tables are written, which ends the lineage and survives lost executors.
    """
    links = saved(links.where("a <> b").select("a", "b"), "links")
    names = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("name", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "low")
        names = names.join(low.withColumnRenamed("a", "name"), "name", "left").select("node", F.coalesce("low", "name").alias("name"))
        names = saved(names, "names")
        left = links.join(low, "a").select(F.col("low").alias("x"), "b").join(low.withColumnRenamed("a", "b"), "b")
        links = saved(left.select(F.col("x").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), "links")
    return names.select("node", F.col("name").alias("component"))


def merge_candidates(entities: DataFrame, block: list[str], least: float = 0.85, most: int = 1000, guarded: DataFrame | None = None) -> DataFrame:
    """a, b, score of entities (id, name) of one block whose names are alike, the best first.

    Pairs come from a join on segments of names within a block (a type), not from all pairs of it. guarded: block values
    whose entities are never merged. The result is a report of the `most` best.
    """
    rows = entities if guarded is None else entities.join(guarded.select(*block).distinct(), block, "left_anti")
    return alike_names(rows, block, least).orderBy(F.desc("score"), "a", "b").limit(most)


def valid_relations(relations: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Relations (source, rel, target) with both ends known and their types allowed; an empty list allows any.

    nodes: node, type. allowed: rel, sources, targets.
    """
    s = nodes.select(F.col("node").alias("source"), F.col("type").alias("st"))
    t = nodes.select(F.col("node").alias("target"), F.col("type").alias("tt"))
    rows = relations.join(allowed, "rel").join(s, "source").join(t, "target")
    fits = lambda types, kind: (F.size(types) == 0) | F.array_contains(types, F.col(kind))
    return rows.where(fits("sources", "st") & fits("targets", "tt")).select("source", "rel", "target")
