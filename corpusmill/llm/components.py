"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links lead to) for every node of links (a, b).

    In each round a node takes the name of its smallest neighbour, or keeps its own if that is smaller, and links are
    renamed; links within one name go. A round at least halves a component's names, so there are few rounds. Each
    round's tables are written, which ends their lineage. Minima are computed before the shuffle; a node with very many
    links skews a join, which adaptive execution splits. Self-links and repeated links are fine.
    """
    links = written(links.select("a", "b").where("a <> b"), "links")
    names: DataFrame | None = None
    while True:
        both = links.union(links.select("b", "a"))
        named = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("name"))
        named = written(named.select(F.col("a").alias("node"), "name"), "names")
        if names is None:
            names = named
        else:
            newer = named.select(F.col("node").alias("name"), F.col("name").alias("newer"))
            names = written(names.join(newer, "name", "left").select("node", F.coalesce("newer", "name").alias("name")), "names")
        left = links.join(named.select(F.col("node").alias("a"), F.col("name").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("name").alias("y")), "b")
        links = written(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return names.select("node", F.col("name").alias("component"))
