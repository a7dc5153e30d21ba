"""Row security, catalogs, review queues and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_prefixes, safe_ratio
from ..sources.tables import saved

# Access levels in ascending order.
LEVELS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "SECRET"]


def access_rank(level: Column) -> Column:
    """Position of a level, whatever its case; 1 if it is unknown."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), F.upper(F.trim(level)))
    return F.when(F.coalesce(at, F.lit(0)) == 0, 1).otherwise(at - 1).cast("int")


def may_read(user_level: Column, user_dept: Column, doc_level: Column, doc_dept: Column) -> Column:
    """The user's rank reaches the document's; from CONFIDENTIAL on also the department is the same, if both are known."""
    rank = access_rank(doc_level)
    same = user_dept.isNull() | doc_dept.isNull() | (user_dept == doc_dept)
    return (access_rank(user_level) >= rank) & ((rank < 2) | same)


# The scopes of a user, from all rows to the own ones.
ALL, CUSTOM, DEPT, DEPT_AND_CHILD, SELF = 1, 2, 3, 4, 5


def data_scope(level: int, dept: Column, owner: Column, user: str | None = None, own_dept: object = None, custom: list | None = None, below: list | None = None) -> Column:
    """A condition for the rows that a user's scope covers, of literals alone, so that it reaches the scan.

    ALL: every row; CUSTOM: of the departments in custom; DEPT: of own_dept; DEPT_AND_CHILD: of own_dept's `below` (it and
    its descendants); any other level: the rows whose owner is the user. A user without the department, departments or
    name that the level needs sees nothing, and neither is a row without its department or owner seen but by ALL.
    """
    never = F.lit(False)
    if level == ALL:
        return F.lit(True)
    if level == CUSTOM:
        return dept.isin(*custom) if custom else never
    if level == DEPT:
        return never if own_dept is None else dept == own_dept
    if level == DEPT_AND_CHILD:
        return dept.isin(*below) if own_dept is not None and below else never
    return never if user is None or user == "anonymous" else owner == user


def descendants(parents: DataFrame, root: str) -> DataFrame:
    """The ids below root (and itself) of a tree (id, parent) of any depth; one join a level, and a cycle ends."""
    level = out = parents.where(F.col("id") == root).select("id").distinct()
    tree = parents.select(F.col("id").alias("child"), F.col("parent").alias("up"))
    while not level.isEmpty():
        level = level.join(tree, F.col("id") == F.col("up")).select(F.col("child").alias("id")).distinct()
        level = saved(level.join(out, "id", "left_anti"), "level")
        out = out.union(level)
    return out


def catalog_rollup(docs: DataFrame, path: Column) -> DataFrame:
    """path, n: a document counts at every prefix of its path. Paths are counted before they are taken apart."""
    paths = docs.groupBy(path.alias("full")).agg(F.count("*").alias("c"))
    return paths.select(F.explode(path_prefixes(F.col("full"))).alias("path"), "c").groupBy("path").agg(F.sum("c").alias("n"))


def own_and_parent(docs: DataFrame, path: Column) -> DataFrame:
    """path, n: a document counts at its path and one level up."""
    paths = docs.groupBy(path.alias("full")).agg(F.count("*").alias("c"))
    up = F.regexp_extract("full", r"^(.*)/[^/]*$", 1)
    both = F.when(up == "", F.array("full")).otherwise(F.array("full", up))
    return paths.select(F.explode(both).alias("path"), "c").groupBy("path").agg(F.sum("c").alias("n"))


def queue_matrix(items: DataFrame, roles: list[str], stations: list[str]) -> DataFrame:
    """workstation, role, n of open items, for every pair of the two lists."""
    spark = items.sparkSession
    grid = spark.createDataFrame([(s, r) for s in stations for r in roles], "workstation string, role string")
    n = items.where(F.col("status").isin("pending", "reviewing")).groupBy("workstation", "role").agg(F.count("*").alias("n"))
    return grid.join(n, ["workstation", "role"], "left").fillna(0, ["n"])


def overdue(items: DataFrame, now: str) -> DataFrame:
    """Open items past their due time; escalated ones are out."""
    return items.where(F.col("status").isin("pending", "reviewing") & (F.col("due") < F.to_timestamp_ntz(F.lit(now))))


def sla_sweep(items: DataFrame, now: str, escalation: dict[str, str]) -> DataFrame:
    """items with overdue ones escalated to the next role; their due time is cleared, so they are not swept again."""
    late = F.col("status").isin("pending", "reviewing") & (F.col("due") < F.to_timestamp_ntz(F.lit(now)))
    up = F.coalesce(F.create_map(*[F.lit(x) for pair in escalation.items() for x in pair])[F.col("role")], F.col("role"))
    return items.withColumns({"role": F.when(late, up).otherwise(F.col("role")), "status": F.when(late, F.lit("escalated")).otherwise(F.col("status")), "due": F.when(~F.coalesce(late, F.lit(False)), F.col("due"))})


def quality_histogram(docs: DataFrame, kpi: Column) -> DataFrame:
    """band, n, avg_pct: documents by quality in per cent (null: 50) in four bands."""
    pct = F.coalesce(F.round(kpi * 100), F.lit(50.0))
    band = F.when(pct >= 85, "excellent").when(pct >= 70, "good").when(pct >= 50, "fair").otherwise("poor")
    return docs.select(pct.alias("pct"), band.alias("band")).groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("pct"), 4).alias("avg_pct"))


def knowledge_gaps(domains: DataFrame, docs: DataFrame, key: str, most: int = 1) -> DataFrame:
    """Domains with at most so many documents."""
    n = docs.groupBy(key).agg(F.count("*").alias("n"))
    return domains.join(n, key, "left").fillna(0, ["n"]).where(F.col("n") <= most).select(key, "n")


def review_priority(confidence: Column, blocking: Column) -> Column:
    return F.floor((1 - confidence) * 100).cast("long") + F.when(blocking, 20).otherwise(0)


def coverage(total: Column, done: Column) -> Column:
    return F.least(F.floor(safe_ratio(done, total) * 100), F.lit(100)).cast("long")
