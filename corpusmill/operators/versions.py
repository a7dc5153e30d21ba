"""Versioned state: diffs, as-of reads, drift, latest rows, upserts, rebuild plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: `added`, `removed` or `modified`, of two snapshots with one row for each key."""
    a = old.select(key, F.col(value).alias("x"), F.lit(1).alias("was"))
    b = new.select(key, F.col(value).alias("y"), F.lit(1).alias("now"))
    both = a.join(b, key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def as_of(rows: DataFrame, at_col: str, at: str) -> DataFrame:
    """Rows made at or before a time; rows without a time were always there."""
    return rows.where(F.col(at_col).isNull() | (F.col(at_col) <= F.to_timestamp_ntz(F.lit(at))))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, by one aggregate: no key is sorted or held."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """table with changes (one row for each key) over it; columns in keep are not overwritten."""
    rest = [c for c in table.columns if c not in keys]
    old = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__old"))
    both = old.join(changes.withColumn("__new", F.lit(True)), keys, "full")
    pick = lambda c: F.when(F.col("__new").isNull() | (F.col("__old").isNotNull() & F.lit(c in keep)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *[pick(c) for c in rest]).select(*table.columns)


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those of rows whose key it lacks."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def drift(base: DataFrame, current: DataFrame, kind: str) -> DataFrame:
    """kind, n_base, n_now, share_base, delta, lost (a kind of 10 % or more that is gone)."""
    a = base.groupBy(kind).agg(F.count("*").alias("n_base"))
    b = current.groupBy(kind).agg(F.count("*").alias("n_now"))
    both = a.join(b, kind, "full").fillna(0, ["n_base", "n_now"])
    total = a.agg(F.sum("n_base").alias("total"))
    share = F.round(F.col("n_base") / F.col("total"), 4)
    out = both.join(F.broadcast(total)).withColumn("share_base", share)
    delta = F.coalesce(F.round(F.try_divide((F.col("n_now") - F.col("n_base")).cast("double"), F.col("n_base").cast("double")), 4), F.lit(0.0))
    return out.select(kind, "n_base", "n_now", "share_base", delta.alias("delta"), ((F.col("share_base") >= 0.1) & (F.col("n_now") == 0)).alias("lost"))


def rebuild_plan(docs: DataFrame, changed: DataFrame, any_added: bool = False) -> DataFrame:
    """doc, plan: `full` if types were added, `partial` where a document has a changed type, else `skipped`.

    docs: doc, type (a row for each type found in it). changed: type.
    """
    hit = docs.join(changed.select("type", F.lit(1).alias("hit")).distinct(), "type", "left")
    out = hit.groupBy("doc").agg(F.max("hit").alias("hit"))
    return out.select("doc", F.when(F.lit(any_added), "full").when(F.col("hit").isNotNull(), "partial").otherwise("skipped").alias("plan"))


def rebuild_cost(plan: DataFrame) -> DataFrame:
    """n_full, n_partial, n_skipped, cost (.3 for a partial one), saving."""
    n = lambda p: F.count_if(F.col("plan") == p)
    agg = plan.agg(n("full").alias("n_full"), n("partial").alias("n_partial"), n("skipped").alias("n_skipped"))
    cost = F.greatest(F.floor(F.col("n_partial") / 4), F.bround(F.col("n_full") + 0.3 * F.col("n_partial"))).cast("long")
    total = F.col("n_full") + F.col("n_partial") + F.col("n_skipped")
    return agg.withColumn("cost", cost).withColumn("saving", F.coalesce(F.round(1 - F.try_divide(cost.cast("double"), total.cast("double")), 4), F.lit(0.0)))


def version_chain(rows: DataFrame, base: Column, version: Column, id_col: str) -> DataFrame:
    """id, base, version, place (newest 1), is_latest within rows of one base title; versions by number."""
    keyed = rows.select(F.col(id_col).alias("id"), base.alias("base"), version.alias("version"))
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("version"), "id"))
    return keyed.withColumn("place", place.cast("long")).withColumn("is_latest", F.col("place") == 1)


# Where a title says its version, or else its date, what is cut off the end of what is left, and the
# version of a title that says neither.
VERSION, DATE, TAIL, FIRST = r"[vV](\d+(?:\.\d+)*)", r"(\d{4}[-/]?\d{2}[-/]?\d{2})", r"[_\-\s.]+$", "1.0"


def titled_versions(rows: DataFrame, title: Column, id_col: str) -> DataFrame:
    """id, base, version, place (newest 1), is_latest of the titles that share a base with another one.

    The base is the title without versions and dates and what then ends it; titles of which nothing is left are out.
    Versions are compared as strings, so that 9 comes before 10; ties go by id.
    """
    keyed = rows.select(F.col(id_col).alias("id"), F.coalesce(title, F.lit("")).alias("title"))
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("title", VERSION, ""), DATE, ""), TAIL, ""))
    said, dated = F.regexp_extract("title", VERSION, 1), F.regexp_extract("title", DATE, 1)
    version = F.when(said != "", said).when(dated != "", dated).otherwise(F.lit(FIRST))
    keyed = keyed.select("id", base.alias("base"), version.alias("version")).where("base <> ''")
    several = keyed.groupBy("base").agg(F.count("*").alias("n")).where("n > 1").select("base")
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("version"), "id"))
    return keyed.join(several, "base", "left_semi").withColumn("place", place.cast("long")).select("id", "base", "version", "place", (F.col("place") == 1).alias("is_latest"))
