"""Observation after a promotion: a start opens it, ticks compare with its baseline, it ends by time or by rollback.

The batch form over a log. A project's log is dealt by day: a row finds its start in its own day, or else the last one
of the days before, so that no project is one task's. streaming.observation has the same machine with timers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 7
# Counts that change by more than this share, custom relations that grow by more than this factor, or pass
# this share where there were hardly any, what counts as hardly any, and a key type's share of the baseline's entities.
DELTA, GROWTH, FROM_ZERO, HARDLY, KEY = 0.5, 2.0, 0.1, 0.01, 0.1
ALERTS = ["entities", "relations", "ratio", "types"]
LOG = "project long, at timestamp, seq long, kind string, entities long, relations long, ratio double, types map<string,long>"


def alert_codes(base: Column, now: Column) -> Column:
    """The alerts of a snapshot against the baseline (structs of entities, relations, ratio, types), in the order of ALERTS.

    entities, relations: the count changed by more than DELTA of the baseline's, if that has any; ratio: the share of
    custom relations more than doubled, or passes FROM_ZERO where it was at most HARDLY; types: a key type is gone.
    """
    moved = lambda c: (base[c] > 0) & (F.abs(F.round(F.try_divide(now[c] - base[c], base[c]), 4)) > DELTA)
    ratio = F.when(base["ratio"] > HARDLY, now["ratio"] / base["ratio"] > GROWTH).otherwise(now["ratio"] > FROM_ZERO)
    lost = F.exists(F.map_entries(base["types"]), lambda t: (t["value"] >= KEY * base["entities"]) & (F.coalesce(F.try_element_at(now["types"], t["key"]), F.lit(0)) == 0)) & (base["entities"] > 0)
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in zip(ALERTS, (moved("entities"), moved("relations"), ratio, lost), strict=True)]))


def observations(log: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """project, observation (seq of its start), started, n_snapshots, alerts (sorted), status as of `now`, of a log (LOG).

    kind: start, tick or rollback; rows are ordered by at, then seq (unique in a project). A start opens an observation
    and ends the one before; rows before a project's first start are ignored. Ticks count until the observation expires,
    after `days`, or is rolled back. status: rolled_back, else expired (if no other start came before), else alert, else
    active.
    """
    order = ["at", "seq"]
    snapshot = F.struct("entities", "relations", "ratio", "types")
    start = F.when(F.col("kind") == "start", F.struct("seq", "at", snapshot.alias("base")))
    rows = log.select("*", F.to_date("at").alias("day"), start.alias("start"), snapshot.alias("snap"))
    here = F.last("start", ignorenulls=True).over(Window.partitionBy("project", "day").orderBy(*order))
    by_day = rows.groupBy("project", "day").agg(F.max_by("start", F.when(F.col("start").isNotNull(), F.struct(*order))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("project").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    held = rows.withColumn("here", here).join(by_day.select("project", "day", before.alias("before")), ["project", "day"])
    held = held.withColumn("own", F.coalesce("here", "before")).where("own is not null")
    expires = F.col("own.at") + F.expr(f"INTERVAL {days} DAYS")
    held = held.select("project", F.col("own.seq").alias("observation"), F.col("own.at").alias("started"), expires.alias("expires"), "kind", F.struct(*order).alias("when"), alert_codes(F.col("own.base"), F.col("snap")).alias("codes"))
    key = ["project", "observation"]
    ended = held.groupBy(*key).agg(F.first("started").alias("started"), F.first("expires").alias("expires"), F.min(F.when(F.col("kind") == "rollback", F.col("when"))).alias("back"))
    ticks = held.where((F.col("kind") == "tick") & (F.col("when.at") < F.col("expires"))).select(*key, "when", "codes")
    ticks = ticks.join(ended.select(*key, "back"), key).where(F.col("back").isNull() | (F.col("when") < F.col("back")))
    counted = ticks.groupBy(*key).agg(F.count("*").alias("n"), *[F.max(F.array_contains("codes", a)).alias(f"has_{a}") for a in ALERTS])
    out = ended.join(counted, key, "left")
    alerts = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"has_{a}"), F.lit(a)) for a in ALERTS])))
    starts = log.where("kind = 'start'").select("project", F.col("seq").alias("observation"), F.lead("at").over(Window.partitionBy("project").orderBy(*order)).alias("next"))
    out = out.join(starts, key, "left")
    status = F.when(F.col("back").isNotNull(), "rolled_back").when(F.least(now, "next") >= F.col("expires"), "expired").when(F.size(alerts) > 0, "alert").otherwise("active")
    return out.select(*key, "started", F.coalesce("n", F.lit(0)).cast("long").alias("n_snapshots"), alerts.alias("alerts"), status.alias("status"))
