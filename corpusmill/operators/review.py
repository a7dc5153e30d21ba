"""Quality metrics, review queues, version promotion, tables as chunks and choices by preference, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R


def extraction_metrics(docs: DataFrame) -> DataFrame:
    """docs: id, entities, relations, sensitive, confidence, chars, error. Adds density, the four scores, overall and alert."""
    density = F.when(F.col("chars") > 0, F.col("entities") / (F.col("chars") / 1000)).otherwise(0.0)
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    parts = {"density": R.density_score(density), "relations": R.relation_score(F.col("entities"), F.col("relations")), "confidence": F.col("confidence"), "sensitive": R.sensitive_score(F.col("chars"), F.col("sensitive"))}
    out = docs.withColumns({"density": F.round(density, 3), **{f"{k}_score": F.when(ok, F.round(v, 4)).otherwise(0.0) for k, v in parts.items()}, "overall": F.when(ok, R.weighted(parts, R.EXTRACTION_WEIGHTS)).otherwise(0.0)})
    return out.withColumn("alert", ~ok | (F.col("overall") < R.EXTRACTION_ALERT))


def extraction_aggregate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    mean = lambda c, n: F.round(F.avg(c), n)
    return metrics.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("alert").alias("alerting"), mean("overall", 4).alias("avg_overall"), mean("entities", 2).alias("avg_entities"), mean("relations", 2).alias("avg_relations"), mean("confidence", 4).alias("avg_confidence"), mean("density", 3).alias("avg_density"))


def page_scores(pages: DataFrame) -> DataFrame:
    """pages with a column for each dimension, which are clamped to 0 to 1; adds overall and alert."""
    clamped = pages.withColumns({k: F.least(F.greatest(F.coalesce(F.col(k).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for k in R.PAGE_WEIGHTS})
    scored = clamped.withColumn("overall", R.weighted({k: F.col(k) for k in R.PAGE_WEIGHTS}, R.PAGE_WEIGHTS))
    return scored.withColumn("alert", F.col("overall") < R.PAGE_ALERT)


def page_aggregate(scores: DataFrame, project: str, page: str, order: list[str]) -> DataFrame:
    """Averages over the latest score of each page. The latest is a maximum, so that partial ones are taken before the shuffle."""
    kept = [*R.PAGE_WEIGHTS, "overall", "alert"]
    latest = scores.groupBy(project, page).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("s")).select(project, "s.*")
    return latest.groupBy(project).agg(F.count("*").alias("pages"), F.count_if("alert").alias("alerting"), *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in (*R.PAGE_WEIGHTS, "overall")])


def resolve_reviews(docs: DataFrame, decisions: DataFrame, id_col: str) -> DataFrame:
    """docs with the status that the final decision (id, decision) gives: DISCARD, ARCHIVE, anything else ACTIVE; none: unchanged."""
    new = F.when(F.col("decision") == "DISCARD", "DISCARDED").when(F.col("decision") == "ARCHIVE", "ARCHIVED").when(F.col("decision").isNotNull(), "ACTIVE")
    return docs.join(decisions.select(id_col, "decision"), id_col, "left").withColumn("status", F.coalesce(new, F.col("status"))).drop("decision")


def act_on_queue(items: DataFrame, actions: DataFrame, id_col: str) -> DataFrame:
    """items (id, status, role, claimed_by, due, reason) after one action each (id, action, actor, note, to_role).

    claim: pending ones go into review; decide: those in review get the note as their status; escalate: any goes to
    to_role, with the reason added, unclaimed and without a due time. Actions that don't fit leave the item as it is.
    """
    a = F.col("action")
    rows = items.join(actions, id_col, "left")
    claim, decide, up = (F.coalesce(c, F.lit(False)) for c in ((a == "claim") & (F.col("status") == "pending"), (a == "decide") & (F.col("status") == "reviewing"), a == "escalate"))
    new = {
        "status": F.when(claim, "reviewing").when(decide, F.col("note")).when(up, "escalated").otherwise(F.col("status")),
        "role": F.when(up, F.col("to_role")).otherwise(F.col("role")),
        "claimed_by": F.when(claim, F.col("actor")).when(~up, F.col("claimed_by")),
        "due": F.when(~up, F.col("due")),
        "reason": F.when(up, F.concat_ws(" | ", F.when(F.col("reason") != "", F.col("reason")), F.col("note"))).otherwise(F.col("reason")),
    }
    return rows.withColumns(new).select(items.columns)


def reviewers(matrix: DataFrame) -> DataFrame:
    """workstation, primary and co-reviewers (in the matrix's order) from rows (workstation, place, role, part: R, C or I)."""
    first = F.min(F.when(F.col("part") == "R", F.struct("place", "role")))["role"]
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "C", F.struct("place", "role")))), lambda x: x["role"])
    return matrix.groupBy("workstation").agg(first.alias("primary"), others.alias("co_review"))


def promotion_check(old: DataFrame, new: DataFrame, kind: str, most: float = 0.3, key_share: float = 0.1) -> DataFrame:
    """One row: node counts, added and removed kinds, and whether the new version is safe.

    It isn't where the number of nodes moves by more than `most`, or where a kind with key_share of the old nodes is gone.
    """
    count = lambda df, n: df.groupBy(kind).agg(F.count("*").alias(n))
    both = count(old, "old").join(count(new, "new"), kind, "full").fillna(0, ["old", "new"])
    total, names = F.sum("old"), lambda c: F.array_sort(F.collect_list(F.when(c, F.col(kind))))
    out = both.agg(total.alias("n_old"), F.sum("new").alias("n_new"), names(F.col("old") == 0).alias("added"), names(F.col("new") == 0).alias("removed"), F.max(F.when(F.col("new") == 0, F.col("old"))).alias("lost"))
    moved = F.coalesce(F.try_divide(F.abs(F.col("n_new") - F.col("n_old")), F.col("n_old")), F.lit(0.0))
    gone = F.coalesce(F.try_divide(F.col("lost"), F.col("n_old")), F.lit(0.0)) >= key_share
    return out.select("n_old", "n_new", "added", "removed", (moved > most).alias("moved_too_far"), gone.alias("key_kind_lost"), (~((moved > most) | gone)).alias("safe"))


def table_chunks(rows: DataFrame, table: str, row: str, cells: Column, headers: Column, caption: Column, n_rows: Column, window: int = 20, least: int = 50, most: int = 4000) -> DataFrame:
    """table, chunk_index, content: a line for each row of a table that isn't blank, as header=cell for the cells that aren't.

    row: the row's number, from 1. Of tables with more than `least` rows, each window-th line repeats the headers. Contents
    are cut after `most` characters.
    """
    full = rows.select(F.col(table), F.col(row).alias("r"), F.transform(cells, lambda c: F.coalesce(c.cast("string"), F.lit(""))).alias("cells"), R.table_headers(headers).alias("headers"), caption.alias("caption"), n_rows.alias("n"))
    full = full.where(F.exists("cells", lambda c: F.btrim(c) != ""))
    at = F.row_number().over(Window.partitionBy(table).orderBy("r")) - 1
    full = full.withColumn("i", at)
    pairs = F.filter(F.zip_with("headers", "cells", lambda h, c: F.when(F.btrim(c) != "", F.concat(h, F.lit("="), c))), lambda x: x.isNotNull())
    again = (F.col("i") > 0) & (F.col("i") % window == 0) & (F.col("n") > least)
    head = F.concat_ws(" · ", F.concat(F.lit("[表格] "), F.coalesce("caption", F.lit("未命名表"))), F.format_string("第 %d 行", F.col("r")), F.when(again, F.concat(F.lit("列: "), F.array_join("headers", " | "))))
    return full.select(table, F.col("i").cast("long").alias("chunk_index"), F.left(F.concat(head, F.lit("\n"), F.array_join(pairs, " | ")), F.lit(most)).alias("content"))


def first_stage(candidates: DataFrame, key: str, stage: str) -> DataFrame:
    """Of each key the candidates of its lowest stage: a branch, else its parent, else all."""
    return candidates.join(candidates.groupBy(key).agg(F.min(stage).alias(stage)), [key, stage])


def preferred(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")


def longest_prefix(names: DataFrame, known: DataFrame, name: str, mark: str = ".") -> DataFrame:
    """name and the longest of its dotted prefixes that is among known (name); null where none is."""
    parts = F.split(name, rf"\{mark}")
    prefixes = names.select(name).distinct().select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), mark))).alias("prefix"))
    found = prefixes.join(known.select(F.col(name).alias("prefix")).distinct(), "prefix", "left_semi")
    return names.join(found.groupBy(name).agg(F.max_by("prefix", F.length("prefix")).alias("module")), name, "left")


def inside(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The edges (a, b) of which both ends are chosen (left: a, right: b)."""
    return edges.join(left, "a", "left_semi").join(right, "b", "left_semi")
