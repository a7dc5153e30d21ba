"""Answers of a model as columns: the JSON in a reply, its fields with defaults, and the decision that follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import THRESHOLDS, kpi_retain, retain_decision

#: A code fence, with or without its language.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
#: A judge's scores, each 5 where it is missing, and decisions, KEEP where it is none of them.
SCORES, SCORE, DECISIONS, SURE = ("recency", "density", "completeness", "redundancy"), 5.0, ("KEEP", "ARCHIVE", "DISCARD"), 0.5


def json_in(text: Column) -> Column:
    """What stands in a reply's first code fence, or else the reply, without white space about it; null stays null."""
    inside = F.when(F.regexp_like(text, F.lit(FENCE)), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    return F.regexp_replace(inside, r"^\s+|\s+$", "")


def number_or(field: Column, default: float) -> Column:
    """A field as a number, also one in quotes; the default where it is missing or no number."""
    value = field.try_cast("double")
    return F.when(F.isnan(value), default).otherwise(F.coalesce(value, F.lit(default)))


def judged(reply: Column, age_days: Column, overlap: Column, t: dict[str, float] = THRESHOLDS) -> Column:
    """A judge's reply as a struct: parsed, the four scores, proposed, confidence, redundancy, kpi, decision, needs_review, rule.

    redundancy is the larger of the audit's overlap (0 where null) and a tenth of the reply's own score; kpi follows from it, the
    density score and the age, and the decision from the rules. A reply that is no JSON object is not parsed and has
    the defaults throughout; so has a field that is null, missing or of another kind.
    """
    schema = ", ".join(["decision string", "confidence string", f"reasoning struct<{', '.join(f'{s}_score: string' for s in SCORES)}>"])
    raw = json_in(reply)
    whole = F.try_parse_json(raw)
    parsed = F.coalesce(whole.isNotNull() & F.startswith(raw, F.lit("{")), F.lit(False))
    data = F.when(parsed, F.from_json(raw, schema))
    scores = {s: number_or(data["reasoning"][f"{s}_score"], SCORE) for s in SCORES}
    named = F.upper(data["decision"])
    proposed = F.when(named.isin(*DECISIONS), named).otherwise("KEEP")
    sure = number_or(data["confidence"], SURE)
    redundancy = F.greatest(F.coalesce(overlap, F.lit(0.0)), scores["redundancy"] / 10)
    kpi = kpi_retain(scores["density"], age_days, redundancy)
    out = retain_decision(kpi, proposed, sure, t)
    return F.struct(parsed.alias("parsed"), *[c.alias(s) for s, c in scores.items()], proposed.alias("proposed"), sure.alias("confidence"), redundancy.alias("redundancy_used"), kpi.alias("kpi"), out["decision"].alias("decision"), out["needs_review"].alias("needs_review"), out["rule"].alias("rule"))
