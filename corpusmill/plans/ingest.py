"""Compositions: from raw documents to decided and chunked ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import kpi_retain, retain_decision
from ..functions.text import chunk_id, content_hash
from ..operators.corpus import fixed_chunks, incremental_plan, infer_domain, noise_ratio


def distil(docs: DataFrame, judged: DataFrame, rules: DataFrame, stored: DataFrame, most_noise: float = 0.7) -> DataFrame:
    """Chunks of the documents that stay: doc_id, domain_id, decision, chunk_index, chunk_id, content.

    docs: doc_id, text. judged: doc_id, density, age, redundancy, proposed, confidence (what a model says). stored: doc_id
    and hash of what has been done; unchanged documents are skipped. Noise is dropped before anything is joined.
    """
    quiet = docs.where(noise_ratio(F.col("text")) < most_noise)
    todo = incremental_plan(quiet, stored, "doc_id", "text").where("action <> 'same'").select("doc_id")
    kpi = kpi_retain(F.col("density"), F.col("age"), F.col("redundancy"))
    decided = judged.select("doc_id", retain_decision(kpi, F.col("proposed"), F.col("confidence"))["decision"].alias("decision")).where("decision = 'KEEP'")
    kept = quiet.join(todo, "doc_id", "left_semi").join(decided, "doc_id")
    placed = kept.join(infer_domain(kept, rules).select("doc_id", "domain_id"), "doc_id")
    chunks = fixed_chunks(kept)
    return chunks.join(placed.select("doc_id", "domain_id", "decision"), "doc_id").select("doc_id", "domain_id", "decision", "chunk_index", chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "content", content_hash(F.col("content")).alias("hash"))
