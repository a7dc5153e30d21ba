"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, packing. All stages but the last return
the columns of documents; a stage's decisions are in the rows and texts that it passes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import documents, table, written
from corpusmill.llm.decontaminate import contamination
from corpusmill.llm.encoding import tokenizer_path
from corpusmill.llm.line_dedup import drop_shared_lines
from corpusmill.llm.ngram_join import jaccard_components
from corpusmill.llm.packing import pack
from corpusmill.llm.resample import importance_resample


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with the columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample draws stay, as they are."""
    return importance_resample(docs, table(spark, sf_dir, "labels")).where("resample.kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the smallest id."""
    return _measured(drop_shared_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with its smallest id stays. Rows without an id stay."""
    kept = jaccard_components(docs).where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside a window of a benchmark item are cut out, from the first to the last of each run."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), mask=True)
    return _measured(found.withColumn("text", F.col("contamination.clean_text")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("packing", packing)]
#: SQL can express neither the sampling nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
