"""An incremental keyword index: segments of postings on shared storage, merged geometrically.

A batch of documents becomes a segment: its postings (term, doc_id, tf, length) in folders by a hash of the term, its
document frequencies, its number of documents and their length. Segments of like size are merged, so that n batches
leave about log n segments. Which segments count is said by the latest manifest, written last; whatever a failed batch
leaves behind is in no manifest. A search reads the folders of the asked terms in the live segments, and never a text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_tokens

#: Folders of postings by the hash of their term.
BUCKETS = 64
#: Terms whose postings one pass looks up at most; their list is broadcast.
TERMS = 100_000
POSTINGS = "term string, doc_id {id}, tf long, length long, bucket int"
_MANIFEST = "version long, segment string, n_docs long, n_tokens long, n_postings long"


_WORD, _CJK = re.compile("[a-z]{2,}"), re.compile("[一-鿿]")


def token_list(text: str | None) -> list[str]:
    """The tokens of functions.text.search_tokens, in any order."""
    low = (text or "").lower()
    cjk = _CJK.findall(low)
    return _WORD.findall(low) + [a + b for a, b in zip(cjk, cjk[1:], strict=False)] + cjk


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """term, doc_id, length, tf of the documents' tokens, and one row a document with the term '' and tf 1.

    terms (at most TERMS): only those. Rows that share an id count as documents of their own. The row for the document
    carries its length where it has no token that counts. A text is counted where it is read, so nothing is shuffled.
    """
    kind, wanted = docs.schema[id_col].dataType.simpleString(), None if terms is None else frozenset(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            for a in range(0, len(values), 500):
                term, place, length, tf = [], [], [], []
                for k in range(a, min(a + 500, len(values))):
                    tokens = token_list(values[k].as_py())
                    times = Counter(tokens if wanted is None else filter(wanted.__contains__, tokens))
                    times[""] = 1
                    term += times.keys()
                    tf += times.values()
                    place += [k] * len(times)
                    length += [len(tokens)] * len(times)
                yield pa.RecordBatch.from_arrays([pa.array(term), batch.column(0).take(pa.array(place)), pa.array(length, pa.int64()), pa.array(tf, pa.int64())], names=["term", "doc_id", "length", "tf"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(count, f"term string, doc_id {kind}, length long, tf long")


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class KeywordIndex:
    """The index at a path. One writer at a time: two that add at once find the same next version, and one of them fails."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), POSTINGS.format(id=id_type)

    def segments(self) -> list:
        """The live segments, oldest first: version, segment, n_docs, n_tokens, n_postings. There are about log n of them."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/*")
            last = rows.agg(F.max("version")).first()[0]
            return [] if last is None else sorted(rows.where(F.col("version") == last).collect(), key=lambda r: -r["n_postings"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _commit(self, version: int, segments: list[tuple]) -> None:
        rows = [(version, *s) for s in segments]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifests/{version:09d}")

    def _read(self, part: str, segments: list[str], schema: str) -> DataFrame:
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s}/{part}") for s in segments]
        return reduce(DataFrame.union, frames)

    def _write(self, postings: DataFrame, n_docs: int, n_tokens: int) -> tuple:
        name = uuid.uuid4().hex
        dealt = postings.select("term", "doc_id", "tf", "length", bucket_of(F.col("term")).alias("bucket"))
        # Ordered over the partitions by bucket, term and document, so that a frequent term is many files.
        dealt.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/segments/{name}/postings")
        mine = self._read("postings", [name], self.schema)
        mine.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.parquet(f"{self.path}/segments/{name}/frequencies")
        return name, n_docs, n_tokens, mine.count()

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds a batch of documents, as they are: a document that is there already is added once more. An empty batch changes nothing."""
        live = self.segments()
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        postings_of(docs, id_col, text_col).write.parquet(staged)  # texts are read and cut once
        rows = self.spark.read.parquet(staged)
        here = F.col("term") == ""
        n_docs, n_tokens, size = rows.agg(F.count_if(here), F.coalesce(F.sum(F.when(here, F.col("length"))), F.lit(0)), F.count_if(~here)).first()
        if not n_docs:
            return
        version = live[0]["version"] + 1 if live else 1
        kept, joined = [tuple(s)[1:] for s in live], []
        while kept and kept[-1][3] < 2 * size:  # a smaller one joins, until each is twice as large as the next
            joined.append(kept.pop())
            size += joined[-1][3]
        all_rows = rows.where(~here).select("term", "doc_id", "tf", "length")
        if joined:  # all that join are written once
            all_rows = all_rows.unionByName(self._read("postings", [s[0] for s in joined], self.schema).drop("bucket"))
        new = self._write(all_rows, n_docs + sum(s[1] for s in joined), n_tokens + sum(s[2] for s in joined))
        self._commit(version, [*kept, new])

    def search(self, queries: DataFrame, k: int | None = 10, terms_a_pass: int = TERMS) -> DataFrame:
        """As search.bm25: query_id, doc_id, score, rank. queries: query_id, query."""
        from .search import ranked_scores

        live = self.segments()
        terms = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        asked = terms.select("term", bucket_of(F.col("term")).alias("bucket")).distinct()
        if not live:
            postings = self.spark.createDataFrame([], self.schema).select("doc_id", "length", "term", "tf")
            return ranked_scores(postings, postings.groupBy("term").agg(F.count("*").alias("df")), terms, F.lit(0), F.lit(1.0), k)
        names = [s["segment"] for s in live]
        parts, frequencies = -(-asked.count() // terms_a_pass), self._read("frequencies", names, "bucket int, term string, df long")
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        held = self._read("postings", names, self.schema).where(F.col("bucket").isin(buckets))
        passes = []
        for p in range(max(1, parts)):
            some = F.broadcast(asked.where(F.pmod(F.xxhash64("term", F.lit("pass")), F.lit(max(1, parts))) == p))
            passes.append(held.join(some, ["bucket", "term"], "left_semi").select("doc_id", "length", "term", "tf"))
        df = frequencies.join(asked, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        n_docs, n_tokens = sum(s["n_docs"] for s in live), sum(s["n_tokens"] for s in live)
        return ranked_scores(reduce(DataFrame.union, passes), df, terms, F.lit(n_docs), F.lit(n_tokens / n_docs if n_tokens else 1.0), k)
