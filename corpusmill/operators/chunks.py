"""Chunks by meaning: sentences are put together while neighbours are alike, by an embedding that the caller names.

An embedding is a function from texts to vectors, called with batches. hashed_words is deterministic and needs no model:
each word adds a vector drawn from its md5, so that sentences of the same words are near each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from .corpus import boundary_chunks

Embedding = Callable[[list[str]], np.ndarray]
#: Neighbours below this cosine are parted, chunks of fewer characters are not, longer ones are not made.
THRESHOLD, LEAST, MOST = 0.5, 100, 1500
#: Sentences in one call of an embedding, and documents whose chunks are passed on at once.
CALL, DOCS = 1024, 200
_OUT = "doc_id {id}, chunk_index long, content string"


def seeded_vectors(dim: int = 64) -> Embedding:
    """Each text as a unit vector drawn with its md5 as the seed: the same for the same text, and without meaning."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dim))
        for k, text in enumerate(texts):
            v = np.random.RandomState(int(hashlib.md5(text.encode("utf-8")).hexdigest(), 16) % (1 << 32)).randn(dim).astype(np.float32)
            out[k] = v / np.linalg.norm(v)
        return out

    return embed


def hashed_words(dim: int = 64) -> Embedding:
    """The sum of its words' vectors, each word's drawn with its md5 as the seed."""
    one, known = seeded_vectors(dim), {}

    def word(w: str) -> np.ndarray:
        if w not in known:
            if len(known) >= 100_000:
                known.clear()
            known[w] = one([w])[0]
        return known[w]

    def embed(texts: list[str]) -> np.ndarray:
        return np.array([sum((word(w) for w in re.findall(r"\w+", t.lower())), np.zeros(dim)) for t in texts])

    return embed


def neighbour_cosines(vectors: np.ndarray) -> np.ndarray:
    """The cosine of each vector with the next; 0 where one is zero."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    dot = (vectors[:-1] * vectors[1:]).sum(axis=1)
    both = norm[:-1] * norm[1:]
    return np.where(both > 0, dot / np.where(both > 0, both, 1.0), 0.0)


def cuts(lengths: list[int], cosines: list[float], threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where chunks begin after the first: before a sentence that is unlike the one before it when the chunk has its least length, or that would make it too long."""
    out, size = [], lengths[0] if lengths else 0
    for k, alike in enumerate(cosines):
        if (alike < threshold and size >= least) or size + lengths[k + 1] > most:
            out.append(k + 1)
            size = lengths[k + 1]
        else:
            size += lengths[k + 1]
    return out


def semantic_chunks(docs: DataFrame, sentences: Column, embedding: Embedding | None = None, vectors: Column | None = None, id_col: str = "doc_id", threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST, cosines: Column | None = None) -> DataFrame:
    """doc_id, chunk_index, content, chunk_id of the documents of two or more sentences.

    sentences: an array of a document's sentences, with their delimiters. Their vectors come from embedding, in batches
    of CALL, or are given as an array of arrays (vectors), one a sentence; or the cosine of each sentence with the next is given (cosines). A chunk of white space alone is left out and
    takes no index. A document is segmented where it is read: nothing is shuffled. Null and short ones give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), sentences.alias("s"), (vectors if vectors is not None else F.lit(None).cast("array<array<double>>")).alias("v"), (cosines if cosines is not None else F.lit(None).cast("array<double>")).alias("c"))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                places, numbers, contents = [], [], []
                for k in range(start, min(start + DOCS, batch.num_rows)):
                    texts, known, alike = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                    if texts is None or len(texts) < 2:  # no filter: sentences would be found twice
                        continue
                    if alike is None:
                        found = np.array(known) if known is not None else np.concatenate([embedding(texts[a : a + CALL]) for a in range(0, len(texts), CALL)])
                        alike = neighbour_cosines(found).tolist()
                    edges = [0, *cuts([len(t) for t in texts], alike, threshold, least, most), len(texts)]
                    chunks = ["".join(texts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    chunks = [c for c in chunks if c.strip()]
                    places += [k] * len(chunks)
                    numbers += range(len(chunks))
                    contents += chunks
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(numbers, pa.int64()), pa.array(contents, pa.string())], names=["doc_id", "chunk_index", "content"])

    out = rows.mapInArrow(segment, _OUT.format(id=docs.schema[id_col].dataType.simpleString()))
    return out.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.concat(F.lit("s"), F.col("chunk_index"))))


def chunks_by_strategy(docs: DataFrame, strategy: Column, sentences: Column, embedding: Embedding, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_index, content, chunk_id, strategy: each document cut as its strategy says; blank texts give none.

    semantic: by meaning, documents of a single sentence as fixed ones; anything else: fixed, at sentence ends.
    """
    rows = docs.where(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\s+", " ")) != "")
    meant = (F.lower(F.coalesce(strategy, F.lit("fixed"))) == "semantic") & (F.size(sentences) > 1)
    by_meaning = semantic_chunks(rows.where(meant), sentences, embedding, id_col=id_col).withColumn("strategy", F.lit("semantic"))
    fixed = boundary_chunks(rows.where(~meant).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), size, overlap)
    fixed = fixed.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), F.lit("fixed").alias("strategy"))
    return by_meaning.unionByName(fixed)
