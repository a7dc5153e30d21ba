"""Quality classifier by importance resampling: how much likelier a document is under a hashed n-gram model of trusted
documents than under one of the raw corpus, and a Gumbel top-k sample of the documents by that weight.

Words and word pairs fall into two tables of fixed size by hash. Adding Gumbel noise (a hash of the id) to the log weights
over a temperature and taking the largest k draws without replacement in proportion to the tempered weights.

The plain form is the sum over words and pairs (per_word=False) of all log ratios (least=(0, 0)) at temperature 1. The
defaults depart from it, for what they were measured to do (README): ratios near 1 count as 1, as most buckets differ
between the two models by chance and drown the few words that tell documents apart; the sum is taken for each word; a cut
on held-out labelled rows says how many documents to draw, and sets the temperature: a median trusted document weighs
e^MARGIN times one on the cut.

Scale: no text is shuffled, unless there are more than BROADCAST_LABELS labelled ids. Each task counts in arrays of fixed size and sends them compressed; they are added up in
PARTS tasks as they stream by. What is broadcast is the table of ratios (2 * SLOTS floats) and at most BROADCAST_LABELS ids,
whatever the corpus. The k-th largest key is found from counts by bin, never by gathering keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_but, documents, mapped, quoted, table, written
from .encoding import slices
from .ngram_lm import beside, best_cut, labelled_sample

#: Buckets of words, and as many of word pairs; the counters travel in so many parts.
SLOTS, PARTS = 1 << 20, 32
#: Added to the observed and to the expected count of a bucket, and the least |ln ratio| that counts; words, pairs.
PRIORS, LEAST = (3.0, 10.0), (1.0, 0.5)
#: Nats between a document on the cut and the median trusted one.
MARGIN = 12.0
#: Distinct words whose hashes a task remembers; it starts anew beyond.
KNOWN = 100_000
BINS = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hasher() -> Callable[[str | None], np.ndarray]:
    """hashes(text): one of each word `[^\\x20\\x09-\\x0D]+`; none for null."""
    known: dict[bytes, int] = {}

    def hashes(text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").split() if text else []
        if new := set(words).difference(known):
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return hashes


def slots_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and of each pair of neighbours (SLOTS and up)."""
    two = (h[:-1] * _ODD) ^ (h[1:] >> np.uint64(3))
    two = (two * _ODD) >> np.uint64(24)
    size = np.uint64(SLOTS)
    return (h % size).astype(np.int64), (two % size + size).astype(np.int64)


def gram_counts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all documents, and of the trusted ones of fold 0, by bucket."""
    fit = sample.where(F.col("__good") & (F.col("__fold") == 0)).select("__id", F.lit(True).alias("__fit"))
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).cast("string").alias("__text")).join(beside(fit), "__id", "left").select("__text", "__fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, both = hasher(), np.zeros((2, 2 * SLOTS), np.uint32)
        for batch in slices(batches):
            grams: tuple[list, list] = ([], [])
            for text, fits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashes(text)
                grams[bool(fits)].extend(slots_of(h))
            for row, found in zip(both, ([*grams[0], *grams[1]], grams[1]), strict=True):
                if found:
                    at, n = np.unique(np.concatenate(found), return_counts=True)
                    row[at] += n.astype(np.uint32)
        shrink, width = zstandard.ZstdCompressor(level=1), 2 * SLOTS // PARTS
        for k in range(PARTS):
            yield pa.RecordBatch.from_pylist([{"part": k, "counts": shrink.compress(np.ascontiguousarray(both[:, k * width : (k + 1) * width]).tobytes())}], _PART)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint32).astype(np.int64)
        for k, x in total.items():
            yield pa.RecordBatch.from_pylist([{"part": k, "counts": x.tobytes()}], _PART)

    parts = rows.mapInArrow(count, "part int, counts binary").repartition(PARTS, "part").mapInArrow(add, "part int, counts binary")
    width, both = 2 * SLOTS // PARTS, np.zeros((2, 2 * SLOTS), np.int64)
    for x in parts.collect():  # PARTS rows of fixed size
        both[:, x["part"] * width : (x["part"] + 1) * width] = np.frombuffer(x["counts"], np.int64).reshape(2, width)
    return both[0], both[1]


_PART = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def log_ratios(raw: np.ndarray, target: np.ndarray, least: tuple[float, float] = LEAST) -> np.ndarray:
    """ln(target / raw) by bucket; 0 where it is nearer to 0 than least (words, pairs), and everywhere if there is no target."""
    out = np.zeros(2 * SLOTS, np.float32)
    for k, (prior, near) in enumerate(zip(PRIORS, least, strict=True)):
        of = slice(k * SLOTS, (k + 1) * SLOTS)
        if total := target[of].sum():
            r = np.log((target[of] + prior) / (raw[of] * (total / raw[of].sum()) + prior))
            out[of] = np.where(np.abs(r) < near, 0, r)
    return out


def gumbel(doc: int | None, text: str | None, seed: int) -> float:
    """Gumbel noise from a hash of the id, or of the text where there is none."""
    h = xxhash.xxh64_intdigest(repr(doc).encode() if doc is not None else (text or "").encode("utf-8", "replace"), seed)
    return float(-np.log(-np.log((h + 0.5) / 2.0**64)))


def score_documents(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, seed: int = 0, per_word: bool = True) -> DataFrame:
    """All columns of docs and the struct `resample` (n_words, score, noise). score: nats, for each word if per_word; 0 without words."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    own = docs.select(*columns_but(docs, "resample"))
    rest = own.columns
    kind = T.StructType().add("n_words", "long").add("score", "double").add("noise", "double")
    arrow = pa.struct([("n_words", pa.int64()), ("score", pa.float64()), ("noise", pa.float64())])
    doc_at, text_at = rest.index(id_col), rest.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table_ = hasher(), sent.value
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column(doc_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
                h = hashes(text)
                one, two = slots_of(h)
                total = float(table_[one].sum(dtype=np.float64) + table_[two].sum(dtype=np.float64))
                out.append({"n_words": len(h), "score": total / max(1, len(h)) if per_word else total, "noise": gumbel(doc, text, seed)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "resample"])

    return mapped(own, score, "resample", kind)


def kth_largest(keys: DataFrame, key: str, k: int) -> float:
    """The k-th largest of a column of doubles (not null), by counting bins and narrowing to the one that holds it."""
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n or low is None:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while (width := (high - low) / BINS) > 0:
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        bins = keys.where(F.col(key).between(low, high)).groupBy(at.alias("bin")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
        for x in sorted(bins.collect(), key=lambda x: -x["bin"]):  # BINS rows
            if k <= x["n"]:
                low, high = x["lo"], x["hi"]
                break
            k -= x["n"]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, keep: float = 0.99, seed: int = 0, least: tuple[float, float] = LEAST, per_word: bool = True, temperature: float | None = None) -> DataFrame:
    """All columns of docs and the struct `resample` (n_words, score, key, kept). key: score / temperature + Gumbel noise.

    labels: id, quality, toxic; trusted is quality 1 and not toxic. The models are fitted on all documents, and on the
    trusted ones of one half of the labelled rows; the other half sets the cut, so that at least the share keep of
    its trusted rows is above. k: how many rows to draw; as many as reach the cut if None. Rows with equal keys (such as
    repeated rows) are kept or dropped together, so that a few more than k may stay. A text without words (null, empty)
    scores 0. Without usable labels all weights are equal, and all rows stay unless k says otherwise. An empty table
    gives an empty one. An own column named `resample` is replaced.
    """
    sample = written(labelled_sample(labels, (F.col("quality") == 1) & (F.col("toxic") == 0)), "sample")
    ratios = log_ratios(*gram_counts(docs, sample, id_col, text_col), least)
    held = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text")).join(beside(sample.where("__fold = 1")), "__id")
    held = score_documents(held.select("__id", "__text", "__good"), ratios, "__id", "__text", per_word=per_word).select("__good", (F.col("resample.score") * 1e3).alias("s"))
    held = written(held, "held")  # its texts are scored once
    cut, middle = best_cut(held, "__good", "s", keep).first()["cut"], held.where("__good").agg(F.median("s")).first()[0]
    scale = 1 / temperature if temperature else MARGIN / (middle - cut) * 1e3 if cut is not None and middle > cut else 0.0
    cut = cut / 1e3 if cut is not None else float("-inf")
    scored = score_documents(docs, ratios, id_col, text_col, seed, per_word)
    r = F.col("resample")
    key = (r["score"] * F.lit(scale) + r["noise"]).alias("key")
    keys = written(scored.select(r["score"].alias("score"), key), "keys")
    least = kth_largest(keys, "key", keys.where(F.col("score") >= cut).count() if k is None else k)
    fields = F.struct(r["n_words"].alias("n_words"), r["score"].alias("score"), key, (key >= least).alias("kept"))
    return scored.withColumn("resample", fields)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"resample.{c}").alias(c) for c in ("n_words", "score", "key", "kept")])
