"""Corpus preparation: noise, rules, incremental skipping, chunks, duplicates, redaction."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash

# Lines of chat that say nothing.
NOISE_LINES = [
    r"^(收到|好的|OK|ok|嗯|嗯嗯|哈哈|👍|666|赞|了解|明白|知道了|谢谢|感谢|辛苦了?)$",
    r"^(早|早上好|早安|下午好|晚上好|下班了?)$",
    r"^[\x{1F300}-\x{1FAFF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}]+$",
    r"^@\S+\s*(收到|好的|OK|ok)$",
    r"^(来了|马上到|在路上|马上|等一下|稍等)$",
    r"^(走|吃饭|走吧|去吃饭|午饭|晚饭).*$",
    r"^\+1$",
]


def is_noise(line: Column) -> Column:
    """A line of chat without content: a stock phrase, or at most three characters and no digit; its sender is cut off."""
    said = F.trim(F.regexp_replace(F.trim(line), r"^\[[\d:]+\]\s*\S+:\s*(?=.)", ""))
    stock = F.regexp_like(said, F.lit("|".join(NOISE_LINES)))
    return (said == "") | stock | ((F.length(said) <= 3) & ~F.regexp_like(said, F.lit(r"\d")))


def noise_ratio(text: Column) -> Column:
    """The share of noise among lines that aren't blank; 1 if there are none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.round(F.try_divide(F.size(F.filter(lines, is_noise)).cast("double"), F.size(lines).cast("double")), 4), F.lit(1.0))


def is_noise_document(title: Column, text: Column, most: float = 0.7) -> Column:
    """A chat, by its title, of which so much is noise."""
    low = F.lower(F.coalesce(title, F.lit("")))
    chat = F.contains(low, F.lit("聊天")) | F.contains(low, F.lit("群聊")) | F.contains(low, F.lit("chat"))
    return chat & (noise_ratio(text) >= most)


def mentions_any(title: Column, text: Column, words: list[str], first: int = 500) -> Column:
    """Whether one of the words is in the title or the text's beginning, in lower case."""
    start = F.lower(F.concat_ws(" ", title, F.left(text, F.lit(first))))
    return reduce(lambda a, b: a | b, [F.contains(start, F.lit(w)) for w in words], F.lit(False))


def missing_facets(facets: Column, required: list[str]) -> Column:
    """The required keys that a map of facets lacks, or has as null or ''."""
    return F.filter(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.try_element_at(facets, k), F.lit("")) == "")


def query_events(rows: DataFrame) -> DataFrame:
    """Rows of a query log as they are kept: query_text cut at 200, hit by the number of sources where unknown, no negative
    latency_ms, 50 doc_ids of 80 characters."""
    ids = F.transform(F.slice(F.coalesce("doc_ids", F.array().cast("array<string>")), 1, 50), lambda i: F.left(i, F.lit(80)))
    return rows.withColumns({"query_text": F.left("query_text", F.lit(200)), "hit": F.coalesce("hit", F.col("sources") > 0), "latency_ms": F.greatest(F.lit(0), F.col("latency_ms")), "doc_ids": ids})


def infer_domain(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, domain_id, hits, confidence: the best rule (domain_id, priority, keywords) of which a keyword is contained.

    By priority, then hits, then domain_id. A document without one is pending with confidence 0. The rules, a table of
    some hundred rows, are one broadcast array, so texts are looked at where they are read.
    """
    packed = rules.agg(F.collect_list(F.struct("domain_id", "priority", "keywords")).alias("rules"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def rated(r: Column) -> Column:
        words = F.filter(r["keywords"], lambda w: w != "")
        hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
        return F.struct((-r["priority"]).alias("p"), (-hits).alias("h"), r["domain_id"].alias("domain_id"), F.size(r["keywords"]).alias("n"))

    best = F.array_min(F.filter(F.transform("rules", rated), lambda x: x["h"] < 0))
    out = docs.join(F.broadcast(packed)).select(F.col(id_col), best.alias("b"))
    confidence = F.round(F.least(-F.col("b.h") / F.greatest(F.col("b.n"), F.lit(1)), F.lit(1.0)), 3)
    return out.select(id_col, F.coalesce("b.domain_id", F.lit("pending")).alias("domain_id"), F.coalesce(-F.col("b.h"), F.lit(0)).cast("long").alias("hits"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def incremental_plan(chunks: DataFrame, stored: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, hash, action: `new`, `changed`, `empty` (always done again) or `same` against the stored (key, hash)."""
    now = chunks.select(key, content_hash(F.col(text_col)).alias("hash"))
    both = now.join(stored.select(key, F.col("hash").alias("old")), key, "left")
    action = F.when(F.col("hash") == "", "empty").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("hash"), "changed").otherwise("same")
    return both.select(key, "hash", action.alias("action"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per content that several documents hold: hash, first, n."""
    rows = docs.select(F.col(id_col).alias("id"), content_hash(F.col(text_col)).alias("hash")).where("hash <> ''")
    return rows.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


def duplicate_titles(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """id, first, n of rows whose normalised title another row with a smaller id has."""
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and key <> ''")
    return keyed.join(first, "key").where("id <> first").select("id", "first", "n")


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, start, content: sliding windows; also after the last full one a tail that repeats the overlap."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    text, step = F.coalesce(F.col(text_col), F.lit("")), size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step) * step, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    rows = docs.select(F.col(id_col), F.col(text_col), F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), "start", F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)).alias("content"))


# Where a chunk may end, in order of preference.
ENDS = ["。", "！", "？", ".", "!", "?", "\n"]


def window_cutter(size: int, overlap: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    """From a text to the windows (from, until) of boundary_chunks, blank ones too."""
    near = min(size // 5, 100)
    if overlap >= size - near:
        raise ValueError("overlap must be less than the shortest window")
    find = re.compile("|".join(map(re.escape, ENDS)))

    def windows(text: str) -> Iterator[tuple[int, int]]:
        places = {mark: [] for mark in ENDS}
        for m in find.finditer(text):
            places[m.group()].append(m.end())
        start = 0
        while start < len(text):
            until = start + size
            if until < len(text):
                last = [at[k - 1] for at in places.values() if (k := bisect_right(at, until)) and at[k - 1] > until - near + 1]
                until = last[0] if last else until
            yield start, until
            start = until - overlap

    return windows


def boundary_chunks(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, start, content: as fixed_chunks, but a window ends after a mark in its last fifth (100 characters at most).

    Of the marks found there the most preferred counts, at its last place. Blank windows are left out. Windows stay longer
    than the overlap, so size / 5 and the overlap must leave room. Where a window ends depends on the one before, so texts
    are cut in Arrow batches: the places of all marks are listed in one pass, and each window looks its end up in them.
    """
    windows = window_cutter(size, overlap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                kept = [(a, text[a:b]) for a, b in windows(text or "") if text[a:b].strip()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("id")[i].as_py()] * len(kept), batch.schema.field("id").type), pa.array(range(len(kept)), pa.int64()), pa.array([a for a, _ in kept], pa.int64()), pa.array([c for _, c in kept], pa.string())], ["id", "chunk_index", "start", "content"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {id_type}, chunk_index long, start long, content string")
    return rows.withColumnRenamed("id", id_col)


def with_boundary_texts(docs: DataFrame, name: str, size: int = 500, overlap: int = 100, text_col: str = "text") -> DataFrame:
    """docs with the array `name`: the contents of boundary_chunks, in order, beside the columns of the row they come from."""
    windows, at = window_cutter(size, overlap), docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch = whole.slice(a, 500)
                kept = [[t[a:b] for a, b in windows(t or "") if t[a:b].strip()] for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(pa.string()))], [*batch.schema.names, name])

    return docs.mapInArrow(cut, T.StructType([*docs.schema, T.StructField(name, T.ArrayType(T.StringType()))]))


def context_windows(chunks: DataFrame, doc: str, index: str, text_col: str, n: int = 2, most: int = 1500) -> DataFrame:
    """Each chunk with up to n neighbours on either side, joined by blank lines and cut."""
    near = Window.partitionBy(doc).orderBy(index).rowsBetween(-n, n)
    return chunks.withColumn("context", F.left(F.array_join(F.collect_list(text_col).over(near), "\n\n"), F.lit(most)))


def score_groups(members: DataFrame, key: str, value: Column) -> DataFrame:
    """One audit value for each group of at least two members, given back to all of them."""
    groups = members.groupBy(key).agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    return members.join(groups.select(key, "n_docs", value.alias("overlap")), key, "left").fillna(0.0, ["overlap"])
