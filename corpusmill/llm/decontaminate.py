"""Benchmark decontamination: document words inside any ten-word window of a benchmark item.

The normalised windows of the benchmark are broadcast as a set of hashes; each document's windows are looked up, hits are
verified word for word, and hit spans or whole documents are removed.

Scale: documents are never shuffled; each is scanned where it is read. What is broadcast is bounded: the benchmark's size
is measured first, and one larger than BLOCK_BYTES is split by item into blocks, of which one is gathered and broadcast at
a time, in a pass of its own over all documents (a stated query set against all rows, in blocks). A pass after the first
reads what the last one wrote: the rows with the words that were hit and the items that were found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_but, documents, mapped, quoted, table, unused, written

WINDOW = 10
#: Benchmark text in one broadcast block; a worker needs about a hundred bytes for each.
BLOCK_BYTES = 1 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased, as UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def windows_of(items: list[tuple[str | None, list[bytes]]], size: int = WINDOW) -> tuple[dict, dict, dict]:
    """Of a block of items: a number for each word, the items of each window, and by length the sorted window hashes."""
    ids: dict[bytes, int] = {}
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in items:
        n = min(size, len(words))
        for i in range(len(words) - n + 1) if n else ():
            at = owners.setdefault(tuple(words[i : i + n]), set())
            if item is not None:
                at.add(item)
        for w in words:
            ids.setdefault(w, len(ids) + 1)
    by: dict[int, set[int]] = {}
    for w in owners:
        by.setdefault(len(w), set()).add(int(_hashes(np.array([ids[x] for x in w], np.uint64), len(w))[0]))
    return ids, owners, {n: np.array(sorted(x), np.uint64) for n, x in sorted(by.items())}


def scan_windows(block: tuple[dict, dict, dict], words: list[bytes], hit: np.ndarray, found: set[str]) -> None:
    """Marks the words that are hit and adds the items of the windows that occur."""
    numbers, owners, by_length = block
    ids = np.fromiter(map(numbers.get, words, repeat(0)), np.uint64, len(words))
    for n, hashes in by_length.items():
        if len(ids) < n:
            continue
        inside = np.concatenate(([0], np.cumsum(ids != 0)))
        starts = np.flatnonzero(inside[n:] - inside[:-n] == n)  # only words of the benchmark
        if not len(starts):
            continue
        h = _hashes(ids, n)[starts]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for i in starts[hashes[at] == h].tolist():
            items = owners.get(tuple(words[i : i + n]))
            if items is not None:
                hit[i : i + n] = True
                found |= items


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n ids in a row."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[tuple[dict, dict, dict], bool]]:
    """The benchmark in blocks of about block_bytes of text, each gathered when it is asked for, and whether it is the last."""
    items = benchmark.select(F.col(quoted(id_col)).cast("string").alias("item"), F.col(quoted(text_col)).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    for k in range(n):
        yield windows_of([(x["item"], words_of(x["text"])) for x in items.where(part == k).collect()]), k == n - 1


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, mask: bool = False) -> DataFrame:
    """All columns of docs and the struct `contamination` (n_words, n_hit, n_items, items, clean_text).

    items: the ids of the items with a window that occurs, as strings in order, comma-joined. clean_text, only if mask:
    the text without the characters from the first to the last word of each run of hit words. Null text has no words.
    An item without words has no window; items that share an id count once; an item without an id marks words but is not
    listed. Rows are looked at one by one: repeated rows repeat their result, empty tables give an empty or clean one.
    An own column named `contamination` is replaced.
    """
    out = docs.select(*columns_but(docs, "contamination"))
    n, at = len(out.columns), out.columns.index(text_col)
    final = T.StructType().add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items", "string").add("clean_text", "string")
    so_far = T.StructType().add("hit", "binary").add("found", T.ArrayType(T.StringType()))

    def scan(block, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                before = [None] * batch.num_rows if first else batch.column(n).to_pylist()
                for text, old in zip(batch.column(at).to_pylist(), before, strict=True):
                    words = words_of(text)
                    hit, found = (np.zeros(len(words), bool), set()) if first else (np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=len(words)).astype(bool), set(old["found"]))
                    scan_windows(block.value, words, hit, found)
                    if last:
                        clean = (without(text, hit) if hit.any() else text) if mask else None
                        rows.append({"n_words": len(words), "n_hit": int(hit.sum()), "n_items": len(found), "items": ",".join(sorted(found)), "clean_text": clean})
                    else:
                        rows.append({"hit": np.packbits(hit).tobytes(), "found": sorted(found)})
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _FINAL if last else _SO_FAR)], names=[*batch.schema.names, new])

        return run

    first, (new,) = True, unused(docs, "next")
    for block, last in blocks_of(benchmark, item_col, item_text, block_bytes):
        run = scan(docs.sparkSession.sparkContext.broadcast(block), first, last)
        out = mapped(out, run, new, final if last else so_far)
        out = out.select(*columns_but(docs, "contamination"), F.col(new).alias("contamination"))
        if not last:
            out, first = written(out, "scanned"), False
    return out


_FINAL = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.string()), ("clean_text", pa.string())])
_SO_FAR = pa.struct([("hit", pa.binary()), ("found", pa.list_(pa.string()))])


def without(text: str, hit: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each run of hit words."""
    raw = text.encode("utf-8", "replace")
    place = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], place.view(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        out.append(raw[at : starts[a]])
        at = stops[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return out.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), c["n_items"].alias("n_items"), F.sha2(c["items"], 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))
