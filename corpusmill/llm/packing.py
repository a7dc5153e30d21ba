"""Packing: sequences of at most 4096 tokens, planned on the histogram of lengths.

Each document is cut into full windows and a rest. Shallow combinations of lengths that fill a window (some pieces of one
length and one of another) are enumerated, non-negative least squares finds how often each is repeated so that together
they use up the histogram, the counts are rounded down, and what is left over is packed greedily, longest first.

Scale: the plan depends on the histogram alone, which has SIZE numbers whatever the corpus; so does its size. A piece
finds its place from its length and its rank among the pieces of that length. Ranks are counted in two steps (within the
task that cut the piece, then by task and length), so that a length that a third of all pieces have is never gathered.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, quoted, written
from .encoding import END_ID, encoder, slices, tokenizer_path

SIZE = 4096
#: Pieces of the first length in a combination, at most.
DEPTH = 16
STEPS = 400


def combinations(counts: np.ndarray, size: int = SIZE, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(a, i, b): i pieces of length a and one of length b fill a window; b 0: a alone. Only lengths that occur."""
    out = []
    for a in np.flatnonzero(counts[:size]).tolist():
        for i in range(1, min(depth, size // a) + 1):
            b = size - i * a
            if b == 0 or b != a and counts[b] and (i > 1 or a < b):
                out.append((a, i, b))
    return out


def nonnegative_least_squares(columns: list[tuple[int, int, int]], counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with the least |A x - counts|^2, by accelerated projected gradients. Column (a, i, b) has i at a and 1 at b."""
    a, i, b = (np.array(c) for c in zip(*columns, strict=True))
    one = (b > 0).astype(float)
    apply = lambda x: np.bincount(a, i * x, len(counts)) + np.bincount(b, one * x, len(counts))
    back = lambda r: i * r[a] + one * r[b]
    v = np.ones(len(a))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(apply(v))))
    x = y = np.zeros(len(a))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(apply(y) - counts))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(repeats, pieces of each length) of sequences, which use up the histogram exactly."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = [(int(counts[size]), {size: 1})] if counts[size] else []
    left = counts.copy()
    left[size] = left[0] = 0
    if columns := combinations(left, size):
        x = np.floor(nonnegative_least_squares(columns, left[:size].astype(float))).astype(np.int64)
        for k in np.argsort(-x, kind="stable").tolist():
            a, i, b = columns[k]
            n = min(int(x[k]), int(left[a]) // i, int(left[b]) if b else int(x[k]))
            if n > 0:
                out.append((n, {a: i} | ({b: 1} if b else {})))
                left[a] -= n * i
                left[b] -= n * bool(b)
    lengths = np.flatnonzero(left).tolist()
    while lengths:
        room, used, top = size, {}, len(lengths)
        while top and (top := bisect_right(lengths, room, 0, top)):
            length = lengths[top - 1]
            used[length] = min(room // length, int(left[length]))
            room -= used[length] * length
            top -= 1
        n = min(int(left[k]) // m for k, m in used.items())
        out.append((n, used))
        for k, m in used.items():
            left[k] -= n * m
        lengths = [k for k in lengths if left[k]]
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """The plan by (length, first rank), ordered: key, first rank, first sequence, pieces in a sequence, first offset."""
    rows, ranks, sequence = [], {}, 0
    for n, used in patterns:
        offset = 0
        for length, m in used.items():
            lo = ranks.get(length, 0)
            rows.append(((length << 44) + lo, lo, sequence, m, offset))
            ranks[length] = lo + n * m
            offset += length * m
        sequence += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


def cut_pieces(docs: DataFrame, tokenizer: str, spaces: bool, id_col: str, text_col: str, size: int = SIZE, special: bool = True) -> DataFrame:
    """Full windows and the rest of each document's ids and END_ID, as a written table."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {PIECE}"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, spaces, special), TaskContext.get().partitionId()
        ranks, end = [0] * (size + 1), struct.pack("<I", END_ID)
        for batch in slices(batches):
            rows: list[tuple] = []
            for k, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[at * 4 : (at + size) * 4]
                    length = len(piece) // 4
                    rows.append((k, at, length, zlib.crc32(piece), n, part, ranks[length]))
                    ranks[length] += 1
            index, *columns = zip(*rows, strict=True)
            docs_ = batch.column(0).take(pa.array(index, pa.int64()))
            arrays = [docs_, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    return written(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(cut, schema), "pieces")


def pack(docs: DataFrame, tokenizer: str, spaces: bool = False, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, special: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document (its text's ids, then END_ID) is in exactly one piece; null text counts as empty, so it is
    END_ID alone. Repeated rows and rows that share an id or have none are documents of their own. An empty table gives
    no pieces. Other columns of docs are not looked at. special: as in encoder().
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer, spaces, id_col, text_col, size, special)
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = written(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = {x["length"]: x["n"] for x in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    sent = spark.sparkContext.broadcast(places(plan(histogram, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, los, sequences, per, offsets = sent.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), pc.add(batch["base"], batch["rank"]).to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence, slot = np.divmod(rank - los[k], per[k])
            new = [pa.array(sequences[k] + sequence), pa.array(offsets[k] + slot * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    # The table grows with the tasks, so it is not broadcast; the pieces are small rows, and (task, length) has few of them.
    based = pieces.join(by_task.select("part", "length", "base").hint("merge"), ["part", "length"])
    based = based.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "base", "rank")
    return based.mapInArrow(place, f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
