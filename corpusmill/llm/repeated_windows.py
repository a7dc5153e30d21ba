"""Substring dedup by super-k-mers: every word covered by a 35-word window that also starts anywhere else is removed.

The minimiser of a window is the smallest hash of the 4-word strings in it. Consecutive windows sharing one travel as one
string, a super-k-mer, to the bucket of that minimiser; equal windows have equal minimisers, so they meet there. A bucket
sorts its windows, compares neighbours of equal hash word by word, and so counts them exactly. Only the marks of repeated
windows go back.

Scale: texts are gathered in packs of about PACK_BYTES, compressed, and written once. A pack sends each distinct string
once, with whether it holds it several times, so that a passage that a third of all documents share is one entry from
each pack. Buckets hold about BUCKET_WINDOWS windows whatever the corpus (their number grows). Minimisers whose windows
would fill a large part of a bucket (a common phrase in differing surroundings, or a passage of very many packs) are found
by a count beforehand; their windows don't go to buckets but are counted by a Spark aggregate over the windows
themselves, whose partial counts take any number of equal ones, and the marks come back by a join that adaptive execution
splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, quoted, written
from .substring_dedup import _bucketwise, _by_bucket, _in, _pack, _unpack

WINDOW = 35
#: Words of the strings whose smallest hash is a window's minimiser; a window has 32 of them, a power of two.
GRAM = 4
GRAMS = WINDOW - GRAM + 1
PACK_BYTES, PACK_DOCS, BUCKET_WINDOWS = 2 << 20, 50_000, 500_000
#: Windows of a super-k-mer at most.
LONGEST = 4096
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _MIX[2]
    x ^= x >> np.uint64(32)
    return x


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each word of raw, whose words are joined by one space."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    begin, end = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
    length = end - begin
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each position on
    h = (eight[begin] & _MASKS[np.minimum(length, 8)]) * _MIX[0]
    h += length.astype(np.uint64)
    h = _mixed(h)
    for at in range(8, LONG_WORD, 8):
        more = np.flatnonzero(length > at)
        if not len(more):
            break
        h[more] = _mixed(h[more] * _MIX[1] + (eight[begin[more] + at] & _MASKS[np.minimum(length[more] - at, 8)]))
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(raw[begin[k] : end[k]], digest_size=8).digest(), "little")
    return begin, end, h


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of strings made of two parts; arrays are cut to the shorter."""
    n = min(len(left), len(right))
    return _mixed(left[:n] * _MIX[0] + right[:n] * _MIX[1])


def minimisers(h: np.ndarray) -> np.ndarray:
    """The minimiser of each window of the words with these hashes."""
    two = _joined(h, h[1:])
    low = _joined(two, two[2:])
    width = 1
    while width < GRAMS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return low


def window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each window's 35 words."""
    by = {1: h}
    for n in (1, 2, 4, 8, 16):
        by[2 * n] = _joined(by[n], by[n][n:])
    return _joined(_joined(by[32], by[2][32:]), h[34:])


def super_kmers(h: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer. n_words: words of each document; windows never cross documents."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = minimisers(h)
    end = np.cumsum(n_words)
    inside = np.zeros(len(low) + 1, np.int32)
    long = n_words >= WINDOW
    inside[(end - n_words)[long]] += 1
    inside[(end - WINDOW + 1)[long]] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    new[(end - n_words)[long]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(low)))
    keep = inside[first]
    first, count, low = first[keep], count[keep], low[first[keep]]
    times = -(-count // LONGEST)
    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    first, low, count = np.repeat(first, times) + part * LONGEST, np.repeat(low, times), np.minimum(np.repeat(count, times) - part * LONGEST, LONGEST)
    return first, count, low


class Pack:
    """The documents of a pack and their super-k-mers; windows of hot minimisers stand alone, after the others.

    first, count, number: each occurrence, and the number of its distinct string. strings, minimum, several: of each
    distinct string its bytes, its minimiser and whether the pack holds it more than once; from `cold` on they are hot
    windows.
    """

    def __init__(self, blob: bytes, hot: list[int] | None = None):
        ids, known, n_words, raw = _unpack(blob)
        self.ids, self.known = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8)
        self.n_words, self.raw = np.frombuffer(n_words, "<u4").astype(np.int64), bytes(raw)
        self.begin, self.end, self.h = word_hashes(self.raw)
        first, count, low = super_kmers(self.h, self.n_words)
        alone = _in(low, np.sort(np.array(hot or [], np.int64).view(np.uint64)))
        times = count[alone]
        ahead = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.first = np.concatenate((first[~alone], np.repeat(first[alone], times) + ahead))
        self.count = np.concatenate((count[~alone], np.ones(times.sum(), np.int64)))
        low = np.concatenate((low[~alone], np.repeat(low[alone], times)))
        raw, seen = self.raw, {}
        spans = zip(self.begin[self.first].tolist(), self.end[self.first + self.count + WINDOW - 2].tolist(), strict=True)
        self.number = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in spans), np.int64, len(self.first))
        at = np.unique(self.number, return_index=True)[1]
        self.strings, self.minimum, self.windows = list(seen), low[at], self.count[at]
        self.several = np.bincount(self.number, minlength=len(seen)) > 1
        self.cold = int(np.searchsorted(at, (~alone).sum()))


def make_packs(docs: DataFrame, id_col: str, text_col: str, pack_bytes: int) -> DataFrame:
    """pack, n_windows, body (compressed ids, numbers of words, words joined by one space), as a written table."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        counts: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            n = np.array(counts, np.int64)
            body = _pack(np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8), n.astype("<u4"), b" ".join(t for t in texts if t))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([int(np.maximum(n - WINDOW + 1, 0).sum())]), pa.array([body], pa.binary())], names=["pack", "n_windows", "body"])

        for batch in batches:
            values = batch.column(1).cast(pa.large_binary())
            for k, doc in enumerate(batch.column(0).to_pylist()):
                words = (values[k].as_py() or b"").split()  # bytes are split at ASCII white space
                ids.append(doc)
                counts.append(len(words))
                texts.append(b" ".join(words))
                size += len(texts[-1])
                if size >= pack_bytes or len(ids) >= PACK_DOCS:
                    yield row()
                    made, ids, counts, texts, size = made + 1, [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return written(rows.mapInArrow(gather, "pack long, n_windows long, body binary"), "packs")


def minimiser_windows(packs: DataFrame) -> DataFrame:
    """pack, minimum, windows: of each minimiser of a pack the windows of its distinct strings."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Pack(blob.as_py())
                low, of = np.unique(own.minimum, return_inverse=True)
                windows = np.bincount(of, own.windows, len(low)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), pack)), pa.array(low.view(np.int64)), pa.array(windows)], names=["pack", "minimum", "windows"])

    return packs.select("pack", "body").mapInArrow(send, "pack long, minimum long, windows int")


def send_strings(packs: DataFrame, buckets: int) -> DataFrame:
    """bucket, pack, body (number, whether several, bytes and windows of each distinct string, and the strings). packs: pack, body, hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob, hot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own, rows = Pack(blob.as_py(), hot), []
                for bucket, mine in _by_bucket(own.minimum[: own.cold], buckets):
                    strings = [own.strings[i] for i in mine.tolist()]
                    rows.append((bucket, _pack(mine.astype("<u4"), own.several[mine].astype(np.uint8), np.array([len(s) for s in strings], "<u4"), own.windows[mine].astype("<u4"), b"".join(strings))))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([pack] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["bucket", "pack", "body"])

    return packs.select("pack", "body", "hot").mapInArrow(send, "bucket long, pack long, body binary")


def repeated_in(strings: list[bytes], windows: np.ndarray, again: np.ndarray) -> np.ndarray:
    """For each window of distinct strings, one string after the other: whether it stands elsewhere. again: whether the whole string does."""
    raw = b" ".join(strings)
    begin, end, h = word_hashes(raw)
    n_words = windows + WINDOW - 1
    ahead = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(n_words) - n_words, windows) + ahead
    prints = window_hashes(h)[at]
    order = np.argsort(prints, kind="stable")
    hit = np.repeat(again, windows)
    left, right = begin[at], end[at + WINDOW - 1]
    equal = np.flatnonzero(prints[order][1:] == prints[order][:-1])
    chance = set()
    for x, y in zip(order[equal].tolist(), order[equal + 1].tolist(), strict=True):
        if raw[left[x] : right[x]] == raw[left[y] : right[y]]:
            hit[x] = hit[y] = True
        else:
            chance.add(int(prints[x]))
    for p in chance:  # different windows of one hash
        seen: dict[bytes, int] = {}
        for x in np.flatnonzero(prints == np.uint64(p)).tolist():
            y = seen.setdefault(raw[left[x] : right[x]], x)
            if y != x:
                hit[x] = hit[y] = True
    return hit


def _expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers lo to hi - 1 of each pair, and the place of the pair."""
    times = hi - lo
    return np.arange(times.sum()) + np.repeat(lo - (np.cumsum(times) - times), times), np.repeat(np.arange(len(lo)), times)


def count_bucket(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """(pack, marks: number of the string, first and number of windows, of each stretch of repeated windows)."""
    seen: dict[bytes, int] = {}
    number, string, owner, several, windows = [], [], [], [], []
    for k, (_, blob) in enumerate(rows):
        a, b, c, d, raw = _unpack(blob)
        ends = np.cumsum(np.frombuffer(c, "<u4"), dtype=np.int64)
        number.append(np.frombuffer(a, "<u4").astype(np.int64))
        several.append(np.frombuffer(b, np.uint8))
        windows.append(np.frombuffer(d, "<u4").astype(np.int64))
        string.append(np.array([seen.setdefault(bytes(raw[x:y]), len(seen)) for x, y in zip((ends - np.frombuffer(c, "<u4")).tolist(), ends.tolist(), strict=True)], np.int64))
        owner.append(np.full(len(ends), k))
    number, string, owner, several, windows = map(np.concatenate, (number, string, owner, several, windows))
    times = np.bincount(string, several + 1.0, len(seen))
    size = np.zeros(len(seen), np.int64)
    size[string] = windows
    hit = repeated_in(list(seen), size, times > 1)
    of = np.repeat(np.arange(len(seen)), size)
    less = np.flatnonzero(hit)
    if not len(less):
        return []
    new = np.flatnonzero((np.diff(less, prepend=-2) != 1) | (np.diff(of[less], prepend=-1) != 0))
    count, run_of = np.diff(np.append(new, len(less))), of[less[new]]
    offset = less[new] - (np.cumsum(size) - size)[run_of]
    run, entry = _expanded(np.searchsorted(run_of, string), np.searchsorted(run_of, string, side="right"))
    out, edges = [], np.searchsorted(owner[entry], np.arange(len(rows) + 1))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            out.append((rows[k][0], _pack(number[entry[a:b]].astype("<u4"), offset[run[a:b]].astype("<u4"), count[run[a:b]].astype("<u4"))))
    return out


def count_strings(sent: DataFrame) -> DataFrame:
    """pack, marks."""

    def count(_: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        marks = count_bucket(rows)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.binary())], names=["pack", "marks"])

    return _bucketwise(sent, "bucket", count, "pack long, marks binary")


def hot_windows(packs: DataFrame) -> DataFrame:
    """pack, window (its words), number, times (2 if the pack holds it several times, else 1) of the windows of hot minimisers. packs: pack, body, hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob, hot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = Pack(blob.as_py(), hot)
                for a in range(own.cold, len(own.strings), 10_000):
                    some = own.strings[a : a + 10_000]
                    numbers = np.arange(a, a + len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), pack)), pa.array(some, pa.binary()), pa.array(numbers), pa.array(own.several[numbers].astype(np.int32) + 1)], names=["pack", "window", "number", "times"])

    return packs.where("hot is not null").select("pack", "body", "hot").mapInArrow(send, "pack long, window binary, number long, times int")


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_marked(packs: DataFrame, with_kept: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept. packs: pack, body, hot, marks, numbers (of repeated hot windows)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, hot, marks, numbers in zip(batch.column(0), *[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                yield _removed(Pack(body.as_py(), hot), marks or [], numbers or [], with_kept)

    return packs.select("body", "hot", "marks", "numbers").mapInArrow(remove, _OUT)


def _removed(pack: Pack, marks: list[bytes], numbers: list[int], with_kept: bool) -> pa.RecordBatch:
    told = [[np.frombuffer(x, "<u4").astype(np.int64) for x in _unpack(m)] for m in marks]
    hot = np.array(numbers, np.int64)
    of, offset, n = (np.concatenate(x) for x in zip(*told, (hot, np.zeros_like(hot), np.ones_like(hot)), strict=True))
    order = np.argsort(of, kind="stable")
    of, offset, n = of[order], offset[order], n[order]
    run, place = _expanded(np.searchsorted(of, pack.number), np.searchsorted(of, pack.number, side="right"))
    begin = pack.first[place] + offset[run]
    depth = np.bincount(begin, minlength=len(pack.h) + 1) - np.bincount(begin + n[run] + WINDOW - 1, minlength=len(pack.h) + 1)
    gone = np.cumsum(depth[:-1]) > 0
    ends, rows = np.cumsum(pack.n_words), []
    for k, b in enumerate(ends.tolist()):
        count = int(pack.n_words[k])
        mine = gone[b - count : b]
        text = pack.raw[pack.begin[b - count] : pack.end[b - 1]] if count else b""
        removed = int(np.count_nonzero(mine))
        if removed:
            text = b" ".join([w for w, g in zip(text.split(b" "), mine.tolist(), strict=True) if not g])
        rows.append((int(pack.ids[k]) if pack.known[k] else None, count, removed, hashlib.sha256(text).hexdigest(), text if with_kept else None))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, pack_bytes: int = PACK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and (with_kept) kept, the words that stay, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. All places of a repeated window lose it, the first one too, and places in
    one text count. Null text counts as empty and has no words; texts of fewer than 35 words stay whole. Rows that share
    an id, and rows without one, are documents of their own: repeated rows of 35 words or more lose all of them. Other
    columns aren't looked at. An empty table gives no rows.
    """
    packs = make_packs(docs, id_col, text_col, pack_bytes)
    hot = minimiser_windows(packs).groupBy("minimum").agg(F.sum("windows").alias("n")).where(F.col("n") >= max(2, bucket_windows // 4))
    hot = written(hot.select("minimum"), "hot_minimisers")
    some = not hot.isEmpty()
    if some:
        own = minimiser_windows(packs).join(hot, "minimum", "left_semi").groupBy("pack").agg(F.collect_list("minimum").alias("hot"))
        known = packs.join(written(own, "hot_of_packs"), "pack", "left")
    else:
        known = packs.withColumn("hot", F.lit(None).cast("array<long>"))
    buckets = max(1, math.ceil((packs.agg(F.sum("n_windows")).first()[0] or 0) / bucket_windows))
    marks = count_strings(send_strings(known, buckets)).groupBy("pack").agg(F.collect_list("marks").alias("marks"))
    known = known.join(marks, "pack", "left")
    if some:
        windows = written(hot_windows(known), "hot_windows")
        again = windows.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1")
        numbers = windows.join(again, "window", "left_semi").groupBy("pack").agg(F.collect_list("number").alias("numbers"))
        known = known.join(numbers, "pack", "left")
    else:
        known = known.withColumn("numbers", F.lit(None).cast("array<long>"))
    out = remove_marked(known, with_kept)
    return out if with_kept else out.drop("kept")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(documents(spark, sf_dir))
