"""Substring dedup: bytes of a 50-byte string that also starts in a document with a smaller id are removed.

The index is a family of suffix arrays: positions of texts in the alphabetical order of what begins there, sorted to a
depth of 50 bytes, which is all that is asked for. Batches come in the order of the document id. A new batch gets its
suffix array and is merge-scanned against the existing levels for strings of smaller documents; then it joins the family,
where levels of like size merge geometrically, each string with the smallest id that has it.

Suffixes are dealt to buckets by content, so that equal ones meet: the bucket of a 50-byte window follows from the
smallest hash of the 16-byte strings in it (its seed), and neighbouring windows with the same one travel together as one
stretch of text. Each bucket has a family of its own. Two passes come before: seeds are counted, and only stretches whose
seed occurs elsewhere travel at all.

Scale: texts are gathered in packs of about PACK_BYTES, compressed, and written once. A pack sends each distinct stretch
once, however often it holds it, with the smallest id that has it; so a passage that a third of all documents share is
one entry from each pack. Buckets hold about BUCKET_WINDOWS windows whatever the corpus (their number grows), and a task
takes its buckets one after the other. Windows of a seed that would fill a large part of a bucket (a common string in
differing surroundings) travel alone and are dealt by a hash of all their 50 bytes, so that a pack sends each of them
once. Only the marks go back to the packs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, quoted, written

LENGTH = 50
#: Length of the strings whose smallest hash deals a window to its bucket.
SEED = 16
PACK_BYTES, BUCKET_WINDOWS, BATCH_WINDOWS = 2 << 20, 1_000_000, 125_000
#: Windows of a text that are dealt at a time; longer texts are taken in parts.
PART = 4 << 20
#: Text of which the seeds are counted together.
COUNT_BYTES = 32 << 20
NO_ID = (1 << 63) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _words(raw: bytes | memoryview) -> np.ndarray:
    """The eight bytes from each position on, as an integer."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _MIX[2]
    x ^= x >> np.uint64(32)
    return x


def window_minima(raw: bytes) -> np.ndarray:
    """For each 50-byte window of raw the smallest hash of its 16-byte strings."""
    at = _words(raw)
    h = at[: len(raw) - SEED + 1] * _MIX[0]
    h += _mixed(at[8:] * _MIX[1])
    h = _mixed(h)
    width, need = 1, LENGTH - SEED + 1
    while width * 2 <= need:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (need - width)], h[need - width :])


def stretches(raw: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in raw one after the other: the first window and the number of windows of each stretch of
    neighbouring windows with one minimum, and the minima. Windows never cross texts."""
    firsts, counts, minima, at = [], [], [], 0
    ends = np.cumsum(lengths)
    group, size = [], 0
    for k, n in enumerate([*lengths, -1]):
        if size and (n < 0 or size + n > PART):
            _deal(raw, at, group, firsts, counts, minima)
            at, group, size = int(ends[k - 1]), [], 0
        group.append(n)
        size += n
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(minima)


def _deal(raw: bytes, at: int, lengths: list[int], firsts: list, counts: list, minima: list) -> None:
    total = sum(lengths)
    for lo in range(at, at + total, PART):
        part = raw[lo : min(lo + PART + LENGTH - 1, at + total)]
        if len(part) < LENGTH:
            continue
        low = window_minima(part)
        inside = np.ones(len(low), bool)
        new = np.empty(len(low), bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        end = at
        for n in lengths:
            start, end = end, end + n
            a, b = max(lo, end - LENGTH + 1, start) - lo, end - lo
            if b > 0 and a < len(low):
                inside[max(a, 0) : b] = False
            if 0 <= start - lo < len(low):
                new[start - lo] = True
        new[1:] |= inside[1:] != inside[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(low)))
        keep = inside[first]
        firsts.append(first[keep] + lo)
        counts.append(count[keep])
        minima.append(low[first[keep]])


def distinct_stretches(raw: bytes, lengths: list[int], ids: list[int], found: tuple[np.ndarray, ...] | None = None, hot: np.ndarray | None = None, goes: np.ndarray | None = None):
    """Occurrences (first window, windows, number of its stretch, id) and distinct stretches (bytes, minimum, smallest id, name), in the order of first sight.

    found: stretches() of the texts. hot: the minima, ascending, whose windows are stretches of their own, with the hash
    of the window for the minimum. goes: if given, the minima, ascending, of the other stretches that are wanted. A
    stretch's name is the place of its first occurrence among all, whether wanted or not.
    """
    first, count, low = stretches(raw, lengths) if found is None else found
    alone = _in(low, hot)
    if alone.any():
        times = np.where(alone, count, 1)
        begin = np.cumsum(times) - times
        first = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(begin, times)
        count, low, alone = np.repeat(np.where(alone, 1, count), times), np.repeat(low, times), np.repeat(alone, times)
        low[alone] = fingerprints(memoryview(raw), first[alone])
    place = np.arange(len(first)) if goes is None else np.flatnonzero(alone | _in(low, goes))
    first, count, low = first[place], count[place], low[place]
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)), np.int64, len(first))
    doc = np.array(ids, np.int64)[np.searchsorted(np.cumsum(lengths), first, side="right")] if len(first) else np.zeros(0, np.int64)
    smallest = np.full(len(seen), NO_ID, np.int64)
    np.minimum.at(smallest, number, doc)
    at = np.unique(number, return_index=True)[1]
    return (first, count, number, doc), (list(seen), low[at], smallest, place[at])


def _in(values: np.ndarray, some: np.ndarray | None) -> np.ndarray:
    """Whether each value is among some (ascending; None: none)."""
    if some is None or not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    head = np.array([len(arrays), *[len(a if isinstance(a, bytes) else a.tobytes()) for a in arrays]], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)))
    return [raw[int(a) : int(b)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def make_packs(docs: DataFrame, id_col: str, text_col: str, pack_bytes: int) -> DataFrame:
    """pack, n_bytes, body (compressed ids, lengths, texts), as a written table."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        known: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            body = _pack(np.array(ids, "<i8"), np.array(known, np.uint8), np.array([len(t) for t in texts], "<u4"), b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([size]), pa.array([body], pa.binary())], names=["pack", "n_bytes", "body"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                ids.append(NO_ID if doc is None else doc)
                known.append(doc is not None)
                texts.append(raw)
                size += len(raw)
                if size >= pack_bytes or len(ids) >= 50_000:
                    yield row()
                    made, ids, known, texts, size = made + 1, [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return written(rows.mapInArrow(gather, "pack long, n_bytes long, body binary"), "packs")


def _body(blob: bytes) -> tuple[list[int], list[int], list[int], bytes]:
    ids, known, lengths, raw = _unpack(blob)
    return np.frombuffer(ids, "<i8").tolist(), np.frombuffer(known, np.uint8).tolist(), np.frombuffer(lengths, "<u4").tolist(), bytes(raw)


def _by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in order) of the values, dealt by their remainder."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges.tolist(), np.append(edges, len(order))[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b]


UNIQUE, SHARED, HOT = 0, 1, 2


def seed_kinds(packs: DataFrame, parts: int, most: int) -> DataFrame:
    """pack, part, kinds (one byte for each of the pack's minima in that part, ascending), windows (of what is not UNIQUE, this pack's), hot (whether any is HOT), as a written table.

    A minimum of one distinct stretch in all packs is UNIQUE: nothing can equal its windows. One with `most` windows or
    more is HOT. Minima are counted by 32 of their bits, so that one may be taken for SHARED or HOT that isn't.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, _, lengths, raw = _body(blob.as_py())
                _, (found, minimum, _, _) = distinct_stretches(raw, lengths, ids)
                seeds, of = np.unique(minimum, return_inverse=True)
                several = (np.bincount(of, minlength=len(seeds)) > 1).astype(np.uint8)
                windows = np.bincount(of, [len(x) - LENGTH + 1 for x in found], len(seeds)).astype("<u4")
                rows = [(part, _pack(((seeds[at] // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype("<u4"), several[at], windows[at])) for part, at in _by_bucket(seeds, parts)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([pack] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["part", "pack", "body"])

    def decide(part: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        own = [[np.frombuffer(x, k) for x, k in zip(_unpack(b), ("<u4", np.uint8, "<u4"), strict=True)] for _, b in rows]
        keys, several, windows = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        sizes = np.diff(np.append(first, len(order)))
        kind = np.where(np.add.reduceat(windows[order].astype(np.int64), first) >= most, HOT, np.where((sizes > 1) | (np.maximum.reduceat(several[order], first) > 0), SHARED, UNIQUE))
        kind[(sizes == 1) & (several[order[first]] == 0)] = UNIQUE
        kinds = np.empty(len(keys), np.uint8)
        kinds[order] = np.repeat(kind, sizes)
        ends = np.cumsum([len(x[0]) for x in own])
        mine = [kinds[b - len(x[0]) : b] for x, b in zip(own, ends.tolist(), strict=True)]
        columns = [pa.array([p for p, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array([zstandard.compress(k.tobytes()) for k in mine], pa.binary())]
        columns += [pa.array([int(x[2][k > 0].sum()) for x, k in zip(own, mine, strict=True)], pa.int64()), pa.array([bool((k == HOT).any()) for k in mine])]
        return pa.RecordBatch.from_arrays(columns, names=["pack", "part", "kinds", "windows", "hot"])

    sent = packs.select("pack", "body").mapInArrow(send, "part long, pack long, body binary")
    return written(_bucketwise(sent, "part", decide, "pack long, part long, kinds binary, windows long, hot boolean"), "seed_kinds")


def _bucketwise(sent: DataFrame, key: str, result, schema: str) -> DataFrame:
    """result(bucket, [(pack, body)]) of each bucket; sent: bucket (named key), pack, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for bucket, pack, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != last and rows:
                    yield result(last, rows)
                    rows = []
                last = bucket
                rows.append((pack, body.as_py()))
        if rows:
            yield result(last, rows)

    return sent.repartition(key).sortWithinPartitions(key, "pack").mapInArrow(run, schema)


def _of_kind(found: tuple[np.ndarray, ...], told: list[tuple[int, bytes]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The minima of a pack's stretches that are HOT, and those that are SHARED, by its rows of seed_kinds (part, kinds)."""
    seeds = np.unique(found[2])
    kinds, given = np.zeros(len(seeds), np.uint8), dict(told)
    for part, at in _by_bucket(seeds, parts) if told else ():
        if part in given:
            kinds[at] = np.frombuffer(zstandard.decompress(given[part]), np.uint8)
    return seeds[kinds == HOT], seeds[kinds == SHARED]


def send_stretches(packs: DataFrame, kinds: DataFrame, parts: int, buckets: int) -> DataFrame:
    """bucket, pack, body (names, smallest ids, lengths and bytes of the distinct stretches that may occur elsewhere)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids, _, lengths, raw = _body(blob.as_py())
                found = stretches(raw, lengths)
                hot, goes = _of_kind(found, [(x["part"], x["kinds"]) for x in told or []], parts)
                _, (texts, minimum, smallest, name) = distinct_stretches(raw, lengths, ids, found, hot, goes)
                rows = []
                for bucket, mine in _by_bucket(minimum, buckets):
                    own = [texts[i] for i in mine.tolist()]
                    rows.append((bucket, _pack(name[mine].astype("<u4"), smallest[mine].astype("<i8"), np.array([len(p) for p in own], "<u4"), b"".join(own))))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([pack] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["bucket", "pack", "body"])

    told = kinds.groupBy("pack").agg(F.collect_list(F.struct("part", "kinds")).alias("told"))
    return packs.select("pack", "body").join(told, "pack", "left").select("pack", "body", "told").mapInArrow(send, "bucket long, pack long, body binary")


class Level:
    """The distinct strings of a suffix array, ascending, each with the smallest id that has it."""

    def __init__(self, strings: np.ndarray, ids: np.ndarray):
        self.strings, self.ids = strings, ids

    def merged(self, other: Level) -> Level:
        strings, ids = np.concatenate((self.strings, other.strings)), np.concatenate((self.ids, other.ids))
        order = np.argsort(strings, kind="stable")  # two runs, which are merged
        strings, first = _runs(strings[order])
        return Level(strings, np.minimum.reduceat(ids[order], first) if len(first) else ids)

    def smallest(self, strings: np.ndarray) -> np.ndarray:
        """The smallest id that has each of the strings (ascending); NO_ID where none has."""
        at = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
        return np.where(self.strings[at] == strings, self.ids[at], NO_ID)


def _runs(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ascending strings, and where each begins."""
    first = np.flatnonzero(np.append(True, strings[1:] != strings[:-1])) if len(strings) else np.zeros(0, np.int64)
    return strings[first], first


def suffix_array(text: memoryview, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the starts by the 50 bytes from each on (equal ones as given), and those bytes in that order."""
    strings = np.ndarray((len(text) - LENGTH + 1,), f"S{LENGTH}", text, strides=(1,))[starts]
    order = np.argsort(strings, kind="stable")
    return order, strings[order]


def add_batch(levels: list[Level], text: memoryview, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the starts have a string that a smaller id has, in the batch or in a level. The batch then joins the family.

    ids: ascending, and none below those of the batches before. Levels less than twice as large as the new one merge
    with it, so that the family has as many levels as the logarithm of its strings.
    """
    order, sorted_ = suffix_array(text, starts)
    strings, first = _runs(sorted_)
    least = ids[order][first]
    for level in levels:
        np.minimum(least, level.smallest(strings), out=least)
    hit = np.empty(len(starts), bool)
    hit[order] = ids[order] > np.repeat(least, np.diff(np.append(first, len(order))))
    new = Level(strings, least)
    while levels and len(levels[-1].strings) < 2 * len(new.strings):
        new = levels.pop().merged(new)
    levels.append(new)
    return hit


def fingerprints(raw: memoryview, starts: np.ndarray) -> np.ndarray:
    at = _words(raw)
    h = at[starts] * _MIX[0]
    for step in (8, 16, 24, 32, 40, LENGTH - 8):
        h ^= h >> np.uint64(31)
        h += at[starts + step]
        h *= _MIX[1]
    return _mixed(h)


def repeated(prints: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints whose slot (some of their bits) another position has too; none that repeats is missed."""
    bits = min(24, max(10, (4 * len(prints)).bit_length()))
    slot, here = (prints >> np.uint64(64 - bits)).astype(np.int32), np.arange(len(prints), dtype=np.int32)
    one = np.empty(1 << bits, np.int32)
    one[slot] = here
    twice = np.zeros(1 << bits, bool)
    twice[slot[one[slot] != here]] = True
    return np.flatnonzero(twice[slot])


def scan_bucket(rows: list[tuple[int, bytes]], batch_windows: int = BATCH_WINDOWS) -> list[tuple[int, bytes]]:
    """(pack, body of marks): for each stretch of which windows are in a smaller document, their runs."""
    number, smallest, lengths, owner, parts = [], [], [], [], []
    for k, (_, blob) in enumerate(rows):
        a, b, c, raw = _unpack(blob)
        number.append(np.frombuffer(a, "<u4"))
        smallest.append(np.frombuffer(b, "<i8"))
        lengths.append(np.frombuffer(c, "<u4").astype(np.int64))
        owner.append(np.full(len(lengths[-1]), k))
        parts.append(raw)
    raw = memoryview(b"".join(parts))
    number, smallest, lengths, owner = map(np.concatenate, (number, smallest, lengths, owner))
    windows = lengths - LENGTH + 1
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    window_at = np.concatenate(([0], np.cumsum(windows)))
    cuts = np.unique(np.append(np.searchsorted(window_at, np.arange(0, window_at[-1], batch_windows)), len(lengths)))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    prints = np.concatenate([fingerprints(raw, np.arange(window_at[b] - window_at[a]) + np.repeat(begin[a:b] - (window_at[a:b] - window_at[a]), windows[a:b])) for a, b in spans])
    window = repeated(prints)
    if not len(window):
        return []
    stretch = np.searchsorted(window_at, window, side="right") - 1
    ids, starts = smallest[stretch], begin[stretch] + window - window_at[stretch]
    by_id, hit, levels = np.argsort(ids, kind="stable"), np.zeros(len(window), bool), []
    for a in range(0, len(window), batch_windows):
        x = by_id[a : a + batch_windows]
        hit[x] = add_batch(levels, raw, starts[x], ids[x])
    less, out = np.flatnonzero(hit), {}
    first = np.flatnonzero((np.diff(window[less], prepend=-2) != 1) | (np.diff(stretch[less], prepend=-1) != 0))
    count, of = np.diff(np.append(first, len(less))), stretch[less[first]]
    offset = window[less[first]] - window_at[of]
    for k in np.unique(owner[of]).tolist():
        mine = owner[of] == k
        out[k] = _pack(number[of[mine]].astype("<u4"), offset[mine].astype("<u4"), count[mine].astype("<u4"))
    return [(rows[k][0], v) for k, v in out.items()]


def mark_stretches(sent: DataFrame) -> DataFrame:
    """pack, marks."""

    def scan(_: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        marks = scan_bucket(rows)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.binary())], names=["pack", "marks"])

    return _bucketwise(sent, "bucket", scan, "pack long, marks binary")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_marked(packs: DataFrame, marks: DataFrame, kinds: DataFrame, parts: int, with_kept: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, told in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                marked = [x["marks"] for x in told or [] if x["marks"] is not None]
                yield _removed(body.as_py(), marked, with_kept, [(x["part"], x["kinds"]) for x in told or [] if x["marks"] is None], parts)

    # Packs with hot seeds have to know them, so as to number their stretches in the same way again.
    rows = marks.select("pack", "marks", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("kinds"))
    rows = rows.union(kinds.where("hot").select("pack", F.lit(None).cast("binary"), "part", "kinds"))
    by_pack = rows.groupBy("pack").agg(F.collect_list(F.struct("marks", "part", "kinds")).alias("told"))
    return packs.select("pack", "body").join(by_pack, "pack", "left").select("body", "told").mapInArrow(remove, _OUT)


def _removed(blob: bytes, marked: list[bytes], with_kept: bool, told: list[tuple[int, bytes]], parts: int) -> pa.RecordBatch:
    ids, known, lengths, raw = _body(blob)
    found = stretches(raw, lengths)
    (first, count, number, doc), (_, _, smallest, name) = distinct_stretches(raw, lengths, ids, found, _of_kind(found, told, parts)[0])
    later = doc > smallest[number]  # the pack itself has a smaller document with the whole stretch
    begins, counts = [first[later]], [count[later]]
    if marked:
        of, offset, n = (np.concatenate(x).astype(np.int64) for x in zip(*[[np.frombuffer(a, "<u4") for a in _unpack(b)] for b in marked], strict=True))
        order = np.argsort(of, kind="stable")
        of, offset, n = of[order], offset[order], n[order]
        own = np.flatnonzero(~later)
        named = name[number[own]]
        lo, hi = np.searchsorted(of, named), np.searchsorted(of, named, side="right")
        times = hi - lo
        run = np.arange(times.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times)
        begins.append(np.repeat(first[own], times) + offset[run])
        counts.append(n[run])
    begin, stop = np.concatenate(begins), np.concatenate(begins) + np.concatenate(counts) + LENGTH - 1
    depth = np.zeros(len(raw) + 1, np.int32)
    np.add.at(depth, begin, 1)
    np.add.at(depth, stop, -1)
    gone = np.cumsum(depth[:-1]) > 0
    data, at, rows = np.frombuffer(raw, np.uint8), 0, []
    for k, n in enumerate(lengths):
        mine = gone[at : at + n]
        removed = int(np.count_nonzero(mine))
        kept = data[at : at + n][~mine].tobytes() if removed else raw[at : at + n]
        spans = int(np.count_nonzero(np.diff(mine.view(np.int8), prepend=0) == 1)) if removed else 0
        rows.append((ids[k] if known[k] else None, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        at += n
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, pack_bytes: int = PACK_BYTES, bucket_windows: int = BUCKET_WINDOWS, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_kept) kept, the bytes that stay.

    Null text counts as empty. Rows that share an id are one document: they don't cut each other. A row without an id
    cuts no other and is cut by all that have one. Texts of fewer than 50 bytes stay whole. Other columns aren't looked
    at. An empty table gives no rows.
    """
    packs = make_packs(docs, id_col, text_col, pack_bytes)
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / count_bytes))
    kinds = seed_kinds(packs, parts, max(2, bucket_windows // 4))
    buckets = max(1, math.ceil((kinds.agg(F.sum("windows")).first()[0] or 0) / bucket_windows))
    marks = written(mark_stretches(send_stretches(packs, kinds, parts, buckets)), "marks")
    out = remove_marked(packs, marks, kinds, parts, with_kept)
    return out if with_kept else out.drop("kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))
