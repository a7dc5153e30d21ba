"""Periodic run detection: stretches of words that repeat themselves, found by Lyndon words and collapsed to one period.

A run is a stretch of consecutive words whose smallest period fits into it several times and that neither neighbour
extends. Every run shows as the longest Lyndon word at some position, under one of two opposite orders of the words; so a
stack of Lyndon words is scanned from right to left under both orders, and each word on it is extended to both sides
with its length as the period. Suffixes are compared, and periods extended, by the longest common extension of two
positions: a binary search over rolling hashes, whose answer is then verified word by word. No suffix array is built.

Words that no run can hold are passed over first. A run of at least min_words and min_exponent periods holds every
stretch of `anchor` words (9 for 24 and 3) at two places, one period apart; what holds no such stretch is left out.

Scale: each text is looked at by itself, in Arrow batches of which about BATCH_BYTES are taken apart at a time. Nothing is
shuffled. A text of n words takes n log n steps and about 150 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_but, documents, let, mapped, whole

MIN_WORDS, MIN_EXPONENT = 24, 3
#: Text that is looked at together; longer texts alone.
BATCH_BYTES = 8 << 20
#: The modulus and base of the rolling hash.
MODULUS, BASE = (1 << 61) - 1, 1_000_003_000_037
_RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def anchor_words(min_words: int, min_exponent: int) -> int:
    """The most words of which a stretch at any place of a run stands a period away, too, within the run."""
    return min(max(min_words, min_exponent * q) - 2 * q + 1 for q in (min_words // min_exponent, min_words // min_exponent + 1) if q)


class Extensions:
    """Longest common extensions of two positions of a sequence of numbers."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.raw = np.array(words, "<i4").tobytes()
        self.sums, self.powers = [0] * (self.n + 1), [1] * (self.n + 1)
        for k, w in enumerate(words):
            self.sums[k + 1] = (self.sums[k] * BASE + w + 1) % MODULUS
            self.powers[k + 1] = self.powers[k] * BASE % MODULUS
        self.known: dict[int, tuple[int, int]] = {}

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether the hashes of the n words from a and from b are equal."""
        s, p = self.sums, self.powers[n]
        return (s[a + n] - s[a] * p - s[b + n] + s[b] * p) % MODULUS == 0

    def verified(self, a: int, b: int, n: int) -> bool:
        return self.raw[4 * a : 4 * (a + n)] == self.raw[4 * b : 4 * (b + n)]

    def search(self, a: int, b: int, most: int, back: bool) -> int:
        """The largest number of words, up to most, that agree from a and b on (back: before a and b)."""
        at = (lambda k, n: (a - k - n, b - k - n)) if back else (lambda k, n: (a + k, b + k))
        found, step = 0, 1
        while found + step <= most and self.same(*at(found, step), step):
            found, step = found + step, 2 * step
        while step > 1:
            step //= 2
            if found + step <= most and self.same(*at(found, step), step):
                found += step
        if not self.verified(a - found if back else a, b - found if back else b, found):  # two hashes were equal by chance
            w, found = self.words, 0
            while found < most and (w[a - found - 1] == w[b - found - 1] if back else w[a + found] == w[b + found]):
                found += 1
        return found

    def after(self, i: int, j: int) -> int:
        """Words from i on that equal those from j on (i < j). What has been verified for a distance is not verified again."""
        w, d = self.words, j - i
        if j >= self.n or w[i] != w[j]:
            return 0
        low, high = self.known.get(d, (self.n, self.n))
        if low <= i < high:
            return high - i
        most = self.n - j
        meets = i < low and low - i <= most and low < high
        found = self.search(i, j, low - i if meets else most, False)
        if meets and found == low - i:
            found = high - i
        self.known[d] = (i, i + found)
        return found

    def before(self, i: int, j: int) -> int:
        """Words before i that equal those before j (i < j)."""
        return self.search(i, j, i, True)


def stretch_runs(words: list[int], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and period. min_exponent: 2 at least."""
    e, n, out = Extensions(words), len(words), set()
    for order in (words, [-w for w in words]):
        stack = [n]  # where the Lyndon words begin that follow each other from the position on
        done: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            j = stack[-1]
            while j < n:
                k = e.after(i, j)
                if j + k == n or order[i + k] > order[j + k]:
                    break  # the word at j is not greater: it doesn't join the one at i
                stack.pop()
                j = stack[-1]
            stack.append(i)
            low, high = done.get(j - i, (n, 0))
            if low <= i and j <= high:
                continue  # the same period around the same place
            if not (j < n and words[i] == words[j]) and not (i and words[i - 1] == words[j - 1]):
                continue
            low, high = i - e.before(i, j), j + e.after(i, j)
            done[j - i] = low, high
            if high - low >= max(min_words, min_exponent * (j - i)):
                out.add((low, high - low, j - i))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _MIX[2]
    x ^= x >> np.uint64(32)
    return x


def candidates(texts: list[list[bytes]], anchor: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end) of the stretches of at least `least` words in which every `anchor` words stand at several places of the text."""
    n = sum(map(len, texts))
    starts = n - anchor + 1
    if starts <= 0:
        return
    h = np.fromiter((hash(w) for words in texts for w in words), np.int64, n).view(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    gram, mixed = np.zeros(starts, np.uint64), _mixed(h + _MIX[1])
    for k in range(anchor):
        gram *= _MIX[0]
        gram += mixed[k : k + starts]
    gram = _mixed(gram ^ (of[:starts].astype(np.uint64) * _MIX[1]))
    order = np.argsort(gram, kind="stable")
    equal = gram[order][1:] == gram[order][:-1]
    several = np.zeros(starts, bool)
    several[order[1:]] |= equal
    several[order[:-1]] |= equal
    several &= of[:starts] == of[anchor - 1 :]
    new = np.diff(np.where(several, of[:starts] + 1, 0), prepend=0, append=0) != 0
    edges = np.flatnonzero(new)
    begin_of = np.concatenate(([0], np.cumsum([len(words) for words in texts])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if several[a] and b - a + anchor - 1 >= least:
            t = int(of[a])
            yield t, a - int(begin_of[t]), b + anchor - 1 - int(begin_of[t])


def text_runs(texts: list[list[bytes]], min_words: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, a, b in candidates(texts, anchor_words(min_words, min_exponent), min_words):
        number: dict[bytes, int] = {}
        words = [number.setdefault(w, len(number)) for w in texts[t][a:b]]
        out[t] += [(a + start, length, period) for start, length, period in stretch_runs(words, min_words, min_exponent)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    return b" ".join(kept + words[at:])


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """All columns of docs and the struct `periodicity`: n_words, runs (start, length, period; by start, then period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is at least min_words long and min_exponent (2 or more) times
    its smallest period. collapsed is the text's words without those that a run holds after its first period, joined by
    one space.

    Null text counts as empty; it has no words, no runs and an empty collapsed text. Rows are looked at one by one, so
    repeated rows repeat their result, and an empty table gives an empty one. An own column named `periodicity` is
    replaced.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")

    own = [c for c in docs.columns if c.lower() != "periodicity"]
    at = own.index(next(c for c in own if c.lower() == text_col.lower()))
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(values: pa.Array) -> pa.StructArray:
        texts = [(v.as_py() or b"").split() for v in values]  # bytes are split at ASCII white space
        runs = text_runs(texts, min_words, min_exponent)
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine in runs]
        left = [collapsed(words, mine) for words, mine in zip(texts, runs, strict=True)]
        columns = [pa.array([len(words) for words in texts], pa.int64()), pa.array(rows, pa.list_(item)), pa.array(left, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).cast(pa.large_binary())
            sizes = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(values):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_BYTES, side="right")))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, found(values.slice(a, b - a))], names=[*part.schema.names, "periodicity"])
                a = b

    return mapped(docs.select(*columns_but(docs, "periodicity")), run, "periodicity", T.StructType.fromDDL(_RESULT))


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's text: in a tenth of the documents, by crc32 of the id, the words from one on repeat with a period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i.cast("long")).otherwise(a + F.pmod(i - a, p))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " "))

    words = F.array_remove(F.split(whole(text), r"[\x20\x09-\x0D]+"), "")
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(whole(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    runs = F.col("periodicity.runs")
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), lambda acc, r: F.when(better(r, acc), r).otherwise(acc)))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = periodic_runs(docs).select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("periodicity.collapsed"), 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return out.select("doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], exponent, "runs_sha256", "collapsed_sha256")
