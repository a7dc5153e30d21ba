"""Positions of regular expression matches by DataFrame functions alone.

Spark's functions return matches but not where they are. Each match is wrapped in \x01, the text is split there, and
the lengths of the pieces are summed up; \x01 itself is first replaced in the text (one code point for one), so no
pattern may match \x01 or \x02. Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

MARK, OTHER = "\x01", "\x02"
SPAN = "array<struct<start:int,kind:int,stop:int,match:string,before:string>>"
#: Code points of context kept before a match.
BEFORE = 24


def running(values: Column, op) -> Column:
    """op of all values so far, for each value of an array of integers; op: an associative function of two columns.

    A fold copies its list at every step, so values are folded in blocks, then the blocks' last ones, and the two are put
    together: n values take about n to the power of 4/3 steps.
    """

    def fold(block: Column) -> Column:
        last = lambda acc: F.get(acc, F.size(acc) - 1)
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(last(acc), x)).otherwise(x))))

    def blocks(values: Column) -> Column:
        size = F.ceil(F.cbrt(F.size(values))).cast("int")
        cuts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))
        return F.transform(cuts, lambda b: fold(F.slice(values, b * size + 1, size)))

    def carried(folded: Column) -> Column:
        before = fold(F.transform(folded, lambda block: F.element_at(block, -1)))
        with_carry = lambda before: F.transform(folded, lambda block, b: F.when(b > 0, F.transform(block, lambda x: op(F.get(before, b - 1), x))).otherwise(block))
        return F.flatten(let(before, with_carry))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), carried)).otherwise(F.array().cast("array<int>")))


def found(text: Column, kind: int, pattern: str, keep) -> Column:
    """The leftmost non-overlapping matches of pattern for which keep(match) holds, as SPAN. text: not null."""
    parts = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, MARK + "$0" + MARK), MARK)

    def spans(x: Column) -> Column:
        def span(part: Column, i: Column) -> Column:
            before = F.right(F.get(x["parts"], i - 1), F.lit(BEFORE))
            return F.struct(F.get(x["ends"], i - 1).alias("start"), F.lit(kind).alias("kind"), F.get(x["ends"], i).alias("stop"), part.alias("match"), before.alias("before"))

        return F.array_compact(F.transform(x["parts"], lambda part, i: F.when((i % 2 == 1) & keep(part), span(part, i)))).cast(SPAN)

    ends = lambda p: F.struct(p.alias("parts"), running(F.transform(p, F.length), lambda a, b: a + b).alias("ends"))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(let(parts, ends), spans)).otherwise(F.array().cast(SPAN))


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:stop of each span, comma-joined; spans: ordered."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def ordered(*spans: Column) -> Column:
    """By start, then kind in the order of the list."""
    return F.array_sort(F.concat(*spans))


def n_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
