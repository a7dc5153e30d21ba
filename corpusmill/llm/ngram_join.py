"""N-gram Jaccard join: documents whose sets of five-word shingles are alike, and the components they form.

Documents with equal sets are one class, stood for by its smallest id. Each class gives its rarest shingles (so many that
two alike classes must share one) to inverted lists; rarity is read from a table of counts of fixed size. Every list of
two classes or more proposes pairs of its first class with the others; pairs that share enough are searched: the first
class is the query, the others are indexed in blocks, and a T-occurrence search (DivideSkip) merges the short inverted
lists and binary-probes the long ones for those that reach the required overlap. Classes that this leaves in different
components but in one list are paired where the list's shingle comes early enough in both, and searched in the same
way. So a group of copies makes links in proportion to its size and no link between different components is lost.

Scale: the shuffles carry (shingle, class) rows for about a fifth of the shingles, and the texts of classes in a pair;
those are picked where they are read, by a table of BITS bits. A query with very many partners is split into groups of
about GROUP. Lists are streamed, never held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, quoted, written
from .components import components
from .encoding import slices

WORDS = 5
#: Two documents link when 100 * intersection >= SHARE * union.
SHARE = 80
#: Counters of the rarity table, in so many parts.
SLOTS, PARTS = 1 << 20, 16
#: Partners of a query in one group, about; documents indexed at a time.
GROUP, BLOCK = 128, 256
#: Bits of the table that says which documents a search may need, in PARTS parts.
BITS = 1 << 25
#: Counted shingles from which on a list is split, into parts of about so many.
HOT = 100_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words is one shingle, one without words none."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        h += ids[k : k + len(h)] * _ODD[k]
    h ^= h >> np.uint64(31)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def least_overlap(a: int, b: np.ndarray | int, share: int = SHARE):
    """The least intersection with which sets of a and b elements link."""
    return -(-share * (a + b) // (100 + share))


def _signature(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)


def describe(docs: DataFrame) -> DataFrame:
    """docs: id, text. Rows of documents (id, n, set; part null) and of counters (part, counts), as a written table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in slices(batches):
            rows = []
            for h in map(shingles, batch.column(1).to_pylist()):
                np.add.at(counts, (h % np.uint64(SLOTS)).astype(np.int64), np.uint32(1))
                rows.append((len(h), _signature(h)))
            n, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=schema)
        size = SLOTS // PARTS
        for k in range(PARTS):
            yield pa.RecordBatch.from_pylist([{"part": k, "counts": counts[k * size : (k + 1) * size].tobytes()}], schema=schema)

    return written(docs.mapInArrow(read, "id long, n long, set long, part int, counts binary"), "sets")


def rarity(described: DataFrame) -> np.ndarray:
    """The counters of all tasks together: SLOTS numbers, added up in tasks as the rows stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(blob.as_py(), np.uint32)
                total[k] = total[k] + new if k in total else new.astype(np.uint64)
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])

    parts = described.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(SLOTS, np.uint32)
    for x in parts.collect():  # PARTS rows
        out[x["part"] * (SLOTS // PARTS) : (x["part"] + 1) * (SLOTS // PARTS)] = np.frombuffer(x["counts"], np.uint32)
    return out


def rare_lists(docs: DataFrame, rarity_table: np.ndarray, share: int) -> DataFrame:
    """Of the rarest shingles of each class (node: its smallest id) the lists that have two classes or more, as a written table.

    shingle, salt, node, n, pos (the shingle's place among the class's, rarest first), and first, first_n: the list's
    smallest node. Lists that the counters show to be longer than HOT are split by salt (-1: not split). The counters
    count documents, copies too, so a split list may have few classes and each in a part of its own: whether it has two
    is counted over all its parts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rarity_table)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in slices(batches):
            rows = []
            for h in map(shingles, batch.column(1).to_pylist()):
                keep = len(h) - -(-share * len(h) // 100) + 1 if len(h) else 0
                count = counts[(h % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((h, count))[:keep]
                rows.append((len(h), _signature(h), h[order].astype(np.int64), count[order] // HOT))
            n, s, r, c = zip(*rows, strict=True)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in r]))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((r, np.int64), (c, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.int64()), *lists], names=["id", "n", "set", "rare", "hot"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of lists of two or more and of parts of split lists (alone: the part's only row), with the list's or part's first. Rows stream by in the order of their lists."""
        names = ["shingle", "salt", "node", "n", "pos", "first", "first_n", "alone"]
        last, pending, head = None, None, None  # the last list, its only row if not yet given out, its first (node, n)
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, salt, node, n = (batch.column(k).to_numpy() for k in range(4))
            starts = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])))
            sizes = np.diff(np.append(starts, len(shingle)))
            goes_on = last == (shingle[0], salt[0])
            first, first_n = np.repeat(node[starts], sizes), np.repeat(n[starts], sizes)
            if goes_on:
                first[: sizes[0]], first_n[: sizes[0]] = head
                if pending is not None:
                    yield pending.set_column(7, "alone", pa.array([False]))
            elif pending is not None and last[1] >= 0:
                yield pending
            keep = sizes > 1
            keep[0] |= goes_on
            alone = np.repeat(~keep, sizes)
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(first_n), pa.array(alone)], names=names)
            pending = None if keep[-1] else rows.slice(len(shingle) - 1, 1)
            last, head = (shingle[-1], salt[-1]), (first[-1], first_n[-1])
            given = ~alone | (salt >= 0)
            given[-1] &= pending is None
            yield rows.filter(pa.array(given))
        if pending is not None and last[1] >= 0:
            yield pending

    described = docs.mapInArrow(rare, "id long, n long, set long, rare array<long>, hot array<int>").where("n > 0 and id is not null")
    classes = described.groupBy("n", "set").agg(F.min("id").alias("node"), F.first("rare").alias("rare"), F.first("hot").alias("hot"))
    rows = classes.select("node", "n", F.posexplode(F.arrays_zip("rare", "hot")).alias("pos", "x")).select(F.col("x.rare").alias("shingle"), F.when(F.col("x.hot") > 0, F.pmod(F.xxhash64("node"), F.col("x.hot") + 1)).otherwise(-1).cast("int").alias("salt"), "node", "n", "pos")
    rows = rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "node")
    parts = written(rows.mapInArrow(shared, "shingle long, salt int, node long, n long, pos int, first long, first_n long, alone boolean"), "lists")
    several = parts.where("salt >= 0 and node = first").groupBy("shingle").agg(F.count("*").alias("parts")).where("parts > 1").select("shingle")
    lone = written(parts.where("alone").join(several, "shingle", "left_semi").select(*parts.columns), "lone_parts")
    return parts.where("not alone").union(lone).drop("alone")


def _may_link(a: str, b: str, share: int) -> Column:
    least, most = F.least(a, b), F.greatest(a, b)
    return 100 * least >= share * most


def _least_shared(a: str, b: str, share: int) -> Column:
    """How many of their rare shingles two sets of a and b must share in order to link.

    What they share beyond the rare shingles of the one whose last comes first is at most the rest of that one.
    """
    up = lambda x, d: F.floor((x + (d - 1)) / d).cast("long")
    overlap = up(share * (F.col(a) + F.col(b)), 100 + share)
    return F.greatest(F.lit(1), overlap - up(share * F.greatest(a, b), 100) + 1)


def first_pairs(lists: DataFrame, share: int) -> DataFrame:
    """a, b, an, bn: the first of a list with each other one of it, and the firsts of a split list with the smallest of them."""
    to = lists.where("first <> node").select(F.col("first").alias("a"), F.col("first_n").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn"))
    split = lists.where("salt > 0").select("shingle").distinct()
    firsts = lists.join(split, "shingle", "left_semi").select("shingle", "first", "first_n").distinct()
    heads = firsts.groupBy("shingle").agg(F.min(F.struct("first", "first_n")).alias("h"))
    across = firsts.join(heads, "shingle").where("h.first <> first").select(F.col("h.first").alias("a"), F.col("h.first_n").alias("an"), F.col("first").alias("b"), F.col("first_n").alias("bn"))
    pairs = to.union(across).where(_may_link("an", "bn", share)).groupBy("a", "an", "b", "bn").agg(F.count("*").alias("c"))
    return pairs.where(F.col("c") >= _least_shared("an", "bn", share)).select("a", "b", "an", "bn")


def left_pairs(lists: DataFrame, found: DataFrame, share: int) -> DataFrame:
    """a, b, an, bn: the pairs of a list that found (node, component) leaves in different components and that may link.

    Two sets of a and b elements that link share `overlap` shingles, so of the rarest a - overlap + 1 of the one and
    b - overlap + 1 of the other at least one is shared: pairs for which this list's shingle comes later are left out
    here, and made by a list where it doesn't.
    """
    named = lists.join(found, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    mixed = named.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("shingle")
    open_ = written(named.join(mixed, "shingle", "left_semi"), "open_lists")
    side = lambda x: open_.select("shingle", F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("pos").alias(f"{x}p"), F.col("c").alias(f"{x}c"))
    overlap = F.ceil(share * (F.col("an") + F.col("bn")) / (100 + share))
    early = (F.col("ap") + overlap <= F.col("an")) & (F.col("bp") + overlap <= F.col("bn"))
    pairs = side("a").join(side("b"), "shingle").where((F.col("ac") < F.col("bc")) & _may_link("an", "bn", share) & early)
    return pairs.select("a", "b", "an", "bn").distinct()


def t_occurrence(query: np.ndarray, docs: list[np.ndarray], share: int = SHARE) -> list[int]:
    """The documents whose sets link with the query's, by DivideSkip over the inverted lists of docs.

    The longest lists are set aside. The short ones are merged, counting for each document the lists it is in; one that
    reaches the least overlap less the number of long lists is probed in those by binary search.
    """
    sizes = np.array([len(d) for d in docs])
    needs = least_overlap(len(query), sizes, share)
    fits = needs <= np.minimum(sizes, len(query))
    if not len(query) or not fits.any():
        return []
    all_ = np.concatenate(docs)
    owner = np.repeat(np.arange(len(docs)), sizes)
    order = np.lexsort((owner, all_))
    all_, owner = all_[order], owner[order]
    lo, hi = np.searchsorted(all_, query), np.searchsorted(all_, query, side="right")
    least = int(needs[fits].min())
    longest = int((hi - lo).max())
    by_length = np.argsort(lo - hi, kind="stable")
    n_long = min(max(0, least - 1), int(least / (0.01 * math.log2(max(2, longest)) + 1)))
    long, short = by_length[:n_long], by_length[n_long:]
    sizes_short = hi[short] - lo[short]
    ends = np.cumsum(sizes_short)
    merged = owner[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo[short] - (ends - sizes_short), sizes_short)]
    count = np.bincount(merged, minlength=len(docs))
    for d in np.flatnonzero(fits & (count >= needs - n_long)).tolist():
        at = np.minimum(lo[long] + _probe(owner, lo[long], hi[long], d), len(owner) - 1)
        count[d] += np.count_nonzero((at < hi[long]) & (owner[at] == d))
    return np.flatnonzero(fits & (count >= needs)).tolist()


def _probe(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
    """For each list [lo, hi) of owner the offset of the first owner not below d, by binary search in all lists at once."""
    a, b = lo.copy(), hi.copy()
    while (more := a < b).any():
        mid = (a + b) // 2
        below = more & (owner[np.minimum(mid, len(owner) - 1)] < d)
        a = np.where(below, mid + 1, a)
        b = np.where(more & ~below, mid, b)
    return a - lo


def _bit(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * _ODD[0]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def picked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (id, text) of nodes (id), and some others: those with a bit that a node has. No row is shuffled."""
    width = BITS // PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy())] = True
        found = [k for k in range(PARTS) if bits[k * width : (k + 1) * width].any()]
        packed = [zstandard.compress(np.packbits(bits[k * width : (k + 1) * width]).tobytes()) for k in found]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(packed, pa.binary())], names=["part", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint8)
                total[k] = total[k] | new if k in total else new
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "bits"])

    kind = "part int, bits binary"
    packed = np.zeros(BITS // 8, np.uint8)
    for x in nodes.mapInArrow(mark, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect():  # PARTS rows of fixed size
        packed[x["part"] * width // 8 : (x["part"] + 1) * width // 8] = np.frombuffer(x["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(packed)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column(0).to_numpy())
            yield batch.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return rows.where("id is not null").mapInArrow(pick, rows.schema)


def search(pairs: DataFrame, docs: DataFrame, share: int, name: str) -> DataFrame:
    """a, b of those pairs whose sets link. docs: id, text."""
    pairs = written(pairs.select("a", "b"), f"{name}_pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    asks = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("a").alias("id"), F.lit(0).alias("role"))
    gives = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.col("b").alias("id"), F.lit(1).alias("role"))
    texts = picked(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    rows = asks.union(gives).join(texts, "id").select("a", "g", "role", "id", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, block, ids = None, [], [], []

        def links() -> pa.RecordBatch:
            found = sorted({ids[k] for q in queries for k in t_occurrence(q, block, share)}) if block else []
            return pa.RecordBatch.from_arrays([pa.array([group[0] if group else 0] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, g, role, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, g) != group or len(block) >= BLOCK:
                    yield links()
                    block, ids = [], []
                    if (a, g) != group:
                        group, queries = (a, g), []
                if role:
                    block.append(shingles(text))
                    ids.append(doc)
                else:
                    queries.append(shingles(text))
        yield links()

    return written(rows.repartition("a", "g").sortWithinPartitions("a", "g", "role", "id").mapInArrow(find, "a long, b long"), f"{name}_links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest id that links lead to).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Null, empty and blank texts have no shingles and link with
    nothing. Equal texts (and repeated rows) are one class. Ids should be unique; rows that share one are each joined by
    their own text. A row without an id links with nothing and has no component. Other columns aren't looked at. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    described = describe(rows)
    lists = rare_lists(rows, rarity(described), share)
    first = first_pairs(lists, share)
    links = search(first, rows, share, "first")
    if not lists.isEmpty():
        rest = left_pairs(lists, components(links), share).join(first.select("a", "b"), ["a", "b"], "left_anti")
        links = links.union(search(rest, rows, share, "rest"))
    sets = described.where("part is null").select("id", "n", "set")
    classes = sets.where("n > 0 and id is not null").groupBy("n", "set").agg(F.min("id").alias("node"))
    named = classes.join(components(links), "node", "left").select("n", "set", F.coalesce("component", "node").alias("component"))
    out = sets.join(written(named, "named"), ["n", "set"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
