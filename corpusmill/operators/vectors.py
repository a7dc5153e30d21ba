"""Vector search: exact, by an inverted-file index, and from coarse to fine.

Queries are a stated set. They come to the driver block by block (a block has QUERY_BYTES of vectors and QUERY_BLOCK
queries at most, whatever the table), and for each block one pass multiplies them with the vectors in Arrow batches; scores are
made in tiles of a fixed size, and a task passes on the k best of each query, so that k rows a query and task are shuffled. Each block's answer is written before the next.

The index deals all vectors to lists by their nearest centroid; centroids are fitted on a bounded sample. A search looks
only into the lists whose centroids are nearest to the query; with as many probes as lists it is the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import fresh_path, saved

#: Bytes of query vectors, and queries, in a pass at most.
QUERY_BYTES, QUERY_BLOCK = 32 << 20, 8192
#: Queries and vectors of a tile of scores, found rows that a task holds (which bounds the queries of a pass where k is
#: large), and pairs of a query and a list in a pass of an index.
TILE, HELD, PLACES = (1024, 2048), 1 << 20, 32 << 20
#: Rows that the centroids are fitted on at most, those with the smallest hashes, and rounds of the fit.
SAMPLE, ROUNDS = 50_000, 10


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, one a row; a vector of another length, a null or a zero vector is a row of zeros."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()])
    good = np.flatnonzero(lengths == dim)
    out = np.zeros((len(column), dim))
    if len(good):
        values = pc.list_flatten(column.take(pa.array(good)))
        out[good] = np.nan_to_num(values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim))
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1.0)[:, None]


def _unit(vector: list[float] | None) -> np.ndarray:
    v = np.nan_to_num(np.array(vector or [], np.float64))
    return v / (np.sqrt((v * v).sum()) or 1.0)


def _best(block: list[tuple], k: int, probed: dict[int, np.ndarray] | None, queries: str, ids: str):
    """A function over batches of (id, vector[, list]) that gives the k best (query_id, id, score) of each query of the block.

    probed: for each list the queries that look into it, as packed bits. Scores are made tile by tile, and of a tile only what
    can be among the k best is taken out, so that a task holds a few tiles and k rows a query, whatever the block and the batch.
    """
    units = [_unit(v) for _, v in block]
    sizes = np.array([len(u) for u in units])
    groups = [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]
    groups = [(n, at, np.array([units[i] for i in at]).reshape(len(at), n)) for n, at in groups]
    names, count = [q for q, _ in block], len(block)
    del block, units

    def best_of(score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of scores that reach the least of their row; where those are many, the k best of each row, ties by column."""
        fits = score >= least[:, None]
        width = score.shape[1]
        if width <= k or np.count_nonzero(fits) <= 4 * k * len(score):
            return np.nonzero(fits)
        part = np.argpartition(score * width - np.arange(width), width - k, axis=1)[:, width - k :]
        a, b = np.nonzero(np.take_along_axis(fits, part, axis=1))
        return a, part[a, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_id, kind = np.full((count, k), -1.0), None, None  # scores in millionths, -1 where there is none yet
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")  # so that ties in a tile go by column
            own = batch.column(0).to_numpy(zero_copy_only=False)[order]
            lists = batch.column(2).to_numpy(zero_copy_only=False)[order] if probed is not None else np.zeros(len(own), np.int64)
            if held_id is None:
                kind, held_id = batch.column(0).type, np.full((count, k), own[0], own.dtype)
                try:
                    asker = pa.array(names, kind).to_numpy(zero_copy_only=False)
                except (pa.ArrowInvalid, pa.ArrowTypeError):  # ids of another type are never a query's own
                    asker = None
            for dim, at, matrix in groups:
                v = _matrix(batch.column(1), dim)[order]
                for number in np.unique(lists):
                    among = np.flatnonzero(lists == number)
                    some = np.arange(len(at)) if probed is None else np.flatnonzero(np.unpackbits(probed[int(number)], count=count)[at])
                    for x in range(0, len(some), TILE[0]):
                        q, asked = matrix[some[x : x + TILE[0]]], at[some[x : x + TILE[0]]]
                        for y in range(0, len(among), TILE[1]):
                            rows = among[y : y + TILE[1]]
                            score = q @ v[rows].T
                            np.clip(score, 0.0, 1.0, out=score)
                            np.rint(np.multiply(score, 1e6, out=score), out=score)
                            if asker is not None:
                                low, high = (np.searchsorted(own[rows], asker[asked], side) for side in ("left", "right"))
                                for i in np.flatnonzero(high > low):
                                    score[i, low[i] : high[i]] = -1.0
                            a, b = best_of(score, np.maximum(held[asked, k - 1], 0.0))
                            if not len(a):
                                continue
                            new, place = np.unique(a, return_inverse=True)
                            mine = asked[new]
                            by = np.concatenate((np.repeat(np.arange(len(mine)), k), place))
                            points, found = np.concatenate((held[mine].ravel(), score[a, b])), np.concatenate((held_id[mine].ravel(), own[rows[b]]))
                            to = np.lexsort((found, -points, by))
                            to = to[np.arange(len(to)) - np.searchsorted(by[to], by[to]) < k]
                            held[mine], held_id[mine] = points[to].reshape(-1, k), found[to].reshape(-1, k)
        for x in range(0, count if held_id is not None else 0, TILE[0]):
            a, b = np.nonzero(held[x : x + TILE[0]] >= 0)
            columns = [pa.array([names[x + i] for i in a.tolist()]), pa.array(held_id[x + a, b].tolist(), kind), pa.array(held[x + a, b] / 1e6)]
            if len(a):
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    return run, f"query_id {queries}, id {ids}, score double"


def _query_blocks(queries: DataFrame, query_bytes: int, most: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in queries.where("query_id is not null").select("query_id", "query_vector").toLocalIterator():
        block.append((r[0], r[1]))
        size += 8 * len(r[1] or ())
        if size >= query_bytes or len(block) >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(rows: DataFrame, queries: DataFrame, k: int, query_bytes: int, probes=None, most: int = QUERY_BLOCK) -> DataFrame:
    """rows: id, vector and, with probes, list. probes(block): for each list the queries that look into it, as packed bits."""
    spark, rows = rows.sparkSession, rows.where("id is not null")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    path, any_ = fresh_path(spark, "nearest"), False
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    schema = f"query_id {kind(queries, 'query_id')}, id {kind(rows, 'id')}, score double, rank int"
    for block in _query_blocks(queries, query_bytes, max(1, min(most, HELD // k))):
        probed = None if probes is None else probes(block)
        among = rows
        if probed is not None:
            among = rows.where(F.col("list").isin(sorted(probed)))  # prunes the folders of the other lists
        run, found = _best(block, k, probed, kind(queries, "query_id"), kind(rows, "id"))
        answer = among.mapInArrow(run, found).withColumn("rank", rank).where(F.col("rank") <= k)
        answer.write.mode("append").parquet(path)
        any_ = True
    return spark.read.schema(schema).parquet(path) if any_ else spark.createDataFrame([], schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", allowed: DataFrame | None = None, query_bytes: int = QUERY_BYTES, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank of the k nearest vectors of each query by cosine, exact, never the query's own id.

    queries: query_id, query_vector. where, and allowed (the ids, in a column named as id_col, that the asker may see),
    leave rows out before the k best are taken. A null vector, or one of another length, scores 0. Ties go by id. Null ids are
    never found and never ask.
    """
    rows = vectors if where is None else vectors.where(where)
    rows = rows if allowed is None else rows.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    return _search(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), queries, k, query_bytes, most=block)


def nearest_in(rows: DataFrame, queries: DataFrame, k: int, lists) -> DataFrame:
    """As nearest, over rows (id, vector, list: an int), each query among its own lists: lists(block of (query_id, vector)) names them, a set a query."""

    def bits(block: list[tuple]) -> dict[int, np.ndarray]:
        of: dict[int, list[int]] = {}
        for n, own in enumerate(lists(block)):
            for number in own:
                of.setdefault(int(number), []).append(n)
        return {number: np.packbits(np.isin(np.arange(len(block)), members)) for number, members in of.items()}

    return _search(rows, queries, k, QUERY_BYTES, bits)


# ---- the index


def fit_centroids(vectors: DataFrame, n_lists: int, vector_col: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 42) -> list[list[float]]:
    """At most n_lists unit vectors that stand for lists, by k-means with the cosine distance on at most `sample` vectors (those with the smallest hashes)."""
    usable = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    dim = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dim is None:
        return []
    rows = usable.where(F.size("v") == dim["n"]).orderBy(F.xxhash64("v"), "v").limit(sample).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, n_lists), distanceMeasure="cosine", maxIter=rounds, seed=seed).fit(rows)
    return [_unit(list(map(float, c))).tolist() for c in model.clusterCenters()]


def _nearest_lists(units: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n lists nearest to each row, the nearest first, ties by number; a tile of rows and lists at a time."""
    out = np.zeros((len(units), min(n, len(centroids))), np.int32)
    step = max(1, TILE[0] * TILE[1] // len(centroids))
    for x in range(0, len(units), step):
        near = np.round(units[x : x + step] @ centroids.T, 12)
        out[x : x + step] = near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
    return out


def build_index(vectors: DataFrame, path: str, n_lists: int = 128, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), sample: int = SAMPLE) -> int:
    """Writes all vectors with an id to path/lists, dealt to folders by list, and the centroids to path/centroids. Returns the number of lists.

    keep: columns for filters of later searches. Vectors that no centroid fits (null, zero, another length) are in list 0.
    Rows are ordered by list and id over the partitions, so that a list that holds very many vectors is many files.
    """
    spark = vectors.sparkSession
    centroids = fit_centroids(vectors, n_lists, vector_col, sample) or [[0.0]]
    spark.createDataFrame(list(enumerate(centroids)), "list long, centroid array<double>").write.parquet(f"{path}/centroids")
    matrix, dim = np.array(centroids), len(centroids[0])
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *keep)
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _nearest_lists(_matrix(batch.column(1), dim), matrix, 1)[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], names=[*batch.schema.names, "list"])

    rows.mapInArrow(assign, schema).repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/lists")
    return len(centroids)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, n_probe: int = 16, where: Column | None = None, allowed: DataFrame | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """As nearest, from an index, in the n_probe lists nearest to each query. where: a condition on id and the kept columns; allowed: id."""
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])  # one row a list
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/lists")
    rows = rows if where is None else rows.where(where)
    rows = rows if allowed is None else rows.join(allowed.select("id").distinct(), "id", "left_semi")

    def probes(block: list[tuple]) -> dict[int, np.ndarray]:
        units = np.array([u if len(u) == centroids.shape[1] else np.zeros(centroids.shape[1]) for u in (_unit(v) for _, v in block)])
        looks = np.zeros((len(centroids), len(block)), bool)
        looks[_nearest_lists(units, centroids, n_probe), np.arange(len(block))[:, None]] = True
        return {int(n): np.packbits(looks[n]) for n in np.flatnonzero(looks.any(axis=1))}

    return _search(rows.select("id", "vector", "list"), queries, k, query_bytes, probes, max(1, min(QUERY_BLOCK, PLACES // len(centroids))))


def probes_for(spark: SparkSession, path: str, recall: float = 0.95, k: int = 10, sample: int = 256) -> int:
    """The least number of probes with which the k nearest of a bounded sample of the index's own vectors are found to this share.

    The sample (the smallest hashes of ids) is searched exactly, over all rows; then the place of each true neighbour's
    list in its query's order of lists says how many probes it takes. Vectors without structure take most of the lists.
    """
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])
    rows = spark.read.parquet(f"{path}/lists")
    queries = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    near = nearest(rows, queries, k, id_col="id", vector_col="vector").select("query_id", "id")
    found = rows.join(F.broadcast(near), "id").select("query_id", "list").collect()  # k rows a query of the sample
    units = {r[0]: _unit(r[1]) for r in queries.collect()}
    places = [0] * len(centroids)
    for r in found:
        u = units[r["query_id"]]
        order = _nearest_lists(np.array([u if len(u) == centroids.shape[1] else np.zeros(centroids.shape[1])]), centroids, len(centroids))[0]
        places[int(np.flatnonzero(order == r["list"])[0])] += 1
    enough = np.flatnonzero(np.cumsum(places) >= recall * len(found))
    return int(enough[0]) + 1 if len(enough) else len(centroids)


def recall_against(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, n_true, n_found (of the true ones), recall; exact and found: query_id, id."""
    hits = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    out = exact.select("query_id", "id").distinct().join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", F.round(F.col("n_found") / F.col("n_true"), 4))


def document_vectors(chunks: DataFrame, doc_col: str, vector_col: str = "embedding") -> DataFrame:
    """doc, vector: the mean of each document's chunk vectors, place by place."""
    places = chunks.select(F.col(doc_col).alias("doc"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("at", "x"))
    means = places.groupBy("doc", "at").agg(F.avg("x").alias("x"))
    ordered = means.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return ordered.select("doc", F.transform("v", lambda p: p["x"]).alias("vector"))


def coarse_then_fine(found: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 10, doc_col: str = "doc", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank of the k nearest chunks among the documents found for each query. found: query_id, id (a document)."""
    asked = found.select("query_id", F.col("id").alias("doc")).distinct().join(queries.select("query_id", "query_vector"), "query_id")
    rows = chunks.select(F.col(doc_col).alias("doc"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).join(asked, "doc").where("id <> query_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [float(a @ b) if len(a) == len(b) else 0.0 for a, b in zip(map(_unit, batch.column(2).to_pylist()), map(_unit, batch.column(3).to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.clip(values, 0.0, 1.0), 6), pa.float64())], names=["query_id", "id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scored = rows.select("query_id", "id", "vector", "query_vector").mapInArrow(score, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def lists_of(n_rows: int) -> int:
    """A number of lists that fits a number of rows: its square root, 2 to 65,536."""
    return max(2, min(65_536, math.isqrt(n_rows)))


#: Vectors in one row of a join of packs.
PACK = 512


def _packs(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, ids, vectors: the rows (key, id, unit) of each key in packs of PACK, from rows in the order of the key."""

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, units, types = None, [], [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v], kind) for v, kind in zip(last, types, strict=True)], pa.array([ids]), pa.array([units], pa.list_(pa.list_(pa.float64())))], names=[*key, "ids", "units"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in key]
            for r in batch.to_pylist():
                own = tuple(r[c] for c in key)
                if ids and (own != last or len(ids) >= PACK):
                    yield row()
                    ids, units = [], []
                last = own
                ids.append(r["id"])
                units.append(r["unit"])
        if ids:
            yield row()

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in key], f"ids array<{kinds['id']}>", "units array<array<double>>"])
    # By key and id over the partitions, so that a key with very many vectors is many tasks' and packs.
    return rows.select(*key, "id", "unit").repartitionByRange(*key, "id").sortWithinPartitions(*key, "id").mapInArrow(pack, schema)


def alike_vectors(entities: DataFrame, block: str, least: float = 0.92, n_lists: int = 64, id_col: str = "id", vector_col: str = "vector", guarded: DataFrame | None = None) -> DataFrame:
    """a, b (a < b by id), score of pairs of one block whose vectors' cosine, to six places, is at least `least`; exact.

    Equal vectors of a block are one class, which the smallest id stands for: pairs are those between such ids, and each
    other id with its class's (score 1), so that a large group of copies is no square of pairs.
    Vectors are dealt to lists by their nearest centroid. A vector is compared with the lists in which one within the
    angle can be: those whose centroid is no further than that angle and the list's own widest angle. Lists are joined
    as packs, by block and list. guarded: values of block whose entities are never merged. Nulls and zero vectors, and
    vectors of another length than most, have no pairs. least: more than 0.
    """
    rows = entities if guarded is None else entities.join(guarded.select(block).distinct(), block, "left_anti")
    rows = rows.where(F.col(block).isNotNull() & F.col(id_col).isNotNull()).select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    classes = saved(rows.groupBy("block", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    centroids, copied = fit_centroids(classes, n_lists, "vector"), classes.where("n > 1").select("block", "vector", F.col("id").alias("a"))
    matrix, slack = np.array(centroids or [[0.0]]), 1e-6
    theta = math.acos(min(1.0, least - 1e-6))

    def angles(units: np.ndarray) -> np.ndarray:
        """Of each vector, to each centroid."""
        return np.arccos(np.clip(units @ matrix.T, -1.0, 1.0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _matrix(batch.column(2), matrix.shape[1])
            good = np.flatnonzero((units * units).sum(axis=1) > 0)
            apart = angles(units[good])
            lists = apart.argmin(axis=1) if len(good) else np.zeros(0, np.int64)
            own = batch.take(pa.array(good))
            widest = apart[np.arange(len(good)), lists]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(lists), pa.array(widest), pa.array(units[good].tolist(), pa.list_(pa.float64()))], names=["block", "id", "list", "angle", "unit"])

    own = saved(classes.select("block", "id", "vector").mapInArrow(assign, f"block {kinds['block']}, id {kinds['id']}, list long, angle double, unit array<double>"), "assigned")
    widest = {r[0]: r[1] for r in own.groupBy("list").agg(F.max("angle")).collect()}  # a row a list
    reach = np.array([widest.get(k, -10.0) for k in range(len(matrix))]) + theta + slack

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = np.array(batch.column(2).to_pylist()).reshape(len(batch), -1)
            at, lists = np.nonzero(angles(units) <= reach) if len(batch) else (np.zeros(0, np.int64),) * 2
            for a in range(0, len(at), 10_000):
                part = batch.take(pa.array(at[a : a + 10_000]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lists[a : a + 10_000])], names=["block", "id", "unit", "list"])

    asked = own.select("block", "id", "unit").mapInArrow(ask, f"block {kinds['block']}, id {kinds['id']}, unit array<double>, list long")
    left = _packs(own, ["block", "list"])
    right = _packs(asked, ["block", "list"]).withColumnsRenamed({"ids": "ids2", "units": "units2"})
    pairs = left.join(right, ["block", "list"]).select("ids", "units", "ids2", "units2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                a, u, b, v = (batch.column(c)[k].as_py() for c in range(4))
                score = np.round(np.clip(np.array(u) @ np.array(v).T, 0.0, 1.0), 6)
                x, y = np.nonzero(score >= least)
                found = [(a[i], b[j], float(score[i, j])) for i, j in zip(x.tolist(), y.tolist(), strict=True) if a[i] < b[j]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["a", "b", "score"])

    between = pairs.mapInArrow(compare, f"a {kinds['id']}, b {kinds['id']}, score double")
    held = rows.where(F.size("vector") == matrix.shape[1]).join(copied, ["block", "vector"]).where("id <> a")
    return between.union(held.select("a", F.col("id").alias("b"), F.lit(1.0).alias("score")))
