"""Tables with versions on shared storage: idempotent upserts, histories, shadow versions, swap and rollback.

Rows are dealt to buckets by a hash of their key. A commit writes the buckets that it changes to a new folder and then,
as its last act, a manifest: where each bucket's rows are, and the last batch of each stream. A manifest has the number of
its version, so of two writers at once one fails; whatever a failed commit has written is in no manifest and never read.
A batch of a stream that comes again (after a failure, say) has a number that the manifest knows, and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MANIFEST = "version long, kind string, name string, value string"


class VersionedTable:
    """A table at a path with a schema and key columns, which may not be null: rows with a null key are left out.

    Rows have two more columns. `version`: how often the key was written (upsert), or which of the key's intervals it is
    (append_history, which also keeps valid_from and valid_to). Extra columns of what is written are ignored; missing ones are an error.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.columns = [c for c in spark.createDataFrame([], schema).columns]
        self.stored = f"{schema}, version long"

    # ---- manifests

    def _entries(self, version: int | None = None) -> list:
        """Kind, name and value of the manifest of a version (None: the current one). A row a bucket and a stream."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/*")
            wanted = rows.agg(F.max("version")).first()[0] if version is None else version
            return rows.where(F.col("version") == wanted).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def version(self) -> int:
        """The current version; 0 for a table that was never written."""
        return max((r["version"] for r in self._entries()), default=0)

    def _commit(self, version: int, entries: dict[tuple[str, str], str]) -> int:
        rows = [(version, kind, name, value) for (kind, name), value in entries.items()] or [(version, "empty", "", "")]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifests/{version:09d}")
        return version

    @staticmethod
    def _folders(entries: list) -> dict[int, str]:
        return {int(r["name"]): r["value"] for r in entries if r["kind"] == "bucket"}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (None: the current one)."""
        return self._read(sorted(self._folders(self._entries(version)).values()))

    # ---- writes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, touched: list[int], version: int) -> dict[tuple[str, str], str]:
        """Writes the rows of the touched buckets and says where they are. A bucket's rows may be in many tasks."""
        folder = f"data/{version:09d}-{uuid.uuid4().hex}"  # its own, so that a commit that fails touches nothing live
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = {r[0] for r in self.spark.read.parquet(f"{self.path}/{folder}").select("bucket").distinct().collect()} if not rows.isEmpty() else set()
        return {("bucket", str(b)): f"{folder}/bucket={b}" for b in touched if b in there}

    def _merge(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], stream: str, batch: int | None) -> int:
        entries = self._entries()
        now, folders = max((r["version"] for r in entries), default=0), self._folders(entries)
        known = {r["name"]: int(r["value"]) for r in entries if r["kind"] == "stream"}
        if batch is not None and known.get(stream, -1) >= batch:
            return now
        new = rows.select(*self.columns).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys]))
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # `buckets` at most
        old = self._read([folders[b] for b in touched if b in folders])
        kept = {("bucket", str(b)): f for b, f in folders.items() if b not in touched}
        written = self._write(merged(old, new), touched, now + 1) if touched else {}
        streams = {("stream", s): str(b) for s, b in (known | ({stream: batch} if batch is not None else {})).items()}
        others = {(r["kind"], r["name"]): r["value"] for r in entries if r["kind"] in ("previous", "shadow")}
        return self._commit(now + 1, kept | written | streams | others)

    def upsert(self, rows: DataFrame, order: list[str] | None = None, stream: str = "", batch: int | None = None) -> int:
        """Rows replace those of their key, and their version is one more. Returns the table's version.

        Of several rows of a key the last by order counts (ties, or no order: the greatest row), and counts once. stream,
        batch: numbers that grow; a batch that is not above the stream's last one changes nothing.
        """

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            last = F.struct(F.struct(*(order or self.keys)).alias("by"), F.struct(*self.columns).alias("row"))
            one = new.groupBy(*self.keys).agg(F.max(last).alias("x")).select("x.row.*")
            before = old.select(*self.keys, F.col("version").alias("was"))
            fresh = one.join(before, self.keys, "left").select(*self.columns, (F.coalesce("was", F.lit(0)) + 1).cast("long").alias("version"))
            return old.join(one.select(*self.keys), self.keys, "left_anti").select(*self.columns, "version").union(fresh)

        return self._merge(rows, merged, stream, batch)

    def append_history(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> int:
        """Each row opens an interval of its key at valid_from, which closes the one before it (valid_to). Returns the table's version.

        The schema has valid_from and valid_to. Rows that are there already, of the same key and valid_from, are replaced;
        a row between two others gets its place. valid_to of what is given is ignored; version numbers the intervals.
        Within a bucket the intervals of one key are put in order in one task.
        """

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            fresh = new.groupBy(*self.keys, "valid_from").agg(F.max(F.struct(*self.columns)).alias("x")).select("x.*")
            both = old.select(*self.columns).join(fresh.select(*self.keys, "valid_from"), [*self.keys, "valid_from"], "left_anti").select(*self.columns).union(fresh.select(*self.columns))
            order = Window.partitionBy(*self.keys).orderBy("valid_from")
            return both.withColumns({"valid_to": F.lead("valid_from").over(order), "version": F.row_number().over(order).cast("long")}).select(*self.columns, "version")

        return self._merge(rows, merged, stream, batch)

    def sink(self, stream: str, order: list[str] | None = None, history: bool = False) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upserts (or appends to histories) each batch of a stream once, however often it comes."""

        def write(batch: DataFrame, number: int) -> None:
            if history:
                self.append_history(batch, stream, number)
            else:
                self.upsert(batch, order, stream, number)

        return write

    # ---- shadow versions

    def begin_shadow(self, rows: DataFrame) -> int:
        """Writes rows as a version that is not current. One shadow at a time: a new one takes the old one's place."""
        entries = self._entries()
        now = max((r["version"] for r in entries), default=0)
        folder = f"shadows/{now + 1:09d}-{uuid.uuid4().hex}"
        rows.select(*self.columns, F.lit(1).cast("long").alias("version")).withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        kept = {(r["kind"], r["name"]): r["value"] for r in entries if r["kind"] not in ("shadow", "empty")}
        return self._commit(now + 1, kept | {("shadow", ""): folder})

    def shadow(self) -> DataFrame | None:
        """The rows of the shadow, if there is one."""
        at = [r["value"] for r in self._entries() if r["kind"] == "shadow"]
        return self.spark.read.schema(f"{self.stored}, bucket int").parquet(f"{self.path}/{at[0]}").drop("bucket") if at else None

    def cancel_shadow(self) -> bool:
        """Forgets the shadow. False: there is none."""
        entries = self._entries()
        kept = {(r["kind"], r["name"]): r["value"] for r in entries if r["kind"] not in ("shadow", "empty")}
        if not any(r["kind"] == "shadow" for r in entries):
            return False
        self._commit(entries[0]["version"] + 1, kept)
        return True

    def swap(self) -> bool:
        """The shadow becomes current, in one step; the version before can come back. False: there is no shadow."""
        entries = self._entries()
        at = [r["value"] for r in entries if r["kind"] == "shadow"]
        if not at:
            return False
        now = entries[0]["version"]
        rows = self.spark.read.schema(f"{self.stored}, bucket int").parquet(f"{self.path}/{at[0]}")
        buckets = [r[0] for r in rows.select("bucket").distinct().collect()]
        streams = {(r["kind"], r["name"]): r["value"] for r in entries if r["kind"] == "stream"}
        self._commit(now + 1, {("bucket", str(b)): f"{at[0]}/bucket={b}" for b in buckets} | streams | {("previous", ""): str(now)})
        return True

    def rollback(self) -> int | None:
        """The rows of the version before the last swap are current again. Returns that version; None: there was no swap."""
        entries = self._entries()
        before = [int(r["value"]) for r in entries if r["kind"] == "previous"]
        if not before:
            return None
        kept = {(r["kind"], r["name"]): r["value"] for r in self._entries(before[0]) if r["kind"] == "bucket"}
        streams = {(r["kind"], r["name"]): r["value"] for r in entries if r["kind"] == "stream"}
        self._commit(entries[0]["version"] + 1, kept | streams)
        return before[0]
