"""Token files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file is a zstandard stream that any decoder reads from end to end: data frames of about FRAME_BYTES of token ids (a
document's ids are not cut), a skippable frame with the documents' ids and lengths, and a skippable frame with the seek
table in the layout of the public seekable format: for each frame its compressed and decompressed size and the low 32
bits of the XXH64 of its content, then the number of frames, a descriptor and a magic number. A reader of some documents
reads the tail of the file and decompresses only the frames that hold them.

Scale: texts are shuffled once, by ranges of the document id, and encoded after it; each task writes files of its own
range and reports them in a manifest, which is written as a table: a lost task's files are never in it. The offsets
of all files follow from the manifest, one small row for each file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh_path, quoted, written
from .encoding import END_ID, encoder, slices, tokenizer_path

FRAME_BYTES = 1 << 20
#: Token ids in one file at most, but for a document that is longer.
FILE_BYTES = 256 << 20
# Fixed values of the seekable format; the index frame uses another of the numbers left to users.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC, DESCRIPTOR = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80


class Writer:
    """Writes documents' ids to one file of the format, frame by frame."""

    def __init__(self, folder: str, name: str, frame_bytes: int):
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        self.name, self.frame_bytes = name, frame_bytes
        self.out = files.open_output_stream(f"{base}/{name}", compression=None)
        self.zip = zstandard.ZstdCompressor(level=3)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.buffer: list[bytes] = []
        self.held = self.size = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.buffer.append(ids)
        self.held += len(ids)
        self.size += len(ids)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.buffer)
            frame = self.zip.compress(raw)
            self.out.write(frame)
            self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        known = np.array([d is not None for d in self.docs], np.uint8)
        index = struct.pack("<I", len(self.docs)) + known.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes()
        body = self.zip.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.entries.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), DESCRIPTOR, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(footer)) + table + footer)
        self.out.close()


def read_file(folder: str, name: str, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, position of its first id in the file, ids) of all documents, or of those wanted, in the file's order.

    Raises ValueError where a checksum, a size or a magic number doesn't fit.
    """
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/{name}") as f:
        size = f.size()
        n, descriptor, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEK_MAGIC or descriptor != DESCRIPTOR:
            raise ValueError(f"{name}: no seek table")
        table = np.frombuffer(f.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        places, raw_at = np.concatenate(([0], np.cumsum(table[:, 0]))), np.concatenate(([0], np.cumsum(table[:, 1])))
        unzip = zstandard.ZstdDecompressor()
        index = unzip.decompress(f.read_at(int(table[-1, 0]) - 8, int(places[n - 1]) + 8))
        (count,) = struct.unpack_from("<I", index)
        known = np.frombuffer(index, np.uint8, count, 4)
        docs, lengths = np.frombuffer(index, "<i8", count, 4 + count), np.frombuffer(index, "<u4", count, 4 + 9 * count)
        starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        frames = np.searchsorted(raw_at[:n], starts[:-1] * 4, side="right") - 1
        last, raw = -1, b""
        for i in range(count):
            doc = int(docs[i]) if known[i] else None
            if wanted is not None and doc not in wanted:
                continue
            if (k := int(frames[i])) != last:
                raw = unzip.decompress(f.read_at(int(table[k, 0]), int(places[k])))
                if len(raw) != table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != table[k, 2]:
                    raise ValueError(f"{name}: frame {k} is damaged")
                last = k
            at = int(starts[i]) * 4 - int(raw_at[k])
            yield doc, int(starts[i]), raw[at : at + int(lengths[i]) * 4]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, spaces: bool = True, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES, special: bool = True) -> DataFrame:
    """Writes all documents in ascending id order and returns the manifest: part, seq, file, n_docs, n_tokens, start.

    Each text's ids are followed by END_ID; null text counts as empty, so it is END_ID alone. Rows without an id come
    first; rows that share an id are kept, in the order of their texts' hashes. An empty table gives an empty manifest.
    start: ids of all files before. special: as in encoder().
    """
    folder = folder.rstrip("/")
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = encoder(tokenizer, spaces, special), TaskContext.get().partitionId(), []
        end, out = struct.pack("<I", END_ID), None

        def close() -> None:
            out.close()
            done.append({"part": part, "seq": len(done), "file": out.name, "n_docs": len(out.docs), "n_tokens": out.size // 4})

        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                if out is not None and out.size >= file_bytes:
                    close()
                    out = None
                out = out or Writer(folder, f"{part:08d}-{len(done):04d}-{uuid.uuid4().hex}.tok.zst", frame_bytes)
                out.add(doc, ids + end)
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, _MANIFEST)

    manifest = written(rows.mapInArrow(write, "part int, seq int, file string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents of the files, or of those wanted, from the files alone."""
    some = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows = []
                for doc, at, ids in read_file(folder, x["file"], some):
                    rows.append({"doc_id": doc, "start": x["start"] + at, "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _READ)

    files = max(1, min(manifest.count(), 20_000))
    return manifest.select("file", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    manifest = write_token_files(documents(spark, sf_dir), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(manifest, folder)
