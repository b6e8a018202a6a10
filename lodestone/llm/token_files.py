"""Token ids in seekable Zstandard files, read back by document.

File format: independent Zstandard frames (each at most ``frame_tokens`` ids unless one document is longer, cut only
between documents), then a skippable frame (magic 0x184D2A50) with the document index, then a skippable frame (magic
0x184D2A5E) with the seek table of the Zstandard seekable format: for each frame its compressed size, its
decompressed size and the low 32 bits of its content's XXH64, then the number of frames, a descriptor with the checksum
flag, and the magic 0x8F92EAB1. All integers are little-endian. Ids take 2 bytes if the vocabulary has at most 65,536
entries, else 4. The document index is itself Zstandard-compressed: the width (1 byte), the file's part and its number in the part
(8 each), the number of documents (8), then columns of ids (8 bytes), a null flag (1), frame numbers (4) and lengths (8). A
document's place in its frame follows from the lengths before it.

Rows are range-partitioned and sorted by doc_id, equal ids by their place in the input, so that many rows of one id (or null ids)
are spread over tasks too. Each task encodes its rows and closes a file after ``file_tokens`` ids, so memory is bounded. Files
are written by Spark's own writer, whose commit protocol keeps exactly one copy of each when executors are lost, into
any file system that Spark reaches: the archive travels as a binary value, which a cast to string leaves byte by byte and the text
writer copies as it is, and the writer's record separator is the last magic of the format. The order of documents is that of
(part, number in the part), which every file states itself; starts are summed within parts by a window, and the driver sees one row
for each part (as many as range partitions).

Null texts count as empty (the end id alone). Null ids come first. Repeated rows are all written; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from lodestone.llm.common import map_arrow, materialise, scratch_path
from lodestone.llm.tokens import encoder, vocabulary

INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, b"\xb1\xea\x92\x8f"
CHECKSUM_FLAG = 0x80


class ArchiveWriter:
    """Collects documents into one archive; ``close`` gives its bytes."""

    def __init__(self, width: int, frame_tokens: int, part: int = 0, number: int = 0):
        self.width, self.frame_bytes = width, frame_tokens * width
        self.part, self.number = part, number
        self.compressor = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[bytes] = []
        self.pending: list[bytes] = []
        self.size = self.tokens = 0
        self.ids: list[int | None] = []
        self.frame_of: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_raw(doc_id, ids.astype(f"<u{self.width}").tobytes())

    def add_raw(self, doc_id: int | None, raw: bytes) -> None:
        """``raw``: the ids in the file's width."""
        n = len(raw) // self.width
        if self.pending and self.size + len(raw) > self.frame_bytes:
            self._flush()
        self.ids.append(doc_id)
        self.frame_of.append(len(self.frames))
        self.lengths.append(n)
        self.pending.append(raw)
        self.size += len(raw)
        self.tokens += n

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        packed = self.compressor.compress(raw)
        self.frames.append(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> bytes:
        if self.pending:
            self._flush()
        index = self.compressor.compress(
            struct.pack("<BQQQ", self.width, self.part, self.number, len(self.ids))
            + np.array([x or 0 for x in self.ids], "<i8").tobytes()
            + np.array([x is None for x in self.ids], np.uint8).tobytes()
            + np.array(self.frame_of, "<u4").tobytes()
            + np.array(self.lengths, "<u8").tobytes()
        )
        table = b"".join(self.table) + struct.pack("<IB", len(self.frames), CHECKSUM_FLAG) + SEEK_MAGIC
        return b"".join(
            [
                *self.frames,
                struct.pack("<II", INDEX_MAGIC, len(index)),
                index,
                struct.pack("<II", TABLE_MAGIC, len(table)),
                table,
            ]
        )


@dataclass
class Archive:
    """Reader of one archive: decompresses only the frames of the documents that are asked for."""

    data: bytes

    def __post_init__(self) -> None:
        data = memoryview(self.data)
        if bytes(data[-4:]) != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        frames, flags = struct.unpack("<IB", data[-9:-4])
        if not flags & CHECKSUM_FLAG:
            raise ValueError("the seek table has no checksums")
        at = len(data) - 9 - 12 * frames
        magic, size = struct.unpack("<II", data[at - 8 : at])
        if magic != TABLE_MAGIC or size != 12 * frames + 9:
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(data[at : at + 12 * frames], "<u4").reshape(frames, 3)
        self.places = np.concatenate(([0], np.cumsum(self.entries[:, 0].astype(np.int64))))
        start = int(self.places[-1])
        magic, size = struct.unpack("<II", data[start : start + 8])
        if magic != INDEX_MAGIC or start + 8 + size != at - 8:
            raise ValueError("damaged document index")
        self.decompressor = zstandard.ZstdDecompressor()
        index = self.decompressor.decompress(data[start + 8 : start + 8 + size])
        self.width, self.part, self.number, n = struct.unpack("<BQQQ", index[:25])
        at = 25
        columns = []
        for kind in ("<i8", "u1", "<u4", "<u8"):
            end = at + n * np.dtype(kind).itemsize
            columns.append(np.frombuffer(index[at:end], kind))
            at = end
        self.ids, self.null, self.frame_of, lengths = columns
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths  # in this archive
        first = np.searchsorted(self.frame_of, np.arange(frames))
        self.in_frame = self.starts - self.starts[first][self.frame_of] if n else self.starts

    def frame(self, k: int) -> bytes:
        raw = self.decompressor.decompress(memoryview(self.data)[self.places[k] : self.places[k + 1]])
        if len(raw) != self.entries[k, 1] or xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this archive, ids) of the wanted documents, or of all."""
        held, raw = -1, b""
        for i, doc_id in enumerate(self.ids.tolist()):
            doc_id = None if self.null[i] else doc_id
            if wanted is not None and doc_id not in wanted:
                continue
            if self.frame_of[i] != held:
                held = int(self.frame_of[i])
                raw = self.frame(held)
            yield doc_id, int(self.starts[i]), np.frombuffer(raw, f"<u{self.width}", int(self.lengths[i]), int(self.in_frame[i]) * self.width)


def write(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, frame_tokens: int = 1 << 16, file_tokens: int = 1 << 23
) -> None:
    """Writes the ids of all documents, in ascending doc_id order, as archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
        code, part = encoder(tokenizer, False, width), TaskContext.get().partitionId()
        end = end_id.to_bytes(width, "little")
        out = ArchiveWriter(width, frame_tokens, part)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.add_raw(doc_id, code.encode(text.as_py() or "") + end)
                if out.tokens >= file_tokens:
                    yield _row(out.close())
                    out = ArchiveWriter(width, frame_tokens, part, out.number + 1)
        if out.ids:
            yield _row(out.close())

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place")
    )
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    # The separator after each record is the magic that every archive ends with.
    (
        map_arrow(ordered, run, "value binary", encodes=True)
        .select(F.col("value").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", SEEK_MAGIC.decode("latin-1"))
        .text(path)
    )


def _row(archive: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive[: -len(SEEK_MAGIC)]], pa.binary())], names=["value"])


FOUND = "part long, number long, doc_id long, at long, n_tokens long, ids_crc32 long"
FOUND_NAMES = ["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return raw.select("content").filter(F.length("content") > 0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, doc_id, at, n_tokens, ids_crc32) of all documents: every frame is decompressed and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                archive = Archive(content.as_py())
                rows = [(doc_id, at, len(ids), crc32(ids.astype("<u4").tobytes())) for doc_id, at, ids in archive.documents()]
                same = [pa.array(np.full(len(rows), x, np.int64)) for x in (archive.part, archive.number)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, pa.int64()) for c in cols]], names=FOUND_NAMES)

    return map_arrow(_files(spark, path), run, FOUND, encodes=True)  # a writer may follow in the same worker


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents in ``wanted`` (a list the caller bounds); other frames stay compressed."""
    ask = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                got = [(d, ids.astype(np.int64)) for d, _, ids in Archive(content.as_py()).documents(ask)]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int64()))],
                        names=["doc_id", "ids"],
                    )

    return map_arrow(_files(spark, path), run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write(docs, tokenizer, path, end_id)
    found = materialise(read(spark, path), "token-places")
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = list(accumulate((n for _, n in parts), initial=0))
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, before, strict=False)], "part long, base long")
    order = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = files.withColumn("before", F.sum("n").over(order) - F.col("n")).join(bases, "part")
    starts = starts.select("part", "number", (F.col("base") + F.col("before")).alias("base"))
    return found.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
