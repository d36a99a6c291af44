"""Token ids in binary files of independent zstandard frames with a seek table (operator 8).

A file is a row of zstandard frames, one per document (its ids as little-endian unsigned 32-bit integers), then one
frame with the documents' ids (signed 64-bit; ``NO_ID`` stands for null), then the seek table of the public
seekable format: a skippable frame with compressed size, size and checksum (low 32 bits of XXH64 of the content) per
frame, and a footer. A reader takes the table from the end of the file and decompresses only the frames it wants.

Documents are dealt by ranges of doc_id, so files follow each other in ascending doc_id order. A task writes under a
name of its own attempt; the driver learns the names only from tasks that ended well, so a lost executor or a task
run twice leaves at most a file that nothing reads. The path must be one that pyarrow's file systems open on driver and
executors (file, hdfs, s3, gs), below the shared folder unless the caller gives another.

Null text is empty. Equal doc_ids keep the order of their ids and texts; null doc_ids come first. An empty table gives
no file and no row. Columns other than id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imputeflow.llm.encoding import SpacedEncoder, encoder_for
from imputeflow.llm.shared import shared_path, slices

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

NO_ID = -(1 << 63)
LEVEL = 1
FILES = "path string, first long, n_docs long, n_ids long"


class FrameWriter:
    """Append frames, then the seek table."""

    def __init__(self, sink):
        self.sink, self.table = sink, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, content: bytes) -> None:
        frame = self.packer.compress(content)
        self.sink.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


class FrameReader:
    """Random access to the frames of one file."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("the file has no seek table with checksums")
        source.seek(source.size() - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, i: int, raw: bytes | None = None) -> bytes:
        """Content of frame i, its checksum tested; ``raw`` is the frame where it was read before."""
        if raw is None:
            self.source.seek(int(self.starts[i]))
            raw = self.source.read(int(self.table[i, 0]))
        content = self.unpacker.decompress(raw, max_output_size=int(self.table[i, 1]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} doesn't match its checksum")
        return content

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self.frame(len(self.table) - 1), "<i8")

    def documents(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        """Ids of all documents in order, read in blocks of about that many bytes."""
        last, i = len(self.table) - 1, 0
        while i < last:
            j = max(i + 1, min(last, int(np.searchsorted(self.starts, self.starts[i] + block, "right")) - 1))
            self.source.seek(int(self.starts[i]))
            raw, base = self.source.read(int(self.starts[j] - self.starts[i])), self.starts[i]
            for k in range(i, j):
                yield np.frombuffer(self.frame(k, raw[self.starts[k] - base:self.starts[k + 1] - base]), "<u4")
            i = j


def _file(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)
    return system, name


def read_documents(path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of the wanted documents of one file; no other frame is decompressed."""
    system, name = _file(path)
    with system.open_input_file(name) as source:
        reader = FrameReader(source)
        wanted = set(doc_ids)
        return {int(d): np.frombuffer(reader.frame(i), "<u4")
                for i, d in enumerate(reader.doc_ids().tolist()) if d in wanted}


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 2, id_col: str = "doc_id",
                text_col: str = "text", files: int | None = None) -> list:
    """Encode and write; returns a row (path, first, n_docs, n_ids) per file in ascending doc_id order.

    Bounds of the ranges come from the id column alone: quantiles of it, so the texts are read and moved once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = files or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)})
    place = F.coalesce(_rank(cuts, F.col("doc_id")), F.lit(0)).cast("int")
    dealt = (rows.repartitionById(len(cuts) + 1, place)
             .sortWithinPartitions("doc_id", F.length("text"), "text"))
    system, name = _file(folder)
    system.create_dir(name, recursive=True)

    def write(batches):
        encoder = encoder_for(vocabulary, SpacedEncoder)
        target = f"{name}/{uuid.uuid4().hex}.ids.zst"
        writer, seen, total, first = None, [], 0, 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in slices(batches):
            if writer is None:
                out, _ = _file(folder)
                writer = FrameWriter(out.open_output_stream(target, compression=None))
            ids, counts = encoder.encode(batch.column("text"))
            keys = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            seen.append(keys)
            for own in np.split(ids, np.cumsum(counts)[:-1]):
                content = np.concatenate([own, tail])
                total += len(content)
                writer.add(content.astype("<u4").tobytes())
        if writer is not None:
            keys = np.concatenate(seen).astype("<i8")
            writer.add(keys.tobytes())
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [target], "first": pa.array([int(keys[0])], pa.int64()),
                                              "n_docs": pa.array([len(keys)], pa.int64()),
                                              "n_ids": pa.array([total], pa.int64())})

    return sorted(dealt.mapInArrow(write, FILES).collect(), key=lambda r: r["first"])


def _rank(cuts: list[int], value):
    """Number of cuts below the value, as nested comparisons of logarithmic depth."""
    def node(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > cuts[mid], node(mid + 1, hi)).otherwise(node(lo, mid))
    return node(0, len(cuts))


def read_files(spark: SparkSession, folder: str, files: list) -> DataFrame:
    """One row per document as the files hold it: doc_id, start, n_tokens, ids_crc32 and its place (file, frame)."""
    before = np.concatenate([[0], np.cumsum([r["n_ids"] for r in files], dtype=np.int64)])[:-1]
    listed = spark.createDataFrame([(r["path"], i, int(b)) for i, (r, b) in enumerate(zip(files, before, strict=True))],
                                   "path string, file int, before long")

    def read(batches):
        for batch in batches:
            for path, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, _ = _file(folder)
                with system.open_input_file(path) as source:
                    reader = FrameReader(source)
                    keys = reader.doc_ids()
                    sizes, sums = [], []
                    for ids in reader.documents():
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.tobytes()))
                n = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(keys, pa.int64(), mask=keys == NO_ID),
                    "start": pa.array(start + np.cumsum(n) - n), "n_tokens": pa.array(n),
                    "ids_crc32": pa.array(sums, pa.int64()), "file": pa.array([file] * len(n), pa.int32()),
                    "frame": pa.array(np.arange(len(n)))})

    return listed.repartition(max(1, len(files))).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, file int, frame long")


def token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int | None = 2,
                folder: str | None = None, **columns) -> DataFrame:
    """Write the documents' ids and read them back from the files."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    return read_files(spark, folder, write_files(docs, folder, vocabulary, end_id, **columns))
