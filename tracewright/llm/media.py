"""Media columns: payloads kept in archives, read back by a custom Spark data source.

``store`` writes one tar archive a partition into a shared folder: each text is a lossless 8-bit
greyscale PNG 576 samples wide, with an index of the members' offsets beside the archive. Archives
are named by partition and put in place by a rename, so a repeated task replaces its own archive.

The data source ``archive_members`` lists the archives of a folder, plans partitions of byte ranges
over them, and streams the members that begin in a range in Arrow batches of bounded size. A member
that can't be read or fails its checksum is tried again by its offset, on a fresh handle, alone.

Defined cases: a null or empty text is one row of 576 samples of 255; a null id is kept; repeated
rows are members each; an empty table gives no members; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch_path

WIDTH = 576
PAD = b"\xff"  # no byte of UTF-8
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + PAD * (-len(raw) % WIDTH if raw else WIDTH)


def png_of(payload: bytes) -> bytes:
    """A greyscale PNG of 8-bit samples, WIDTH a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + chunk(b"IEND", b"")


def samples_of(png: bytes) -> bytes:
    """The samples of a PNG that ``png_of`` made."""
    if png[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, data = 8, b""
    width = height = 0
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Mean, spread, entropy and mean step of the samples, and a 64-bit average hash of 64 runs."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    seen = share[share > 0]
    means = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) * 64 / len(x)
    code = int("".join("1" if m > means.mean() else "0" for m in means), 2)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(seen * np.log2(seen)).sum():.4f};step={step:.4f};ahash={code:016x}"


_INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("crc32", pa.int64())])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write the archives of ``df`` into ``folder``, a URI that all executors reach; the members written."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        task = TaskContext.get()
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}"
        own = f"{name}.{task.taskAttemptId()}"
        index: list[tuple] = []
        at = 0
        with fs.open_output_stream(f"{own}.writing") as out:
            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    png = png_of(payload_of(text))
                    head = tarfile.TarInfo(f"{len(index):09d}.png")
                    head.size = len(png)
                    block = head.tobuf(tarfile.USTAR_FORMAT)
                    out.write(block)
                    out.write(png)
                    out.write(bytes(-len(png) % 512))
                    index.append((doc, at + len(block), len(png), zlib.crc32(png)))
                    at += len(block) + len(png) + -len(png) % 512
            out.write(bytes(1024))
        cols = list(zip(*index, strict=True)) or [()] * 4
        table = pa.table([pa.array(list(c), f.type) for c, f in zip(cols, _INDEX, strict=True)], schema=_INDEX)
        buffer = io.BytesIO()
        with pa.ipc.new_file(buffer, _INDEX) as w:
            w.write_table(table)
        with fs.open_output_stream(f"{own}.writing-index") as out:
            out.write(buffer.getvalue())
        fs.move(f"{own}.writing-index", f"{name}.index")
        fs.move(f"{own}.writing", f"{name}.tar")
        yield pa.RecordBatch.from_arrays([pa.array([len(index)], pa.int64())], ["members"])

    return rows.mapInArrow(write, "members long").agg(F.sum("members")).first()[0] or 0


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MemberReader(DataSourceReader):
    BATCH = 4 << 20
    TRIES = 4

    def __init__(self, folder: str, split: int):
        self.folder, self.split = folder, split

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, base = _filesystem(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        sizes = sorted((f.path, f.size) for f in found if f.path.endswith(".tar"))
        return [ByteRange(p, at, at + self.split) for p, n in sizes for at in range(0, n, self.split)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = _filesystem(self.folder)
        with fs.open_input_file(partition.archive.removesuffix(".tar") + ".index") as f:
            index = pa.ipc.open_file(f.read_buffer()).read_all()
        offset = index.column("offset").to_numpy()
        own = np.flatnonzero((offset >= partition.start) & (offset < partition.end))
        rows = index.take(pa.array(own)).to_pylist()
        handle = fs.open_input_file(partition.archive)
        ids, media, size = [], [], 0
        for row in rows:
            for attempt in range(self.TRIES):
                try:
                    handle.seek(row["offset"])
                    png = handle.read(row["size"])
                    if zlib.crc32(png) != row["crc32"]:
                        raise OSError(f"{partition.archive} at {row['offset']}: checksum")
                    break
                except OSError:
                    if attempt == self.TRIES - 1:
                        raise
                    handle = fs.open_input_file(partition.archive)
            ids.append(row["doc_id"])
            media.append(png)
            size += len(png)
            if size >= self.BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])
                ids, media, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").option("path", folder).load()``: (doc_id, media)."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options["path"], int(self.options.get("splitbytes", 16 << 20)))


def members(spark: SparkSession, folder: str, split_bytes: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("path", folder).option("splitbytes", split_bytes).load()


def describe(media: DataFrame) -> DataFrame:
    """Decode (doc_id, media) rows and compute the digests and features of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, png in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                x = samples_of(png)
                out.append((doc, len(x.rstrip(PAD)), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(x)))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text of ``df`` as media, read it back through the data source and describe it."""
    folder = scratch_path(df.sparkSession, "archives")
    store(df, folder, id_col, text_col)
    return describe(members(df.sparkSession, folder))
