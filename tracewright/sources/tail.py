"""Live tail of growing log files: a streaming source whose offset is the bytes read of each file.

``spark.readStream.format("jsonl_tail").option("path", folder)`` gives (file, start, value): the file's path, the
byte at which the line begins, and the line. Appended lines are read once; a line without its newline
waits until it is whole. A file that has become shorter than what was read of it is read anew from its start.
Lines are read by byte ranges of at most ``rangeBytes``, cut at newlines by the reader of a range, so one large file is many
tasks. ``maxBytesPerTrigger`` bounds a batch; files then follow each other by path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start bigint, value string"
RANGE_BYTES = 32 << 20
PIECE = 1 << 20
BATCH_LINES = 4096


def store_of(folder: str):
    """(file system, path) of a local path or URI."""
    from pyarrow import fs

    scheme, sep, rest = folder.partition(":")
    if not sep or "/" in scheme:
        return fs.LocalFileSystem(), folder
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(folder.replace("s3a:", "s3:", 1), safe=":/@"))


def whole_lines(store, path: str, start: int, size: int) -> int:
    """The byte after the last newline between ``start`` and ``size``, read backward; ``start`` if there is none."""
    with store.open_input_file(path) as f:
        end = size
        while end > start:
            at = max(start, end - PIECE)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return start


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file, of which whole lines reach to ``limit``."""

    path: str
    start: int
    end: int
    limit: int
    first: bool


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.most = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 1 << 62)))
        self.suffix = options.get("suffix", ".jsonl")
        self.given: dict[str, int] = {}  # what the last offset had of each file

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole lines of each file, no more than ``maxBytesPerTrigger`` beyond the last offset given."""
        from pyarrow import fs

        store, path = store_of(self.folder)
        found = [i for i in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and i.path.endswith(self.suffix)]
        out, left = dict(self.given), self.most
        for i in sorted(found, key=lambda i: i.path):
            had = out.get(i.path, 0)
            had = 0 if i.size < had else had
            if i.size == had or left <= 0:
                continue
            end = whole_lines(store, i.path, had, i.size)
            if end - had > left:
                end = whole_lines(store, i.path, had, had + left)
                if end == had and left < self.most:
                    continue
                if end == had:  # a line longer than a batch is one of its own
                    end = self._first_line(store, i.path, had, i.size)
            left -= end - had
            if end != out.get(i.path, 0):
                out[i.path] = end
        self.given = out
        return out

    @staticmethod
    def _first_line(store, path: str, start: int, size: int) -> int:
        with store.open_input_file(path) as f:
            f.seek(start)
            at = start
            while at < size:
                piece = f.read(min(PIECE, size - at))
                found = piece.find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += len(piece)
        return start

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, limit in sorted(end.items()):
            had = start.get(path, 0)
            if limit == had:
                continue
            begin = 0 if limit < had else had
            for at in range(begin, limit, self.range_bytes):
                out.append(Range(path, at, min(at + self.range_bytes, limit), limit, at == begin))
        if not self.given:  # after a restart the log's offset is where this reader goes on
            self.given = dict(end)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.folder)
        files, starts, lines = [], [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], ["file", "start", "value"])

        with store.open_input_file(partition.path) as f:
            at = partition.start
            if not partition.first:  # a line that began before belongs to the range before
                f.seek(at - 1)
                at = self._first_line_in(f, at - 1, partition.limit)
            f.seek(at)
            rest = b""
            read_to = at
            while at < partition.end:
                piece = f.read(min(PIECE, partition.limit - read_to))
                if not piece:
                    break
                read_to += len(piece)
                *whole, rest = (rest + piece).split(b"\n")
                for line in whole:
                    if at >= partition.end:
                        break
                    files.append(partition.path)
                    starts.append(at)
                    lines.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                    if len(lines) == BATCH_LINES:
                        yield batch()
                        files, starts, lines = [], [], []
        if lines:
            yield batch()

    @staticmethod
    def _first_line_in(f, at: int, limit: int) -> int:
        while at < limit:
            piece = f.read(min(PIECE, limit - at))
            found = piece.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(piece)
        return limit

    def commit(self, end: dict) -> None:
        pass


class JsonlTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, folder: str, max_bytes: int | None = None, range_bytes: int = RANGE_BYTES, suffix: str = ".jsonl"):
    """A stream of (file, start, value) of the files below ``folder`` whose names end with ``suffix``."""
    spark.dataSource.register(JsonlTail)
    r = spark.readStream.format("jsonl_tail").option("path", folder).option("rangeBytes", range_bytes).option("suffix", suffix)
    return (r.option("maxBytesPerTrigger", max_bytes) if max_bytes else r).load()
