"""Inventory of a corpus of files: what is new or changed, and what no longer matches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK = 1 << 20


def sha256_of(uri: str, size: int) -> str:
    """SHA-256 of a file's first ``size`` bytes, CHUNK at a time, so memory doesn't follow the size."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        store, path = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        store, path = fs.FileSystem.from_uri(quote(uri.replace("s3a:", "s3:", 1), safe=":/@"))
    h, left = hashlib.sha256(), size
    with store.open_input_file(path) as f:
        while left:
            chunk = f.read(min(CHUNK, left))
            if not chunk:
                raise OSError(f"{uri}: {left} of {size} bytes are missing")
            h.update(chunk)
            left -= len(chunk)
    return h.hexdigest()


def _at_store(spark: SparkSession, folder: str) -> Column:
    """A listed file's path at the store behind ``folder``, whose own path may be a mount table's (viewfs)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed, real = store.makeQualified(path).toString(), store.resolvePath(path).toString()
    return F.concat(F.lit(real), F.substring("path", len(listed) + 1, 1 << 20))


MANIFEST = "path string, size bigint, mtime timestamp, sha256 string, run int"


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime, uri) of the files below ``folder``; none is opened.

    Spark lists no empty files and none whose name begins with ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), _at_store(spark, folder).alias("uri"))


def hashed(files: DataFrame, counter: Accumulator | None = None) -> DataFrame:
    """Files of (path, size, mtime, uri) with their SHA-256, each streamed once by one task; ``counter`` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [sha256_of(u, n) for u, n in zip(b.column("uri").to_pylist(), b.column("size").to_pylist(), strict=True)]
            if counter is not None:
                counter.add(len(sums))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size"), b.column("mtime"), pa.array(sums, pa.string())], ["path", "size", "mtime", "sha256"])

    # files are dealt out by path, so a few large ones don't follow each other in the task that listed them
    return files.repartition("path").mapInArrow(run, "path string, size bigint, mtime timestamp, sha256 string")


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime, sha256) of the files below ``folder``."""
    return hashed(listing(spark, folder, glob))


def changed(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest doesn't have with that path, size and time."""
    return found.join(manifest.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def read(spark: SparkSession, table: str) -> DataFrame:
    """Every row that runs have appended to a manifest; none if there is no manifest yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(table)


def current(manifest: DataFrame) -> DataFrame:
    """The latest row of each path."""
    last = manifest.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "sha256", "run"), "run").alias("m"))
    return last.select("path", "m.*")


def append(files: DataFrame, table: str, run: int, counter: Accumulator | None = None) -> None:
    """Hash files of (path, size, mtime, uri) and add them to the manifest at ``table``."""
    hashed(files, counter).withColumn("run", F.lit(run)).write.mode("append").parquet(table)


def update(spark: SparkSession, folder: str, table: str, glob: str = "*", counter: Accumulator | None = None) -> DataFrame:
    """Append to the manifest at ``table`` what is new or changed below ``folder``; the rows appended.

    Path, size and time are compared before any byte is read, and only what the manifest lacks is hashed, once,
    as the rows are written. A run that finds nothing new appends nothing; one that fails before its rows are
    committed leaves the manifest as it was.
    """
    known = current(read(spark, table))
    run = (known.agg(F.max("run")).head()[0] or 0) + 1
    new = changed(listing(spark, folder, glob), known)
    if new.limit(1).count():
        append(new, table, run, counter)
    return read(spark, table).where(F.col("run") == run)


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): ok, corrupt, missing or unlisted."""
    both = manifest.select("path", F.col("sha256").alias("was")).join(found.select("path", F.col("sha256").alias("now")), "path", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("was") == F.col("now"), "ok").otherwise("corrupt")
    return both.select("path", state.alias("state"))
