"""Idempotent sinks: payload rows as JSON by project, stream batches by their number, what was skipped.

A repeated run changes nothing: writing replaces the partitions that the rows belong to and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PAYLOADS = "payload string, project string"


def as_json(rows: DataFrame, by: str = "project", pretty: bool = False) -> DataFrame:
    """(project, payload): each row's other columns as one JSON text."""
    fields = F.struct(*[c for c in rows.columns if c != by])
    return rows.select(F.col(by).cast("string").alias("project"), F.to_json(fields, {"pretty": "true"} if pretty else {}).alias("payload"))


def write_payloads(payloads: DataFrame, folder: str) -> None:
    """Replace the rows of the projects in ``payloads``; other projects' stay. One project's rows go to one task's files.

    A null project is a partition of its own.
    """
    payloads.select("payload", "project").repartition("project").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(folder)


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PAYLOADS).parquet(folder)


def batch_writer(folder: str, by: str = "project"):
    """For ``foreachBatch``: each batch replaces what an earlier attempt at the same batch has written, and nothing else."""

    def write(rows: DataFrame, batch: int) -> None:
        out = as_json(rows, by).withColumn("batch", F.lit(batch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return write


def write_skipped(listing: DataFrame, folder: str) -> None:
    """The disclosure table: files of a project that are not read, and why."""
    rows = listing.where("skipped is not null").select("file", "size", "skipped", "project")
    rows.repartition("project").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(folder)
