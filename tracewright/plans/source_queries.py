"""Queries over log files that Spark has written: line numbers, the live tail, manifests, sinks."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from ..sources import manifest, sinks, tail, transcripts as T
from ..sources.scratch import scratch_path
from ..streaming import live
from . import base_sql as B
from .log_queries import LOGS, log_lines
from .unit_queries import big, ranked_of, shown_breakdown

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def written_logs(spark: SparkSession, d: str) -> str:
    """The folder of the log lines as text files: one a project, its transcripts after each other."""
    folder = scratch_path(spark, "logs")
    lines = log_lines(spark, d).withColumn("project", F.substring_index("file", "/", 1))
    lines.repartition("project").sortWithinPartitions("project", "file", "line_no").select("project", "value").write.partitionBy("project").text(folder)
    return folder


def _project() -> Column:
    return F.regexp_extract("file", "/project=([^/]+)/", 1)


def _tool() -> Column:
    return F.regexp_extract("value", r'"(?:id|tool_use_id)":"(t\d+|spawn)"', 1)


LINES = LOGS + r""",
l2 AS (SELECT split_part(file, '/', 1) AS project, file, line_no, CASE WHEN kind='turn' THEN '' ELSE 't' || event_id END AS tool FROM e3 UNION ALL SELECT split_part(file, '/', 1), file, line_no+1, 't' || event_id FROM e3 WHERE answered
  UNION ALL SELECT split_part(file, '/', 1), file, unnest([0,1]), 'spawn' FROM e3 WHERE place='m' AND user_id%7 IN (3,4) AND nth=1)"""


@query("s02_read_lines", B.sql(LINES, "SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY file, line_no) - 1 AS BIGINT) AS line_no, tool FROM l2"))
def s02(spark, d):
    """Line numbers of written files, each line told by the tool id in it."""
    return T.scan_lines(spark, written_logs(spark, d), glob="*.txt").select(_project().alias("project"), "line_no", _tool().alias("tool"))


@query("st1_tail_logs", B.sql(LINES, "SELECT project, tool, count(*) AS lines FROM l2 GROUP BY project, tool"))
def st1(spark, d):
    """Written files as a stream: every line comes once, by the bytes read of each file."""
    out = live.run_to_table(tail.tail(spark, written_logs(spark, d), suffix=".txt"), scratch_path(spark, "tail"))
    return out.groupBy(_project().alias("project"), _tool().alias("tool")).agg(F.count("*").alias("lines"))


def _manifest_of(spark: SparkSession, d: str) -> str:
    """A manifest of the corpus folder after two runs, the second over files that haven't changed."""
    table = scratch_path(spark, "manifest")
    for _ in range(2):
        manifest.update(spark, d, table, "*.parquet")
    return table


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


@query("s08_manifest")
def s08(spark, d):
    """Inventory of the corpus folder's files against a manifest that lacks every other one."""
    table, files = scratch_path(spark, "manifest"), manifest.listing(spark, d, "*.parquet")
    manifest.append(files.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0), table, 1)
    known = manifest.current(manifest.read(spark, table))
    new = manifest.changed(files, known).select("path", "size", F.lit("new").alias("state"))
    seen = manifest.verify(manifest.hashed(files), known).join(files.select("path", "size"), "path").select("path", "size", "state")
    return new.unionByName(seen).select(_name().alias("name"), "size", "state")


@query("s08_manifest_update")
def s08b(spark, d):
    """Every file of the corpus folder, hashed once, in the first of two runs."""
    return manifest.read(spark, _manifest_of(spark, d)).select(_name().alias("name"), "size", "sha256", "run")


@query("s09_manifest_verify")
def s09(spark, d):
    """The corpus folder's files hashed again and compared with the manifest."""
    kept = manifest.current(manifest.read(spark, _manifest_of(spark, d)))
    return manifest.verify(manifest.scan(spark, d, "*.parquet"), kept).select(_name().alias("name"), "state")


@query("s07_sink_tables", B.sql(B.RANKED, "SELECT CAST(unit_id%50 AS VARCHAR) AS project, CAST(unit_id AS BIGINT) AS unit_id, rank, file, class, edits, breakdown FROM rk"))
def s07(spark, d):
    """Ranked files as JSON rows by project, written, half of the projects written again, and read back."""
    r = ranked_of(spark, d).select((F.col("unit_id") % 50).alias("project"), big("unit_id"), big("rank"), "file", "class", big("edits"), shown_breakdown())
    rows, folder = sinks.as_json(r), scratch_path(spark, "payloads")
    sinks.write_payloads(rows, folder)
    sinks.write_payloads(rows.where("CAST(project AS INT) < 25"), folder)
    back = sinks.read_payloads(spark, folder)
    v = F.from_json("payload", "unit_id bigint, rank bigint, file string, class string, edits bigint, breakdown string")
    return back.select("project", v.alias("v")).select("project", "v.*")
