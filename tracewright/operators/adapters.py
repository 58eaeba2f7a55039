"""The engine's tables projected from general event and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

EXTENSIONS = [".rs", ".md", ".json", ".html", ".env", ".pem", "", ".txt"]
COMMANDS = ["cargo test", "make", "npm run lint", "ls"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event, numbered within its user's log, with the running auto-accept mode."""
    ev = events(spark, sf_dir)
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    ev = ev.select("event_id", "ts", F.col("user_id").alias("unit_id"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), k.alias("k"))
    order = Window.partitionBy("unit_id").orderBy("ts", "event_id")
    mode = F.when(F.col("k") % 10 == 0, True).when(F.col("k") % 10 == 1, False)
    return ev.select(
        "*",
        (F.row_number().over(order) - 1).cast("bigint").alias("line_no"),
        F.coalesce(F.last(mode, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)).alias("auto_accept_here"),
    )


def actions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions: a unit a user, a project fifty users apart; sign-ups are turns, not actions."""
    e = event_lines(spark, sf_dir).where("event_type <> 'signup'")
    k, eid = F.col("k"), F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "purchase", "Write").otherwise("Bash")
    e = e.withColumn("kind", kind)
    bash, edit = F.col("kind") == "Bash", F.col("kind").isin("Edit", "Write")
    name = F.concat(F.lit("f"), (k % 12).cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (k % 8 + 1).cast("int")))
    is_error = F.when(bash, k % 2 == 0).when(eid % 10 == 0, True).when(eid % 10 == 1, None).otherwise(False)
    error = F.when(bash & (k % 2 == 0), F.concat(F.lit("failed"), F.when(k % 3 == 0, F.concat(F.lit(" at "), name)).otherwise(""))).when(edit & (eid % 20 == 0), "File has not been read yet")
    out = e.select(
        "unit_id",
        (F.col("unit_id") % 50).alias("project"),
        F.lit(0).alias("session_ix"),
        "line_no",
        "ts",
        "event_id",
        F.when(eid % 5 == 0, "a").alias("lane"),
        "kind",
        F.when(~bash, F.concat(F.lit("/p/"), name)).alias("file_path"),
        is_error.alias("is_error"),
        F.when(bash, F.element_at(F.array(*map(F.lit, COMMANDS)), (k % 4 + 1).cast("int"))).alias("command"),
        error.alias("error"),
        (edit & (eid % 17 == 0)).alias("user_modified"),
        "auto_accept_here",
        F.when(edit, F.col("cents")).alias("write_len"),
        F.when(edit, F.floor(F.col("cents") / 10)).alias("write_lines"),
        F.when(edit, (k % 10).cast("double")).alias("approval_latency_s"),
        F.when(F.col("kind") == "Read", 100 + k).alias("read_total_lines"),
        F.when(F.col("kind") == "Edit", F.array(F.struct(k.alias("lo"), (k + eid % 20).alias("hi")))).alias("hunks"),
        F.when(F.col("kind") == "Edit", F.concat(F.lit("v"), (k % 5).cast("string"))).alias("edit_old"),
        F.when(F.col("kind") == "Edit", F.concat(F.lit("v"), (eid % 5).cast("string"))).alias("edit_new"),
        F.concat("kind", F.lit(":"), (k % 3).cast("string")).alias("input_hash"),
    )
    return with_idx(out)


def with_idx(actions: DataFrame) -> DataFrame:
    """The total order of a unit: time, transcript, main lane first, lane, line."""
    order = Window.partitionBy("unit_id").orderBy("ts", "session_ix", F.col("lane").isNotNull(), "lane", "line_no")
    return actions.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))


def turns_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: sign-ups, with an origin and a text that pushes back a quarter of the time."""
    e = event_lines(spark, sf_dir).where("event_type = 'signup'")
    eid = F.col("event_id")
    return e.select(
        "unit_id",
        F.lit(0).alias("session_ix"),
        "line_no",
        "ts",
        F.when(eid % 3 == 0, "Human").when(eid % 3 == 1, "NonHuman").otherwise("Unknown").alias("origin"),
        F.when(eid % 4 == 0, "no revert that").otherwise("please continue").alias("text"),
    )


def transcripts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript a user and day: its span in epoch seconds and its project."""
    ev = events(spark, sf_dir)
    path = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    return ev.groupBy((F.col("user_id") % 50).alias("project"), path.alias("path")).agg(
        F.min(F.unix_seconds("ts")).alias("first"), F.max(F.unix_seconds("ts")).alias("last"), F.count("*").alias("lines")
    )
