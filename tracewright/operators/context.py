"""Review context: requests, decisions, tasks, failing commands, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import is_boundary_turn, is_quotable_turn, is_validation


def requests(turns: DataFrame) -> DataFrame:
    """Turns that a human certainly sent, and per unit how many are of unknown origin."""
    unknown = F.count_if(F.col("origin") == "Unknown").over(Window.partitionBy("unit_id"))
    return turns.withColumn("unknown", unknown).where(is_quotable_turn(F.col("origin")))


def files_edited(actions: DataFrame) -> DataFrame:
    """Paths with an edit that isn't known to have failed."""
    ok = actions.where(F.col("kind").isin("Edit", "Write") & ~F.col("is_error").eqNullSafe(True) & F.col("file_path").isNotNull())
    return ok.groupBy("unit_id").agg(F.array_sort(F.collect_set("file_path")).alias("files"))


def decisions(asked: DataFrame, matches: Column) -> DataFrame:
    """Options not chosen (all of them without an answer) and how the question was found in the log."""
    rejected = F.filter("options", lambda o: F.col("answer").isNull() | (o != F.col("answer")))
    state = F.when(matches == 1, "resolved").when(matches == 0, "not_found").otherwise("ambiguous")
    return asked.withColumn("rejected", rejected).withColumn("resolution", state)


def resolve_decisions(asked: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions of units with the action that asked: ``idxs`` holds it where one call to ask stands on the decision's
    line of its member, and is empty where none ('not_found') or several ('ambiguous') do."""
    keys = ["unit_id", "session_ix", "line_no"]
    calls = actions.where("kind = 'AskUserQuestion'").groupBy(*keys).agg(F.count("*").alias("matches"), F.min("idx").alias("idx"))
    rows = asked.join(calls, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    none = F.array().cast("array<bigint>")
    return decisions(rows, F.col("matches")).withColumn("idxs", F.when(F.col("matches") == 1, F.array("idx")).otherwise(none)).drop("idx")


def unfinished_tasks(events: DataFrame, by: list[str], order: Column, finished: list[str]) -> DataFrame:
    """Each task's last status and last known subject, of those not finished."""
    last = events.groupBy(*by).agg(F.max_by("status", order).alias("status"), F.max_by(F.col("subject"), F.when(F.col("subject").isNotNull(), order)).alias("subject"))
    return last.where(~F.col("status").isin(finished))


def failing_commands(actions: DataFrame) -> DataFrame:
    """Validation commands whose last invocation failed."""
    runs = actions.where((F.col("kind") == "Bash") & is_validation(F.col("command")))
    last = runs.groupBy("unit_id", "command").agg(F.max_by(F.struct("is_error", "idx"), "idx").alias("l"))
    return last.where("l.is_error").select("unit_id", "command", "l.idx")


def claims(prose: DataFrame, turns: DataFrame) -> DataFrame:
    """The last prose before each boundary turn of a transcript, and the trailing one."""
    marks = turns.where(is_boundary_turn(F.col("origin"))).select("unit_id", "line_no", F.lit(None).cast("string").alias("text"), F.lit(1).alias("turn"))
    both = prose.select("unit_id", "line_no", "text", F.lit(0).alias("turn")).unionByName(marks)
    w = Window.partitionBy("unit_id").orderBy("line_no", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("window", F.sum("turn").over(w)).where("turn = 0")
    return rows.groupBy("unit_id", "window").agg(F.max_by("text", "line_no").alias("text"), F.max("line_no").alias("line_no"))
