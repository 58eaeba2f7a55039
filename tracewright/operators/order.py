"""Windows over a unit's order: segments, runs, spans, marks, work units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import is_boundary_turn, is_edit

IDLE_S = 1800
MEMBERS = 16


def unit_window():
    return Window.partitionBy("unit_id").orderBy("idx")


def lane_window():
    return Window.partitionBy("unit_id", "session_ix", "lane").orderBy("idx")


def with_segments(actions: DataFrame, turns: DataFrame) -> DataFrame:
    """Main-lane actions with the number of boundary turns crossed so far and the last one's line.

    The turns before an action's line are counted by a running sum over both, then the count is
    carried forward in idx order, since a boundary that was crossed stays crossed.
    """
    key = ["unit_id", "session_ix"]
    main = actions.where("lane is null")
    marks = turns.where(is_boundary_turn(F.col("origin"))).select(*key, "line_no", F.lit(None).cast("bigint").alias("idx"), F.lit(1).alias("turn"))
    both = main.select(*key, "line_no", "idx", F.lit(0).alias("turn")).unionByName(marks)
    upto = Window.partitionBy(*key).orderBy("line_no", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("*", F.sum("turn").over(upto).alias("n"), F.last(F.when(F.col("turn") == 1, F.col("line_no")), ignorenulls=True).over(upto).alias("at"))
    seen = seen.where("turn = 0").select(*key, "idx", "n", "at")
    run = Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = seen.select(*key, "idx", F.max("n").over(run).cast("bigint").alias("segment"), F.max("at").over(run).alias("user_line_no"))
    return main.join(crossed, [*key, "idx"])


def action_runs(actions: DataFrame) -> DataFrame:
    """Maximal runs of one call per lane: (unit_id, session_ix, lane, run, n, first_idx, file, idxs)."""
    brk = F.when(F.col("input_hash").isNull() | ~F.col("input_hash").eqNullSafe(F.lag("input_hash").over(lane_window())), 1).otherwise(0)
    run = F.sum("brk").over(lane_window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = actions.withColumn("brk", brk).withColumn("run", run)
    return rows.groupBy("unit_id", "session_ix", "lane", "run").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.min_by("file_path", "idx").alias("file"), F.sort_array(F.collect_list("idx")).alias("idxs")
    )


def active_span(actions: DataFrame, cap: int = 300) -> DataFrame:
    """Per unit the wall span and the sum of gaps held to [0, cap] seconds, in time order."""
    at = F.unix_seconds("ts")
    w = Window.partitionBy("unit_id").orderBy("at", "idx")
    rows = actions.where("ts is not null").select("unit_id", "idx", at.alias("at"))
    gap = F.col("at") - F.lag("at").over(w)
    rows = rows.withColumn("held", F.least(F.greatest(gap, F.lit(0)), F.lit(cap)))
    return rows.groupBy("unit_id").agg((F.max("at") - F.min("at")).alias("wall_s"), F.coalesce(F.sum("held"), F.lit(0)).alias("active_s"))


def gap_marks(actions: DataFrame, cap: int = 300) -> DataFrame:
    """Consecutive actions more than ``cap`` seconds apart."""
    gap = F.unix_seconds(F.lead("ts").over(unit_window())) - F.unix_seconds("ts")
    return actions.select("unit_id", "idx", gap.alias("gap_s")).where(F.col("gap_s") > cap)


def story_runs(actions: DataFrame, least: int = 3) -> DataFrame:
    """Per file, three or more equal non-failing events in a row become one run."""
    w = Window.partitionBy("unit_id", "file_path").orderBy("idx")
    rows = actions.where("file_path is not null").withColumn("outcome", F.when(F.col("is_error"), "fail").otherwise("ok"))
    same = (F.col("outcome") == "ok") & (F.lag("outcome").over(w) == "ok") & (F.col("kind") == F.lag("kind").over(w))
    rows = rows.withColumn("brk", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("unit_id", "file_path", "island").agg(F.first("kind").alias("kind"), F.first("outcome").alias("outcome"), F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return runs.withColumn("collapsed", F.col("n") >= least)


def last_known_size(actions: DataFrame) -> DataFrame:
    seen = actions.where((F.col("kind") == "Read") & F.col("read_total_lines").isNotNull() & F.col("file_path").isNotNull())
    return seen.groupBy("unit_id", "file_path").agg(F.max_by("read_total_lines", "idx").alias("total_lines"))


def read_before_edit(actions: DataFrame) -> DataFrame:
    """Share of edits whose file was read before in the unit; 1 without edits."""
    before = Window.partitionBy("unit_id", "file_path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = actions.withColumn("seen", F.coalesce(F.max(F.when(F.col("kind") == "Read", 1).otherwise(0)).over(before), F.lit(0)))
    edit = (F.col("kind") == "Edit") & F.col("file_path").isNotNull()
    return rows.groupBy("unit_id").agg(F.coalesce(F.avg(F.when(edit, F.col("seen").cast("double"))), F.lit(1.0)).alias("share"))


def preceding_edit(actions: DataFrame, within: int = 5) -> DataFrame:
    """Each action with the file last edited in its lane among the ``within`` positions before it."""
    w = unit_window().rowsBetween(-within, -1)
    item = F.struct("session_ix", "lane", F.when(is_edit(F.col("kind")), F.col("file_path")).alias("file"))
    own = actions.withColumn("near", F.collect_list(item).over(w))
    hits = F.filter("near", lambda x: x["file"].isNotNull() & (x["session_ix"] == F.col("session_ix")) & x["lane"].eqNullSafe(F.col("lane")))
    return own.withColumn("near_file", F.try_element_at(hits, F.lit(-1))["file"]).drop("near")


def opening_window(segments: DataFrame, size: int = 10) -> DataFrame:
    """The first ``size`` actions of each segment with their position."""
    w = Window.partitionBy("unit_id", "session_ix", "segment").orderBy("idx")
    return segments.withColumn("pos", F.row_number().over(w) - 1).withColumn("segment_size", F.count("*").over(Window.partitionBy("unit_id", "session_ix", "segment"))).where(F.col("pos") < size)


def work_units(transcripts: DataFrame, idle_s: int | Column = IDLE_S, by: list[str] | None = None) -> DataFrame:
    """Transcripts with their unit of their project, position and gap in minutes from the running end."""
    by = by or ["project"]
    w = Window.partitionBy(*by).orderBy("first", "path")
    end = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = transcripts.withColumn("running_end", end)
    new = F.when(F.col("running_end").isNull() | F.col("first").isNull() | F.col("last").isNull() | (F.col("first") - F.col("running_end") > idle_s), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("unit", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    member = Window.partitionBy(*by, "unit").orderBy("first", "path")
    return rows.withColumn("member", F.row_number().over(member) - 1).withColumn("gap_min", F.when(F.col("new") == 0, (F.col("first") - F.col("running_end")) / 60.0))


def cap_units(members: DataFrame, size: int = MEMBERS, requested: Column | None = None) -> DataFrame:
    """The newest ``size`` members of each unit, a requested one always; ``kept`` and the unit's ``dropped``."""
    first = F.lit(0) if requested is None else F.when(requested, 1).otherwise(0)
    w = Window.partitionBy("project", "unit").orderBy(first.desc(), F.desc("first"), F.desc("path"))
    rows = members.withColumn("kept", F.row_number().over(w) <= size)
    return rows.withColumn("dropped", F.count_if(~F.col("kept")).over(Window.partitionBy("project", "unit")))


def session_seq(transcripts: DataFrame) -> DataFrame:
    w = Window.partitionBy("project").orderBy("first", "path")
    return transcripts.withColumn("seq", F.row_number().over(w) - 1)
