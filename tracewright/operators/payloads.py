"""Report bodies of units assembled from logs: one row a unit, for a whole corpus at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import is_boundary_turn, is_edit, is_interrupt, is_quotable_turn
from . import context, detect, order
from .assemble import Units

KNOWN_TYPES = ["assistant", "user", "mode", "permission-mode"]


def totals(actions: DataFrame) -> DataFrame:
    """Counts of a unit's actions; files changed and lines written only where the result confirmed it."""
    kind = F.col("kind")
    edit, sure = is_edit(kind), F.col("is_error").eqNullSafe(False)
    return actions.groupBy("unit_id").agg(
        F.count("*").alias("actions"), F.count_if(kind == "Edit").alias("edits"), F.count_if(kind == "Write").alias("writes"), F.count_if(kind == "Read").alias("reads"), F.count_if(kind == "Bash").alias("bash"),
        F.count_distinct(F.when(edit | (kind == "Read"), F.col("file_path"))).alias("files_touched"), F.count_if(edit & sure).alias("file_ops"), F.count_if(edit & ~sure).alias("file_ops_unconfirmed"),
        F.sum(F.when(edit & sure, F.coalesce("write_lines", F.lit(0))).otherwise(0)).alias("lines_written"), F.min_by("effective_ts", "idx").alias("started"), F.max_by("effective_ts", "idx").alias("ended"),
        F.count_distinct(F.when(kind == "Read", F.col("file_path"))).alias("files_read"), F.count_distinct(F.when(edit, F.col("file_path"))).alias("files_edited"),
    )


def frequent_types(sessions: DataFrame, most: int = 8) -> DataFrame:
    """The event types that the engine doesn't model: the most frequent, and how many there are."""
    seen = sessions.select("unit_id", F.explode("type_counts").alias("type", "n")).where(~F.col("type").isin(KNOWN_TYPES)).groupBy("unit_id", "type").agg(F.sum("n").alias("n"))
    by_n = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "type")))
    per = seen.groupBy("unit_id").agg(by_n.alias("all"))
    return per.select("unit_id", F.size("all").alias("unknown_types_total"), F.transform(F.slice("all", 1, most), lambda x: F.concat(x["type"], F.lit(":"), (-x["o"]).cast("string"))).alias("unknown_types"))


def overview(units: Units, actions: DataFrame, turns: DataFrame, ranked: DataFrame) -> DataFrame:
    """Totals, tokens, health, the first three ranked files of how many, opening moves, and what was merged."""
    top = ranked.groupBy("unit_id").agg(F.count("*").alias("ranked_files"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "file")))), lambda x: x["file"]).alias("top_files"))
    moves = detect.opening_moves(order.with_segments(actions, turns)).groupBy("unit_id").agg(F.round(F.avg((~F.col("read_first")).cast("double")), 2).alias("patch_first_share"))
    gaps = units.members.where("kept").groupBy("unit_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("session_ix") > 0, F.struct("session_ix", F.round("gap_min", 2).alias("g"))))), lambda x: x["g"]).alias("gaps_min"), F.max("dropped").alias("dropped"))
    first, last = F.unix_seconds(F.try_to_timestamp("started")), F.unix_seconds(F.try_to_timestamp("ended"))
    tokens_in = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    out = units.units.join(totals(actions), "unit_id").join(top, "unit_id", "left").join(moves, "unit_id", "left").join(gaps, "unit_id", "left").join(frequent_types(units.sessions), "unit_id", "left")
    return out.withColumns({
        "ranked_files": F.coalesce("ranked_files", F.lit(0)), "unknown_types_total": F.coalesce("unknown_types_total", F.lit(0)), "duration_min": F.when(last >= first, F.floor((last - first) / 60)),
        "cache_hit_ratio": F.round(F.try_divide(F.col("cache_read").cast("double"), tokens_in), 2), "read_edit_ratio": F.round(F.try_divide(F.col("files_read").cast("double"), F.col("files_edited")), 2),
        "session_ids": F.transform("session_ids", lambda x: F.left(x, F.lit(8))),
    })


def claims(prose: DataFrame, turns: DataFrame) -> DataFrame:
    """The last prose before each boundary turn of a transcript, and the trailing one; ``interrupted`` where
    the turn that closed its window was an interrupt."""
    keys = ["unit_id", "session_ix"]
    marks = turns.where(is_boundary_turn(F.col("origin"))).select(*keys, "line_no", F.lit(None).cast("string").alias("said"), F.lit(0).alias("pos"), F.lit(1).alias("turn"), is_interrupt(F.col("text")).alias("stop"))
    both = prose.select(*keys, "line_no", F.col("text").alias("said"), F.col("block_pos").alias("pos"), F.lit(0).alias("turn"), F.lit(None).cast("boolean").alias("stop")).unionByName(marks)
    # a turn on the line of a block does not close its window before it
    w = Window.partitionBy(*keys).orderBy("line_no", "turn", "pos")
    rows = both.withColumn("window", F.coalesce(F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = rows.groupBy(*keys, "window").agg(F.max(F.when(F.col("turn") == 0, F.struct("line_no", "pos", "said"))).alias("last"), F.bool_or("stop").alias("stop")).where("last is not null")
    return per.select(*keys, F.col("last.line_no").alias("line_no"), F.col("last.said").alias("text"), F.coalesce("stop", F.lit(False)).alias("interrupted"))


def review_context(units: Units, actions: DataFrame, turns: DataFrame, most: int = 12, quote: int = 500) -> DataFrame:
    """What was asked, changed, decided, left open and claimed: samples of ``most`` each, totals of all."""

    def sample(rows: DataFrame, name: str, by: list[str | Column], text: Column) -> DataFrame:
        w = Window.partitionBy("unit_id").orderBy(*by)
        some = rows.select("unit_id", F.row_number().over(w).alias("rn"), text.alias("x"))
        return some.groupBy("unit_id").agg(F.count("*").alias(f"{name}_total"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", "x")))), lambda r: r["x"]).alias(name))

    def short(c: str) -> Column:
        half = quote // 2
        gone = F.length(c) - 2 * half
        return F.when(F.length(c) > quote, F.concat(F.left(c, F.lit(half)), F.lit("…["), gone.cast("string"), F.lit(" chars elided]…"), F.right(c, F.lit(half)))).otherwise(F.col(c))

    asked = turns.where(is_quotable_turn(F.col("origin")))
    files = actions.where(is_edit(F.col("kind")) & ~F.col("is_error").eqNullSafe(True) & F.col("file_path").isNotNull()).select("unit_id", "file_path").distinct()
    open_tasks = context.unfinished_tasks(units.tasks, ["unit_id", "session_ix", "lane", "id"], F.struct("line_no", "block_pos"), ["completed", "deleted"])
    parts = [
        sample(asked, "requests", ["effective_ts", "session_ix", "line_no"], short("text")), sample(files, "files_edited", ["file_path"], F.col("file_path")),
        sample(units.decisions, "decisions", ["session_ix", "line_no", "question"], short("question")), sample(open_tasks, "unfinished_tasks", ["session_ix", F.col("lane").isNotNull(), "lane", "id"], F.coalesce(short("subject"), F.lit(""))),
        sample(context.failing_commands(actions), "failing_commands", ["idx"], short("command")), sample(claims(units.prose, turns), "claims", ["session_ix", "line_no"], F.concat(F.when(F.col("interrupted"), "(interrupted) ").otherwise(""), short("text"))),
    ]
    unknown = turns.groupBy("unit_id").agg(F.count_if(F.col("origin") == "Unknown").alias("unattributed_turns"))
    out = units.units.select("unit_id").join(unknown, "unit_id", "left")
    for p in parts:
        out = out.join(p, "unit_id", "left")
    names = ["requests", "files_edited", "decisions", "unfinished_tasks", "failing_commands", "claims"]
    out = out.na.fill(0, ["unattributed_turns", *(f"{n}_total" for n in names)])
    longest = F.greatest(*[F.col(f"{n}_total") for n in names])
    return out.withColumn("coverage_incomplete", F.col("unattributed_turns") > 0).withColumn("truncated", longest > most)
