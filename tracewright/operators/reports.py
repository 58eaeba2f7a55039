"""Report relations: one row a unit, or a unit and file, for a whole corpus at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import excerpt, is_edit, is_pushback
from . import context, detect, order, rank

BLIND_KINDS = ["blind_write_attempt", "large_write_instant_accept", "review_burden", "secrets_file_touched"]


def session_overview(actions: DataFrame, turns: DataFrame, overview: DataFrame) -> DataFrame:
    """Totals, spans, top files and the share of stretches opened by a patch; ``overview`` is a row a unit."""
    findings = detect.all_findings(actions, turns).persist()  # read for ranks and their breakdowns
    top = rank.top_struggles(rank.rank_files(findings, actions)).groupBy("unit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]), ",").alias("top_files"), F.max("total").alias("struggle_files"))
    moves = detect.opening_moves(order.with_segments(actions, turns)).groupBy("unit_id").agg(F.avg((~F.col("read_first")).cast("double")).alias("patch_first_share"))
    span = order.active_span(actions)
    out = overview.join(span, "unit_id", "left").join(top, "unit_id", "left").join(moves, "unit_id", "left")
    return out.withColumn("struggle_files", F.coalesce("struggle_files", F.lit(0)))


def struggle_areas(findings: DataFrame, ranked: DataFrame, n: int = 5, per_file: int = 4) -> DataFrame:
    """The first ``n`` ranked files with their representative findings and how many files are left out."""
    some = rank.representative_findings(findings, per_file).groupBy("unit_id", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
    total = F.count("*").over(Window.partitionBy("unit_id"))
    rows = ranked.withColumn("omitted", F.greatest(total - n, F.lit(0))).where(F.col("rank") <= n)
    return rows.join(some, ["unit_id", "file"], "left")


def file_story(actions: DataFrame, edge: int = 8) -> DataFrame:
    """A file's events in order, its head and tail, with the runs they belong to."""
    runs = order.story_runs(actions).select("unit_id", "file_path", "first_idx", "last_idx", "n", "collapsed")
    w = Window.partitionBy("unit_id", "file_path")
    up, down = F.row_number().over(w.orderBy("first_idx")), F.row_number().over(w.orderBy(F.desc("first_idx")))
    rows = runs.select("*", up.alias("at"), down.alias("from_end"), F.count("*").over(w).alias("runs"))
    return rows.where((F.col("at") <= edge) | (F.col("from_end") <= edge)).withColumn("elided", F.greatest(F.col("runs") - 2 * edge, F.lit(0)))


def story_with_failures(actions: DataFrame, edge: int = 8) -> DataFrame:
    """A file's head and tail events and the failed commands attributed to it, each action once."""
    own = rank.head_tail(actions.where("file_path is not null"), ["unit_id", "file_path"], "idx", edge).select("unit_id", "file_path", "idx", F.lit("event").alias("what"))
    failed = detect.attribute_failures(actions).select("unit_id", "file_path", "idx", F.lit("failure").alias("what"))
    return own.unionByName(failed).groupBy("unit_id", "file_path", "idx").agg(F.min("what").alias("what"))


def blind_spots(findings: DataFrame, latency_active: DataFrame, k: int = 8) -> DataFrame:
    """Up to ``k`` findings of each kind a reviewer can't see, with totals; instant accepts only where latency says something."""
    rows = findings.where(F.col("kind").isin(BLIND_KINDS)).join(latency_active, "unit_id", "left").where((F.col("kind") != "large_write_instant_accept") | F.coalesce("active", F.lit(True)))
    w = Window.partitionBy("unit_id", "kind")
    rows = rows.withColumn("total", F.count("*").over(w)).withColumn("pos", F.row_number().over(w.orderBy(F.element_at("idxs", 1), F.element_at("idxs", -1))))
    return rows.where(F.col("pos") <= k)


def context_health(actions: DataFrame) -> DataFrame:
    read, edited = F.count_distinct(F.when(F.col("kind") == "Read", F.col("file_path"))), F.count_distinct(F.when(is_edit(F.col("kind")), F.col("file_path")))
    per = actions.groupBy("unit_id").agg(read.alias("files_read"), edited.alias("files_edited"), F.try_divide(read, edited).alias("read_edit_ratio"))
    return per.join(order.read_before_edit(actions), "unit_id")


def evidence(findings: DataFrame, actions: DataFrame, most: int = 10) -> DataFrame:
    """The actions that findings cite, quoted and redacted; citations without an action are marked."""
    cited = findings.select("unit_id", F.col("kind").alias("finding"), F.explode(F.slice("idxs", 1, most)).alias("idx")).distinct()
    got = cited.join(actions.select("unit_id", "idx", "kind", excerpt(F.col("command"), F.col("error"), F.col("edit_new")).alias("excerpt")), ["unit_id", "idx"], "left")
    return got.withColumn("found", F.col("kind").isNotNull())


def review_context(actions: DataFrame, turns: DataFrame) -> DataFrame:
    """Per unit: requests, pushbacks, files edited and commands that still fail."""
    asked = turns.groupBy("unit_id").agg(F.count_if(F.col("origin") == "Human").alias("requests"), F.count_if(F.col("origin") == "Unknown").alias("unknown_turns"), F.count_if(is_pushback(F.col("text"))).alias("pushbacks"))
    files = context.files_edited(actions).select("unit_id", F.size("files").cast("bigint").alias("files_edited"))
    failing = context.failing_commands(actions).groupBy("unit_id").agg(F.count("*").alias("failing_commands"))
    units = actions.select("unit_id").distinct()
    out = units.join(asked, "unit_id", "left").join(files, "unit_id", "left").join(failing, "unit_id", "left")
    return out.na.fill(0, ["requests", "unknown_turns", "pushbacks", "files_edited", "failing_commands"])


def timeline(actions: DataFrame) -> DataFrame:
    """Each action's place from 0 to 100 along its unit, its track and whether it failed."""
    n = F.count("*").over(Window.partitionBy("unit_id"))
    track = F.when(F.col("kind") == "Read", "read").when(is_edit(F.col("kind")), "edit").when(F.col("kind") == "Bash", "bash").otherwise("other")
    return actions.select("unit_id", "idx", F.when(n > 1, F.col("idx") * 100.0 / (n - 1)).otherwise(0.0).alias("x"), track.alias("track"), F.coalesce("is_error", F.lit(False)).alias("failed"))


def finding_bands(findings: DataFrame) -> DataFrame:
    return findings.select("unit_id", "kind", "file", F.array_min("idxs").alias("from_idx"), F.array_max("idxs").alias("to_idx"))


def unit_disclosure(members: DataFrame) -> DataFrame:
    """Units of several transcripts: how many, gaps, span and members left out by the cap."""
    per = members.groupBy("project", "unit").agg(F.count("*").alias("sessions"), F.round(F.sum(F.coalesce("gap_min", F.lit(0.0))), 3).alias("gap_min"), F.min("first").alias("first"), F.max("last").alias("last"), F.count_if(~F.col("kept")).alias("dropped"))
    return per.where("sessions > 1")
