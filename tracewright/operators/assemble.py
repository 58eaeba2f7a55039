"""Raw log lines to the tables of work units that detectors, ranks and reports read.

A main transcript is a session; its subagents' files are lanes of it. Transcripts of a project whose
spans follow each other within the idle gap are one unit, at most ``cap`` of them, the newest, or all where it is None. Actions
and turns carry the unit, the member's place in it (oldest first) and, over the whole unit, one total
order by time, member, lane and line. Everything is windows and joins by file, session and unit. All lines are
scanned for their stamps alone; members that the cap drops and siblings that no one claims are not parsed further.
Lines are read twice, for the stamps and for what is kept of them, rather than written whole: they have to stay the same.
Without a cap nothing is picked, so the second reading parses them, and files beside the transcripts are read on their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import latency_secs
from ..sources import transcripts as T
from ..sources.scratch import kept as written
from . import order


@dataclass
class Units:
    """``members``: unit_id, project, session_id, session_ix, path, first_ts, last_ts, first, last, kept, dropped, gap_min;
    ``actions``, ``turns``, ``prose``, ``decisions``, ``tasks``: the members' rows with unit_id and session_ix;
    ``sessions``: counters of each kept member; ``units``: the counters merged."""

    members: DataFrame
    actions: DataFrame
    turns: DataFrame
    prose: DataFrame
    decisions: DataFrame
    tasks: DataFrame
    sessions: DataFrame
    units: DataFrame


def epoch(ts: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(F.concat(F.left(ts, F.lit(19)), F.lit("Z"))))


def folder_of(file: Column) -> Column:
    return F.regexp_extract(file, "^(.*/)?[^/]+$", 1)


def unit_members(events: DataFrame, idle_s: int = order.IDLE_S, cap: int | None = order.MEMBERS) -> DataFrame:
    """Main transcripts with their unit; those whose stamps can't be read are units of their own. Without a cap all are kept."""
    main = events.where("agent_id is null and session_id is not null")
    spans = main.groupBy("file", "session_id").agg(F.min("own_ts").alias("first_ts"), F.max("own_ts").alias("last_ts"))
    spans = spans.select(folder_of(F.col("file")).alias("project"), F.col("file").alias("path"), "session_id", "first_ts", "last_ts", epoch(F.col("first_ts")).alias("first"), epoch(F.col("last_ts")).alias("last"))
    # those without stamps go through the same windows beside the others, so the spans are grouped once
    spans = spans.withColumn("dated", F.col("first").isNotNull() & F.col("last").isNotNull())
    placed = order.work_units(spans, idle_s, ["project", "dated"])
    rows = placed.withColumn("unit_id", F.when(F.col("dated"), F.concat("project", F.col("unit").cast("string"))).otherwise(F.concat(F.lit("?"), "path")))
    w = Window.partitionBy("unit_id")
    rows = rows.withColumn("kept", F.lit(True) if cap is None else F.coalesce(F.row_number().over(w.orderBy(F.desc("first_ts"), F.desc("path"))) <= cap, F.lit(True)))
    rows = rows.withColumn("dropped", F.count_if(~F.col("kept")).over(w))
    # the place among the members kept, oldest first, and the gap to the running end of those before
    kept = w.orderBy(F.desc("kept"), "first_ts", "path")
    end = F.max("last").over(kept.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("session_ix", F.row_number().over(kept) - 1).withColumn("gap_min", F.when(F.col("kept") & (F.col("session_ix") > 0), F.coalesce((F.col("first") - end) / 60.0, F.lit(0.0))))
    return rows.select("unit_id", "project", "session_id", "session_ix", "path", "first_ts", "last_ts", "first", "last", "kept", "dropped", "gap_min")


def own_files(events: DataFrame) -> DataFrame:
    """Events without the files of a subagents folder that name another session; their names are written, so no event is shuffled for a few of them."""
    named = T.text_at("v", "$.sessionId")
    first = events.where("agent_id is not null and session_id is not null").groupBy("file", "session_id").agg(F.min_by(named, F.when(named.isNotNull(), F.col("line_no"))).alias("named"))
    foreign = written(first.where("named <> session_id").select("file"), "foreign")
    if foreign.count() <= T.MAX_SPLITS:
        foreign = F.broadcast(foreign)
    return events.join(foreign, "file", "left_anti")


def missing_children(spawned: DataFrame, foldered: DataFrame, claims: DataFrame, used: DataFrame) -> DataFrame:
    """(session_id, missing): children expected, by spawns or files, that were not merged into the unit.

    A sibling file that an earlier member of the unit owns is neither expected nor missing.
    ``foldered``: (session_id, file) of subagents folders, rejected files too; ``used``: (session_id, file)
    that gave actions.
    """
    per = spawned.groupBy("session_id").agg(F.count("*").alias("spawns"))
    files = foldered.groupBy("session_id").agg(F.count_distinct("file").alias("in_folder"))
    theirs = claims.groupBy("session_id").agg(F.count_if("owner").alias("own"), F.count_if(~F.col("owner")).alias("excluded"))
    merged = used.groupBy("session_id").agg(F.count_distinct("file").alias("merged"))
    rows = per.join(files, "session_id", "full").join(theirs, "session_id", "full").join(merged, "session_id", "full").na.fill(0)
    attempted = F.greatest("spawns", F.col("in_folder") + F.col("own") + F.col("excluded")) - F.col("excluded")
    return rows.select("session_id", F.greatest(attempted - F.col("merged"), F.lit(0)).alias("missing"))


def only(lines: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The lines whose ``key`` is among ``keys``, a table of sessions or files."""
    some = keys.select(key).distinct()
    if keys.count() <= T.MAX_SPLITS:
        some = F.broadcast(some)
    return lines.join(some, key, "left_semi")


def is_beside() -> Column:
    """A line of a file beside the transcripts."""
    return F.col("agent_id").isNotNull() & F.col("session_id").isNull()


def needed(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """The lines of kept members and of files beside the transcripts, written as they are."""
    beside = is_beside()
    keys = kept.select("session_id").distinct()
    if kept.count() <= T.MAX_SPLITS:
        rows = lines.join(F.broadcast(keys.withColumn("_kept", F.lit(True))), "session_id", "left").where(F.col("_kept") | beside)
    else:  # by a shuffle, of which lines without a session are no part
        rows = lines.join(keys, "session_id", "left_semi").unionByName(lines.where(beside))
    return written(rows.select(*lines.columns), "lines")


def parsed(lines: DataFrame) -> DataFrame:
    return written(T.parse(lines).drop("value"), "events")


def assemble(lines: DataFrame, idle_s: int = order.IDLE_S, cap: int | None = order.MEMBERS) -> Units:
    """The tables of all units in (file, session_id, agent_id, line_no, value) lines; of all their members where ``cap`` is None."""
    members = written(unit_members(T.stamped(lines), idle_s, cap), "members")
    kept = members.where("kept").select("unit_id", "session_id", "session_ix")
    lines = lines if cap is None else needed(lines, kept)  # files of sessions without a transcript go where rows meet the members
    events = parsed(lines.where("session_id is not null"))
    beside = lines.where(is_beside())
    owned = own_files(events)
    b = T.blocks(owned.where("session_id is not null"))
    spawned = T.spawns(T.tool_calls(b.where("agent_id is null")), T.results(b.where("agent_id is null")))
    names = ["file", "session_id", "agent_id", "own_ts"]
    claims = written(T.sibling_claims(owned.select(*names).unionByName(beside.withColumn("own_ts", F.lit(None).cast("string")).select(*names)), spawned, kept), "claims")  # small, and every table below needs it
    claimed = parsed(only(beside, claims.where("owner"), "file"))
    agents = T.with_siblings(owned.where("agent_id is not null").unionByName(claimed), claims)  # transcripts' own lines stay as they are
    rows = written(owned.where("agent_id is null").unionByName(agents).join(kept, "session_id"), "rows")  # read for calls, turns, prose and counters
    calls_of = T.blocks(rows)
    calls, got = T.tool_calls(calls_of), T.results(calls_of)

    acts = calls.drop("input").join(got, ["file", "tool_use_id"], "left").withColumnRenamed("agent_id", "lane").join(kept, "session_id")
    acts = acts.withColumn("approval_latency_s", F.when(F.col("kind").isin("Edit", "Write"), latency_secs(F.col("effective_ts"), F.col("result_ts"))))
    total = Window.partitionBy("unit_id").orderBy("effective_ts", "session_ix", F.col("lane").isNotNull(), "lane", "line_no", "block_pos")
    acts = acts.withColumn("idx", (F.row_number().over(total) - 1).cast("bigint")).withColumn("ts", F.try_to_timestamp("effective_ts")).drop("result_ts", "answers")

    main = rows.where("agent_id is null")
    turns = T.user_texts(main).join(kept, "session_id").withColumn("ts", F.try_to_timestamp("effective_ts"))
    main_calls, main_got = calls.where("agent_id is null"), got
    foldered = events.where("agent_id is not null and session_id is not null").select("session_id", "file").distinct()
    used = calls.where("agent_id is not null").select("session_id", "file").distinct()
    # missing children are those of the whole session; a capped member has none that count
    missing = missing_children(spawned, foldered, claims, used)

    health = T.sessions(rows).select("session_id", "parse_errors", "untimestamped_lines", "interrupts", "type_counts", "cwd")
    own_mode = main.groupBy("session_id").agg(F.bool_or("auto_accept_here").alias("auto_accept"))
    tokens = T.usage(rows).groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_creation")])
    sessions = kept.join(health, "session_id", "left").join(own_mode, "session_id", "left").join(tokens, "session_id", "left").join(missing, "session_id", "left").na.fill(0)
    return Units(
        members, acts, turns, T.agent_texts(rows).join(kept, "session_id"), T.decisions(main_calls, main_got).join(kept, "session_id"), T.task_events(calls, got).join(kept, "session_id"), sessions, merge_units(sessions)
    )


def merge_units(sessions: DataFrame) -> DataFrame:
    """Counters add up over a unit's members, auto-accept of any counts, the first member's folder that is known stands."""
    counters = ["parse_errors", "untimestamped_lines", "interrupts", "input", "output", "cache_read", "cache_creation", "missing"]
    types = sessions.select("unit_id", F.explode("type_counts").alias("type", "n")).groupBy("unit_id", "type").agg(F.sum("n").alias("n"))
    types = types.groupBy("unit_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("type_counts"))
    per = sessions.groupBy("unit_id").agg(
        F.count("*").alias("members"), *[F.sum(c).alias(c) for c in counters], F.bool_or("auto_accept").alias("auto_accept"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("session_ix"))).alias("cwd"),
        F.transform(F.sort_array(F.collect_list(F.struct("session_ix", "session_id"))), lambda x: x["session_id"]).alias("session_ids"),
    )
    return per.join(types, "unit_id", "left")
