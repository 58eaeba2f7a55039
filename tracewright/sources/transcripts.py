"""Raw JSON event lines to typed tables: scans, line numbers, extraction, dedup, call-result joins.

Lines are read as text and parsed to VARIANT, so no schema is inferred and any field may be missing
or of another type; a wrong type reads as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import line_count, norm_cap
from .scratch import kept

MAX_FILE_BYTES = 256 << 20
#: Splits of files whose first line numbers are broadcast, some 200 bytes each; beyond, they are joined by a shuffle.
MAX_SPLITS = 200_000
MAX_SUBAGENTS = 64
PROSE_CAP = 4000


def _get(v: Column | str, path: str, kind: str, of: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == of, F.try_variant_get(v, path, kind))


def text_at(v: Column | str, path: str) -> Column:
    return _get(v, path, "string", "STRING")


def flag_at(v: Column | str, path: str) -> Column:
    return _get(v, path, "boolean", "BOOLEAN")


def long_at(v: Column | str, path: str) -> Column:
    return _get(v, path, "bigint", "BIGINT")


def present(v: Column | str, path: str) -> Column:
    """A key that is there, even with JSON null."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def project_dir(cwd: Column) -> Column:
    return F.regexp_replace(cwd, "[^A-Za-z0-9]", "-")


def scan_lines(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES, glob: str = "*.jsonl") -> DataFrame:
    """(file, stem, session_id, agent_id, line_no, value) of every log below ``folder``; lines count from 0.

    Lines are counted a split of a file first; running sums over a file's splits, a small table, give each split the
    number of its first line, and a line's place in its split does the rest. So no text is shuffled, but it is
    read twice. Files over ``max_bytes`` are left out; ``listing`` tells them.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    splits = kept(raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first")), "splits")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits_at = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    if splits.count() <= MAX_SPLITS:
        splits_at = F.broadcast(splits_at)
    rows = raw.where(F.col("size") <= max_bytes).join(splits_at, ["file", "block"]).withColumn("line_no", F.col("mid") + F.col("shift"))
    return _named(rows).drop("block", "mid", "size", "shift")


def _named(rows: DataFrame) -> DataFrame:
    """Adds stem, agent_id and session_id as the file's name and folder state them."""
    stem = F.regexp_extract("file", r"([^/]+)\.[a-z]+$", 1)
    rows = rows.withColumn("stem", stem).withColumn("agent_id", F.nullif(F.regexp_extract("stem", "^agent-(.+)$", 1), F.lit("")))
    parent = F.regexp_extract("file", r"/([^/]+)/subagents/[^/]+$", 1)
    own = F.when(F.col("stem").rlike("^[0-9A-Fa-f-]{36}$"), F.col("stem"))
    return rows.withColumn("session_id", F.coalesce(F.when(F.col("agent_id").isNotNull(), F.nullif(parent, F.lit(""))), own))


def listing(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES, glob: str = "*.jsonl") -> DataFrame:
    """(file, project, session_id, agent_id, size, mtime, skipped, newest) of the logs below ``folder``; no file is opened.

    project is the first folder below ``folder``; skipped says why a file isn't read: ``oversize``, ``empty`` or
    ``name`` (no transcript's). newest counts a project's readable main transcripts from the latest on, from 0.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    files = _named(files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index(F.col("file"), root, -1)
    why = F.when(F.col("size") > max_bytes, "oversize").when(F.col("size") == 0, "empty").when(F.col("session_id").isNull() & F.col("agent_id").isNull(), "name")
    files = files.withColumn("project", F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1))).withColumn("skipped", why)
    rank = F.row_number().over(Window.partitionBy("project", F.col("skipped").isNull() & F.col("agent_id").isNull()).orderBy(F.col("mtime").desc(), F.col("file").desc())) - 1
    return files.select("file", "project", "session_id", "agent_id", "size", "mtime", "skipped", F.when(F.col("skipped").isNull() & F.col("agent_id").isNull(), rank).alias("newest"))


def stamped(lines: DataFrame) -> DataFrame:
    """Adds the own time stamp of main transcripts' lines, all that members of units are told by; agents' lines aren't parsed for it."""
    return lines.withColumn("v", F.when(F.col("agent_id").isNull(), F.try_parse_json("value"))).withColumn("own_ts", text_at("v", "$.timestamp")).drop("v")


def parse(lines: DataFrame) -> DataFrame:
    """Adds ``v`` (VARIANT), parse_error, own and carried time stamps and the running auto-accept mode."""
    v = F.try_parse_json("value")
    rows = lines.withColumn("v", v).withColumn("blank", F.trim("value") == "")
    rows = rows.withColumn("parse_error", ~F.col("blank") & F.col("v").isNull()).withColumn("own_ts", text_at("v", "$.timestamp"))
    mode = F.coalesce(text_at("v", "$.permissionMode"), F.when(~F.coalesce(present("v", "$.permissionMode"), F.lit(False)), text_at("v", "$.mode")))
    flag = F.when(mode.isin("acceptEdits", "bypassPermissions"), True).when(mode.isin("normal", "default", "plan"), False)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("effective_ts", F.coalesce(F.last("own_ts", ignorenulls=True).over(w), F.lit(""))).withColumn("ts_inherited", F.col("own_ts").isNull()).withColumn("mode_flag", flag).withColumn("auto_accept_here", F.coalesce(F.last("mode_flag", ignorenulls=True).over(w), F.lit(False)))


def blocks(events: DataFrame) -> DataFrame:
    """One row a content block, of lines whose content is an array."""
    events = events.withColumn("_content", F.try_variant_get("v", "$.message.content", "variant"))
    spark = events.sparkSession
    view = f"_blocks_{id(events)}"
    events.createOrReplaceTempView(view)
    return spark.sql(f"SELECT e.*, b.pos AS block_pos, b.value AS block FROM {view} e, LATERAL variant_explode(e._content) b WHERE schema_of_variant(e._content) LIKE 'ARRAY%'").drop("_content")


def tool_calls(blk: DataFrame) -> DataFrame:
    """tool_use blocks as calls; of a repeated id in a file the first stands."""
    b = F.col("block")
    content = F.coalesce(text_at(b, "$.input.content"), text_at(b, "$.input.new_string"))
    calls = blk.where(text_at(b, "$.type") == "tool_use").select(
        "file", "session_id", "agent_id", "line_no", "block_pos", "effective_ts", "ts_inherited", "auto_accept_here", text_at(b, "$.id").alias("tool_use_id"), text_at(b, "$.name").alias("kind"),
        text_at(b, "$.input.file_path").alias("file_path"), text_at(b, "$.input.command").alias("command"), F.octet_length(content).cast("bigint").alias("write_len"), line_count(content).cast("bigint").alias("write_lines"),
        norm_cap(text_at(b, "$.input.old_string")).alias("edit_old"), norm_cap(text_at(b, "$.input.new_string")).alias("edit_new"),
        F.xxhash64(text_at(b, "$.name"), F.to_json(F.try_variant_get(b, "$.input", "variant"))).alias("input_hash"), F.try_variant_get(b, "$.input", "variant").alias("input"),
    )
    rn = F.row_number().over(Window.partitionBy("file", "tool_use_id").orderBy("line_no", "block_pos"))
    return calls.withColumn("rn", rn).where("rn = 1 or tool_use_id is null").drop("rn")


def content_text(v: Column) -> Column:
    """A string, or the texts of an array's blocks joined by spaces."""
    parts = F.try_variant_get(v, "$", "array<struct<type: string, text: string>>")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.array_join(F.filter(F.transform(parts, lambda x: x["text"]), lambda x: x.isNotNull()), " "))


def results(blk: DataFrame) -> DataFrame:
    """tool_result blocks with the line's toolUseResult; of a repeated id in a file the last stands."""
    b, v = F.col("block"), F.col("v")
    failed = F.coalesce(flag_at(b, "$.is_error"), F.lit(False))
    error = F.trim(F.concat_ws(" ", content_text(F.try_variant_get(b, "$.content", "variant")), text_at(v, "$.toolUseResult.stderr")))
    hunks = F.try_variant_get(v, "$.toolUseResult.structuredPatch", "array<struct<oldStart: int, oldLines: int>>")
    hunks = F.transform(F.filter(hunks, lambda h: h["oldStart"].isNotNull()), lambda h: F.struct(h["oldStart"].alias("lo"), (h["oldStart"] + F.coalesce(h["oldLines"], F.lit(0))).alias("hi")))
    rows = blk.where(text_at(b, "$.type") == "tool_result").select(
        "file", text_at(b, "$.tool_use_id").alias("tool_use_id"), "line_no", "block_pos",
        F.struct(
            failed.alias("is_error"), F.when(failed, error).alias("error"), hunks.alias("hunks"), flag_at(v, "$.toolUseResult.userModified").alias("user_modified"), long_at(v, "$.toolUseResult.file.totalLines").alias("read_total_lines"),
            text_at(v, "$.toolUseResult.agentId").alias("child_id"), text_at(v, "$.toolUseResult.task.id").alias("task_id"), flag_at(v, "$.toolUseResult.success").alias("success"), text_at(v, "$.toolUseResult.statusChange").alias("status_change"),
            F.to_json(F.try_variant_get(v, "$.toolUseResult.answers", "variant")).alias("answers"), F.col("effective_ts").alias("result_ts"),
        ).alias("r"),
    )
    return rows.where("tool_use_id is not null").groupBy("file", "tool_use_id").agg(F.max_by("r", F.struct("line_no", "block_pos")).alias("r")).select("file", "tool_use_id", "r.*")


def actions(calls: DataFrame, got: DataFrame) -> DataFrame:
    """Calls with their results, in a session's total order, main lane before subagents."""
    from ..functions.scalars import latency_secs

    rows = calls.drop("input").join(got, ["file", "tool_use_id"], "left")
    latency = F.when(F.col("kind").isin("Edit", "Write"), latency_secs(F.col("effective_ts"), F.col("result_ts")))
    rows = rows.withColumn("approval_latency_s", latency).withColumnRenamed("agent_id", "lane")
    w = Window.partitionBy("session_id").orderBy("effective_ts", F.col("lane").isNotNull(), "lane", "line_no", "block_pos")
    return rows.withColumn("idx", F.row_number().over(w) - 1).drop("result_ts", "answers")


def user_texts(events: DataFrame) -> DataFrame:
    """Text a user line carries, unless marked meta, with the origin it states."""
    content = F.try_variant_get("v", "$.message.content", "variant")
    kind = text_at("v", "$.origin.kind")
    origin = F.when(kind == "human", "Human").when(kind.isNotNull(), "NonHuman").otherwise("Unknown")
    rows = events.where((text_at("v", "$.type") == "user") & ~F.coalesce(flag_at("v", "$.isMeta"), F.lit(False))).withColumn("text", content_text(content))
    return rows.where(F.trim("text") != "").select("file", "session_id", "line_no", "effective_ts", "text", origin.alias("origin"))


def agent_texts(events: DataFrame) -> DataFrame:
    """Prose blocks of the assistant in the main lane, without the harness's own notices."""
    notice = (text_at("v", "$.message.model") == "<synthetic>") | flag_at("v", "$.isApiErrorMessage") | present("v", "$.error")
    rows = blocks(events.where((text_at("v", "$.type") == "assistant") & F.col("agent_id").isNull() & ~F.coalesce(notice, F.lit(False))))
    text = F.regexp_replace(text_at(F.col("block"), "$.text"), r"(?U)^\s+|\s+$", "")
    rows = rows.where(text_at(F.col("block"), "$.type") == "text").withColumn("text", F.left(text, F.lit(PROSE_CAP)))
    return rows.where("text <> ''").select("file", "session_id", "line_no", "block_pos", "text")


USAGE = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens"}


def message_usage(events: DataFrame) -> DataFrame:
    """(file, session_id, message_id, line_no, input, output, cache_read, cache_creation): tokens that the last line of each message states."""
    u = F.struct("line_no", *[F.coalesce(long_at("v", f"$.message.usage.{p}"), F.lit(0)).alias(c) for c, p in USAGE.items()])
    rows = events.withColumn("message_id", text_at("v", "$.message.id")).where(F.col("message_id").isNotNull() & present("v", "$.message.usage"))
    return rows.groupBy("file", "session_id", "message_id").agg(F.max_by(u, "line_no").alias("u")).select("file", "session_id", "message_id", "u.*")


def usage(events: DataFrame) -> DataFrame:
    """Tokens of each message, its last line's, then summed a file."""
    return message_usage(events).groupBy("file", "session_id").agg(*[F.sum(c).alias(c) for c in USAGE])


def window_fill(events: DataFrame) -> DataFrame:
    """How full the context was at each message of a file, in order of lines: what was sent and what came from the cache."""
    w = Window.partitionBy("file").orderBy("line_no", "message_id")
    return message_usage(events).select("file", "message_id", F.row_number().over(w).cast("bigint").alias("turn"), (F.col("input") + F.col("cache_read")).alias("fill"))


def decisions(calls: DataFrame, got: DataFrame) -> DataFrame:
    """One row a question asked, its options and the answer; texts repeated within a call keep none."""
    q = F.explode(F.try_variant_get("input", "$.questions", "array<struct<question: string, options: array<struct<label: string>>>>")).alias("q")
    asked = calls.where("kind = 'AskUserQuestion'").select("file", "session_id", "line_no", "tool_use_id", q)
    asked = asked.select("file", "session_id", "line_no", "tool_use_id", F.col("q.question").alias("question"), F.transform("q.options", lambda o: o["label"]).alias("options"))
    asked = asked.withColumn("ambiguous", F.count("*").over(Window.partitionBy("file", "tool_use_id", "question")) > 1)
    both = asked.join(got.select("file", "tool_use_id", "answers"), ["file", "tool_use_id"], "left")
    answer = F.element_at(F.from_json("answers", "map<string,string>"), F.col("question"))
    return both.select("file", "session_id", "line_no", "question", "options", F.when(~F.col("ambiguous"), answer).alias("answer"))


def task_events(calls: DataFrame, got: DataFrame) -> DataFrame:
    """Confirmed task creations and updates: a creation needs the result's task id, an update its success."""
    status = text_at("input", "$.status")
    t = calls.where((F.col("kind") == "TaskCreate") | ((F.col("kind") == "TaskUpdate") & status.isNotNull()))
    t = t.select("file", "session_id", "agent_id", "line_no", "block_pos", "tool_use_id", "kind", status.alias("status"), text_at("input", "$.subject").alias("subject"), F.coalesce(text_at("input", "$.taskId"), F.lit("?")).alias("task"))
    both = t.join(got, ["file", "tool_use_id"])
    made = (F.col("kind") == "TaskCreate") & F.col("task_id").isNotNull()
    moved = (F.col("kind") == "TaskUpdate") & F.coalesce("success", F.lit(False))
    return both.where(made | moved).select("file", "session_id", F.col("agent_id").alias("lane"), "line_no", "block_pos", F.when(made, F.col("task_id")).otherwise(F.col("task")).alias("id"), "subject", F.coalesce("status_change", "status", F.lit("pending")).alias("status"))


def spawns(calls: DataFrame, got: DataFrame) -> DataFrame:
    s = calls.where(F.col("kind").isin("Agent", "Task")).select("file", "session_id", "line_no", "tool_use_id")
    return s.join(got.select("file", "tool_use_id", "child_id"), ["file", "tool_use_id"], "left")


def sibling_claims(events: DataFrame, spawned: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(session_id, child_id, file, owner): sibling files agent-<id>.jsonl that a session's own spawns name.

    A session with a subagents folder claims none. Of a unit's claimants (``units``: session_id,
    unit_id; without it the corpus is one) the oldest owns a file. MAX_SUBAGENTS files a session, by path.
    """
    at = F.regexp_extract("file", "^(.*/)?[^/]+$", 1)
    mains = events.where("agent_id is null and session_id is not null").groupBy("file", "session_id").agg(F.min("own_ts").alias("first_ts"))
    foldered = events.where("agent_id is not null and session_id is not null").select("session_id").distinct()
    siblings = events.where("agent_id is not null and session_id is null").select("file", F.col("agent_id").alias("child_id"), at.alias("_dir")).distinct()
    asked = spawned.where("child_id is not null").select("file", "child_id").join(mains, "file").select("session_id", "child_id", "first_ts", at.alias("_dir")).distinct()
    found = asked.join(foldered, "session_id", "left_anti").join(siblings, ["_dir", "child_id"])
    found = found.withColumn("_rn", F.row_number().over(Window.partitionBy("session_id").orderBy("file"))).where(F.col("_rn") <= MAX_SUBAGENTS)
    found = found.withColumn("unit_id", F.lit(0)) if units is None else found.join(units.select("session_id", "unit_id"), "session_id")
    oldest = Window.partitionBy("unit_id", "file").orderBy(F.asc_nulls_last("first_ts"), "session_id")
    return found.withColumn("owner", F.row_number().over(oldest) == 1).select("session_id", "child_id", "file", "owner")


def with_siblings(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Lines or events with sibling agent files under the sessions that own them; unclaimed files are left out.

    A file that several units own is there once for each, told apart by ``#session`` after its name.
    Of the files in a subagents folder the first MAX_SUBAGENTS by path stay.
    """
    several = F.count("*").over(Window.partitionBy("file")) > 1
    own = claims.where("owner").select("file", F.col("session_id").alias("_owner"), several.alias("_several"))
    rows = lines.join(own, "file", "left").withColumn("file", F.when(F.col("_several"), F.concat("file", F.lit("#"), "_owner")).otherwise(F.col("file")))
    rows = rows.withColumn("session_id", F.coalesce("session_id", "_owner")).where("agent_id is null or session_id is not null").drop("_owner", "_several")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("file"))
    beyond = rows.where("agent_id is not null").select("session_id", "file").distinct().withColumn("_rn", rank).where(F.col("_rn") > MAX_SUBAGENTS).select("file")
    return rows.join(beyond, "file", "left_anti").select(*lines.columns)


def missing_children(spawned: DataFrame, lines: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Per session, spawned children whose file isn't there; a claimed sibling is, whoever owns it."""
    there = lines.where("agent_id is not null and session_id is not null").select("session_id", F.col("agent_id").alias("child_id"))
    if claims is not None:
        there = there.unionByName(claims.select("session_id", "child_id"))
    there = there.distinct().withColumn("found", F.lit(True))
    both = spawned.join(there, ["session_id", "child_id"], "left")
    return both.groupBy("session_id").agg(F.count("*").alias("spawned"), F.count_if(F.col("found").isNull()).alias("missing"))


def sessions(events: DataFrame) -> DataFrame:
    """Parse health, types, span, project and modes of each session."""
    t = text_at("v", "$.type")
    counted = events.where(t.isNotNull()).groupBy("session_id", t.alias("type")).agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("type_counts"))
    interrupted = content_text(F.try_variant_get("v", "$.message.content", "variant")).startswith("[Request interrupted by user") & (t == "user")
    cwd = text_at("v", "$.cwd")
    per = events.groupBy("session_id").agg(
        F.count_if("parse_error").alias("parse_errors"), F.count_if(F.col("v").isNotNull() & F.col("own_ts").isNull()).alias("untimestamped_lines"), F.count_if(F.coalesce(interrupted, F.lit(False))).alias("interrupts"),
        F.bool_or("auto_accept_here").alias("auto_accept"), F.min("own_ts").alias("first_ts"), F.max("own_ts").alias("last_ts"), F.min_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("cwd"),
    )
    return per.join(counted, "session_id", "left").withColumn("project", project_dir(F.col("cwd")))
