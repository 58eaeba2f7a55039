"""Serialised report payloads of units assembled from logs, within their token caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import elide_middle, is_edit, is_quotable_turn, short_id
from . import context, payloads
from .assemble import Units
from .shrink import PATH_MAX, fits

# Caps in tokens and characters, how many unmodelled types are listed, the rule of units, the note.
CAP_TOKENS, ID_MAX, TS_MAX, TYPES_MAX = 1000, 120, 40, 8
RULE = "same project; joined when a transcript overlaps the previous or starts within 30 min of its end"
CONTEXT_CAP, LIST_MAX, QUOTE_MAX = 2000, 12, 500
LISTS = ["requests", "files_edited", "decisions", "unfinished_tasks", "failing_commands", "claims"]
NOTE = "v0.1 reports context economics as information only; token-level waste deferred"


def _json(x: Column) -> Column:
    return F.to_json(x, {"ignoreNullFields": "false"})


def _quote(x: Column) -> Column:
    """A JSON string."""
    j = F.to_json(F.array(x))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def disclosure(units: Units, unreadable: DataFrame | None = None) -> DataFrame:
    """(unit_id, work_unit, cut): the JSON that tells what was merged into each unit, null where one transcript stands alone.

    ``siblings_unplaced`` counts transcripts of the project without a stamp. ``unreadable``: (unit_id, n) of members
    that a listing placed but the scan left out; they are no row here. ``cut``: a stamp was too long to print.
    """
    kept = units.members.where("kept")
    odd = units.members.where("first is null or last is null").groupBy("project").agg(F.count("*").alias("unplaced"))
    gaps = F.transform(F.sort_array(F.collect_list(F.when(F.col("session_ix") > 0, F.struct("session_ix", F.round("gap_min", 2).alias("g"))))), lambda x: x["g"])
    ids = F.transform(F.sort_array(F.collect_list(F.struct("session_ix", "session_id"))), lambda x: short_id(x["session_id"]))
    per = kept.groupBy("unit_id", "project").agg(
        F.count("*").alias("sessions"), gaps.alias("gaps"), F.coalesce(F.min_by("first_ts", "session_ix"), F.lit("")).alias("start"), F.coalesce(F.max("last_ts"), F.lit("")).alias("end"), ids.alias("ids"), F.max("dropped").alias("dropped")
    )
    per = per.join(odd, "project", "left")
    per = per.join(unreadable.select("unit_id", F.col("n").alias("lost")), "unit_id", "left") if unreadable is not None else per.withColumn("lost", F.lit(0))
    per = per.na.fill(0, ["unplaced", "lost"])
    block = _json(F.struct(
        F.lit(RULE).alias("rule"), "sessions", F.col("gaps").alias("joined_gaps_min"), elide_middle(F.col("start"), TS_MAX).alias("span_start"), elide_middle(F.col("end"), TS_MAX).alias("span_end"), F.col("ids").alias("session_ids"),
        "dropped", F.col("lost").alias("members_unreadable"), F.col("unplaced").alias("siblings_unplaced"),
    ))
    alone = (F.col("sessions") <= 1) & (F.col("lost") == 0) & (F.col("unplaced") == 0) & (F.col("dropped") == 0)
    return per.select("unit_id", F.when(~alone, block).alias("work_unit"), (~alone & ((F.length("start") > TS_MAX) | (F.length("end") > TS_MAX))).alias("cut"))


def unmodelled(units: DataFrame) -> DataFrame:
    """(unit_id, unknown): event types that the engine has no table for, the most frequent first, with their counts."""
    other = F.filter(F.map_entries("type_counts"), lambda e: ~e["key"].isin(payloads.KNOWN_TYPES))
    ordered = F.array_sort(F.transform(other, lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("type"))))
    none = F.array().cast("array<struct<o:bigint,type:string>>")
    return units.select("unit_id", F.coalesce(ordered, none).alias("unknown"))


def overviews(units: Units, actions: DataFrame, turns: DataFrame, ranked: DataFrame, unreadable: DataFrame | None = None, cap: int = CAP_TOKENS) -> DataFrame:
    """(unit_id, types_shown, payload): totals, tokens, top files, opening moves, flags and what was merged.

    Only the list of unmodelled types gives way: the most types, at most eight, with which the payload fits the cap.
    """
    o = payloads.overview(units, actions, turns, ranked).drop("unknown_types", "unknown_types_total")
    file = F.to_json(F.struct(elide_middle(F.col("file"), PATH_MAX).alias("file"), "class", "edits", F.map_from_entries(F.sort_array(F.map_entries("breakdown"))).alias("breakdown")))
    top = ranked.where("rank <= 3").groupBy("unit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", file.alias("j")))), lambda x: x["j"]), ",").alias("top"), F.bool_or(F.length("file") > PATH_MAX).alias("paths_cut"))
    rows = o.join(unmodelled(units.units), "unit_id").join(disclosure(units, unreadable), "unit_id").join(top, "unit_id", "left")
    rows = rows.withColumn("cut", F.col("cut") | F.coalesce("paths_cut", F.lit(False)) | (F.length("unit_id") > ID_MAX))
    session = _json(F.struct(elide_middle(F.col("unit_id"), ID_MAX).alias("id"), F.lit("unit").alias("identified_by"), elide_middle(F.nullif("started", F.lit("")), TS_MAX).alias("started"), "duration_min"))
    totals = _json(F.struct("actions", "file_ops", "lines_written", "file_ops_unconfirmed", "edits", "writes", "reads", "bash", "files_touched", "interrupts"))
    tokens = _json(F.struct("output", "cache_read", "cache_hit_ratio"))
    before = F.concat(
        F.lit('{"v":2,"session":'), session, F.lit(',"totals":'), totals, F.lit(',"tokens":'), tokens, F.lit(',"top_struggles":['), F.coalesce("top", F.lit("")), F.lit('],"top_struggles_total":'), F.col("ranked_files").cast("string"),
        F.lit(',"patch_first_segment_share":'), _text(F.col("patch_first_share")), F.lit(',"flags":{"unknown_event_types":'),
    )
    flags = F.concat(*[x for name, c in (("unknown_event_types_total", F.size("unknown")), ("parse_errors", F.col("parse_errors")), ("untimestamped_lines", F.col("untimestamped_lines")), ("subagent_files_missing", F.col("missing"))) for x in (F.lit(f',"{name}":'), c.cast("string"))])
    merged = F.concat(F.coalesce(F.concat(F.lit(',"work_unit":'), F.col("work_unit")), F.lit("")), F.lit("}"))
    rows = rows.select("unit_id", "unknown", "cut", before.alias("before"), flags.alias("flags"), merged.alias("merged"))

    def made(k: Column) -> Column:
        shown = F.to_json(F.map_from_entries(F.array_sort(F.transform(F.slice("unknown", 1, k), lambda x: F.struct(x["type"].alias("key"), (-x["o"]).alias("value"))))))
        truncated = (F.size("unknown") > k) | F.col("cut")
        return F.struct(k.alias("k"), F.concat("before", shown, "flags", F.lit('},"truncated":'), truncated.cast("string"), "merged").alias("payload"))

    tries = F.transform(F.sequence(F.least(F.size("unknown"), F.lit(TYPES_MAX)), F.lit(0), F.lit(-1)), made)
    first = F.element_at(F.filter(tries, lambda x: (x["k"] == 0) | fits(F.octet_length(x["payload"]), cap)), 1)
    return rows.select("unit_id", first.alias("x")).select("unit_id", F.col("x.k").alias("types_shown"), "x.payload")


def health(units: Units, actions: DataFrame, cap: int = CAP_TOKENS) -> DataFrame:
    """(unit_id, payload): tokens and ratios of each unit; the note goes where the cap leaves no room for it."""
    read, edited = F.count_distinct(F.when(F.col("kind") == "Read", F.col("file_path"))), F.count_distinct(F.when(is_edit(F.col("kind")), F.col("file_path")))
    ratio = actions.groupBy("unit_id").agg(F.round(F.try_divide(read.cast("double"), edited), 2).alias("ratio"))
    rows = units.units.join(ratio, "unit_id", "left")
    hit = F.round(F.try_divide(F.col("cache_read").cast("double"), F.col("input") + F.col("cache_read") + F.col("cache_creation")), 2)
    session = F.struct(elide_middle(F.col("unit_id"), ID_MAX).alias("id"), F.lit("unit").alias("identified_by"))
    tokens = F.struct("output", F.col("input").alias("input_uncached"), "cache_read", "cache_creation")

    def made(note: str) -> Column:
        cut = (F.length("unit_id") > ID_MAX) | F.lit(not note)
        return _json(F.struct(F.lit(2).alias("v"), session.alias("session"), hit.alias("cache_hit_ratio"), tokens.alias("tokens"), F.col("ratio").alias("read_edit_file_ratio"), F.lit(note).alias("note"), cut.alias("truncated")))

    rows = rows.select("unit_id", made(NOTE).alias("whole"), made("").alias("bare"))
    return rows.select("unit_id", F.when(fits(F.octet_length("whole"), cap), F.col("whole")).otherwise(F.col("bare")).alias("payload"))


def _listed(rows: DataFrame, name: str, by: list[str | Column], item: Column, cut: Column, options: Column | None = None) -> DataFrame:
    """(unit_id, name_total, name): the first items of each unit as (JSON before its options, options, JSON after, cut)."""
    none = F.array().cast("array<struct<j:string,cut:boolean>>")
    x = F.struct(F.row_number().over(Window.partitionBy("unit_id").orderBy(*by)).alias("rn"), item.alias("j"), F.lit(options is not None).alias("asks"), (options if options is not None else none).alias("options"), F.coalesce(cut, F.lit(False)).alias("cut"))
    some = rows.select("unit_id", x.alias("x"))
    return some.groupBy("unit_id").agg(F.count("*").alias(f"{name}_total"), F.sort_array(F.collect_list(F.when(F.col("x.rn") <= LIST_MAX, F.col("x")))).alias(name))


def review_contexts(units: Units, actions: DataFrame, turns: DataFrame, excluded: DataFrame | None = None, unreadable: DataFrame | None = None, cap: int = CONTEXT_CAP) -> DataFrame:
    """(unit_id, list_cap, payload): what was asked, changed, decided, left open and claimed, with totals.

    All lists give way together: the most items, at most twelve of each, with which the payload fits the cap.
    ``excluded``: (unit_id, n) of prose left out as the harness's own. Items name their member where a unit has several.
    """
    members = units.members.where("kept")
    several = members.groupBy("unit_id").agg(F.count("*").alias("n_members"))
    names = members.join(several.where("n_members > 1"), "unit_id").select("unit_id", "session_ix", F.concat(F.lit(',"session":"'), short_id(F.col("session_id")), F.lit('"')).alias("whose"))

    def quoted(c: str) -> Column:
        return elide_middle(F.col(c), QUOTE_MAX)

    def long(c: str, most: int = QUOTE_MAX) -> Column:
        return F.length(c) > most

    def item(*fields: Column | str) -> Column:
        """An object without its last brace, with its member's name."""
        j = _json(F.struct(*fields))
        return F.concat(F.substring(j, F.lit(1), F.length(j) - 1), F.coalesce("whose", F.lit("")))

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(names, ["unit_id", "session_ix"], "left")

    asked = named(turns.where(is_quotable_turn(F.col("origin"))))
    files = actions.where(is_edit(F.col("kind")) & ~F.col("is_error").eqNullSafe(True) & F.col("file_path").isNotNull()).select("unit_id", "file_path").distinct()
    decided = named(context.resolve_decisions(units.decisions, actions))
    options = F.transform("rejected", lambda o: F.struct(_quote(elide_middle(o, QUOTE_MAX)).alias("j"), (F.length(o) > QUOTE_MAX).alias("cut")))
    tasks = units.tasks.groupBy("unit_id", "session_ix", "lane", "id").agg(F.max_by("status", F.struct("line_no", "block_pos")).alias("status"), F.max_by("subject", F.when(F.col("subject").isNotNull(), F.struct("line_no", "block_pos"))).alias("subject"), F.max("line_no").alias("line_no"))
    tasks = named(tasks.where(~F.col("status").isin("completed", "deleted")))
    failing = context.failing_commands(actions).withColumn("whose", F.lit(None).cast("string"))
    said = named(payloads.claims(units.prose, turns))
    line = F.col("line_no").alias("line")
    parts = [
        _listed(asked, "requests", ["effective_ts", "session_ix", "line_no"], item(quoted("text").alias("text"), line), long("text")),
        _listed(files, "files_edited", ["file_path"], _quote(elide_middle(F.col("file_path"), PATH_MAX)), long("file_path", PATH_MAX)),
        _listed(decided, "decisions", ["session_ix", "line_no", "question"], item(quoted("question").alias("question"), quoted("answer").alias("chosen"), F.size("rejected").alias("options_not_chosen_total"), "idxs", line), long("question") | F.coalesce(long("answer"), F.lit(False)), options),
        _listed(tasks, "unfinished_tasks", ["session_ix", F.col("lane").isNotNull(), "lane", "id"], item(quoted("subject").alias("subject"), quoted("status").alias("last_status"), line), F.coalesce(long("subject"), F.lit(False)) | long("status")),
        _listed(failing, "failing_commands", ["idx"], item(quoted("command").alias("command"), F.array("idx").alias("idxs")), long("command")),
        _listed(said, "claims", ["session_ix", "line_no"], item(quoted("text").alias("text"), line, F.col("interrupted").alias("window_interrupted")), long("text")),
    ]
    unknown = turns.groupBy("unit_id").agg(F.count_if(F.col("origin") == "Unknown").alias("unattributed"))
    rows = units.units.select("unit_id").join(unknown, "unit_id", "left").join(disclosure(units, unreadable), "unit_id")
    rows = rows.join(excluded.select("unit_id", F.col("n").alias("excluded")), "unit_id", "left") if excluded is not None else rows.withColumn("excluded", F.lit(0))
    for p in parts:
        rows = rows.join(p, "unit_id", "left")
    none = F.array().cast("array<struct<rn:int,j:string,asks:boolean,options:array<struct<j:string,cut:boolean>>,cut:boolean>>")
    rows = rows.na.fill(0, ["unattributed", "excluded", *(f"{n}_total" for n in LISTS)]).withColumns({n: F.coalesce(n, none) for n in LISTS})
    whole = _json(F.struct(*[F.col(f"{n}_total").alias(n) for n in LISTS], F.col("excluded").alias("agent_texts_excluded")))
    coverage = _json(F.struct(((F.col("unattributed") > 0) | (F.col("excluded") > 0)).alias("coverage_incomplete"), F.col("unattributed").alias("unattributed_turns"), F.col("excluded").alias("agent_texts_excluded")))
    session = _json(F.struct(elide_middle(F.col("unit_id"), ID_MAX).alias("id"), F.lit("unit").alias("identified_by")))
    rows = rows.select("unit_id", "cut", "unattributed", "work_unit", *LISTS, whole.alias("totals"), coverage.alias("coverage"), session.alias("session"), F.greatest(*[F.col(f"{n}_total") for n in LISTS]).alias("longest"))

    def made(k: Column) -> Column:
        def shown(name: str, closed: bool = True) -> Column:
            def text(x: Column) -> Column:
                asked = F.concat(F.lit(',"options_not_chosen":['), F.array_join(F.transform(F.slice(x["options"], 1, k), lambda o: o["j"]), ","), F.lit("]"))
                return F.concat(x["j"], F.when(x["asks"], asked).otherwise(""), F.lit("}" if closed else ""))

            return F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.col(name), 1, k), text), ","), F.lit("]"))

        hidden = F.exists(F.flatten(F.array(*[F.slice(F.col(n), 1, k) for n in LISTS])), lambda x: x["cut"] | (F.size(x["options"]) > k) | F.exists(F.slice(x["options"], 1, k), lambda o: o["cut"]))
        truncated = (F.col("longest") > k) | hidden | F.col("cut") | (F.length("unit_id") > ID_MAX)
        body = F.concat(
            F.lit('{"v":3,"session":'), "session", F.lit(',"scope":{"requests":'), shown("requests"), F.lit(',"files_edited":'), shown("files_edited", False), F.lit(',"unattributed_turns":'), F.col("unattributed").cast("string"), F.lit('},"decisions":'), shown("decisions"),
            F.lit(',"incomplete":{"unfinished_tasks":'), shown("unfinished_tasks"), F.lit(',"failing_commands":'), shown("failing_commands"), F.lit('},"claims":'), shown("claims"), F.lit(',"totals":'), "totals", F.lit(',"list_cap":'), k.cast("string"),
            F.lit(',"coverage":'), "coverage", F.lit(',"attributed_intent_via":"session_intent","truncated":'), truncated.cast("string"), F.coalesce(F.concat(F.lit(',"work_unit":'), F.col("work_unit")), F.lit("")), F.lit("}"),
        )
        return F.struct(k.alias("k"), body.alias("payload"))

    tries = F.transform(F.sequence(F.lit(LIST_MAX), F.lit(0), F.lit(-1)), made)
    first = F.element_at(F.filter(tries, lambda x: (x["k"] == 0) | fits(F.octet_length(x["payload"]), cap)), 1)
    return rows.select("unit_id", first.alias("x")).select("unit_id", F.col("x.k").alias("list_cap"), "x.payload")
