"""Detectors: actions and turns to findings, joins and groupings by unit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import basename, is_edit, is_pushback, is_secrets
from . import order
from .mentions import mentions

LINE_BIN = 50
FINDING_COLUMNS = ["unit_id", "detector_ord", "kind", "tier", "exact", "confidence", "idxs", "file", "note", "nums"]


def finding(rows: DataFrame, ord_: int | Column, kind: Column | str, tier: str, exact: bool, confidence: Column | str, file: Column | None = None, note: Column | None = None, nums: Column | None = None) -> DataFrame:
    """Rows with unit_id and idxs in the findings' uniform shape."""

    def as_col(x: Column | str) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    none = F.lit(None).cast("string")
    return rows.select(
        "unit_id", (F.lit(ord_) if isinstance(ord_, int) else ord_).alias("detector_ord"), as_col(kind).alias("kind"), F.lit(tier).alias("tier"), F.lit(exact).alias("exact"), as_col(confidence).alias("confidence"),
        F.col("idxs").cast("array<bigint>").alias("idxs"), (none if file is None else file).alias("file"), (none if note is None else note).alias("note"),
        (F.lit(None).cast("map<string,double>") if nums is None else nums.cast("map<string,double>")).alias("nums"),
    )


def _idxs() -> Column:
    return F.sort_array(F.collect_list("idx")).alias("idxs")


def churn(actions: DataFrame, least: int = 2) -> DataFrame:
    edits = actions.where(is_edit(F.col("kind")) & F.col("file_path").isNotNull())
    per = edits.groupBy("unit_id", "file_path").agg(_idxs(), F.sum(F.coalesce("write_lines", F.lit(0))).alias("lines")).where(F.size("idxs") >= least)
    rows = per.join(order.last_known_size(actions), ["unit_id", "file_path"], "left")
    relative = F.when((F.col("total_lines") > 0) & (F.col("lines") > 0), F.map_from_arrays(F.array(F.lit("relative_churn")), F.array(F.col("lines") / F.col("total_lines"))))
    return finding(rows, 0, "churn", "T1", True, "high", F.col("file_path"), nums=relative)


def re_read(actions: DataFrame, least: int = 3) -> DataFrame:
    rows = actions.where((F.col("kind") == "Read") & F.col("file_path").isNotNull()).groupBy("unit_id", "file_path").agg(_idxs()).where(F.size("idxs") >= least)
    return finding(rows, 1, "re_read", "T1", True, "high", F.col("file_path"))


def hunk_overlaps(actions: DataFrame) -> DataFrame:
    """(unit_id, file_path, idx, earlier): each edit whose hunks overlap an earlier edit's, with the earliest.

    Hunks of one range are one row, with the first edit that has it; ranges are dealt to bins of LINE_BIN lines, both ends
    included, so only ranges of a bin meet, however many edits have them. The first edit that overlaps an edit at all is the
    earliest, if it is earlier; else none is.
    """
    edits = actions.where((F.col("kind") == "Edit") & F.col("file_path").isNotNull() & (F.size("hunks") > 0))
    h = edits.select("unit_id", "file_path", "idx", F.explode("hunks").alias("h")).select("unit_id", "file_path", "idx", "h.lo", "h.hi")
    span = ["unit_id", "file_path", "lo", "hi"]
    spans = h.groupBy(*span).agg(F.min("idx").alias("first")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / LINE_BIN), F.floor(F.col("hi") / LINE_BIN))))
    a, b = spans.alias("a"), spans.alias("b")
    on = (F.col("a.unit_id") == F.col("b.unit_id")) & (F.col("a.file_path") == F.col("b.file_path")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi"))
    met = a.join(b, on).groupBy(*[F.col(f"b.{c}").alias(c) for c in span]).agg(F.min("a.first").alias("earlier"))
    return h.join(met, span).where("earlier < idx").groupBy("unit_id", "file_path", "idx").agg(F.min("earlier").alias("earlier"))


def rework(actions: DataFrame) -> DataFrame:
    rows = hunk_overlaps(actions).withColumn("idxs", F.array("earlier", "idx"))
    return finding(rows, 2, "rework", "T2", True, "high", F.col("file_path"))


def blind_write_attempts(actions: DataFrame) -> DataFrame:
    rows = actions.where(is_edit(F.col("kind")) & F.contains("error", F.lit("File has not been read yet"))).withColumn("idxs", F.array("idx"))
    return finding(rows, 3, "blind_write_attempt", "T1", True, "high", F.col("file_path"))


def attribute_failures(actions: DataFrame) -> DataFrame:
    """Failed commands with the file they are about: one named in the command or its error, the longest
    name first, else the file last edited in the lane within five positions. Unattributed ones go."""
    failed = actions.where((F.col("kind") == "Bash") & F.col("is_error")).select("unit_id", "idx", F.concat_ws(" ", "command", "error").alias("text"))
    # a text with a path has its base name too; of files with one name the longest path, then the greatest, stands for all
    own = F.when(basename(F.col("file")) != "", basename(F.col("file"))).otherwise(F.col("file"))
    touched = actions.where(F.col("file_path").isNotNull()).select("unit_id", F.col("file_path").alias("file")).withColumn("name", own)
    best = touched.groupBy("unit_id", "name").agg(F.max(F.struct(F.octet_length("file").alias("n"), F.col("file").alias("f"))).alias("m"))
    named = mentions(failed, best).groupBy("unit_id", "idx").agg(F.max("m").alias("m")).select("unit_id", "idx", F.col("m.f").alias("named_file"))
    near = order.preceding_edit(actions).where((F.col("kind") == "Bash") & F.col("is_error")).select("unit_id", "idx", "near_file")
    both = near.join(named, ["unit_id", "idx"], "left")
    return both.select("unit_id", "idx", F.coalesce("named_file", "near_file").alias("file_path"), F.col("named_file").isNull().alias("by_proximity")).where("file_path is not null")


def failure_loops(actions: DataFrame, least: int = 2) -> DataFrame:
    rows = attribute_failures(actions).groupBy("unit_id", "file_path").agg(_idxs(), F.bool_or("by_proximity").alias("near")).where(F.size("idxs") >= least)
    note = F.when(F.col("near"), "attributed by proximity").otherwise("attributed by name")
    return finding(rows, 4, "failure_loop", "T2", False, F.when(F.col("near"), "low").otherwise("medium"), F.col("file_path"), note)


def action_loops(actions: DataFrame, least: int = 3) -> DataFrame:
    rows = order.action_runs(actions).where(F.col("n") >= least)
    return finding(rows, 5, "action_loop", "T1", True, "low", F.col("file"), nums=F.map_from_arrays(F.array(F.lit("repeats")), F.array(F.col("n").cast("double"))))


def opening_moves(segments: DataFrame) -> DataFrame:
    """(unit_id, session_ix, segment, read_first, edit_fraction, first_edit, idxs) of segments with five actions or more."""
    w = order.opening_window(segments).where("segment_size >= 5")
    edit = is_edit(F.col("kind"))
    per = w.groupBy("unit_id", "session_ix", "segment").agg(
        F.min(F.when(edit, F.col("pos"))).alias("first_edit"), F.min(F.when(F.col("kind") == "Read", F.col("pos"))).alias("first_read"),
        F.avg(F.when(edit, 1.0).otherwise(0.0)).alias("edit_fraction"), F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("w"),
    ).where("first_edit is not null")
    return per.select("unit_id", "session_ix", "segment", F.coalesce(F.col("first_read") < F.col("first_edit"), F.lit(False)).alias("read_first"), "edit_fraction", "first_edit", F.transform(F.filter("w", lambda x: x["pos"] <= F.col("first_edit")), lambda x: x["idx"]).alias("idxs"))


def opening_move(segments: DataFrame) -> DataFrame:
    rows = opening_moves(segments)
    nums = F.create_map(F.lit("edit_fraction_first10"), F.col("edit_fraction"), F.lit("first_edit_index"), F.col("first_edit").cast("double"))
    return finding(rows, 6, "opening_move", "T1", False, "medium", note=F.when(F.col("read_first"), "read-first").otherwise("patch-first"), nums=nums)


def revert_pairs(actions: DataFrame) -> DataFrame:
    """Edits that restore what an earlier edit of the file and lane replaced, with the earliest such edit.

    The texts meet by hash first; equality is checked after, so long texts are never sort keys.
    """
    edits = actions.where("kind = 'Edit' and edit_old is not null and edit_new is not null").select("unit_id", "session_ix", "lane", "file_path", "idx", "line_no", "ts", "edit_old", "edit_new")
    a, b = edits.withColumn("h", F.xxhash64("edit_old")).alias("a"), edits.withColumn("h", F.xxhash64("edit_new")).alias("b")
    on = (F.col("a.unit_id") == F.col("b.unit_id")) & (F.col("a.session_ix") == F.col("b.session_ix")) & F.col("a.lane").eqNullSafe(F.col("b.lane")) & F.col("a.file_path").eqNullSafe(F.col("b.file_path")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.edit_old") == F.col("b.edit_new")) & (F.col("a.idx") < F.col("b.idx"))
    first = F.min_by(F.struct("a.idx", "a.line_no", "a.ts"), "a.idx").alias("e")
    return a.join(b, on).groupBy(*[F.col(f"b.{c}").alias(c) for c in ("unit_id", "session_ix", "lane", "file_path", "idx", "line_no", "ts")]).agg(first).select("unit_id", "session_ix", "lane", "file_path", "idx", "line_no", "ts", F.col("e.idx").alias("earlier_idx"), F.col("e.line_no").alias("earlier_line"))


def pushback_between(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """The first pushback turn strictly between the two lines of a pair, whoever sent it."""
    t = turns.where(is_pushback(F.col("text"))).select(F.col("unit_id").alias("tu"), F.col("session_ix").alias("tsx"), F.col("line_no").alias("turn_line"), F.col("ts").alias("turn_ts"))
    on = (F.col("unit_id") == F.col("tu")) & (F.col("session_ix") == F.col("tsx")) & (F.col("turn_line") > F.col("earlier_line")) & (F.col("turn_line") < F.col("line_no"))
    hit = pairs.join(t, on).groupBy("unit_id", "session_ix", "idx").agg(F.min_by(F.struct("turn_line", "turn_ts"), F.struct("turn_ts", "turn_line")).alias("p"))
    return hit.select("unit_id", "session_ix", "idx", "p.turn_line", "p.turn_ts")


def reverts_and_flips(actions: DataFrame, turns: DataFrame) -> DataFrame:
    pairs = revert_pairs(actions)
    pushed = pairs.join(pushback_between(pairs, turns), ["unit_id", "session_ix", "idx"], "left")
    ev = actions.where("kind in ('Read', 'Bash')").select(F.col("unit_id").alias("eu"), F.col("session_ix").alias("es"), F.col("lane").alias("el"), F.col("line_no").alias("eline"), F.col("ts").alias("ets"))
    between = F.when(F.col("el").isNull(), (F.col("eline") > F.col("turn_line")) & (F.col("eline") < F.col("line_no"))).otherwise((F.col("ets") > F.col("turn_ts")) & (F.col("ets") < F.col("ts")))
    candidates = pushed.where("lane is null and turn_line is not null")
    flips = candidates.join(ev, (F.col("unit_id") == F.col("eu")) & (F.col("session_ix") == F.col("es")) & between, "left_anti").select("unit_id", "session_ix", "idx", F.lit(True).alias("flip"))
    rows = pairs.join(flips, ["unit_id", "session_ix", "idx"], "left").withColumn("idxs", F.array("earlier_idx", "idx"))
    return finding(rows, 7, F.when(F.col("flip"), "flip").otherwise("true_revert"), "T2", True, "high", F.col("file_path"))


def user_corrections(actions: DataFrame) -> DataFrame:
    return finding(actions.where("user_modified").withColumn("idxs", F.array("idx")), 8, "user_corrected", "T2", True, "high", F.col("file_path"))


def review_burden(segments: DataFrame, limit: int = 400) -> DataFrame:
    edits = segments.where(is_edit(F.col("kind")))
    rows = edits.groupBy("unit_id", "session_ix", "segment").agg(_idxs(), F.sum("write_lines").alias("lines")).where(F.col("lines") > limit)
    return finding(rows, 9, "review_burden", "T1", False, "medium", note=F.lit("lines written in one stretch"), nums=F.create_map(F.lit("lines"), F.col("lines").cast("double")))


def large_write_instant_accept(actions: DataFrame, size: int = 2000, seconds: float = 3.0) -> DataFrame:
    rows = actions.where(is_edit(F.col("kind")) & F.col("lane").isNull() & ~F.col("auto_accept_here") & (F.col("write_len") >= size) & (F.col("approval_latency_s") <= seconds)).withColumn("idxs", F.array("idx"))
    return finding(rows, 10, "large_write_instant_accept", "T2", False, "medium", F.col("file_path"), F.lit("accepted within seconds"))


def secrets_touched(actions: DataFrame) -> DataFrame:
    rows = actions.where(F.col("kind").isin("Read", "Edit", "Write") & is_secrets(F.col("file_path"))).groupBy("unit_id", "file_path").agg(_idxs())
    return finding(rows, 11, "secrets_file_touched", "T1", True, "high", F.col("file_path"))


def per_file_findings(actions: DataFrame, churn_least: int = 2, re_read_least: int = 3) -> DataFrame:
    """Churn, re-reads and secrets touched, from one grouping by unit and file."""
    k = F.col("kind")
    edit, read = is_edit(k), k == "Read"
    rows = actions.where(F.col("file_path").isNotNull() & (edit | read))
    per = rows.groupBy("unit_id", "file_path").agg(
        F.sort_array(F.collect_list(F.when(edit, F.col("idx")))).alias("edited"), F.sort_array(F.collect_list(F.when(read, F.col("idx")))).alias("read"), F.sum(F.when(edit, F.coalesce("write_lines", F.lit(0)))).alias("lines"),
        F.max_by("read_total_lines", F.when(read & F.col("read_total_lines").isNotNull(), F.col("idx"))).alias("total_lines"),
    )
    relative = F.when((F.col("total_lines") > 0) & (F.col("lines") > 0), F.map_from_arrays(F.array(F.lit("relative_churn")), F.array(F.col("lines") / F.col("total_lines"))))
    none = F.lit(None).cast("map<string,double>")

    def found(holds: Column, ord_: int, kind: str, idxs: Column, nums: Column) -> Column:
        return F.when(holds, F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), idxs.cast("array<bigint>").alias("idxs"), nums.cast("map<string,double>").alias("nums")))

    edited, seen = F.col("edited"), F.col("read")
    parts = [
        found(F.size(edited) >= churn_least, 0, "churn", edited, relative), found(F.size(seen) >= re_read_least, 1, "re_read", seen, none),
        found(is_secrets(F.col("file_path")), 11, "secrets_file_touched", F.sort_array(F.concat(edited, seen)), none),
    ]
    one = per.select("unit_id", "file_path", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("unit_id", "file_path", "x.*")
    return finding(one, F.col("ord"), F.col("kind"), "T1", True, "high", F.col("file_path"), nums=F.col("nums"))


def single_action_findings(actions: DataFrame, size: int = 2000, seconds: float = 3.0) -> DataFrame:
    """Blind writes, user's corrections and instant accepts, from one reading of the actions, without a shuffle."""
    edit = is_edit(F.col("kind"))

    def found(holds: Column, ord_: int, kind: str, tier: str, exact: bool, confidence: str, note: str | None) -> Column:
        return F.when(holds, F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), F.lit(exact).alias("exact"), F.lit(confidence).alias("confidence"), F.lit(note).cast("string").alias("note")))

    large = edit & F.col("lane").isNull() & ~F.col("auto_accept_here") & (F.col("write_len") >= size) & (F.col("approval_latency_s") <= seconds)
    parts = [
        found(edit & F.contains("error", F.lit("File has not been read yet")), 3, "blind_write_attempt", "T1", True, "high", None), found(F.col("user_modified"), 8, "user_corrected", "T2", True, "high", None),
        found(large, 10, "large_write_instant_accept", "T2", False, "medium", "accepted within seconds"),
    ]
    rows = actions.select("unit_id", F.array("idx").cast("array<bigint>").alias("idxs"), F.col("file_path").alias("file"), F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return rows.select("unit_id", F.col("x.ord").alias("detector_ord"), "x.kind", "x.tier", "x.exact", "x.confidence", "idxs", "file", "x.note", F.lit(None).cast("map<string,double>").alias("nums"))


def segment_findings(segments: DataFrame, limit: int = 400, size: int = 10, least: int = 5) -> DataFrame:
    """Opening moves and review burden, from one grouping by segment."""
    edit = is_edit(F.col("kind"))
    w = Window.partitionBy("unit_id", "session_ix", "segment").orderBy("idx")
    first = F.col("pos") < size
    per = segments.withColumn("pos", F.row_number().over(w) - 1).groupBy("unit_id", "session_ix", "segment").agg(
        F.count("*").alias("n"), F.min(F.when(first & edit, F.col("pos"))).alias("first_edit"), F.min(F.when(first & (F.col("kind") == "Read"), F.col("pos"))).alias("first_read"),
        F.avg(F.when(first, F.when(edit, 1.0).otherwise(0.0))).alias("edit_fraction"), F.sort_array(F.collect_list(F.when(first, F.struct("pos", "idx")))).alias("opening"),
        F.sort_array(F.collect_list(F.when(edit, F.col("idx")))).alias("edited"), F.sum(F.when(edit, F.col("write_lines"))).alias("lines"),
    )
    upto = F.transform(F.filter("opening", lambda x: x["pos"] <= F.col("first_edit")), lambda x: x["idx"])
    read_first = F.coalesce(F.col("first_read") < F.col("first_edit"), F.lit(False))
    move = F.create_map(F.lit("edit_fraction_first10"), F.col("edit_fraction"), F.lit("first_edit_index"), F.col("first_edit").cast("double"))

    def found(holds: Column, ord_: int, kind: str, idxs: Column, note: Column, nums: Column) -> Column:
        return F.when(holds, F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), idxs.cast("array<bigint>").alias("idxs"), note.alias("note"), nums.cast("map<string,double>").alias("nums")))

    parts = [
        found((F.col("n") >= least) & F.col("first_edit").isNotNull(), 6, "opening_move", upto, F.when(read_first, "read-first").otherwise("patch-first"), move),
        found(F.col("lines") > limit, 9, "review_burden", F.col("edited"), F.lit("lines written in one stretch"), F.create_map(F.lit("lines"), F.col("lines").cast("double"))),
    ]
    one = per.select("unit_id", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("unit_id", "x.*")
    return finding(one, F.col("ord"), F.col("kind"), "T1", False, "medium", note=F.col("note"), nums=F.col("nums"))


_extra: dict[str, Callable[[dict], DataFrame]] = {}


def register_detector(name: str, detector: Callable[[dict], DataFrame]) -> None:
    """Add a detector: a function of {"actions", "turns", "segments"} that returns findings."""
    _extra[name] = detector


def all_findings(actions: DataFrame, turns: DataFrame) -> DataFrame:
    """Every detector's findings, in the fixed order of ``detector_ord``.

    Detectors that group alike share a grouping; each also stands alone above.
    """
    segments = order.with_segments(actions, turns)
    parts = [per_file_findings(actions), rework(actions), single_action_findings(actions), failure_loops(actions), action_loops(actions), segment_findings(segments), reverts_and_flips(actions, turns)]
    parts += [d({"actions": actions, "turns": turns, "segments": segments}).select(*FINDING_COLUMNS) for d in _extra.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_edit_verified(actions: DataFrame) -> DataFrame:
    """(unit_id, file_path, verified): a confirmed look back at a file after its last edit."""
    from ..functions.scalars import RUNNERS, contains_any

    last = actions.where(is_edit(F.col("kind")) & F.col("file_path").isNotNull()).groupBy("unit_id", "file_path").agg(F.max("idx").alias("last_idx"))
    ok = actions.where(F.col("is_error") == False)  # noqa: E712  null is neither
    runs = ok.where(F.col("kind") == "Bash").select("unit_id", "command", F.col("idx").alias("i"))
    runner = runs.where(contains_any(F.col("command"), RUNNERS)).groupBy("unit_id").agg(F.max("i").alias("runner_idx"))
    reads = ok.where(F.col("kind") == "Read").groupBy("unit_id", "file_path").agg(F.max("idx").alias("read_idx"))
    names = last.withColumn("name", basename(F.col("file_path")))
    in_command = mentions(runs.select("unit_id", F.col("i").alias("idx"), F.col("command").alias("text")), names.select("unit_id", "name").distinct()).groupBy("unit_id", "name").agg(F.max("idx").alias("i"))
    any_command = runs.where("command is not null").groupBy("unit_id").agg(F.max("i").alias("i")).withColumn("name", F.lit(""))  # an empty name is in every command
    named = names.join(in_command.unionByName(any_command), ["unit_id", "name"]).where(F.col("i") > F.col("last_idx")).select("unit_id", "file_path", F.lit(True).alias("named"))
    out = last.join(reads, ["unit_id", "file_path"], "left").join(runner, "unit_id", "left").join(named, ["unit_id", "file_path"], "left")
    seen = F.coalesce(F.col("read_idx") > F.col("last_idx"), F.lit(False)) | F.coalesce(F.col("runner_idx") > F.col("last_idx"), F.lit(False)) | F.coalesce("named", F.lit(False))
    return out.select("unit_id", "file_path", seen.alias("verified"))
