"""Joins, deduplication and aggregates over a unit's rows that stand alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import is_edit


def asof_backward(actions: DataFrame, turns: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, turn_line): the line of the latest turn strictly before each action's, in one running window over both."""
    none = F.lit(None).cast("bigint")
    both = actions.select(*by, "line_no", F.col("idx").cast("bigint").alias("idx"), none.alias("turn_line")).unionByName(turns.select(*by, "line_no", none.alias("idx"), F.col("line_no").cast("bigint").alias("turn_line")))
    w = Window.partitionBy(*by).orderBy("line_no", F.col("idx").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    return both.select(*by, "idx", F.last("turn_line", ignorenulls=True).over(w).alias("turn_line")).where("idx is not null")


def asof_forward(actions: DataFrame, turns: DataFrame, by: list[str]) -> DataFrame:
    """(by, line_no, idx): the first action at or after each turn's line, else the group's last."""
    none = F.lit(None).cast("bigint")
    both = actions.select(*by, "line_no", F.col("idx").cast("bigint").alias("idx"), F.lit(False).alias("turn")).unionByName(turns.select(*by, "line_no", none.alias("idx"), F.lit(True).alias("turn")))
    ahead = Window.partitionBy(*by).orderBy("line_no").rangeBetween(0, Window.unboundedFollowing)
    at = F.coalesce(F.min("idx").over(ahead), F.max("idx").over(Window.partitionBy(*by)))
    return both.select(*by, "line_no", "turn", at.alias("idx")).where("turn").drop("turn")


def commit_windows(commits: DataFrame) -> DataFrame:
    """(project, sha, epoch) commits with the time of the one before: a window is open at its start."""
    w = Window.partitionBy("project").orderBy("epoch", "sha")
    return commits.select("project", "sha", F.lag("epoch").over(w).alias("start"), F.col("epoch").alias("end"))


def sessions_in_windows(sessions: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of a project's sessions (first, last) and windows (start, end] that overlap; spans without ends overlap nothing."""
    s, w = sessions.alias("s"), windows.where("start is not null").alias("w")
    return w.join(s, (F.col("w.project") == F.col("s.project")) & (F.col("s.last") > F.col("w.start")) & (F.col("s.first") <= F.col("w.end"))).select("w.project", "w.sha", "s.path")


def sessions_per_window(sessions: DataFrame, windows: DataFrame) -> DataFrame:
    """(project, sha, sessions): how many of a project's sessions (first, last) overlap each window (start, end]; windows without any go.

    Those that began up to its end less those that had ended by its start, as no span ends before it begins: two running
    counts over a project's ends, and no pair of a session and a window is made.
    """
    s = sessions.where("project is not null and first is not null and last is not null")
    w = windows.where("project is not null and start is not null and `end` is not null")
    none, no = F.lit(None).cast(dict(windows.dtypes)["sha"]).alias("sha"), F.lit(0)

    def marks(rows: DataFrame, at: str, sha: Column, began: Column, ended: Column, edge: str) -> DataFrame:
        return rows.select("project", sha, F.col(at).alias("_at"), began.alias("_began"), ended.alias("_ended"), F.lit(edge).alias("_edge"))

    rows = marks(s, "first", none, F.lit(1), no, "").unionByName(marks(s, "last", none, no, F.lit(1), ""))
    rows = rows.unionByName(marks(w, "end", F.col("sha"), no, no, "end")).unionByName(marks(w, "start", F.col("sha"), no, no, "start"))
    upto = Window.partitionBy("project").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    n = F.when(F.col("_edge") == "end", F.sum("_began").over(upto)).when(F.col("_edge") == "start", -F.sum("_ended").over(upto))
    return rows.withColumn("_n", n).where("_edge <> ''").groupBy("project", "sha").agg(F.sum("_n").alias("sessions")).where("sessions > 0")


def locate(hits: DataFrame, newest: int = 5) -> DataFrame:
    """(marker, n, verdict, candidates): the sessions that hold a marker, the newest named.

    The rank stands alone in its window, so each task keeps few rows a marker before the shuffle; the
    count is a grouped one.
    """
    m = hits.groupBy("marker", "user_id").agg(F.max("ts").alias("mtime"))
    n = m.groupBy("marker").agg(F.count("*").alias("n")).select(F.col("marker").alias("_marker"), "n")
    r = m.withColumn("rn", F.row_number().over(Window.partitionBy("marker").orderBy(F.desc("mtime"), F.asc_nulls_last("user_id")))).where(F.col("rn") <= newest)
    c = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "user_id"))), lambda x: x["user_id"].cast("string")), ",")
    top = r.groupBy("marker").agg(c.alias("candidates")).join(n, F.col("marker").eqNullSafe(F.col("_marker")))
    return top.select("marker", "n", F.when(F.col("n") == 1, "verified").otherwise("ambiguous").alias("verdict"), "candidates")


def last_wins(rows: DataFrame, by: list[str | Column], value: Column, order: Column, name: str) -> DataFrame:
    """One row a key with the value of its last row: usage of a message, a result of a call."""
    return rows.groupBy(*by).agg(F.max_by(value, order).alias(name))


def first_wins(rows: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without one all stay."""
    rn = F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))
    return rows.withColumn("_rn", rn).where(F.col("_rn").eqNullSafe(1) | F.col(key).isNull()).drop("_rn")


def finding_idxs(findings: DataFrame) -> DataFrame:
    """Per unit every action that a finding cites, once, in order."""
    return findings.groupBy("unit_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("idxs")))).alias("idxs"))


def tool_error_rates(actions: DataFrame) -> DataFrame:
    return actions.groupBy("unit_id", "kind").agg(F.count_if("is_error").alias("failed"), F.count("*").alias("total"))


def changed_lines(actions: DataFrame) -> DataFrame:
    """Lines that confirmed edits wrote, a file."""
    sure = actions.where(is_edit(F.col("kind")) & F.col("is_error").eqNullSafe(False))
    return sure.groupBy("unit_id", F.col("file_path").alias("file")).agg(F.sum("write_lines").alias("changed_lines"))


def lane_counters(actions: DataFrame) -> DataFrame:
    """Per lane its actions, and whether the main one ever ran under auto-accept."""
    main = F.bool_or(F.when(F.col("lane").isNull(), F.col("auto_accept_here"))).alias("main_auto")
    return actions.groupBy("unit_id", F.coalesce("lane", F.lit("main")).alias("lane")).agg(F.count("*").alias("actions"), main)


def latency_active(actions: DataFrame) -> DataFrame:
    """Whether approval times say anything: some main action ran outside auto-accept, or, without main actions, none ran in it."""
    main = F.bool_or(F.when(F.col("lane").isNull(), ~F.col("auto_accept_here")))
    return actions.groupBy("unit_id").agg(F.coalesce(main, ~F.bool_or("auto_accept_here")).alias("active"))
