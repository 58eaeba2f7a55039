"""Queries over the adapter's actions and turns: windows, joins, aggregates, detectors, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as X
from ..operators import adapters, detect, order, rank, relations
from . import base_sql as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def acts(spark: SparkSession, d: str) -> DataFrame:
    return adapters.actions_from_events(spark, d)


def turns(spark: SparkSession, d: str) -> DataFrame:
    return adapters.turns_from_events(spark, d)


def joined(c: str = "idxs") -> Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)


def big(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("bigint").alias(name or c)


def cached_actions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Actions and turns, kept while many detectors read them; Spark drops them when it needs the room."""
    return acts(spark, d).persist(), turns(spark, d).persist()


def kept_findings(a: DataFrame, t: DataFrame) -> DataFrame:
    """All findings, kept while ranks and reports read them more than once."""
    return detect.all_findings(a, t).persist()


def findings_of(spark: SparkSession, d: str) -> DataFrame:
    a, t = cached_actions(spark, d)
    return detect.all_findings(a, t)


def shown(f: DataFrame) -> DataFrame:
    return f.select(big("unit_id"), "kind", "confidence", "file", joined())


# ---- windows -------------------------------------------------------------------------------

@query("w01_carry_forward_ts", B.sql(B.LINES, """, s AS (SELECT unit_id, line_no, CASE WHEN k%5<>0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS own FROM lines)
SELECT unit_id, line_no, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS effective_ts, own IS NULL AS ts_inherited FROM s"""))
def w01(spark, d):
    e = adapters.event_lines(spark, d).withColumn("own", F.when(F.col("k") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    w = Window.partitionBy("unit_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(big("unit_id"), big("line_no"), F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("")).alias("effective_ts"), F.col("own").isNull().alias("ts_inherited"))


@query("w02_carry_forward_mode", B.sql(B.LINES, "SELECT unit_id, line_no, auto_here AS auto_accept_here FROM lines"))
def w02(spark, d):
    return adapters.event_lines(spark, d).select(big("unit_id"), big("line_no"), "auto_accept_here")


@query("w03_total_order", B.sql(B.ACTIONS, "SELECT unit_id, idx, kind, lane, line_no FROM a"))
def w03(spark, d):
    return acts(spark, d).select(big("unit_id"), big("idx"), "kind", "lane", big("line_no"))


@query("w04_task_segments", B.sql(B.SEGMENTS, "SELECT unit_id, idx, CAST(segment AS BIGINT) AS segment, user_line_no FROM seg"))
def w04(spark, d):
    return order.with_segments(*cached_actions(spark, d)).select(big("unit_id"), big("idx"), "segment", big("user_line_no"))


@query("w05_run_detection", B.sql(B.FINDINGS, "SELECT unit_id, coalesce(lane,'') AS lane, n, list_min(idxs) AS first_idx, file FROM runs"))
def w05(spark, d):
    return order.action_runs(acts(spark, d)).select(big("unit_id"), F.coalesce("lane", F.lit("")).alias("lane"), big("n"), big("first_idx"), "file")


@query("w06_opening_window", B.sql(B.FINDINGS, "SELECT unit_id, CAST(segment AS BIGINT) AS segment, idx, pos, size AS segment_size FROM ow WHERE pos<10"))
def w06(spark, d):
    return order.opening_window(order.with_segments(*cached_actions(spark, d))).select(big("unit_id"), "segment", big("idx"), big("pos"), big("segment_size"))


@query("w07_preceding_edit", B.sql(B.ACTIONS, """SELECT unit_id, idx, (SELECT arg_max(v.file_path, v.idx) FROM a v WHERE v.unit_id=a.unit_id AND v.idx BETWEEN a.idx-5 AND a.idx-1 AND v.kind IN ('Edit','Write') AND v.lane IS NOT DISTINCT FROM a.lane) AS near_file FROM a WHERE kind='Bash' AND is_error"""))
def w07(spark, d):
    return order.preceding_edit(acts(spark, d)).where("kind = 'Bash' and is_error").select(big("unit_id"), big("idx"), "near_file")


@query("w08_active_span", B.sql(B.ACTIONS, """, g AS (SELECT unit_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY unit_id ORDER BY ts, idx) AS gap FROM a)
SELECT unit_id, max(s)-min(s) AS wall_s, CAST(coalesce(sum(least(greatest(gap,0),300)),0) AS BIGINT) AS active_s FROM g GROUP BY unit_id"""))
def w08(spark, d):
    return order.active_span(acts(spark, d)).select(big("unit_id"), big("wall_s"), big("active_s"))


@query("w09_gap_marks", B.sql(B.ACTIONS, """SELECT unit_id, idx, gap_s FROM (SELECT unit_id, idx, CAST(floor(epoch(lead(ts) OVER (PARTITION BY unit_id ORDER BY idx))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS gap_s FROM a) WHERE gap_s>300"""))
def w09(spark, d):
    return order.gap_marks(acts(spark, d)).select(big("unit_id"), big("idx"), big("gap_s"))


@query("w10_story_runs", B.sql(B.ACTIONS, """, s AS (SELECT *, CASE WHEN is_error THEN 'fail' ELSE 'ok' END AS outcome FROM a WHERE file_path IS NOT NULL),
b AS (SELECT *, CASE WHEN outcome='ok' AND lag(outcome) OVER w='ok' AND kind=lag(kind) OVER w THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY unit_id, file_path ORDER BY idx)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY unit_id, file_path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b)
SELECT unit_id, file_path, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n, count(*)>=3 AS collapsed FROM i GROUP BY unit_id, file_path, island"""))
def w10(spark, d):
    return order.story_runs(acts(spark, d)).select(big("unit_id"), "file_path", big("first_idx"), big("last_idx"), big("n"), "collapsed")


@query("w11_last_known_size", B.sql(B.ACTIONS, "SELECT unit_id, file_path, arg_max(total_lines, idx) AS total_lines FROM a WHERE kind='Read' GROUP BY ALL"))
def w11(spark, d):
    return order.last_known_size(acts(spark, d)).select(big("unit_id"), "file_path", big("total_lines"))


@query("w12_read_before_edit", B.sql(B.ACTIONS, """, s AS (SELECT unit_id, CASE WHEN EXISTS (SELECT 1 FROM a v WHERE v.unit_id=a.unit_id AND v.file_path=a.file_path AND v.kind='Read' AND v.idx<a.idx) THEN 1.0 ELSE 0.0 END AS seen FROM a WHERE kind='Edit')
SELECT u.unit_id, round(coalesce(avg(seen), 1.0), 6) AS share FROM (SELECT DISTINCT unit_id FROM a) u LEFT JOIN s USING (unit_id) GROUP BY ALL"""))
def w12(spark, d):
    return order.read_before_edit(acts(spark, d)).select(big("unit_id"), F.round("share", 6).alias("share"))


@query("w13_work_units", B.sql(B.UNITS, "SELECT project, path, CAST(unit AS BIGINT) AS unit, row_number() OVER (PARTITION BY project, unit ORDER BY first, path)-1 AS member FROM un"))
def w13(spark, d):
    return order.work_units(adapters.transcripts_from_events(spark, d)).select(big("project"), "path", big("unit"), big("member"))


@query("w14_joined_gaps", B.sql(B.UNITS, "SELECT project, path, round((first-rend)/60.0, 6) AS gap_min FROM un WHERE new=0"))
def w14(spark, d):
    return order.work_units(adapters.transcripts_from_events(spark, d)).where("new = 0").select(big("project"), "path", F.round("gap_min", 6).alias("gap_min"))


@query("w15_unit_cap", B.sql(B.UNITS, """, c AS (SELECT *, row_number() OVER (PARTITION BY project, unit ORDER BY CASE WHEN lines=1 THEN 1 ELSE 0 END DESC, first DESC, path DESC)<=3 AS kept FROM un)
SELECT project, path, kept, count(*) FILTER (NOT kept) OVER (PARTITION BY project, unit) AS dropped FROM c"""))
def w15(spark, d):
    units = order.work_units(adapters.transcripts_from_events(spark, d))
    return order.cap_units(units, 3, F.col("lines") == 1).select(big("project"), "path", "kept", big("dropped"))


@query("w16_session_seq", B.sql(B.TRANSCRIPTS, "SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY first, path)-1 AS seq FROM tr"))
def w16(spark, d):
    return order.session_seq(adapters.transcripts_from_events(spark, d)).select(big("project"), "path", big("seq"))


# ---- joins ---------------------------------------------------------------------------------

@query("j05_asof_backward", B.sql(B.TURNS, "SELECT a.unit_id, a.idx, (SELECT max(t.line_no) FROM t WHERE t.unit_id=a.unit_id AND t.line_no<a.line_no) AS turn_line FROM a"))
def j05(spark, d):
    return relations.asof_backward(*cached_actions(spark, d), ["unit_id"]).select(big("unit_id"), "idx", big("turn_line"))


@query("j06_asof_forward", B.sql(B.TURNS, "SELECT t.unit_id, t.line_no, coalesce((SELECT min(a.idx) FROM a WHERE a.unit_id=t.unit_id AND a.line_no>=t.line_no), (SELECT max(a.idx) FROM a WHERE a.unit_id=t.unit_id)) AS idx FROM t"))
def j06(spark, d):
    return relations.asof_forward(*cached_actions(spark, d), ["unit_id"]).select(big("unit_id"), big("line_no"), "idx")


@query("j07_interval_overlap", B.sql(B.FINDINGS, "SELECT unit_id, file_path, idx, e AS earlier FROM ov"))
def j07(spark, d):
    return detect.hunk_overlaps(acts(spark, d)).select(big("unit_id"), "file_path", big("idx"), big("earlier"))


@query("j08_content_equality", B.sql(B.TURNS + B.REVERTS, "SELECT unit_id, coalesce(lane,'') AS lane, file_path, idx, e AS earlier FROM rv"))
def j08(spark, d):
    return detect.revert_pairs(acts(spark, d)).select(big("unit_id"), F.coalesce("lane", F.lit("")).alias("lane"), "file_path", big("idx"), big("earlier_idx", "earlier"))


@query("j09_pushback_between", B.sql(B.TURNS + B.REVERTS, "SELECT unit_id, idx, tl AS turn_line FROM pb WHERE tl IS NOT NULL"))
def j09(spark, d):
    a, t = cached_actions(spark, d)
    return detect.pushback_between(detect.revert_pairs(a), t).select(big("unit_id"), big("idx"), big("turn_line"))


@query("j10_flip_evidence", B.sql(B.TURNS + B.REVERTS, "SELECT unit_id, idx, flip FROM fl"))
def j10(spark, d):
    f = detect.reverts_and_flips(*cached_actions(spark, d))
    return f.select(big("unit_id"), F.element_at("idxs", 2).alias("idx"), (F.col("kind") == "flip").alias("flip"))


@query("j11_path_attribution", B.sql(B.TURNS + B.FAILED, "SELECT unit_id, idx, file, near FROM fa"))
def j11(spark, d):
    return detect.attribute_failures(acts(spark, d)).select(big("unit_id"), big("idx"), F.col("file_path").alias("file"), F.col("by_proximity").alias("near"))


@query("j13_evidence", B.sql(B.FINDINGS, """, x AS (SELECT unit_id, o, kind, file, idxs, unnest(idxs[1:10]) AS i FROM f WHERE kind IN ('churn','re_read'))
SELECT x.unit_id, x.kind AS finding, x.file, x.i AS idx, a.kind AS action, a.line_no FROM x LEFT JOIN a ON a.unit_id=x.unit_id AND a.idx=x.i"""))
def j13(spark, d):
    a, _ = cached_actions(spark, d)
    f = detect.churn(a).unionByName(detect.re_read(a))
    x = f.select("unit_id", F.col("kind").alias("finding"), "file", F.explode(F.slice("idxs", 1, 10)).alias("idx"))
    got = x.join(a.select("unit_id", "idx", F.col("kind").alias("action"), "line_no"), ["unit_id", "idx"], "left")
    return got.select(big("unit_id"), "finding", "file", big("idx"), "action", big("line_no"))


@query("j14_window_overlap", B.sql(B.TRANSCRIPTS, """, c AS (SELECT user_id%50 AS project, event_id AS sha, CAST(floor(epoch(ts)) AS BIGINT) AS b FROM events WHERE event_type='purchase'),
w AS (SELECT *, lag(b) OVER (PARTITION BY project ORDER BY b, sha) AS a FROM c)
SELECT w.project, w.sha, count(*) AS sessions FROM w JOIN tr ON tr.project=w.project AND tr.last>w.a AND tr.first<=w.b WHERE w.a IS NOT NULL GROUP BY ALL"""))
def j14(spark, d):
    return relations.sessions_per_window(adapters.transcripts_from_events(spark, d), commit_windows(spark, d))


def commit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Purchases stand in for a project's commits; each window begins at the commit before it."""
    ev = adapters.events(spark, d).where("event_type = 'purchase'")
    return relations.commit_windows(ev.select((F.col("user_id") % 50).alias("project"), F.col("event_id").alias("sha"), F.unix_seconds("ts").alias("epoch")))


@query("j15_commit_windows", """SELECT user_id%50 AS project, event_id AS sha, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id%50 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS "start", CAST(floor(epoch(ts)) AS BIGINT) AS "end" FROM events WHERE event_type='purchase'""")
def j15(spark, d):
    return commit_windows(spark, d).select(big("project"), big("sha"), big("start"), big("end"))


@query("j16_locate_by_id", """WITH m AS (SELECT event_id%7 AS marker, user_id, max(ts) AS mtime FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY mtime DESC, user_id) AS rn, count(*) OVER (PARTITION BY marker) AS n FROM m)
SELECT marker, n AS sessions, CASE WHEN n=1 THEN 'verified' ELSE 'ambiguous' END AS verdict, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY rn) AS candidates FROM r WHERE rn<=5 GROUP BY marker, n""")
def j16(spark, d):
    return locate(adapters.events(spark, d).select((F.col("event_id") % 7).alias("marker"), "user_id", "ts"))


@query("j18_locate_all_tool_ids", """WITH m AS (SELECT event_id%5000 AS marker, user_id, max(ts) AS mtime FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY mtime DESC, user_id) AS rn, count(*) OVER (PARTITION BY marker) AS n FROM m)
SELECT marker, n AS sessions, CASE WHEN n=1 THEN 'verified' ELSE 'ambiguous' END AS verdict, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY rn) AS candidates FROM r WHERE rn<=5 GROUP BY marker, n""")
def j18(spark, d):
    """Every tool id of the logs (raw_lines' own), sought in every event."""
    return locate(adapters.events(spark, d).select((F.col("event_id") % 5000).alias("marker"), "user_id", "ts"))


def locate(hits: DataFrame) -> DataFrame:
    return relations.locate(hits).select(big("marker"), big("n", "sessions"), "verdict", "candidates")


# ---- aggregates ----------------------------------------------------------------------------

@query("a01_type_counts", "SELECT user_id AS unit_id, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def a01(spark, d):
    return adapters.events(spark, d).groupBy(F.col("user_id").alias("unit_id"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@query("a02_parse_health", B.sql(B.TURNS, "SELECT unit_id, count(*) FILTER (k%5=0) AS untimestamped, count(*) FILTER (k%97=0) AS parse_errors, count(*) FILTER (event_type='signup' AND event_id%4=0) AS interrupts FROM lines GROUP BY ALL"))
def a02(spark, d):
    e = adapters.event_lines(spark, d)
    return e.groupBy("unit_id").agg(F.count_if(F.col("k") % 5 == 0).alias("untimestamped"), F.count_if(F.col("k") % 97 == 0).alias("parse_errors"), F.count_if((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0)).alias("interrupts"))


TOKENS = """u AS (SELECT l_orderkey, o_custkey, CAST(l_quantity AS BIGINT) AS input, CAST(l_partkey%1000 AS BIGINT) AS output, CAST(l_suppkey AS BIGINT) AS cache_read, CAST(l_linenumber AS BIGINT) AS creation,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_quantity DESC) AS rn FROM lineitem JOIN orders ON o_orderkey=l_orderkey)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as usage lines of a message (the order) of a session (the customer); the last wins."""
    li, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    u = F.struct(F.col("l_quantity").cast("bigint").alias("input"), (F.col("l_partkey") % 1000).cast("bigint").alias("output"), F.col("l_suppkey").cast("bigint").alias("cache_read"), F.col("l_linenumber").cast("bigint").alias("creation"))
    last = relations.last_wins(li, ["l_orderkey"], u, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"), "u")
    return last.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "o_custkey", "u.*")


@query("d01_usage_last_wins", f"WITH {TOKENS} SELECT l_orderkey AS message_id, input, output, cache_read FROM u WHERE rn=1")
def d01(spark, d):
    return usage(spark, d).select(big("l_orderkey", "message_id"), "input", "output", "cache_read")


@query("a03_token_totals", f"""WITH {TOKENS} SELECT o_custkey AS session, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(creation) AS BIGINT) AS creation,
 round(CAST(sum(cache_read) AS DOUBLE)/nullif(sum(input)+sum(cache_read)+sum(creation),0), 6) AS hit_ratio FROM u WHERE rn=1 GROUP BY ALL""")
def a03(spark, d):
    s = usage(spark, d).groupBy(big("o_custkey", "session")).agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "creation")])
    return s.withColumn("hit_ratio", F.round(F.try_divide(F.col("cache_read"), F.col("input") + F.col("cache_read") + F.col("creation")), 6))


@query("d02_tool_use_first_wins", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id%101 ORDER BY ts, event_id) AS rn FROM events) SELECT user_id AS unit_id, event_id FROM x WHERE rn=1 OR event_id%101=0")
def d02(spark, d):
    ev = adapters.events(spark, d).withColumn("tool", F.when(F.col("event_id") % 101 != 0, F.col("event_id") % 101))
    return relations.first_wins(ev, ["user_id"], "tool", ["ts", "event_id"]).select(F.col("user_id").alias("unit_id"), "event_id")


@query("d03_result_last_wins", "SELECT user_id AS unit_id, event_id%101 AS tool, arg_max(event_type, (ts, event_id)) AS result FROM events GROUP BY ALL")
def d03(spark, d):
    ev = adapters.events(spark, d)
    return relations.last_wins(ev, [F.col("user_id").alias("unit_id"), (F.col("event_id") % 101).alias("tool")], F.col("event_type"), F.struct("ts", "event_id"), "result")


@query("d05_finding_idxs", B.sql(B.FINDINGS, "SELECT unit_id, array_to_string(list_sort(list_distinct(flatten(list(idxs)))), ',') AS idxs FROM f GROUP BY unit_id"))
def d05(spark, d):
    return relations.finding_idxs(findings_of(spark, d)).select(big("unit_id"), joined())


OVERVIEW = """count(*) AS actions, count(DISTINCT file_path) AS files_touched, count(*) FILTER (kind='Edit') AS edits, count(*) FILTER (kind='Write') AS writes, count(*) FILTER (kind='Read') AS reads, count(*) FILTER (kind='Bash') AS bash,
 count(*) FILTER (kind<>'Bash' AND is_error=false) AS file_ops, CAST(coalesce(sum(write_lines) FILTER (is_error=false),0) AS BIGINT) AS lines_written, count(*) FILTER (kind<>'Bash' AND is_error IS NULL) AS file_ops_unconfirmed"""


def overview_columns() -> list[Column]:
    k, ok, op = F.col("kind"), F.col("is_error") == F.lit(False), F.col("kind").isin("Read", "Edit", "Write")
    count = [F.count_if(k == x).alias(n) for x, n in (("Edit", "edits"), ("Write", "writes"), ("Read", "reads"), ("Bash", "bash"))]
    return [F.count("*").alias("actions"), F.count_distinct("file_path").alias("files_touched"), *count, F.count_if(op & ok).alias("file_ops"), F.coalesce(F.sum(F.when(ok, F.col("write_lines"))), F.lit(0)).cast("bigint").alias("lines_written"), F.count_if(op & F.col("is_error").isNull()).alias("file_ops_unconfirmed")]


@query("a04_overview", B.sql(B.ACTIONS, f"SELECT unit_id, {OVERVIEW} FROM a GROUP BY unit_id"))
def a04(spark, d):
    return acts(spark, d).groupBy(big("unit_id")).agg(*overview_columns())


@query("a05_tool_error_rates", B.sql(B.ACTIONS, "SELECT unit_id, kind, count(*) FILTER (is_error) AS failed, count(*) AS total FROM a GROUP BY ALL"))
def a05(spark, d):
    return relations.tool_error_rates(acts(spark, d)).select(big("unit_id"), "kind", "failed", "total")


@query("a06_validation_share", B.sql(B.ACTIONS, "SELECT unit_id, round(coalesce(avg(CASE WHEN command LIKE '%test%' OR command LIKE '%lint%' THEN 1.0 ELSE 0.0 END) FILTER (kind='Bash'),0.0),6) AS share FROM a GROUP BY ALL"))
def a06(spark, d):
    return acts(spark, d).groupBy(big("unit_id")).agg(F.round(F.coalesce(F.avg(F.when(F.col("kind") == "Bash", X.is_validation(F.col("command")).cast("double"))), F.lit(0.0)), 6).alias("share"))


@query("a07_read_edit_ratio", B.sql(B.ACTIONS, "SELECT unit_id, round(CAST(count(DISTINCT file_path) FILTER (kind='Read') AS DOUBLE)/nullif(count(DISTINCT file_path) FILTER (kind IN ('Edit','Write')),0),6) AS ratio FROM a GROUP BY ALL"))
def a07(spark, d):
    r = F.try_divide(F.count_distinct(F.when(F.col("kind") == "Read", F.col("file_path"))), F.count_distinct(F.when(X.is_edit(F.col("kind")), F.col("file_path"))))
    return acts(spark, d).groupBy(big("unit_id")).agg(F.round(r, 6).alias("ratio"))


@query("a08_edit_counts", B.sql(B.ACTIONS, "SELECT unit_id, file_path AS file, count(*) AS edits FROM a WHERE kind IN ('Edit','Write') GROUP BY ALL"))
def a08(spark, d):
    return rank.edit_counts(acts(spark, d)).select(big("unit_id"), "file", "edits")


@query("a09_patch_first_share", B.sql(B.FINDINGS, "SELECT unit_id, round(avg(CASE WHEN fr IS NOT NULL AND fr<fe THEN 0.0 ELSE 1.0 END),6) AS share, count(*) AS segments FROM om GROUP BY ALL"))
def a09(spark, d):
    m = detect.opening_moves(order.with_segments(*cached_actions(spark, d)))
    return m.groupBy(big("unit_id")).agg(F.round(F.avg((~F.col("read_first")).cast("double")), 6).alias("share"), F.count("*").alias("segments"))


@query("a10_breakdown", B.sql(B.RANKED, "SELECT unit_id, file, category, n FROM bd"))
def a10(spark, d):
    return rank.breakdown(findings_of(spark, d)).select(big("unit_id"), "file", "category", "n")


@query("a11_changed_lines", B.sql(B.ACTIONS, "SELECT unit_id, file_path AS file, CAST(sum(write_lines) AS BIGINT) AS changed_lines FROM a WHERE kind IN ('Edit','Write') AND is_error=false GROUP BY ALL"))
def a11(spark, d):
    return relations.changed_lines(acts(spark, d)).select(big("unit_id"), "file", "changed_lines")


@query("a13_lane_merge", B.sql(B.ACTIONS, "SELECT unit_id, coalesce(lane,'main') AS lane, count(*) AS actions, bool_or(auto_here) FILTER (lane IS NULL) AS main_auto FROM a GROUP BY ALL"))
def a13(spark, d):
    return relations.lane_counters(acts(spark, d)).select(big("unit_id"), "lane", "actions", "main_auto")


@query("a14_unit_merge", B.sql(B.UNITS, "SELECT project, CAST(unit AS BIGINT) AS unit, count(*) AS sessions, CAST(sum(lines) AS BIGINT) AS lines, arg_min(path, (first, path)) AS oldest FROM un GROUP BY ALL"))
def a14(spark, d):
    u = order.work_units(adapters.transcripts_from_events(spark, d))
    return u.groupBy(big("project"), big("unit")).agg(F.count("*").alias("sessions"), F.sum("lines").alias("lines"), F.min_by("path", F.struct("first", "path")).alias("oldest"))


@query("a15_latency_active", B.sql(B.ACTIONS, "SELECT unit_id, coalesce(bool_or(NOT auto_here) FILTER (lane IS NULL), NOT bool_or(auto_here)) AS active FROM a GROUP BY ALL"))
def a15(spark, d):
    return relations.latency_active(acts(spark, d)).select(big("unit_id"), "active")


@query("a16_multi_scope", B.sql(B.ACTIONS, f"SELECT project, unit_id, CAST(grouping(project, unit_id) AS BIGINT) AS level, {OVERVIEW} FROM a GROUP BY GROUPING SETS ((project, unit_id), (project), ())"))
def a16(spark, d):
    a = acts(spark, d)
    return a.groupingSets([["project", "unit_id"], ["project"], []], "project", "unit_id").agg(F.grouping_id("project", "unit_id").cast("bigint").alias("level"), *overview_columns())


@query("a12_recount", B.sql(B.ACTIONS, "SELECT unit_id, CAST(0 AS BIGINT) AS differences FROM a GROUP BY unit_id"))
def a12(spark, d):
    """A naive recount straight from the events, in SQL, against the overview; differences a unit."""
    adapters.events(spark, d).createOrReplaceTempView("recount_events")
    naive = spark.sql("""
      SELECT user_id AS unit_id, count_if(event_type = 'click') AS edits2, count_if(event_type = 'purchase') AS writes2, count_if(event_type = 'view') AS reads2,
        count_if(event_type = 'error') AS bash2, count_if(event_type IN ('view', 'click', 'purchase') AND event_id % 10 > 1) AS file_ops2
      FROM recount_events GROUP BY user_id""")
    ours = acts(spark, d).groupBy("unit_id").agg(*overview_columns())
    both = ours.join(naive, "unit_id", "full")
    diff = sum((F.col(c).eqNullSafe(F.col(f"{c}2")) == F.lit(False)).cast("bigint") for c in ("edits", "writes", "reads", "bash", "file_ops"))
    return both.where("actions is not null").select(big("unit_id"), diff.alias("differences"))


# ---- detectors -----------------------------------------------------------------------------

def _detector(name: str, kinds: str, build) -> None:
    QUERIES[name] = lambda spark, d: shown(build(*cached_actions(spark, d)))
    SQL[name] = B.sql(B.FINDINGS, f"SELECT unit_id, kind, confidence, file, array_to_string(idxs, ',') AS idxs FROM f WHERE kind IN ({kinds})")


_detector("f01_churn", "'churn'", lambda a, t: detect.churn(a))
_detector("f02_re_read", "'re_read'", lambda a, t: detect.re_read(a))
_detector("f03_rework", "'rework'", lambda a, t: detect.rework(a))
_detector("f04_blind_write", "'blind_write_attempt'", lambda a, t: detect.blind_write_attempts(a))
_detector("f05_failure_loop", "'failure_loop'", lambda a, t: detect.failure_loops(a))
_detector("f06_opening_move", "'opening_move'", lambda a, t: detect.opening_move(order.with_segments(a, t)))
_detector("f07_revert_flip", "'true_revert','flip'", detect.reverts_and_flips)
_detector("f08_user_corrected", "'user_corrected'", lambda a, t: detect.user_corrections(a))
_detector("f09_action_loop", "'action_loop'", lambda a, t: detect.action_loops(a))
_detector("f10_review_burden", "'review_burden'", lambda a, t: detect.review_burden(order.with_segments(a, t)))
_detector("f11_large_instant", "'large_write_instant_accept'", lambda a, t: detect.large_write_instant_accept(a))
_detector("f12_secrets_touched", "'secrets_file_touched'", lambda a, t: detect.secrets_touched(a))
QUERIES["f13_all_findings"] = lambda spark, d: shown(findings_of(spark, d))
SQL["f13_all_findings"] = B.sql(B.FINDINGS, "SELECT unit_id, kind, confidence, file, array_to_string(idxs, ',') AS idxs FROM f")


@query("f01_relative_churn", B.sql(B.ACTIONS, """, c AS (SELECT unit_id, file_path AS file, sum(write_lines) AS lines FROM a WHERE kind IN ('Edit','Write') GROUP BY ALL HAVING count(*)>=2), s AS (SELECT unit_id, file_path AS file, arg_max(total_lines, idx) AS total FROM a WHERE kind='Read' GROUP BY ALL)
SELECT unit_id, file, round(CASE WHEN lines>0 THEN CAST(lines AS DOUBLE)/total END, 6) AS relative_churn FROM c LEFT JOIN s USING (unit_id, file)"""))
def f01b(spark, d):
    return detect.churn(acts(spark, d)).select(big("unit_id"), "file", F.round(F.element_at("nums", F.lit("relative_churn")), 6).alias("relative_churn"))


VERIFIED = """, le AS (SELECT unit_id, file_path, max(idx) AS last_idx, any_value(name) AS b FROM a WHERE kind IN ('Edit','Write') GROUP BY ALL),
lv AS (SELECT unit_id, file_path AS file, EXISTS (SELECT 1 FROM a v WHERE v.unit_id=le.unit_id AND v.idx>le.last_idx AND v.is_error=false AND ((v.kind='Read' AND v.file_path=le.file_path) OR (v.kind='Bash' AND (contains(v.command, le.b) OR v.command IN ('cargo test','make'))))) AS verified FROM le)"""


@query("f14_last_edit_verified", B.sql(B.ACTIONS + VERIFIED, "SELECT unit_id, file, verified FROM lv"))
def f14(spark, d):
    return detect.last_edit_verified(acts(spark, d)).select(big("unit_id"), F.col("file_path").alias("file"), "verified")


# ---- ranks ---------------------------------------------------------------------------------

def ranked_of(spark: SparkSession, d: str) -> DataFrame:
    a, t = cached_actions(spark, d)
    return rank.rank_files(detect.all_findings(a, t), a)


def shown_breakdown() -> Column:
    return F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("breakdown")


@query("r01_rank_files", B.sql(B.RANKED, "SELECT unit_id, rank, file, class, edits, breakdown FROM rk"))
def r01(spark, d):
    return ranked_of(spark, d).select(big("unit_id"), big("rank"), "file", "class", "edits", shown_breakdown())


@query("r02_top_struggles", B.sql(B.RANKED, "SELECT unit_id, rank, file, count(*) OVER (PARTITION BY unit_id) AS total FROM rk QUALIFY rank<=3"))
def r02(spark, d):
    return rank.top_struggles(ranked_of(spark, d)).select(big("unit_id"), big("rank"), "file", big("total"))


REVIEW = """, q AS (SELECT unit_id, file, count(*) AS n, bool_or(kind IN ('failure_loop','blind_write_attempt','flip','user_corrected','secrets_file_touched')) AS solo, count(*) FILTER (kind='secrets_file_touched') AS s, count(*) FILTER (kind='flip') AS fl, count(*) FILTER (kind='user_corrected') AS uc, count(*) FILTER (kind='true_revert') AS tr, count(*) FILTER (kind='large_write_instant_accept') AS lw FROM f WHERE file IS NOT NULL AND kind<>'opening_move' GROUP BY ALL),
nr2 AS (SELECT q.*, rk.rank, row_number() OVER (PARTITION BY unit_id ORDER BY rk.rank NULLS LAST, file) AS pos FROM q LEFT JOIN rk USING (unit_id, file) WHERE n>=2 OR solo)"""


@query("r03_needs_review", B.sql(B.RANKED + REVIEW, "SELECT unit_id, pos, file, n AS n_findings FROM nr2 WHERE pos<=3"))
def r03(spark, d):
    a, t = cached_actions(spark, d)
    f = kept_findings(a, t)
    return rank.needs_review(f, rank.rank_files(f, a)).select(big("unit_id"), big("pos"), "file", "n_findings")


@query("x15_reason_sentence", B.sql(B.RANKED + REVIEW, """, ph AS (SELECT unit_id, file, list_position(['failure_loops','fumbles','rework','churn','re_read','action_loops'], category) AS sp,
 CASE category WHEN 'churn' THEN 'rewritten '||n||'x' WHEN 'rework' THEN 'reworked '||n||'x' WHEN 're_read' THEN 're-read '||n||'x' WHEN 'failure_loops' THEN n||' looped failing command'||CASE WHEN n=1 THEN '' ELSE 's' END WHEN 'fumbles' THEN n||' blind-write attempt'||CASE WHEN n=1 THEN '' ELSE 's' END ELSE n||' repeated-call loop'||CASE WHEN n=1 THEN '' ELSE 's' END END AS p FROM bd),
pl AS (SELECT unit_id, file, list(p ORDER BY sp) AS ps FROM ph GROUP BY ALL)
SELECT unit_id, file, concat_ws(', ', array_to_string(ps, ', '), CASE WHEN s>0 THEN 'secrets file touched' END, CASE WHEN fl>1 THEN 'flipped after pushback '||fl||'x' WHEN fl=1 THEN 'flipped after pushback' END, CASE WHEN uc>1 THEN 'user-corrected '||uc||'x' WHEN uc=1 THEN 'user-corrected' END, CASE WHEN tr>0 THEN 'self-reverted '||tr||'x' END, CASE WHEN lw>0 THEN lw||' large write'||CASE WHEN lw>1 THEN 's' ELSE '' END||' accepted instantly' END) AS reason FROM nr2 LEFT JOIN pl USING (unit_id, file) WHERE pos<=3"""))
def x15(spark, d):
    a, t = cached_actions(spark, d)
    f = kept_findings(a, t)
    return rank.needs_review(f, rank.rank_files(f, a)).select(big("unit_id"), "file", rank.reason_sentence().alias("reason"))


@query("r04_representative", B.sql(B.RANKED, """, r AS (SELECT unit_id, file, kind, idxs, category, row_number() OVER (PARTITION BY unit_id, file, category ORDER BY o, idxs[1], idxs[-1]) AS rd FROM fc WHERE file IS NOT NULL AND category IS NOT NULL)
SELECT unit_id, file, kind, array_to_string(idxs, ',') AS idxs, slot FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, file ORDER BY rd, list_position(['failure_loops','fumbles','rework','churn','re_read','action_loops'], category)) AS slot FROM r) WHERE slot<=4"""))
def r04(spark, d):
    return rank.representative_findings(findings_of(spark, d)).select(big("unit_id"), "file", "kind", joined(), big("slot"))


@query("r05_budgeted_prefix", B.sql(B.RANKED, """SELECT unit_id, file, used, total FROM (SELECT unit_id, rank, file, CAST(100 + sum(strlen(file)+60) OVER (PARTITION BY unit_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used, count(*) OVER (PARTITION BY unit_id) AS total FROM rk) WHERE used<=700"""))
def r05(spark, d):
    kept = rank.budgeted_prefix(ranked_of(spark, d), ["unit_id"], [F.col("rank")], F.octet_length("file") + 60, 100, 700)
    return kept.select(big("unit_id"), "file", big("used"), big("total"))


@query("r08_head_tail", B.sql(B.ACTIONS, """SELECT unit_id, file_path AS file, idx, greatest(n-4, 0) AS elided FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, file_path ORDER BY idx) AS u, row_number() OVER (PARTITION BY unit_id, file_path ORDER BY idx DESC) AS dn, count(*) OVER (PARTITION BY unit_id, file_path) AS n FROM a WHERE file_path IS NOT NULL) WHERE u<=2 OR dn<=2"""))
def r08(spark, d):
    rows = rank.head_tail(acts(spark, d).where("file_path is not null"), ["unit_id", "file_path"], "idx", 2)
    return rows.select(big("unit_id"), F.col("file_path").alias("file"), big("idx"), big("elided"))


@query("r09_frequent_types", """SELECT unit_id, type, n, pos FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, type) AS pos FROM (SELECT user_id AS unit_id, event_type AS type, count(*) AS n FROM events WHERE event_type NOT IN ('signup') GROUP BY ALL)) WHERE pos<=8""")
def r09(spark, d):
    n = adapters.events(spark, d).where("event_type <> 'signup'").groupBy(F.col("user_id").alias("unit_id"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    return rank.top_n(n, ["unit_id"], "n", "type", 8).select("unit_id", "type", "n", big("pos"))


@query("r10_newest_sessions", B.sql(B.TRANSCRIPTS, "SELECT project, path, pos FROM (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY last DESC, path) AS pos FROM tr) WHERE pos<=5"))
def r10(spark, d):
    return rank.top_n(adapters.transcripts_from_events(spark, d), ["project"], "last", "path", 5).select(big("project"), "path", big("pos"))


@query("r11_top_n_files", B.sql(B.ACTIONS, "SELECT unit_id, file, edits, pos FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY edits DESC, file) AS pos FROM (SELECT unit_id, file_path AS file, count(*) AS edits FROM a WHERE kind IN ('Edit','Write') GROUP BY ALL)) WHERE pos<=3"))
def r11(spark, d):
    return rank.top_n(rank.edit_counts(acts(spark, d)), ["unit_id"], "edits", "file").select(big("unit_id"), "file", "edits", big("pos"))


@query("r12_stratified_sample", B.sql(B.TRANSCRIPTS, """, p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last DESC, path) AS rn, count(*) OVER (PARTITION BY project) AS size FROM tr)
SELECT project, path FROM (SELECT *, row_number() OVER (ORDER BY size DESC, project, rn) AS g FROM p WHERE rn<=3) WHERE g<=15"""))
def r12(spark, d):
    w = Window.partitionBy("project")
    p = adapters.transcripts_from_events(spark, d).select("*", F.row_number().over(w.orderBy(F.desc("last"), "path")).alias("rn"), F.count("*").over(w).alias("size"))
    return p.where("rn <= 3").orderBy(F.desc("size"), "project", "rn").limit(15).select(big("project"), "path")
