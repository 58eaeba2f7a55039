"""Queries of reports, contracts, raw logs, pseudonyms, manifests and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import redact
from ..operators import adapters, detect, order, privacy, quality, rank, reports, shrink
from ..sources import transcripts as T
from ..sources.scratch import kept, scratch_path
from ..streaming import live
from . import base_sql as B
from .text_queries import SQL as TEXT_SQL, TALK, folded
from .unit_queries import OVERVIEW, acts, big, cached_actions, findings_of, joined, overview_columns

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: x12_redact's tables from i (doc_id, s) on, and its last select.
REDACT_SQL = TEXT_SQL["x12_redact"].split("\nb AS", 1)[1].rsplit("\nSELECT ", 1)
REDACT_SQL[0] = "b AS" + REDACT_SQL[0]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("t01_session_overview", B.sql(B.RANKED, f""", o AS (SELECT unit_id, {OVERVIEW} FROM a GROUP BY unit_id),
g AS (SELECT unit_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY unit_id ORDER BY ts, idx) AS gap FROM a),
sp AS (SELECT unit_id, max(s)-min(s) AS wall_s, CAST(coalesce(sum(least(greatest(gap,0),300)),0) AS BIGINT) AS active_s FROM g GROUP BY unit_id),
tp AS (SELECT unit_id, string_agg(file, ',' ORDER BY rank) FILTER (rank<=3) AS top_files, count(*) AS struggle_files FROM rk GROUP BY ALL),
mv AS (SELECT unit_id, avg(CASE WHEN fr IS NOT NULL AND fr<fe THEN 0.0 ELSE 1.0 END) AS s FROM om GROUP BY ALL)
SELECT unit_id, actions, edits, lines_written, wall_s, active_s, top_files, coalesce(struggle_files,0) AS struggle_files, round(s,6) AS patch_first_share FROM o LEFT JOIN sp USING (unit_id) LEFT JOIN tp USING (unit_id) LEFT JOIN mv USING (unit_id)"""))
def t01(spark, d):
    a, t = cached_actions(spark, d)
    o = reports.session_overview(a, t, a.groupBy("unit_id").agg(*overview_columns()))
    return o.select(big("unit_id"), "actions", "edits", "lines_written", big("wall_s"), big("active_s"), "top_files", big("struggle_files"), F.round("patch_first_share", 6).alias("patch_first_share"))


@query("t02_struggle_areas", B.sql(B.RANKED, """, r AS (SELECT unit_id, file, kind, row_number() OVER (PARTITION BY unit_id, file, category ORDER BY o, idxs[1], idxs[-1]) AS rd, category FROM fc WHERE file IS NOT NULL AND category IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY unit_id, file ORDER BY rd, list_position(['failure_loops','fumbles','rework','churn','re_read','action_loops'], category)) AS slot FROM r),
k AS (SELECT unit_id, file, string_agg(kind, ',' ORDER BY slot) AS kinds FROM s WHERE slot<=4 GROUP BY ALL), z AS (SELECT *, greatest(count(*) OVER (PARTITION BY unit_id)-5,0) AS omitted FROM rk)
SELECT unit_id, rank, file, class, edits, kinds, omitted FROM z LEFT JOIN k USING (unit_id, file) WHERE rank<=5"""))
def t02(spark, d):
    a, t = cached_actions(spark, d)
    f = detect.all_findings(a, t)
    return reports.struggle_areas(f, rank.rank_files(f, a)).select(big("unit_id"), big("rank"), "file", "class", "edits", "kinds", big("omitted"))


#: Every cut's payload written out whole, the largest first; of these the first that fits, or the last.
def shrunk(cap: int) -> str:
    rule = shrink.RANKING_RULE
    return f""", r AS (SELECT unit_id, file, kind, confidence, idxs, category, row_number() OVER (PARTITION BY unit_id, file, category ORDER BY o, idxs[1], idxs[-1]) AS rd FROM fc WHERE file IS NOT NULL AND category IS NOT NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY unit_id, file) AS n, row_number() OVER (PARTITION BY unit_id, file ORDER BY rd, list_position(['failure_loops','fumbles','rework','churn','re_read','action_loops'], category)) AS slot FROM r),
j AS (SELECT *, '{{"kind":"' || kind || '","tier":"' || CASE WHEN kind IN ('rework','failure_loop') THEN 'T2' ELSE 'T1' END || '","exact":' || (kind<>'failure_loop') || ',"confidence":"' || confidence || '","idxs":[' || array_to_string(idxs[1:10], ',') || ']' || CASE WHEN len(idxs)>10 THEN ',"idxs_total":' || len(idxs) ELSE '' END || ',"file":"' || file || '"}}' AS x FROM s),
e AS (SELECT rk.unit_id, rk.rank, p, max(coalesce(n,0))>p OR coalesce(bool_or(len(idxs)>10), false) AS hid, '{{"rank":' || rank || ',"file":"' || rk.file || '","class":"' || any_value(class) || '","edits":' || any_value(edits) || ',"breakdown":{{"' || replace(replace(any_value(breakdown), '=', '":'), ';', ',"') || '}},"findings":[' || coalesce(string_agg(x, ',' ORDER BY slot) FILTER (slot<=p), '') || ']' || CASE WHEN max(coalesce(n,0))>p THEN ',"findings_omitted":' || (max(n)-p) ELSE '' END || '}}' AS x FROM rk LEFT JOIN j USING (unit_id, file), (SELECT unnest([0,1,2,3,4]) AS p) WHERE rank<=20 GROUP BY rk.unit_id, rk.rank, rk.file, p),
tot AS (SELECT unit_id, count(*) AS total FROM rk GROUP BY ALL),
cut AS (SELECT unit_id, total, unnest(list_concat(list_transform(range(1, least(total,20)+1), lambda k: {{'k': CAST(k AS BIGINT), 'p': 4}}), list_transform([3,2,1,0], lambda p: {{'k': CAST(1 AS BIGINT), 'p': p}}))) AS c FROM tot),
pay AS (SELECT cut.unit_id, c.k, c.p, '{{"v":2,"session":{{"id":"' || cut.unit_id || '","identified_by":"table"}},"ranking_rule":"{rule}","files":[' || string_agg(x, ',' ORDER BY rank) || '],"files_total":' || any_value(total) || ',"n_max":20,"findings_per_file_cap":' || c.p || ',"truncated":' || (any_value(total)>c.k OR bool_or(hid)) || '}}' AS payload FROM cut JOIN e ON e.unit_id=cut.unit_id AND e.p=c.p AND e.rank<=c.k GROUP BY cut.unit_id, c.k, c.p),
fit AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY NOT (ceil(strlen(payload)/3.5)<={cap} OR (k=1 AND p=0)), k DESC, p DESC) AS rn FROM pay)
SELECT u.unit_id, coalesce(k, 0) AS files, CAST(coalesce(p, 4) AS BIGINT) AS per_file, coalesce(payload, '{{"v":2,"session":{{"id":"' || u.unit_id || '","identified_by":"table"}},"ranking_rule":"{rule}","files":[],"files_total":0,"n_max":20,"findings_per_file_cap":4,"truncated":false}}') AS payload FROM (SELECT DISTINCT unit_id FROM a) u LEFT JOIN (SELECT * FROM fit WHERE rn=1) USING (unit_id)"""


def struggle_payloads(spark: SparkSession, d: str, cap: int) -> DataFrame:
    a, t = cached_actions(spark, d)
    f = findings_of(spark, d)
    units = a.select("unit_id").distinct().withColumn("session", F.to_json(F.struct(F.col("unit_id").cast("string").alias("id"), F.lit("table").alias("identified_by"))))
    out = shrink.struggle_payloads(units, f, rank.rank_files(f, a), cap=cap, extra=())
    return out.select(big("unit_id"), big("files"), big("per_file"), "payload")


@query("t02_struggle_payload", B.sql(B.RANKED, shrunk(1500)))
def t02b(spark, d):
    """The whole payload of each unit, shrunk to the report's cap."""
    return struggle_payloads(spark, d, 1500)


@query("r07_two_stage_shrink", B.sql(B.RANKED, shrunk(170)))
def r07(spark, d):
    """Caps so small that files go and then findings."""
    return struggle_payloads(spark, d, 170)


@query("t03_file_story", B.sql(B.ACTIONS, """, s AS (SELECT *, CASE WHEN is_error THEN 'fail' ELSE 'ok' END AS outcome FROM a WHERE file_path IS NOT NULL),
b AS (SELECT *, CASE WHEN outcome='ok' AND lag(outcome) OVER w='ok' AND kind=lag(kind) OVER w THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY unit_id, file_path ORDER BY idx)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY unit_id, file_path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b),
g AS (SELECT unit_id, file_path AS file, min(idx) AS first_idx, count(*) AS n FROM i GROUP BY unit_id, file_path, island),
h AS (SELECT *, row_number() OVER (PARTITION BY unit_id, file ORDER BY first_idx) AS u, row_number() OVER (PARTITION BY unit_id, file ORDER BY first_idx DESC) AS v, count(*) OVER (PARTITION BY unit_id, file) AS runs FROM g)
SELECT unit_id, file, first_idx, n, greatest(runs-4,0) AS elided FROM h WHERE u<=2 OR v<=2"""))
def t03(spark, d):
    return reports.file_story(acts(spark, d), 2).select(big("unit_id"), F.col("file_path").alias("file"), big("first_idx"), big("n"), big("elided"))


@query("t04_blind_spots", B.sql(B.FINDINGS, """, la AS (SELECT unit_id, coalesce(bool_or(NOT auto_here) FILTER (lane IS NULL), NOT bool_or(auto_here)) AS active FROM a GROUP BY ALL),
z AS (SELECT f.*, count(*) OVER (PARTITION BY unit_id, kind) AS total, row_number() OVER (PARTITION BY unit_id, kind ORDER BY idxs[1], idxs[-1]) AS pos FROM f JOIN la USING (unit_id) WHERE kind IN ('blind_write_attempt','large_write_instant_accept','review_burden','secrets_file_touched') AND (kind<>'large_write_instant_accept' OR active))
SELECT unit_id, kind, pos, total, array_to_string(idxs, ',') AS idxs FROM z WHERE pos<=8"""))
def t04(spark, d):
    a, t = cached_actions(spark, d)
    main = F.bool_or(F.when(F.col("lane").isNull(), ~F.col("auto_accept_here")))
    active = a.groupBy("unit_id").agg(F.coalesce(main, ~F.bool_or("auto_accept_here")).alias("active"))
    return reports.blind_spots(detect.all_findings(a, t), active).select(big("unit_id"), "kind", big("pos"), big("total"), joined())


@query("t05_context_health", B.sql(B.ACTIONS, """, s AS (SELECT unit_id, avg(CASE WHEN EXISTS (SELECT 1 FROM a v WHERE v.unit_id=a.unit_id AND v.file_path=a.file_path AND v.kind='Read' AND v.idx<a.idx) THEN 1.0 ELSE 0.0 END) AS share FROM a WHERE kind='Edit' GROUP BY ALL),
n AS (SELECT unit_id, count(DISTINCT file_path) FILTER (kind='Read') AS r, count(DISTINCT file_path) FILTER (kind IN ('Edit','Write')) AS e FROM a GROUP BY ALL)
SELECT unit_id, r AS files_read, e AS files_edited, round(CAST(r AS DOUBLE)/nullif(e,0),6) AS read_edit_ratio, round(coalesce(share,1.0),6) AS share FROM n LEFT JOIN s USING (unit_id)"""))
def t05(spark, d):
    return reports.context_health(acts(spark, d)).select(big("unit_id"), "files_read", "files_edited", F.round("read_edit_ratio", 6).alias("read_edit_ratio"), F.round("share", 6).alias("share"))


@query("t06_evidence", B.sql(B.FINDINGS, """, c AS (SELECT DISTINCT unit_id, kind AS finding, unnest(idxs[1:10]) AS idx FROM f)
SELECT c.unit_id, c.finding, c.idx, a.kind, left(coalesce(a.command, a.error, a.edit_new), 600) AS excerpt, a.kind IS NOT NULL AS found FROM c LEFT JOIN a ON a.unit_id=c.unit_id AND a.idx=c.idx"""))
def t06(spark, d):
    a, t = cached_actions(spark, d)
    return reports.evidence(detect.all_findings(a, t), a).select(big("unit_id"), "finding", big("idx"), "kind", "excerpt", "found")


@query("t07_review_context", B.sql(B.TURNS, """, q AS (SELECT unit_id, count(*) FILTER (origin='Human') AS requests, count(*) FILTER (origin='Unknown') AS unknown_turns, count(*) FILTER (text LIKE '%revert%') AS pushbacks FROM t GROUP BY ALL),
e AS (SELECT unit_id, count(DISTINCT file_path) AS n FROM a WHERE kind IN ('Edit','Write') AND is_error IS DISTINCT FROM true GROUP BY ALL),
x AS (SELECT unit_id, count(*) AS n FROM (SELECT unit_id, command, arg_max(is_error, idx) AS err FROM a WHERE kind='Bash' AND command IN ('cargo test','npm run lint') GROUP BY ALL) WHERE err GROUP BY ALL)
SELECT u.unit_id, coalesce(requests,0) AS requests, coalesce(unknown_turns,0) AS unknown_turns, coalesce(pushbacks,0) AS pushbacks, coalesce(e.n,0) AS files_edited, coalesce(x.n,0) AS failing_commands FROM (SELECT DISTINCT unit_id FROM a) u LEFT JOIN q USING (unit_id) LEFT JOIN e USING (unit_id) LEFT JOIN x USING (unit_id)"""))
def t07(spark, d):
    return reports.review_context(*cached_actions(spark, d)).select(big("unit_id"), "requests", "unknown_turns", "pushbacks", "files_edited", "failing_commands")


@query("t08_session_intent", "WITH RECURSIVE " + TALK + ",\ni AS (SELECT unit_id*1000000+line_no AS doc_id, text AS s FROM tu WHERE origin<>'NonHuman'),\n" + REDACT_SQL[0] + ",\nrd AS (SELECT " + REDACT_SQL[1] + """),
it AS (SELECT unit_id, line_no, CAST(strlen(rd.text) AS BIGINT) AS cost, row_number() OVER (PARTITION BY unit_id ORDER BY line_no) AS rn, count(*) OVER (PARTITION BY unit_id) AS n, rd.text AS quote FROM tu LEFT JOIN rd ON rd.doc_id=unit_id*1000000+line_no WHERE origin<>'NonHuman'),
""" + folded(4000) + ", gu AS (SELECT unit_id, n, unnest(kept) AS line_no FROM gl)\nSELECT gu.unit_id, gu.line_no, gu.n, quote FROM gu JOIN it ON it.unit_id=gu.unit_id AND it.line_no=gu.line_no")
def t08(spark, d):
    """Each conversation's requests, redacted, that fit a budget in order."""
    from .text_queries import talk

    t, _ = talk(spark, d)
    t = t.where("origin <> 'NonHuman'").withColumn("quote", redact(F.col("text"))).withColumn("cost", F.octet_length("quote"))
    kept = rank.greedy_skip(t, "unit_id", "line_no", "cost", 4000)
    rows = kept.select("unit_id", "n", F.explode("kept").alias("line_no"))
    return rows.join(t.select("unit_id", "line_no", "quote"), ["unit_id", "line_no"]).select("unit_id", "line_no", big("n"), "quote")


@query("t09_timeline", B.sql(B.ACTIONS, "SELECT unit_id, idx, round(CASE WHEN count(*) OVER w>1 THEN idx*100.0/(count(*) OVER w - 1) ELSE 0 END,6) AS x, CASE kind WHEN 'Read' THEN 'read' WHEN 'Bash' THEN 'bash' ELSE 'edit' END AS track, coalesce(is_error,false) AS failed FROM a WINDOW w AS (PARTITION BY unit_id)"))
def t09(spark, d):
    return reports.timeline(acts(spark, d)).select(big("unit_id"), big("idx"), F.round("x", 6).alias("x"), "track", "failed")


@query("t09_finding_bands", B.sql(B.FINDINGS, "SELECT unit_id, kind, file, list_min(idxs) AS from_idx, list_max(idxs) AS to_idx FROM f"))
def t09b(spark, d):
    return reports.finding_bands(findings_of(spark, d)).select(big("unit_id"), "kind", "file", "from_idx", "to_idx")


@query("t10_story_failures", B.sql(B.TURNS + B.FAILED, """, h AS (SELECT unit_id, file_path AS file, idx, row_number() OVER (PARTITION BY unit_id, file_path ORDER BY idx) AS u, row_number() OVER (PARTITION BY unit_id, file_path ORDER BY idx DESC) AS v FROM a WHERE file_path IS NOT NULL)
SELECT DISTINCT unit_id, file, idx FROM (SELECT unit_id, file, idx FROM h WHERE u<=2 OR v<=2 UNION ALL SELECT unit_id, file, idx FROM fa)"""))
def t10(spark, d):
    return reports.story_with_failures(acts(spark, d), 2).select(big("unit_id"), F.col("file_path").alias("file"), big("idx"))


@query("t12_unit_disclosure", B.sql(B.UNITS, """, c AS (SELECT *, row_number() OVER (PARTITION BY project, unit ORDER BY first DESC, path DESC)<=3 AS kept FROM un)
SELECT project, CAST(unit AS BIGINT) AS unit, count(*) AS sessions, round(sum(CASE WHEN new=0 THEN (first-rend)/60.0 ELSE 0 END),3) AS gap_min, min(first) AS first, max(last) AS last, count(*) FILTER (NOT kept) AS dropped FROM c GROUP BY ALL HAVING count(*)>1"""))
def t12(spark, d):
    m = order.cap_units(order.work_units(adapters.transcripts_from_events(spark, d)), 3)
    return reports.unit_disclosure(m).select(big("project"), big("unit"), "sessions", "gap_min", "first", "last", "dropped")


# ---- contracts -----------------------------------------------------------------------------

@query("dq1_findings_contract", B.sql(B.FINDINGS, """, x AS (SELECT unit_id, CASE WHEN unit_id%5=0 THEN 'odd' ELSE kind END AS kind, unit_id%7=0 AS badconf, unit_id%11=0 AS noidx FROM f)
SELECT unit_id, kind, rule, count(*) AS n FROM (SELECT unit_id, kind, 'kind' AS rule FROM x WHERE kind='odd' UNION ALL SELECT unit_id, kind, 'confidence' FROM x WHERE badconf UNION ALL SELECT unit_id, kind, 'idxs' FROM x WHERE noidx) GROUP BY ALL"""))
def dq1(spark, d):
    """Findings with faults put in by unit."""
    u = F.col("unit_id")
    f = findings_of(spark, d).withColumn("kind", F.when(u % 5 == 0, "odd").otherwise(F.col("kind"))).withColumn("confidence", F.when(u % 7 == 0, "sure").otherwise(F.col("confidence"))).withColumn("idxs", F.when(u % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.col("idxs")))
    return quality.check_findings(f).groupBy(big("unit_id"), "kind", "rule").agg(F.count("*").alias("n"))


@query("dq2_payload_contract", B.sql(B.ACTIONS, "SELECT unit_id, rule FROM (SELECT unit_id, unnest(CASE WHEN unit_id%9=0 THEN ['unreadable'] WHEN unit_id%4=0 THEN ['version'] WHEN unit_id%6=1 THEN ['truncated'] ELSE [] END) AS rule FROM (SELECT DISTINCT unit_id FROM a))"))
def dq2(spark, d):
    u = F.col("unit_id")
    p = acts(spark, d).groupBy("unit_id").agg(F.count_if(F.col("kind") == "Edit").alias("edits"))
    p = p.select("unit_id", F.to_json(F.struct(F.when(u % 4 != 0, F.lit(3)).alias("version"), F.when(u % 4 == 0, F.lit(False)).when(u % 6 != 1, F.lit(False)).alias("truncated"), "edits")).alias("json"))
    p = p.withColumn("json", F.when(u % 9 == 0, F.concat(F.lit("{"), F.col("json"))).otherwise(F.col("json")))
    return quality.check_payloads(p, 400).select(big("unit_id"), "rule")


BROKEN = ['"v":2', '"identified_by":"table"', shrink.RANKING_RULE, '"class":', '"truncated":', '"breakdown":', '"tier":"T1"', '"idxs":[']
INSTEAD = ['"v":1', '"identified_by":"guess"', " ", '"klass":', '"cut":', '"score":', '"tier":"T9"', '"idxs":[-1,']


@query("dq2_nested_payloads", B.sql(B.RANKED, f"""{shrunk(1500).rsplit("SELECT u.unit_id", 1)[0]}, b AS (SELECT fit.unit_id, k, unit_id%9 AS how FROM fit WHERE rn=1), x AS (SELECT b.*, unnest(range(0, k)) AS pos FROM b)
SELECT unit_id, unnest([['version','$.v'],['provenance','$.session.identified_by'],['ranking_rule','$.ranking_rule']][how+1:how+1])[1] AS rule, unnest([['version','$.v'],['provenance','$.session.identified_by'],['ranking_rule','$.ranking_rule']][how+1:how+1])[2] AS place FROM b WHERE how<3
UNION ALL SELECT unit_id, 'class', '$.files[' || pos || '].class' FROM x WHERE how=3 UNION ALL SELECT unit_id, 'truncated', '$.truncated' FROM b WHERE how=4
UNION ALL SELECT unit_id, 'score', '$.files[' || pos || '].score' FROM x WHERE how=5 UNION ALL SELECT unit_id, 'breakdown', '$.files' FROM b WHERE how=5
UNION ALL SELECT b.unit_id, CASE how WHEN 6 THEN 'finding_tier' ELSE 'finding_idxs' END, '$.files[' || (rank-1) || '].findings[' || (slot-1) || '].' || CASE how WHEN 6 THEN 'tier' ELSE 'idxs' END FROM b JOIN fit ON fit.unit_id=b.unit_id AND fit.rn=1 JOIN rk ON rk.unit_id=b.unit_id AND rk.rank<=b.k JOIN s ON s.unit_id=rk.unit_id AND s.file=rk.file AND s.slot<=fit.p WHERE how=7 OR (how=6 AND s.kind NOT IN ('rework','failure_loop'))"""))
def dq2b(spark, d):
    """Whole payloads, each unit's broken in one way of eight, or not at all."""
    p, how = struggle_payloads(spark, d, 1500).where("files > 0"), F.col("unit_id") % 9
    text = F.col("payload")
    for k, (old, new) in enumerate(zip(BROKEN, INSTEAD, strict=True)):
        text = F.when(how == k, F.replace("payload", F.lit(old), F.lit(new))).otherwise(text)
    return quality.check_reports(kept(p.select("unit_id", text.alias("json")), "payloads"), 1600, ["table"]).select(big("unit_id"), "rule", "place")


@query("dq4_top_files", B.sql(B.RANKED, """, z AS (SELECT *, string_split(file, '/')[-1] AS b FROM rk WHERE rank<=3), td AS (SELECT unit_id, 'see ' || string_agg(b, ' and ' ORDER BY rank) FILTER (rank<=1+unit_id%3) AS text FROM z GROUP BY ALL)
SELECT unit_id, 'missing_file' AS rule, file FROM z JOIN td USING (unit_id) WHERE NOT contains(text, b)"""))
def dq4b(spark, d):
    """Debriefs that name one, two or three of the first three files."""
    from .unit_queries import ranked_of

    top = ranked_of(spark, d).where("rank <= 3").select("unit_id", "rank", "file").withColumn("b", F.element_at(F.split("file", "/"), -1))
    text = top.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("rank", "b"))).alias("all"))
    text = text.select("unit_id", F.concat(F.lit("see "), F.array_join(F.transform(F.filter("all", lambda x: x["rank"] <= 1 + F.col("unit_id") % 3), lambda x: x["b"]), " and ")).alias("text"))
    return quality.check_top_files(text, top).select(big("unit_id"), "rule", "file")


@query("dq3_unit_invariants", B.sql(B.UNITS, ", g AS (SELECT project, unit, count(*) AS sessions, count(*) FILTER (new=0) AS gaps FROM un GROUP BY ALL) SELECT project, CAST(unit AS BIGINT) AS unit, 'gaps' AS rule FROM g WHERE unit%5=0 AND gaps+1<>sessions-1"))
def dq3(spark, d):
    m = order.work_units(adapters.transcripts_from_events(spark, d))
    u = m.groupBy("project", "unit").agg(F.count("*").alias("sessions"), (F.count_if(F.col("new") == 0) + F.when(F.col("unit") % 5 == 0, 1).otherwise(0)).alias("gaps"), F.count_distinct("path").alias("ids"), F.lit(0).alias("dropped"))
    return quality.check_units(u).select(big("project"), big("unit"), "rule")


@query("dq4_debrief_citations", B.sql(B.ACTIONS, """, m AS (SELECT unit_id, max(idx) AS m FROM a GROUP BY ALL)
SELECT unit_id, rule FROM (SELECT unit_id, unnest([CASE WHEN unit_id%2=0 OR len(list_distinct([0,1,unit_id%30]))<3 THEN 'few_citations' END, CASE WHEN (unit_id%30>m AND unit_id%2=1) OR m<1 THEN 'fabricated' END, CASE WHEN unit_id%3=0 THEN 'few_words' END]) AS rule FROM m) WHERE rule IS NOT NULL"""))
def dq4(spark, d):
    a, u = acts(spark, d), F.col("unit_id")
    text = F.concat(F.lit("see #0 and #1"), F.when(u % 2 == 1, F.concat(F.lit(" and #"), (u % 30).cast("string"))).otherwise(""), F.when(u % 3 == 0, " churn").otherwise(" churn, rework"))
    return quality.check_debriefs(a.select("unit_id").distinct().withColumn("text", text), a, ["churn", "rework", "revert"]).select(big("unit_id"), "rule")


# ---- raw logs ------------------------------------------------------------------------------

def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """The adapter's actions written as raw log lines: a call, then its result; some lines are damaged."""
    a = acts(spark, d)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tool = F.concat(F.lit("t"), (F.col("event_id") % 5000).cast("string"))
    call = F.to_json(F.struct(F.lit("assistant").alias("type"), F.when(F.col("event_id") % 5 != 0, stamp).alias("timestamp"), F.concat(F.lit("/home/u"), F.col("unit_id").cast("string")).alias("cwd"), F.struct(
        F.concat(F.lit("m"), F.floor(F.col("line_no") / 2).cast("string")).alias("id"), F.struct(F.col("line_no").alias("input_tokens"), F.lit(2).alias("output_tokens")).alias("usage"),
        F.array(F.struct(F.lit("tool_use").alias("type"), tool.alias("id"), F.col("kind").alias("name"), F.struct("file_path", "command", F.col("edit_old").alias("old_string"), F.col("edit_new").alias("new_string")).alias("input"))).alias("content")).alias("message")))
    call = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("{"), call)).otherwise(call)
    result = F.to_json(F.struct(F.lit("user").alias("type"), stamp.alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), tool.alias("tool_use_id"), "is_error", F.coalesce("error", F.lit("fine")).alias("content"))).alias("content")).alias("message"),
        F.struct(F.transform("hunks", lambda h: F.struct(h["lo"].alias("oldStart"), (h["hi"] - h["lo"]).alias("oldLines"))).alias("structuredPatch"), F.col("user_modified").alias("userModified")).alias("toolUseResult")))
    who = F.col("unit_id").cast("string")
    both = F.explode(F.array(F.struct((F.col("line_no") * 2).alias("line_no"), call.alias("value")), F.struct((F.col("line_no") * 2 + 1).alias("line_no"), result.alias("value")))).alias("l")
    return a.select(who.alias("file"), who.alias("session_id"), F.lit(None).cast("string").alias("agent_id"), both).select("file", "session_id", "agent_id", "l.line_no", "l.value")


@query("s03_parse_events", B.sql(B.ACTIONS, "SELECT CAST(unit_id AS VARCHAR) AS session_id, count(*) FILTER (event_id%97=0) AS parse_errors, count(*) FILTER (event_id%97<>0 AND event_id%5=0) AS untimestamped FROM a GROUP BY ALL"))
def s03(spark, d):
    return T.sessions(T.parse(raw_lines(spark, d))).select("session_id", "parse_errors", F.col("untimestamped_lines").alias("untimestamped"))


@query("s06_transcript_span", B.sql(B.ACTIONS, "SELECT CAST(unit_id AS VARCHAR) AS file, strftime(min(ts),'%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(ts),'%Y-%m-%dT%H:%M:%SZ') AS last FROM a GROUP BY ALL"))
def s06(spark, d):
    """Spans from the raw text alone, without parsing it."""
    stamps = raw_lines(spark, d).select("file", F.explode(F.regexp_extract_all("value", F.lit('"timestamp":"([^"]{20,})"'), F.lit(1))).alias("at"))
    return stamps.where(F.substring("at", 11, 1) == "T").groupBy("file").agg(F.min("at").alias("first"), F.max("at").alias("last"))


CALLS = ", c AS (SELECT *, row_number() OVER (PARTITION BY unit_id, event_id%5000 ORDER BY line_no) AS rn FROM a WHERE event_id%97<>0)"


@query("p02_tool_calls", B.sql(B.ACTIONS, CALLS + " SELECT CAST(unit_id AS VARCHAR) AS session_id, line_no*2 AS line_no, kind, file_path, command, CASE WHEN edit_new IS NOT NULL THEN strlen(edit_new) END AS write_len FROM c WHERE rn=1"))
def p02(spark, d):
    return T.tool_calls(T.blocks(T.parse(raw_lines(spark, d)))).select("session_id", big("line_no"), "kind", "file_path", "command", "write_len")


@query("p05_results", B.sql(B.ACTIONS, ", r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, event_id%5000 ORDER BY line_no DESC) AS rn FROM a) SELECT CAST(unit_id AS VARCHAR) AS file, 't' || (event_id%5000) AS tool_use_id, coalesce(is_error,false) AS is_error, CASE WHEN is_error THEN coalesce(error,'fine') END AS error, CASE WHEN kind='Edit' THEN lo || '-' || hi ELSE '' END AS hunks, user_modified FROM r WHERE rn=1"))
def p05(spark, d):
    r = T.results(T.blocks(T.parse(raw_lines(spark, d))))
    h = F.coalesce(F.array_join(F.transform("hunks", lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ","), F.lit(""))
    return r.select("file", "tool_use_id", "is_error", "error", h.alias("hunks"), "user_modified")


@query("j01_actions_from_log", B.sql(B.ACTIONS, CALLS + """, r AS (SELECT unit_id, event_id%5000 AS tool, arg_max(coalesce(is_error,false), line_no) AS is_error FROM a GROUP BY ALL)
SELECT CAST(c.unit_id AS VARCHAR) AS session_id, c.line_no*2 AS line_no, c.kind, r.is_error FROM c JOIN r ON r.unit_id=c.unit_id AND r.tool=c.event_id%5000 WHERE rn=1"""))
def j01log(spark, d):
    b = T.blocks(T.parse(raw_lines(spark, d)))
    return T.actions(T.tool_calls(b), T.results(b)).select("session_id", big("line_no"), "kind", "is_error")


@query("p14_usage", B.sql(B.ACTIONS, ", u AS (SELECT unit_id, line_no//2 AS mid, max(line_no) AS n FROM a WHERE event_id%97<>0 GROUP BY ALL) SELECT CAST(unit_id AS VARCHAR) AS session_id, CAST(sum(n) AS BIGINT) AS input, count(*)*2 AS output FROM u GROUP BY ALL"))
def p14(spark, d):
    return T.usage(T.parse(raw_lines(spark, d))).select("session_id", "input", "output")


def sibling_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as spawns in their user's log, and sibling agent files c0 to c39 in each of five folders."""
    ev = adapters.events(spark, d)
    user, tool = F.col("user_id").cast("string"), F.concat(F.lit("t"), F.col("event_id").cast("string"))
    folder = F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"), F.lit("/"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    call = F.to_json(F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), tool.alias("id"), F.lit("Task").alias("name"))).alias("content")).alias("message")))
    child = F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string"))
    result = F.to_json(F.struct(F.lit("user").alias("type"), stamp.alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), tool.alias("tool_use_id"))).alias("content")).alias("message"), F.struct(child.alias("agentId")).alias("toolUseResult")))
    both = F.explode(F.array(F.struct((F.col("event_id") * 2).alias("line_no"), call.alias("value")), F.struct((F.col("event_id") * 2 + 1).alias("line_no"), result.alias("value")))).alias("l")
    main = ev.select(F.concat(folder, user, F.lit(".jsonl")).alias("file"), user.alias("session_id"), F.lit(None).cast("string").alias("agent_id"), both).select("file", "session_id", "agent_id", "l.line_no", "l.value")
    agent = F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))
    name = F.concat(F.lit("p"), F.floor(F.col("id") / 40).cast("string"), F.lit("/agent-"), agent, F.lit(".jsonl"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("e").alias("id"), F.lit("Edit").alias("name"))).alias("content")).alias("message")))
    sub = spark.range(200).select(name.alias("file"), F.lit(None).cast("string").alias("session_id"), agent.alias("agent_id"), F.lit(0).cast("bigint").alias("line_no"), line.alias("value"))
    return main.unionByName(sub)


def spawned_of(events: DataFrame) -> DataFrame:
    b = T.blocks(events)
    return T.spawns(T.tool_calls(b), T.results(b))


@query("d04_sibling_owner", """WITH m AS (SELECT user_id, min(ts) AS t FROM events GROUP BY ALL),
c AS (SELECT DISTINCT 'p' || user_id%5 || '/agent-c' || event_id%50 || '.jsonl' AS file, user_id FROM events WHERE event_id%50<40)
SELECT file, arg_min(CAST(c.user_id AS VARCHAR), (t, CAST(c.user_id AS VARCHAR))) AS session_id, CAST(1 AS BIGINT) AS actions FROM c JOIN m ON m.user_id=c.user_id GROUP BY file""")
def d04(spark, d):
    """Sibling agent files under the oldest session that claims each."""
    ev = T.parse(sibling_lines(spark, d))
    rows = T.with_siblings(ev, T.sibling_claims(ev, spawned_of(ev))).where("agent_id is not null")
    return T.tool_calls(T.blocks(rows)).groupBy("file", "session_id").agg(F.count("*").alias("actions"))


@query("j04_missing_children", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS spawned, count(*) FILTER (event_id%50>=40) AS missing FROM events GROUP BY ALL")
def j04(spark, d):
    ev = T.parse(sibling_lines(spark, d))
    s = spawned_of(ev)
    return T.missing_children(s, ev, T.sibling_claims(ev, s))


@query("pr1_pseudonymise")
def pr1(spark, d):
    return privacy.pseudonymise(raw_lines(spark, d), ["session_id", "line_no"]).select("session_id", "line_no", "value", F.array_join("unknown", ",").alias("unknown"))


@query("pr2_audit", B.sql(B.ACTIONS, "SELECT CAST(unit_id AS VARCHAR) AS session_id, count(*)*2 AS lines_before, count(*)*2 AS lines_after, true AS structure_kept, true AS ids_kept, true AS usage_kept, CAST(0 AS BIGINT) AS leaks FROM a GROUP BY ALL"))
def pr2(spark, d):
    before = raw_lines(spark, d).where("session_id is not null")
    after = privacy.pseudonymise(before, ["session_id", "line_no"])
    out = privacy.audit(before, after, "session_id", ["/home/u", "/p/f"])
    return out.select("session_id", "lines_before", "lines_after", "structure_kept", "ids_kept", "usage_kept", big("leaks"))


@query("pr2_audit_failing", """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS session_id, any_value(user_id%5) AS c, count(*) AS n FROM events GROUP BY 1)
SELECT session_id, n AS lines_before, CASE WHEN c<>1 THEN n WHEN n>1 THEN n-1 END AS lines_after, c<>1 AS structure_kept, c NOT IN (1,2) AS ids_kept, c NOT IN (1,3) AS usage_kept, CAST(CASE WHEN c=4 THEN 1 ELSE 0 END AS BIGINT) AS leaks FROM l""")
def pr2b(spark, d):
    """Audits of scrubbed logs of which most were spoilt after: a line lost, a link changed, tokens changed, a text let through."""
    e = adapters.events(spark, d)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    e = e.select(F.col("user_id").cast("string").alias("session_id"), (F.col("user_id") % 5).alias("c"), F.row_number().over(w).cast("bigint").alias("line_no"), own.alias("uuid"), F.lag(own).over(w).alias("parentUuid"))
    usage = F.struct((F.col("line_no") + 1000).alias("input_tokens"), F.lit(2).alias("output_tokens"))
    before = e.select("session_id", "c", "line_no", F.to_json(F.struct(F.lit("assistant").alias("type"), "uuid", "parentUuid", F.lit("/home/u").alias("cwd"), F.struct(usage.alias("usage")).alias("message"))).alias("value"))
    after = privacy.pseudonymise(before, ["session_id", "c", "line_no"])
    first, c = F.col("line_no") == 1, F.col("c")
    spoilt = F.when(first & (c == 2), F.regexp_replace("value", '"uuid":"', '"uuid":"z')).when(first & (c == 3), F.regexp_replace("value", '"input_tokens":1', '"input_tokens":2')).when(first & (c == 4), F.regexp_replace("value", r"\}$", ',"cwd2":"/home/u"}')).otherwise(F.col("value"))
    after = after.where(~(first & (c == 1))).withColumn("value", spoilt)
    out = privacy.audit(before, after, "session_id", ["/home/u"])
    return out.select("session_id", "lines_before", "lines_after", "structure_kept", "ids_kept", "usage_kept", big("leaks"))


# ---- streams -------------------------------------------------------------------------------

LANDED = "event_id long, ts timestamp, user_id long, event_type string, project long, k long"


def landed(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str]:
    """The events as landing files, and a stream over them."""
    e = adapters.events(spark, d).select("event_id", "ts", "user_id", "event_type", (F.col("user_id") % 50).alias("project"), F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"))
    folder = scratch_path(spark, name)
    e.write.parquet(f"{folder}/landing")
    return live.tail(spark, f"{folder}/landing", LANDED), folder


LANDINGS = 4
LANDING_ROWS = 500_000


def landed_out_of_order(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str, str]:
    """The events in LANDINGS batches of files, a third of each one batch late, with a closing mark a year on; and how late a row may be.

    The mark has no user and moves the watermark behind all events, as the last line of a closed log would.
    """
    e = adapters.events(spark, d).select("event_id", "ts", "user_id", "event_type", (F.col("user_id") % 50).alias("project"), F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"))
    folder = scratch_path(spark, name)
    lo, hi, n = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.count("*")).head()
    files = n // LANDING_ROWS + 1
    step = ((hi or 0) - (lo or 0)) // (LANDINGS - 1) + 1
    at = F.floor((F.unix_seconds("ts") - F.lit(lo)) / step) + F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, 1).otherwise(0)
    e = e.withColumn("at", at)
    for k in range(LANDINGS):  # a file source takes files in the order in which they were written
        e.where(F.col("at") == k).drop("at").repartition(files).write.mode("append").parquet(f"{folder}/landing")
    mark = spark.range(1).select(F.lit(None).cast("bigint").alias("event_id"), F.timestamp_seconds(F.lit(hi or 0) + 366 * 86_400).alias("ts"), *[F.lit(None).cast(t).alias(c) for c, t in (("user_id", "bigint"), ("event_type", "string"), ("project", "bigint"), ("k", "bigint"))])
    mark.write.mode("append").parquet(f"{folder}/landing")
    return live.tail(spark, f"{folder}/landing", LANDED, files), folder, f"{2 * step} seconds"


@query("st2_stream_dedup", "SELECT user_id, event_id%1000 AS call, min(event_id%1) AS z, count(*) AS n FROM events GROUP BY ALL")
def st2(spark, d):
    """Replays of an event are dropped: the events land twice and come out once."""
    e = adapters.events(spark, d).select("event_id", "ts", "user_id", "event_type", (F.col("user_id") % 50).alias("project"), F.lit(0).cast("bigint").alias("k"))
    folder = scratch_path(spark, "dedup")
    e.unionByName(e).write.parquet(f"{folder}/landing")
    out = live.run_to_table(live.first_calls(live.tail(spark, f"{folder}/landing", LANDED), ["user_id", "event_id"]), folder)
    return out.groupBy("user_id", (F.col("event_id") % 1000).alias("call")).agg(F.lit(0).cast("bigint").alias("z"), F.count("*").alias("n"))


@query("st3_stream_units", B.sql("e AS (SELECT user_id%50 AS project, ts FROM events), r AS (SELECT *, max(ts) OVER (PARTITION BY project ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1801 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM r)", "SELECT project, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(*) AS n FROM s GROUP BY project, u"))
def st3(spark, d):
    s, folder = landed(spark, d, "units")
    out = live.run_to_table(live.work_units(s), folder, "complete")
    return out.select("project", F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"), "n")


@query("st4_stream_modes", B.sql(B.LINES, "SELECT unit_id AS user_id, event_id, auto_here AS mode FROM lines"))
def st4(spark, d):
    s, folder, late = landed_out_of_order(spark, d, "modes")
    return live.run_to_table(live.carried_modes(s, late=late), folder).where("user_id is not null")


@query("st5_stream_loops", B.sql(B.LINES, """, c AS (SELECT *, event_type || ':' || (k%3) AS call FROM lines), b AS (SELECT *, CASE WHEN call IS DISTINCT FROM lag(call) OVER (PARTITION BY unit_id ORDER BY line_no) THEN 1 ELSE 0 END AS brk FROM c),
i AS (SELECT *, sum(brk) OVER (PARTITION BY unit_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY unit_id, run ORDER BY line_no) AS r FROM i)
SELECT unit_id AS user_id, event_id, call, r AS repeats FROM n WHERE r>=3"""))
def st5(spark, d):
    s, folder, late = landed_out_of_order(spark, d, "loops")
    return live.run_to_table(live.live_loops(s, late=late), folder).where("user_id is not null")


@query("st6_stream_nudges", B.sql(B.LINES, ", c AS (SELECT *, count(*) FILTER (event_type IN ('click','purchase')) OVER (PARTITION BY unit_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM lines) SELECT unit_id AS user_id, event_id, n AS edits FROM c WHERE event_type IN ('click','purchase') AND n%3=0"))
def st6(spark, d):
    s, folder, late = landed_out_of_order(spark, d, "nudges")
    return live.run_to_table(live.nudges(s, late=late), folder).where("user_id is not null")


@query("st7_stream_tumbling", "SELECT CAST(floor(epoch(time_bucket(INTERVAL 1 HOUR, ts))) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st7(spark, d):
    s, folder = landed(spark, d, "tumbling")
    return live.run_to_table(live.tumbling(s), folder, "complete").select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("st7_stream_sliding", "SELECT CAST(floor(epoch(time_bucket(INTERVAL 15 MINUTE, ts))) AS BIGINT) - o*900 AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0,1,2,3]) AS o) GROUP BY ALL")
def st7b(spark, d):
    s, folder = landed(spark, d, "sliding")
    return live.run_to_table(live.tumbling(s, "1 hour", "15 minutes"), folder, "complete").select(F.unix_seconds("start").alias("start"), "event_type", "n")
