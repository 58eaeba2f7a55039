"""The corpus study on units assembled from raw logs, with the flags that ranks and review lists give; decisions and tokens from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as X
from ..operators import assemble, context, detect, order, rank, study, unit_payloads
from ..sources import transcripts as T
from ..sources.scratch import kept as written
from . import base_sql as B
from .log_queries import COUNTERS, LOGS, MERGED, SQL as LOG_SQL, TALK, UNIT_FINDINGS, WHOLE_LOGS, _json, log_lines, talk_lines
from .study_queries import AGREE, COMPARED, RR, _long

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Units of the given tables are short, so the study keeps those of five actions; v01_unit_corpus counts by the study's own twenty.
FEWEST = 5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CORPUS = UNIT_FINDINGS + """,
xs AS (SELECT unit_id, count(*) AS actions, count(*) FILTER (kind='Bash' AND is_error) AS failed, CAST(floor(epoch(coalesce(TRY_CAST(nullif(arg_min(eff, idx),'') AS TIMESTAMP), TRY_CAST(nullif(max(eff),'') AS TIMESTAMP)))) AS BIGINT) AS start FROM a GROUP BY unit_id),
xm AS (SELECT unit_id, any_value(project) AS project, max(last) AS modified FROM km GROUP BY unit_id),
xc AS (SELECT xm.*, coalesce(actions,0) AS actions, coalesce(failed,0) AS failed, start, (SELECT max(modified) FROM xm) AS now FROM xm LEFT JOIN xs USING (unit_id))"""

DUMP = CORPUS + """,
q AS (SELECT unit_id, file, count(*) AS n, bool_or(kind IN ('failure_loop','blind_write_attempt','flip','user_corrected','secrets_file_touched')) AS solo, bool_or(kind IN ('churn','rework','re_read','failure_loop','blind_write_attempt','action_loop')) AS ranks FROM f WHERE file IS NOT NULL AND kind<>'opening_move' GROUP BY ALL),
ed AS (SELECT unit_id, file_path AS file, count(*) AS edits, CAST(coalesce(sum(write_lines) FILTER (is_error=false),0) AS BIGINT) AS lines, max(idx) AS last_idx FROM a WHERE kind IN ('Edit','Write') GROUP BY ALL),
rk AS (SELECT unit_id, file, row_number() OVER (PARTITION BY unit_id ORDER BY coalesce(edits,0)=0, """ + B.TIER + """, coalesce(edits,0) DESC, file) AS rank FROM q LEFT JOIN ed USING (unit_id, file) WHERE ranks),
nv AS (SELECT unit_id, file, row_number() OVER (PARTITION BY unit_id ORDER BY rank NULLS LAST, file) AS pos FROM q LEFT JOIN rk USING (unit_id, file) WHERE n>=2 OR solo),
kf AS (SELECT unit_id, file, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT unit_id, file, kind FROM f WHERE file IS NOT NULL) GROUP BY ALL),
dump AS (SELECT ed.unit_id, ed.file, edits, lines, coalesce(kinds,'') AS kinds, coalesce(pos<=3, false) AS flagged_nr, coalesce(rank<=3, false) AS flagged_top3,
 EXISTS (SELECT 1 FROM a v WHERE v.unit_id=ed.unit_id AND v.idx>ed.last_idx AND v.is_error=false AND ((v.kind='Read' AND v.file_path=ed.file) OR (v.kind='Bash' AND v.command IN ('cargo test','make')))) AS verified
 FROM ed LEFT JOIN nv USING (unit_id, file) LEFT JOIN rk USING (unit_id, file) LEFT JOIN kf USING (unit_id, file))"""

STUDY = DUMP + f""",
xk AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start NULLS FIRST, unit_id)-1 AS seq FROM xc WHERE NOT coalesce(now-modified<600, false) AND actions>={FEWEST}),
xl AS (SELECT project, max(seq) AS ls FROM xk GROUP BY ALL),
xf AS (SELECT dump.*, project, seq, start, failed, flagged_nr OR regexp_matches(kinds, 'failure_loop|user_corrected|true_revert|flip') AS strong FROM dump JOIN xk USING (unit_id)),
xr AS (SELECT *, row_number() OVER (PARTITION BY project, seq ORDER BY edits DESC, file) AS be, row_number() OVER (PARTITION BY project, seq ORDER BY lines DESC, file) AS bl FROM xf),
oc AS (SELECT x.project, x.seq, x.file, bool_or(y.seq<=x.seq+3) AS nw, bool_or(y.seq<=x.seq+3 AND y.strong) AS ns, bool_or(y.start<=x.start+14*86400) AS ww, bool_or(y.start<=x.start+14*86400 AND y.strong) AS ws FROM xf x JOIN xf y ON x.project=y.project AND x.file=y.file AND y.seq>x.seq GROUP BY ALL),
p AS (SELECT project, seq, file, edits, lines, failed, kinds, verified, flagged_nr, flagged_top3, coalesce(nw,false) AS next3_weak, coalesce(ns,false) AS next3_strong, coalesce(ww,false) AS within14d_weak, coalesce(ws,false) AS within14d_strong,
 edits>=2 AS base_edits_ge2, edits>=4 AS base_edits_ge4, be<=3 AS base_top3_edits, lines>=200 AS base_lines_ge200, lines>=400 AS base_lines_ge400, bl<=3 AS base_top3_lines, failed>=1 AS base_failed_ge1, true AS base_all,
 CASE WHEN edits<=1 THEN '1' WHEN edits<=3 THEN '2-3' ELSE '4+' END AS stratum FROM xr JOIN xl USING (project) LEFT JOIN oc USING (project, seq, file) WHERE seq<ls)"""

#: The study over all members of units.
WHOLE_STUDY = WHOLE_LOGS + STUDY.removeprefix(LOGS)


def corpus(u: assemble.Units, actions: DataFrame) -> DataFrame:
    """(unit_id, project, modified, actions, failed, start, now) of all units; the latest stamp of the corpus is now."""
    m = u.members.where("kept").groupBy("unit_id").agg(F.first("project").alias("project"), F.max("last").alias("modified"))
    rows = m.join(study.session_records(actions), "unit_id", "left").na.fill(0, ["actions", "failed"])
    return rows.join(F.broadcast(u.members.where("kept").agg(F.max("last").alias("now"))))


def dumped(spark: SparkSession, d: str, cap: int | None = order.MEMBERS) -> tuple[DataFrame, DataFrame]:
    """Units of the corpus, and the edited files of each with flags, kinds of findings and look-backs."""
    u = assemble.assemble(log_lines(spark, d), cap=cap)
    a = written(u.actions, "actions")
    f = written(detect.all_findings(a, written(u.turns, "turns")), "findings")
    ranked = written(rank.rank_files(f, a), "ranked")
    return corpus(u, a), study.file_records(a, f, ranked, rank.needs_review(f, ranked), detect.last_edit_verified(a))


def unit_pairs(spark: SparkSession, d: str, cap: int | None = order.MEMBERS) -> DataFrame:
    sessions, files = dumped(spark, d, cap)
    seq = study.number_sessions(study.corpus_filter(sessions, F.col("now"), FEWEST).where("excluded is null")).select("unit_id", "project", "start", "failed", "seq", "last_seq")
    strong = F.col("flagged_nr") | F.arrays_overlap("kinds", F.array(*map(F.lit, study.STRONG_KINDS)))
    return study.build_pairs(written(files.withColumn("strong", strong).join(seq, "unit_id"), "files"))


@query("t11_unit_dump", B.sql(DUMP, "SELECT xc.project, unit_id, start, actions, failed, file, edits, lines, kinds, flagged_nr, flagged_top3, verified FROM dump JOIN xc USING (unit_id)"))
def t11(spark, d):
    """Edited files of each unit with what the study needs of the unit."""
    sessions, files = dumped(spark, d)
    return files.join(sessions, "unit_id").select("project", "unit_id", "start", "actions", "failed", "file", "edits", "lines", F.array_join("kinds", ",").alias("kinds"), "flagged_nr", "flagged_top3", "verified")


@query("v01_unit_corpus", B.sql(CORPUS, ", x AS (SELECT *, CASE WHEN now-modified<600 THEN 'recent' WHEN actions<20 THEN 'low_actions' END AS excluded FROM xc) SELECT project, count(*) AS discovered, count(*) FILTER (excluded='recent') AS excluded_recent, count(*) FILTER (excluded='low_actions') AS excluded_low_actions, count(*) FILTER (excluded IS NULL) AS sessions FROM x GROUP BY ALL"))
def v01(spark, d):
    """Units found and studied, and why the others are left out: by twenty actions and ten minutes."""
    u = assemble.assemble(log_lines(spark, d))
    x = study.corpus_filter(corpus(u, u.actions), F.col("now")).groupBy("project")
    return x.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("excluded") == e).alias(f"excluded_{e}") for e in ("recent", "low_actions")], F.count_if(F.col("excluded").isNull()).alias("sessions"))


@query("v02_unit_pairs", B.sql(WHOLE_STUDY, f"SELECT project, seq, file, edits, lines, failed, verified, stratum, {', '.join(study.RULES)}, next3_weak, next3_strong, within14d_weak, within14d_strong FROM p"))
def v02(spark, d):
    outcomes = [f"{w}_{o}" for w in study.WINDOWS for o in study.OUTCOMES]
    return unit_pairs(spark, d, cap=None).select("project", "seq", "file", "edits", "lines", "failed", "verified", "stratum", *study.RULES, *outcomes)


@query("v07_unit_comparison", B.sql(_long(base=STUDY) + COMPARED, 'SELECT rule, "window", outcome, a, b, c, d, round(rr,6) AS rr, round(rr_lo,6) AS rr_lo, round(rr_hi,6) AS rr_hi, round("precision",6) AS "precision", round(miss_rate,6) AS miss_rate, thin, round(flag_share,6) AS flag_share FROM cm'))
def v07(spark, d):
    """Every rule, window and outcome: cells, relative risk with its interval, precision, misses, thin cells."""
    t = study.rule_comparison(unit_pairs(spark, d))
    return t.withColumns({c: F.round(c, 6) for c in ("rr", "rr_lo", "rr_hi", "precision", "miss_rate", "flag_share")})


@query("v08_unit_agreement", B.sql(STUDY, f", g AS ({AGREE}) SELECT product, baseline, bucket, count(*) AS n, count(*) FILTER (h) AS positive, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END),6) AS rate FROM g GROUP BY ALL"))
def v08(spark, d):
    return study.rule_agreement(unit_pairs(spark, d)).withColumn("rate", F.round("rate", 6))


@query("v09_unit_false_alarms", B.sql(WHOLE_STUDY, ", g AS (SELECT 'flagged_nr' AS rule, next3_weak AS h FROM p WHERE flagged_nr UNION ALL SELECT 'flagged_top3', next3_weak FROM p WHERE flagged_top3) SELECT rule, count(*) AS flagged, count(*) FILTER (NOT h) AS no_future_edit, round(avg(CASE WHEN h THEN 0.0 ELSE 1.0 END),6) AS share FROM g GROUP BY ALL"))
def v09(spark, d):
    return study.false_alarms(unit_pairs(spark, d, cap=None)).withColumn("share", F.round("share", 6))


@query("v10_unit_strata", B.sql(_long("stratum, ", STUDY), f'SELECT stratum, rule, "window", outcome, a, b, c, d, round({RR},6) AS rr FROM ct WHERE rule IN (\'flagged_nr\', \'flagged_top3\')'))
def v10(spark, d):
    return study.contingency(unit_pairs(spark, d), ["stratum"], study.PRODUCT_RULES).withColumn("rr", F.round(study.relative_risk(), 6))


@query("v12_unit_hypothesis", B.sql(WHOLE_STUDY, f""", g AS (SELECT CASE WHEN verified THEN 'verified' ELSE 'unverified' END AS "view", flagged_nr AS flag, next3_strong AS hit FROM p UNION ALL SELECT 'standalone', NOT verified, next3_strong FROM p),
ct AS (SELECT "view", count(*) FILTER (flag AND hit) AS a, count(*) FILTER (flag AND NOT hit) AS b, count(*) FILTER (NOT flag AND hit) AS c, count(*) FILTER (NOT flag AND NOT hit) AS d FROM g GROUP BY ALL)
SELECT "view", a, b, c, d, round({RR},6) AS rr, round(CAST(a AS DOUBLE)/nullif(a+b,0),6) AS "precision" FROM ct"""))
def v12(spark, d):
    return study.hypothesis(unit_pairs(spark, d, cap=None)).withColumns({c: F.round(c, 6) for c in ("rr", "precision")})


@query("v13_unit_verdict", B.sql(_long(base=WHOLE_STUDY) + COMPARED, """, ce AS (SELECT rule, coalesce(rr,0.0) AS rr, coalesce("precision",0.0) AS pr, coalesce(miss_rate,1.0) AS miss, rr_lo, rr_hi FROM cm WHERE "window"='next3' AND outcome='strong'),
ba AS (SELECT * FROM ce WHERE rule LIKE 'base%' AND rule<>'base_all'), be AS (SELECT * FROM ba ORDER BY rr DESC, rule DESC LIMIT 1)
SELECT x.rule, be.rule AS best_baseline, x.rr>be.rr AS beats_best, (x.rr_lo<=be.rr_hi AND be.rr_lo<=x.rr_hi) AS ci_overlaps, coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM ba WHERE ba.rr>=x.rr AND ba.pr>=x.pr AND ba.miss<=x.miss), '') AS dominated_by FROM ce x, be WHERE x.rule IN ('flagged_nr','flagged_top3')"""))
def v13(spark, d):
    return study.verdict(study.rule_comparison(unit_pairs(spark, d, cap=None)))


@query("v18_unit_breakdown", B.sql(STUDY, f""", g AS (SELECT 'class' AS of, {B.CLASS} AS name, next3_strong AS h FROM p UNION ALL SELECT 'kind', unnest(string_split(kinds, ',')), next3_strong FROM p WHERE kinds<>'')
SELECT of, name, count(*) AS n, count(*) FILTER (h) AS positive, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END),6) AS rate FROM g GROUP BY ALL"""))
def v18(spark, d):
    """Pairs and outcomes by class of file and by kind of finding."""
    one = F.array(F.struct(F.lit("class").alias("of"), X.classify_path(F.col("file")).alias("name")))
    each = F.transform("kinds", lambda k: F.struct(F.lit("kind").alias("of"), k.alias("name")))
    g = unit_pairs(spark, d).select("next3_strong", F.explode(F.concat(one, each)).alias("x")).select("next3_strong", "x.*")
    return g.groupBy("of", "name").agg(F.count("*").alias("n"), F.count_if("next3_strong").alias("positive"), F.round(F.avg(F.col("next3_strong").cast("double")), 6).alias("rate"))


# ---- decisions and tokens ------------------------------------------------------------------------

def asking_lines(spark: SparkSession, d: str) -> DataFrame:
    """``talk_lines`` and, beside every turn 9 of 16, a line of two calls to ask and a command."""
    lines = talk_lines(spark, d)
    at = F.expr("line_no div 8")
    n = at.cast("string")

    def ask(i: str, name: str = "AskUserQuestion") -> Column:
        q = F.struct(F.concat(F.lit(i), n).alias("question"), F.array(F.struct(F.lit("A").alias("label")), F.struct(F.lit("B").alias("label"))).alias("options"))
        return F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit(i), n).alias("id"), F.lit(name).alias("name"), F.struct(F.array(q).alias("questions")).alias("input"))

    two = _json(type="assistant", message=F.struct(F.array(ask("x"), ask("y"), ask("z", "Bash")).alias("content")))
    more = lines.where((F.expr("line_no % 8") == 0) & (at % 16 == 9) & F.contains("value", F.lit('"assistant"')))
    return lines.unionByName(more.withColumn("line_no", F.col("line_no") + 7).withColumn("value", two))


@query("j12_decisions_from_logs", B.sql(TALK, """, xd AS (SELECT file, line_no+1 AS line_no, 'Q' || turn AS question, ['A','B','B'] AS options, CASE WHEN turn%8<>5 THEN 'B' END AS answer, 1 AS calls FROM c, (SELECT unnest([1,2]) AS o) WHERE role='assistant' AND turn%4=1 AND (o=1 OR turn%8=5)
 UNION ALL SELECT file, line_no+7, unnest(['x','y']) || turn, ['A','B'], NULL, 2 FROM c WHERE role='assistant' AND turn%16=9),
xa AS (SELECT file, line_no, n, row_number() OVER (PARTITION BY file ORDER BY line_no, n)-1 AS idx FROM (
 SELECT file, line_no+1 AS line_no, 0 AS n FROM c WHERE role='assistant' AND turn%4=1 UNION ALL SELECT file, line_no+unnest([1,3]), 0 FROM c WHERE role='assistant' AND turn%4=3 UNION ALL SELECT file, line_no+7, unnest([0,1,2]) FROM c WHERE role='assistant' AND turn%16=9))
SELECT '?' || xd.file AS unit_id, xd.line_no, question, answer, array_to_string(CASE WHEN answer IS NULL THEN options ELSE ['A'] END, ',') AS rejected, CASE calls WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN calls=1 THEN CAST(idx AS VARCHAR) ELSE '' END AS idxs FROM xd JOIN xa ON xa.file=xd.file AND xa.line_no=xd.line_no AND xa.n=0"""))
def j12(spark, d):
    """Decisions of units with the action that asked, where the log tells it."""
    u = assemble.assemble(asking_lines(spark, d))
    r = context.resolve_decisions(u.decisions, u.actions)
    return r.select("unit_id", "line_no", "question", "answer", F.array_join("rejected", ",").alias("rejected"), "resolution", F.array_join(F.transform("idxs", lambda x: x.cast("string")), ",").alias("idxs"))


def streamed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as logs in which a message takes one to three lines, each stating its tokens so far."""
    c = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), (F.col("turn") % 3).cast("int"))).alias("i"))
    usage = F.struct(F.col("n").alias("input_tokens"), (F.col("i") + 1).alias("output_tokens"), F.when(F.col("turn") % 5 != 0, F.col("turn") * 10).alias("cache_read_input_tokens"))
    value = _json(type="assistant", message=F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), usage.alias("usage")))
    session = F.lpad(F.col("conv_id").cast("string"), 36, "0")
    return c.select(F.concat(F.lit("c/"), session, F.lit(".jsonl")).alias("file"), session.alias("session_id"), F.lit(None).cast("string").alias("agent_id"), (F.col("turn") * 4 + F.col("i")).alias("line_no"), value.alias("value"))


STREAMED = "c AS (SELECT 'c/' || lpad(CAST(conv_id AS VARCHAR), 36, '0') || '.jsonl' AS file, turn, CAST(length(coalesce(text,'')) AS BIGINT) AS input, CAST(turn%3+1 AS BIGINT) AS output, CAST(CASE WHEN turn%5<>0 THEN turn*10 ELSE 0 END AS BIGINT) AS cache_read FROM conversations WHERE role='assistant')"


@query("d01_usage_from_logs", B.sql(STREAMED, "SELECT file, 'm' || turn AS message_id, input, output, cache_read FROM c"))
def d01(spark, d):
    """What the last line of each message states."""
    return T.message_usage(T.parse(streamed_lines(spark, d))).select("file", "message_id", "input", "output", "cache_read")


@query("a03_tokens_from_logs", B.sql(STREAMED, "SELECT file, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_creation, round(CAST(sum(cache_read) AS DOUBLE)/nullif(sum(input)+sum(cache_read),0),6) AS cache_hit_ratio FROM c GROUP BY ALL"))
def a03(spark, d):
    t = T.usage(T.parse(streamed_lines(spark, d)))
    read = F.try_divide(F.col("cache_read").cast("double"), F.col("input") + F.col("cache_read") + F.col("cache_creation"))
    return t.select("file", *T.USAGE, F.round(read, 6).alias("cache_hit_ratio"))


@query("v21_fill_from_logs", B.sql(STREAMED, "SELECT file, 'm' || turn AS message_id, row_number() OVER (PARTITION BY file ORDER BY turn) AS turn, input+cache_read AS fill FROM c"))
def v21(spark, d):
    return T.window_fill(T.parse(streamed_lines(spark, d)))


# ---- payloads ------------------------------------------------------------------------------------

def noted_lines(spark: SparkSession, d: str) -> DataFrame:
    """``log_lines`` and, at the end of main transcripts, a line of an unmodelled type for every stamped command; type names up to 3,500 characters long."""
    lines = log_lines(spark, d)
    k = F.get_json_object("value", "$.message.usage.input_tokens").cast("int") % 40
    name = F.concat(F.lit("x-"), k.cast("string"), F.repeat(F.lit("a"), k * 90))
    stamp = F.get_json_object("value", "$.timestamp")
    commands = lines.where(F.col("agent_id").isNull() & F.contains("value", F.lit('"name":"Bash"'))).where(stamp.isNotNull())
    return lines.unionByName(commands.withColumn("line_no", F.col("line_no") + 1000000).withColumn("value", _json(type=name, timestamp=stamp)))


DISCLOSED = """xo AS (SELECT project, count(*) AS unplaced FROM su0 WHERE first IS NULL GROUP BY ALL),
xw AS (SELECT unit_id, km.project, count(*) AS sessions, coalesce(string_agg(CAST(round(gap_min,2) AS VARCHAR), ',' ORDER BY session_ix) FILTER (session_ix>0), '') AS gaps, coalesce(arg_min(km.first_ts, session_ix), '') AS s, coalesce(max(sp.last_ts), '') AS e, string_agg('"' || left(km.session, 8) || '"', ',' ORDER BY session_ix) AS ids, max(dropped) AS dropped FROM km JOIN sp USING (path) GROUP BY ALL),
xu AS (SELECT unit_id, CASE WHEN sessions>1 OR dropped>0 OR coalesce(unplaced,0)>0 THEN '{"rule":"same project; joined when a transcript overlaps the previous or starts within 30 min of its end","sessions":' || sessions || ',"joined_gaps_min":[' || gaps || '],"span_start":"' || s || '","span_end":"' || e || '","session_ids":[' || ids || '],"dropped":' || dropped || ',"members_unreadable":0,"siblings_unplaced":' || coalesce(unplaced,0) || '}' END AS work_unit FROM xw LEFT JOIN xo USING (project))"""


@query("t12_disclosure_from_logs", B.sql(LOGS, ",\n" + DISCLOSED + " SELECT unit_id, work_unit FROM xu"))
def t12(spark, d):
    """What was merged into each unit, with members dropped and transcripts that have no place."""
    return unit_payloads.disclosure(assemble.assemble(log_lines(spark, d))).select("unit_id", "work_unit")


OVER = LOG_SQL["l04_unit_overview"].rsplit("SELECT unit_id, members, dropped, gaps, actions", 1)

@query("t01_overview_payload", OVER[0].rstrip() + ",\n" + DISCLOSED + """,
xv AS (SELECT unit_id, members, dropped, gaps, actions""" + OVER[1] + """),
xt AS (SELECT unit_id, 'x-' || k%40 || repeat('a', CAST(k%40*90 AS INT)) AS type, count(*) AS n FROM e3 JOIN km USING (session) WHERE place='m' AND kind='Bash' AND event_id%13<>0 GROUP BY ALL),
xn AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, type) AS pos FROM xt),
fq AS (SELECT unit_id, file, CASE WHEN kind IN ('churn','rework','re_read') THEN kind WHEN kind='failure_loop' THEN 'failure_loops' WHEN kind='blind_write_attempt' THEN 'fumbles' ELSE 'action_loops' END AS cat, sum(CASE WHEN kind IN ('churn','failure_loop','re_read') THEN len(idxs) ELSE 1 END) AS n FROM f WHERE file IS NOT NULL AND kind IN ('churn','rework','re_read','failure_loop','blind_write_attempt','action_loop') GROUP BY ALL),
fj AS (SELECT unit_id, file, string_agg('"' || cat || '":' || CAST(n AS BIGINT), ',' ORDER BY cat) AS b FROM fq GROUP BY ALL),
tj AS (SELECT rk.unit_id, string_agg('{"file":"' || file || '","class":"' || """ + B.CLASS + """ || '","edits":' || coalesce(edits,0) || ',"breakdown":{' || b || '}}', ',' ORDER BY rank) AS top FROM rk JOIN fj USING (unit_id, file) LEFT JOIN ed USING (unit_id, file) WHERE rank<=3 GROUP BY ALL),
xb AS (SELECT unit_id, '{"v":2,"session":{"id":"' || unit_id || '","identified_by":"unit","started":' || coalesce('"' || nullif(started,'') || '"', 'null') || ',"duration_min":' || coalesce(CAST(duration_min AS VARCHAR), 'null') || '},"totals":{"actions":' || actions || ',"file_ops":' || file_ops || ',"lines_written":' || lines_written || ',"file_ops_unconfirmed":' || file_ops_unconfirmed || ',"edits":' || edits || ',"writes":' || writes || ',"reads":' || reads || ',"bash":' || bash || ',"files_touched":' || files_touched
 || ',"interrupts":0},"tokens":{"output":' || output || ',"cache_read":0,"cache_hit_ratio":' || coalesce(CAST(cache_hit_ratio AS VARCHAR), 'null') || '},"top_struggles":[' || coalesce(top,'') || '],"top_struggles_total":' || ranked_files || ',"patch_first_segment_share":' || coalesce(CAST(patch_first_share AS VARCHAR), 'null') || ',"flags":{"unknown_event_types":{' AS head,
 (SELECT count(*) FROM xn WHERE xn.unit_id=xv.unit_id) AS types, ',"parse_errors":0,"untimestamped_lines":' || untimestamped || ',"subagent_files_missing":' || missing || '},"truncated":' AS mid, coalesce(',"work_unit":' || work_unit, '') || '}' AS tail FROM xv JOIN xu USING (unit_id) LEFT JOIN tj USING (unit_id)),
xk AS (SELECT unit_id, k, head || coalesce((SELECT string_agg('"' || type || '":' || n, ',' ORDER BY type) FROM xn WHERE xn.unit_id=xb.unit_id AND xn.pos<=k), '') || '},"unknown_event_types_total":' || types || mid || CASE WHEN types>k THEN 'true' ELSE 'false' END || tail AS payload FROM xb, (SELECT unnest(range(9)) AS k) WHERE k<=types)
SELECT unit_id, CAST(max(k) AS INT) AS types_shown, arg_max(payload, k) AS payload FROM xk WHERE k=0 OR ceil(strlen(payload)/3.5)<=1000 GROUP BY unit_id""")
def t01(spark, d):
    """The overview of each unit as its JSON, cut to a thousand tokens."""
    u = assemble.assemble(noted_lines(spark, d))
    a, t = written(u.actions, "actions"), written(u.turns, "turns")
    return unit_payloads.overviews(u, a, t, rank.rank_files(written(detect.all_findings(a, t), "findings"), a))


@query("t05_health_payload", "WITH " + LOGS + COUNTERS.rstrip() + ",\n" + MERGED + """,
xr AS (SELECT unit_id, round(CAST(count(DISTINCT file_path) FILTER (kind='Read') AS DOUBLE)/nullif(count(DISTINCT file_path) FILTER (kind IN ('Edit','Write')),0), 2) AS ratio FROM a GROUP BY ALL)
SELECT unit_id, '{"v":2,"session":{"id":"' || unit_id || '","identified_by":"unit"},"cache_hit_ratio":' || CASE WHEN input>0 THEN '0.0' ELSE 'null' END || ',"tokens":{"output":' || coalesce(output,0) || ',"input_uncached":' || input || ',"cache_read":0,"cache_creation":0},"read_edit_file_ratio":' || coalesce(CAST(ratio AS VARCHAR), 'null') || ',"note":"v0.1 reports context economics as information only; token-level waste deferred","truncated":false}' AS payload FROM un LEFT JOIN xr USING (unit_id)""")
def t05(spark, d):
    u = assemble.assemble(log_lines(spark, d))
    return unit_payloads.health(u, u.actions)


@query("t07_review_payload", B.sql(TALK, """, xq AS (SELECT file, count(*) AS n FROM ut WHERE origin='Human' AND trim(text)<>'' GROUP BY ALL),
xd AS (SELECT file, sum(CASE WHEN turn%4=1 THEN CASE WHEN turn%8=5 THEN 2 ELSE 1 END ELSE 0 END + CASE WHEN turn%16=9 THEN 2 ELSE 0 END) AS n FROM c WHERE role='assistant' GROUP BY ALL),
xt AS (SELECT file, count(*) AS n FROM c WHERE role='assistant' AND turn%4=3 AND (conv_id%5=0 OR turn%8<>3) GROUP BY ALL),
xp AS (SELECT file, (SELECT count(*) FROM ut WHERE ut.file=c.file AND ut.line_no<c.line_no AND trim(ut.text)<>'') AS w FROM c WHERE role='assistant' AND conv_id%7<>0 AND trim(text, chr(32) || chr(9) || chr(10) || chr(13))<>''),
xc AS (SELECT file, count(DISTINCT w) AS n FROM xp GROUP BY ALL)
SELECT '?' || file AS unit_id, coalesce(xq.n,0) AS requests, CAST(coalesce(xd.n,0) AS BIGINT) AS decisions, coalesce(xt.n,0) AS unfinished_tasks, coalesce(xc.n,0) AS claims, true AS fits, true AS lists_as_stated FROM (SELECT DISTINCT file FROM c) LEFT JOIN xq USING (file) LEFT JOIN xd USING (file) LEFT JOIN xt USING (file) LEFT JOIN xc USING (file)"""))
def t07(spark, d):
    """Review contexts of conversations, read back from their JSON: totals, whether each fits its cap, and whether every list is as long as stated."""
    u = assemble.assemble(asking_lines(spark, d))
    p = unit_payloads.review_contexts(u, written(u.actions, "actions"), written(u.turns, "turns"))
    total = {c: F.get_json_object("payload", f"$.totals.{c}").cast("bigint") for c in ("requests", "decisions", "unfinished_tasks", "claims")}
    place = {"requests": "scope.requests", "decisions": "decisions", "unfinished_tasks": "incomplete.unfinished_tasks", "claims": "claims"}
    stated = F.lit(True)
    for c, at in place.items():
        stated = stated & (F.json_array_length(F.get_json_object("payload", f"$.{at}")) == F.least(total[c], F.col("list_cap")))
    fits = (F.col("list_cap") == 0) | (F.ceil(F.octet_length("payload") / 3.5) <= unit_payloads.CONTEXT_CAP)
    return p.select("unit_id", *[x.alias(c) for c, x in total.items()], fits.alias("fits"), stated.alias("lists_as_stated"))
