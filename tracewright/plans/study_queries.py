"""Queries of the corpus study over sessions of a project."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as X
from ..operators import adapters, detect, order, order_stats, study
from ..sources.scratch import kept
from . import base_sql as B
from .unit_queries import acts, big, findings_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: per session and file: edits, lines, failed commands; flagged when edited twice, failed blind or corrected
FILES = B.ACTIONS + """,
tr AS (SELECT unit_id%50 AS project, unit_id || '/' || strftime(ts, '%Y-%m-%d') AS path, min(CAST(floor(epoch(ts)) AS BIGINT)) AS start FROM ev GROUP BY ALL),
sq AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start, path)-1 AS seq FROM tr),
sa AS (SELECT a.*, unit_id || '/' || strftime(ts, '%Y-%m-%d') AS path FROM a),
fc AS (SELECT path, count(*) AS failed FROM sa WHERE kind='Bash' AND is_error GROUP BY ALL),
fe AS (SELECT path, file_path AS file, count(*) AS edits, CAST(coalesce(sum(write_lines) FILTER (is_error=false),0) AS BIGINT) AS lines, (count(*)>=2 OR bool_or(user_modified) OR bool_or(error IS NOT NULL AND error LIKE '%not been read%')) AS flagged_nr FROM sa WHERE kind IN ('Edit','Write') GROUP BY ALL),
fs AS (SELECT project, seq, start, file, edits, lines, coalesce(failed,0) AS failed, flagged_nr, row_number() OVER (PARTITION BY project, seq ORDER BY flagged_nr DESC, edits DESC, file)<=3 AND flagged_nr AS flagged_top3 FROM fe JOIN sq USING (path) LEFT JOIN fc USING (path))"""

PAIRS = FILES + """,
pr0 AS (SELECT *, max(seq) OVER (PARTITION BY project) AS ls, row_number() OVER (PARTITION BY project, seq ORDER BY edits DESC, file) AS be, row_number() OVER (PARTITION BY project, seq ORDER BY lines DESC, file) AS bl FROM fs),
oc AS (SELECT x.project, x.seq, x.file, bool_or(y.seq<=x.seq+3) AS nw, bool_or(y.seq<=x.seq+3 AND y.flagged_nr) AS ns, bool_or(y.start<=x.start+14*86400) AS ww, bool_or(y.start<=x.start+14*86400 AND y.flagged_nr) AS ws
 FROM fs x JOIN fs y ON x.project=y.project AND x.file=y.file AND y.seq>x.seq AND (y.seq<=x.seq+3 OR y.start<=x.start+14*86400) GROUP BY ALL),
p AS (SELECT project, seq, file, edits, lines, failed, flagged_nr, flagged_top3, coalesce(nw,false) AS next3_weak, coalesce(ns,false) AS next3_strong, coalesce(ww,false) AS within14d_weak, coalesce(ws,false) AS within14d_strong,
 edits>=2 AS base_edits_ge2, edits>=4 AS base_edits_ge4, be<=3 AS base_top3_edits, lines>=200 AS base_lines_ge200, lines>=400 AS base_lines_ge400, bl<=3 AS base_top3_lines, failed>=1 AS base_failed_ge1, true AS base_all,
 CASE WHEN edits<=1 THEN '1' WHEN edits<=3 THEN '2-3' ELSE '4+' END AS stratum FROM pr0 LEFT JOIN oc USING (project, seq, file) WHERE seq<ls)"""


def _long(extra: str = "", base: str = PAIRS) -> str:
    arms = [f"SELECT {extra}'{r}' AS rule, '{w}' AS \"window\", '{o}' AS outcome, {r} AS flag, {w}_{o} AS hit FROM p" for r in study.RULES for w in study.WINDOWS for o in study.OUTCOMES]
    keys = f'{extra}rule, "window", outcome'
    return base + ",\nlg AS (" + "\nUNION ALL ".join(arms) + f"),\nct AS (SELECT {keys}, count(*) FILTER (flag AND hit) AS a, count(*) FILTER (flag AND NOT hit) AS b, count(*) FILTER (NOT flag AND hit) AS c, count(*) FILTER (NOT flag AND NOT hit) AS d FROM lg GROUP BY {keys})"


RR = "CASE WHEN a+b>0 AND c>0 THEN (CAST(a AS DOUBLE)/nullif(a+b,0))/(CAST(c AS DOUBLE)/nullif(c+d,0)) END"
SE = "sqrt(1.0/nullif(a,0)-1.0/nullif(a+b,0)+1.0/nullif(c,0)-1.0/nullif(c+d,0))"
THIN = "concat_ws(',', CASE WHEN a<5 THEN 'a' END, CASE WHEN b<5 THEN 'b' END, CASE WHEN c<5 THEN 'c' END, CASE WHEN d<5 THEN 'd' END)"
COMPARED = f""", cm AS (SELECT *, {RR} AS rr, CASE WHEN a>0 AND c>0 THEN exp(ln({RR})-1.96*{SE}) END AS rr_lo, CASE WHEN a>0 AND c>0 THEN exp(ln({RR})+1.96*{SE}) END AS rr_hi,
 CAST(a AS DOUBLE)/nullif(a+b,0) AS "precision", CAST(c AS DOUBLE)/nullif(a+c,0) AS miss_rate, {THIN} AS thin, CAST(a+b AS DOUBLE)/nullif(a+b+c+d,0) AS flag_share FROM ct)"""


def session_files(spark: SparkSession, d: str) -> DataFrame:
    """Session records by file: what T11 dumps and the study starts from."""
    a = acts(spark, d).withColumn("path", F.concat(F.col("unit_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
    seq = order.session_seq(adapters.transcripts_from_events(spark, d)).select("project", "path", "seq", F.col("first").alias("start"))
    failed = a.where("kind = 'Bash' and is_error").groupBy("path").agg(F.count("*").alias("failed"))
    e = a.where(X.is_edit(F.col("kind")))
    blind = F.coalesce(F.contains("error", F.lit("not been read")), F.lit(False))
    f = e.groupBy("path", F.col("file_path").alias("file")).agg(F.count("*").alias("edits"), F.coalesce(F.sum(F.when(F.col("is_error") == F.lit(False), F.col("write_lines"))), F.lit(0)).cast("bigint").alias("lines"), ((F.count("*") >= 2) | F.bool_or("user_modified") | F.bool_or(blind)).alias("flagged_nr"))
    f = f.join(seq, "path").join(failed, "path", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    w = Window.partitionBy("project", "seq").orderBy(F.desc("flagged_nr"), F.desc("edits"), "file")
    return f.withColumn("flagged_top3", (F.row_number().over(w) <= 3) & F.col("flagged_nr"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return study.build_pairs(session_files(spark, d))


@query("t11_session_dump", B.sql(FILES, "SELECT project, seq, file, edits, lines, failed, flagged_nr, flagged_top3 FROM fs"))
def t11(spark, d):
    return session_files(spark, d).select(big("project"), big("seq"), "file", "edits", "lines", "failed", "flagged_nr", "flagged_top3")


@query("v01_corpus_filter", B.sql(B.TRANSCRIPTS, ", m AS (SELECT max(last) AS now FROM tr) SELECT project, count(*) FILTER (lines>=3 AND last<=now-600) AS kept, count(*) FILTER (lines<3) AS too_small, count(*) FILTER (lines>=3 AND last>now-600) AS too_fresh FROM tr, m GROUP BY ALL"))
def v01(spark, d):
    t = adapters.transcripts_from_events(spark, d)
    now = t.agg(F.max("last").alias("now"))
    small, fresh = F.col("lines") < 3, F.col("last") > F.col("now") - 600
    return t.join(F.broadcast(now)).groupBy(big("project")).agg(F.count_if(~small & ~fresh).alias("kept"), F.count_if(small).alias("too_small"), F.count_if(~small & fresh).alias("too_fresh"))


@query("j17_next_k_outcome", B.sql(PAIRS, "SELECT project, seq, file, next3_weak, next3_strong, within14d_weak, within14d_strong FROM p"))
def j17(spark, d):
    return pairs(spark, d).select(big("project"), big("seq"), "file", "next3_weak", "next3_strong", "within14d_weak", "within14d_strong")


@query("v02_build_pairs", B.sql(PAIRS, f"SELECT project, seq, file, edits, lines, failed, stratum, {', '.join(study.RULES)} FROM p"))
def v02(spark, d):
    return pairs(spark, d).select(big("project"), big("seq"), "file", "edits", "lines", "failed", "stratum", *study.RULES)


@query("v03_contingency", B.sql(_long(), 'SELECT rule, "window", outcome, a, b, c, d FROM ct'))
def v03(spark, d):
    return study.contingency(pairs(spark, d))


@query("v04_relative_risk", B.sql(_long() + COMPARED, 'SELECT rule, "window", outcome, round(rr,6) AS rr, round("precision",6) AS "precision", round(miss_rate,6) AS miss_rate FROM cm'))
def v04(spark, d):
    t = study.contingency(pairs(spark, d))
    return t.select("rule", "window", "outcome", F.round(study.relative_risk(), 6).alias("rr"), F.round(study.precision(), 6).alias("precision"), F.round(study.miss_rate(), 6).alias("miss_rate"))


@query("v05_rr_ci", B.sql(_long() + COMPARED, 'SELECT rule, "window", outcome, round(rr_lo,7) AS rr_lo, round(rr_hi,7) AS rr_hi FROM cm'))
def v05(spark, d):
    lo, hi = study.rr_interval()
    return study.contingency(pairs(spark, d)).select("rule", "window", "outcome", F.round(lo, 7).alias("rr_lo"), F.round(hi, 7).alias("rr_hi"))


@query("v06_thin_cells", B.sql(_long() + COMPARED, 'SELECT rule, "window", outcome, thin FROM cm'))
def v06(spark, d):
    return study.contingency(pairs(spark, d)).select("rule", "window", "outcome", study.thin_cells().alias("thin"))


@query("v07_rule_comparison", B.sql(_long() + COMPARED, 'SELECT rule, "window", outcome, a, b, c, d, round(rr,8) AS rr, round(flag_share,6) AS flag_share, thin FROM cm'))
def v07(spark, d):
    return study.rule_comparison(pairs(spark, d)).select("rule", "window", "outcome", "a", "b", "c", "d", F.round("rr", 8).alias("rr"), F.round("flag_share", 6).alias("flag_share"), "thin")


AGREE = "\nUNION ALL ".join(f"SELECT '{x}' AS product, '{y}' AS baseline, CASE WHEN {x} AND {y} THEN 'both' WHEN {x} THEN 'product_only' WHEN {y} THEN 'baseline_only' ELSE 'neither' END AS bucket, next3_strong AS h FROM p" for x in study.PRODUCT_RULES for y in study.BASELINE_RULES)


@query("v08_rule_agreement", B.sql(PAIRS, f", g AS ({AGREE}) SELECT product, baseline, bucket, count(*) AS n, count(*) FILTER (h) AS positive, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END),6) AS rate FROM g GROUP BY ALL"))
def v08(spark, d):
    return study.rule_agreement(pairs(spark, d)).withColumn("rate", F.round("rate", 6))


@query("v09_false_alarms", B.sql(PAIRS, ", g AS (SELECT 'flagged_nr' AS rule, next3_weak AS h FROM p WHERE flagged_nr UNION ALL SELECT 'flagged_top3', next3_weak FROM p WHERE flagged_top3) SELECT rule, count(*) AS flagged, count(*) FILTER (NOT h) AS no_future_edit, round(avg(CASE WHEN h THEN 0.0 ELSE 1.0 END),6) AS share FROM g GROUP BY ALL"))
def v09(spark, d):
    return study.false_alarms(pairs(spark, d)).withColumn("share", F.round("share", 6))


@query("v10_stratified_rr", B.sql(_long("stratum, "), f'SELECT stratum, rule, "window", outcome, a, b, c, d, round({RR},8) AS rr FROM ct'))
def v10(spark, d):
    return study.contingency(pairs(spark, d), ["stratum"]).withColumn("rr", F.round(study.relative_risk(), 8))


@query("v11_compute_metrics", B.sql(_long() + COMPARED, """SELECT rule, "window", outcome, a, b, c, d, round("precision",6) AS "precision" FROM cm WHERE rule IN ('flagged_nr','flagged_top3')"""))
def v11(spark, d):
    t = study.contingency(pairs(spark, d), rules=study.PRODUCT_RULES)
    return t.withColumn("precision", F.round(study.precision(), 6))


@query("v13_verdict", B.sql(_long() + COMPARED, """, ce AS (SELECT rule, coalesce(rr,0.0) AS rr, coalesce("precision",0.0) AS pr, coalesce(miss_rate,1.0) AS miss, rr_lo, rr_hi FROM cm WHERE "window"='next3' AND outcome='strong'),
ba AS (SELECT * FROM ce WHERE rule LIKE 'base%' AND rule<>'base_all'), be AS (SELECT * FROM ba ORDER BY rr DESC, rule DESC LIMIT 1)
SELECT x.rule, be.rule AS best_baseline, x.rr>be.rr AS beats_best, (x.rr_lo<=be.rr_hi AND be.rr_lo<=x.rr_hi) AS ci_overlaps, coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM ba WHERE ba.rr>=x.rr AND ba.pr>=x.pr AND ba.miss<=x.miss), '') AS dominated_by FROM ce x, be WHERE x.rule IN ('flagged_nr','flagged_top3')"""))
def v13(spark, d):
    return study.verdict(study.rule_comparison(pairs(spark, d)))


VERIFIED = """, le AS (SELECT path, file_path, max(idx) AS last_idx, any_value(name) AS b FROM sa WHERE kind IN ('Edit','Write') GROUP BY ALL),
lv AS (SELECT path, file_path AS file, EXISTS (SELECT 1 FROM sa v WHERE v.path=le.path AND v.idx>le.last_idx AND v.is_error=false AND ((v.kind='Read' AND v.file_path=le.file_path) OR (v.kind='Bash' AND v.command IN ('cargo test','make')))) AS verified FROM le)"""


@query("v12_hypothesis", B.sql(PAIRS + VERIFIED, "SELECT verified, flagged_nr, count(*) AS n, count(*) FILTER (next3_strong) AS positive FROM p JOIN sq USING (project, seq) JOIN lv USING (path, file) GROUP BY ALL"))
def v12(spark, d):
    a = acts(spark, d).withColumn("unit_id", F.concat(F.col("unit_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
    v = detect.last_edit_verified(a).select(F.col("unit_id").alias("path"), F.col("file_path").alias("file"), "verified")
    return pairs(spark, d).join(v, ["path", "file"]).groupBy("verified", "flagged_nr").agg(F.count("*").alias("n"), F.count_if("next3_strong").alias("positive"))


@query("v14_anonymize", "SELECT p AS project, 'proj-' || CASE WHEN r<10 THEN '0' ELSE '' END || r AS alias FROM (SELECT p, dense_rank() OVER (ORDER BY p) AS r FROM (SELECT DISTINCT 'p' || (user_id%50) AS p FROM events))")
def v14(spark, d):
    return study.anonymize(adapters.events(spark, d).select(F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")).alias("project")))


@query("v15_token_ratio", """WITH x AS (SELECT conv_id, CAST(ceil(sum(strlen(text))/3.5) AS BIGINT) AS t, CAST(ceil(sum(CASE WHEN role='user' THEN strlen(text) ELSE 0 END)/3.5) AS BIGINT) AS p FROM conversations GROUP BY ALL),
r AS (SELECT CAST(t AS DOUBLE)/p AS ratio FROM x WHERE p>0), s AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS i, count(*) OVER () AS n FROM r)
SELECT max(n) AS sessions, round(min(ratio),6) AS least, round(max(ratio) FILTER (i = n//2+1),6) AS median, round(max(ratio),6) AS most FROM s""")
def v15(spark, d):
    """Transcript tokens over payload tokens (here the users' turns): upper median by counting ranks, no gathered list."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    n = F.octet_length("text")
    x = c.groupBy("conv_id").agg(F.ceil(F.sum(n) / 3.5).alias("t"), F.ceil(F.sum(F.when(F.col("role") == "user", n).otherwise(0)) / 3.5).alias("p")).where("p > 0")
    r = study.token_ratio(x.select((F.col("t") / F.col("p")).alias("ratio")))
    return r.select("sessions", *[F.round(c, 6).alias(c) for c in ("least", "median", "most")])


@query("v15_zero_fire", B.sql(B.RANKED, """, e AS (SELECT unit_id, count(*) FILTER (kind IN ('Edit','Write')) AS edits, unit_id%50 AS project FROM a GROUP BY unit_id),
n AS (SELECT e.*, unit_id IN (SELECT unit_id FROM rk) AS fires FROM e)
SELECT project, count(*) AS units, count(*) FILTER (edits>=3) AS edit_heavy, count(*) FILTER (edits>=3 AND NOT fires) AS zero_fire FROM n GROUP BY project"""))
def v15b(spark, d):
    """Units with three edits or more in which no file is ranked, by project."""
    from .unit_queries import ranked_of

    e = acts(spark, d).groupBy("unit_id").agg(F.count_if(F.col("kind").isin("Edit", "Write")).alias("edits"))
    none = study.zero_fire(e, ranked_of(spark, d)).select("unit_id", F.lit(1).alias("z"))
    n = e.join(none, "unit_id", "left").groupBy((F.col("unit_id") % 50).cast("bigint").alias("project"))
    return n.agg(F.count("*").alias("units"), F.count_if(F.col("edits") >= 3).alias("edit_heavy"), F.count("z").alias("zero_fire"))


@query("v16_convergent", B.sql(B.RANKED, """, z AS (SELECT unit_id, rank, len(string_split(breakdown, ';')) AS n, regexp_replace(breakdown, '=[0-9]+', '', 'g') AS cats FROM rk WHERE rank<=3)
SELECT rank=1 AS top, n AS categories, cats, count(*) AS files FROM z GROUP BY ALL"""))
def v16(spark, d):
    from .unit_queries import ranked_of

    z = ranked_of(spark, d).where("rank <= 3").select((F.col("rank") == 1).alias("top"), F.array_sort(F.map_keys("breakdown")).alias("c"))
    return z.groupBy("top", F.size("c").cast("bigint").alias("categories"), F.array_join("c", ";").alias("cats")).agg(F.count("*").alias("files"))


@query("v17_findings_yield", B.sql(B.FINDINGS, """, n AS (SELECT u.unit_id, count(f.kind) AS n FROM (SELECT DISTINCT unit_id FROM a) u LEFT JOIN f USING (unit_id) GROUP BY ALL), s AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m FROM n)
SELECT count(*) AS units, round(avg(n),6) AS mean, round(var_pop(n),6) AS variance, min(n) AS least, max(n) FILTER (i=m//2+1) AS median, max(n) AS most, round(avg(CASE WHEN n=0 THEN 1.0 ELSE 0.0 END),6) AS zero_share, CAST(sum(n) AS BIGINT) AS total FROM s"""))
def v17(spark, d):
    units = acts(spark, d).select("unit_id").distinct()
    n = units.join(findings_of(spark, d).groupBy("unit_id").agg(F.count("*").alias("n")), "unit_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    n = kept(n, "yields")
    out = n.agg(F.count("*").alias("units"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.var_pop("n"), 6).alias("variance"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("zero_share"), F.sum("n").alias("total"))
    med = order_stats.upper_median(n, "n")
    return out.join(F.broadcast(med), F.col("units") == F.col("rows")).select("units", "mean", "variance", "least", F.col("median").cast("bigint").alias("median"), "most", "zero_share", "total")


@query("v18_class_breakdown", B.sql(PAIRS, f"SELECT {B.CLASS} AS class, count(*) AS n, count(*) FILTER (next3_strong) AS positive, round(avg(CASE WHEN next3_strong THEN 1.0 ELSE 0.0 END),6) AS rate FROM p GROUP BY ALL"))
def v18(spark, d):
    return pairs(spark, d).groupBy(X.classify_path(F.col("file")).alias("class")).agg(F.count("*").alias("n"), F.count_if("next3_strong").alias("positive"), F.round(F.avg(F.col("next3_strong").cast("double")), 6).alias("rate"))


@query("v19_gap_sensitivity", B.sql(B.TRANSCRIPTS, """, re AS (SELECT *, max(last) OVER (PARTITION BY project ORDER BY first, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rend FROM tr)
SELECT m AS minutes, count(*) FILTER (rend IS NULL OR first-rend>m*60) AS units, count(*) FILTER (first-rend<=m*60) AS joined FROM re, (SELECT unnest([5,15,30,60,120]) AS m) GROUP BY ALL"""))
def v19(spark, d):
    """One pass of running ends; each threshold is a count over it."""
    t = order.work_units(adapters.transcripts_from_events(spark, d)).select((F.col("first") - F.col("running_end")).alias("gap"))
    g = t.select("gap", F.explode(F.array(*[F.lit(m) for m in (5, 15, 30, 60, 120)])).alias("minutes"))
    new = F.col("gap").isNull() | (F.col("gap") > F.col("minutes") * 60)
    return g.groupBy("minutes").agg(F.count_if(new).alias("units"), F.count_if(~new).alias("joined"))


@query("v20_file_friction", B.sql(B.RANKED, ", g AS (SELECT unit_id%50 AS project, file, category, n, unit_id FROM bd) SELECT project, file, count(DISTINCT unit_id) AS units, CAST(coalesce(sum(n) FILTER (category='churn'),0) AS BIGINT) AS churn, CAST(coalesce(sum(n) FILTER (category='failure_loops'),0) AS BIGINT) AS failures, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY ALL"))
def v20(spark, d):
    from ..operators import rank

    b = rank.breakdown(findings_of(spark, d)).withColumn("project", F.col("unit_id") % 50)

    def of(c: str):
        return F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).cast("bigint")

    return b.groupBy(big("project"), "file").agg(F.count_distinct("unit_id").alias("units"), of("churn").alias("churn"), of("failure_loops").alias("failures"), F.sum("n").alias("total"))


@query("v20_file_revisits", B.sql(B.TRANSCRIPTS, """, q AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY first, path)-1 AS seq FROM tr),
e AS (SELECT DISTINCT q.project, q.seq, 'f' || (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)%12) AS file FROM events JOIN q ON q.path = user_id || '/' || strftime(ts, '%Y-%m-%d') WHERE event_type IN ('view','click','purchase')),
g AS (SELECT *, seq - lag(seq) OVER (PARTITION BY project, file ORDER BY seq) - 1 AS gap FROM e)
SELECT project, file, count(*) AS sessions, count(gap) AS revisits, min(gap) AS shortest_gap, max(gap) AS longest_gap FROM g GROUP BY ALL"""))
def v20b(spark, d):
    """Gaps between the sessions of a project that touch a file."""
    seq = F.row_number().over(Window.partitionBy("project").orderBy("first", "path")) - 1
    q = adapters.transcripts_from_events(spark, d).select("path", "project", seq.cast("bigint").alias("session_seq"))
    e = adapters.events(spark, d).where(F.col("event_type").isin("view", "click", "purchase"))
    file = F.concat(F.lit("f"), (F.regexp_extract("props", r"(\d+)", 1).cast("bigint") % 12).cast("string"))
    touched = e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("path"), file.alias("file")).distinct()
    return study.revisits(touched.join(q, "path")).select(F.col("project").cast("bigint").alias("project"), "file", "sessions", "revisits", "shortest_gap", "longest_gap")


@query("v21_window_fill", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)+l_suppkey AS fill, l_shipdate, l_quantity FROM lineitem)
SELECT l_orderkey AS session, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS turn, fill FROM m""")
def v21(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return li.select(big("l_orderkey", "session"), F.row_number().over(w).cast("bigint").alias("turn"), (F.col("l_quantity").cast("bigint") + F.col("l_suppkey")).alias("fill"))


FROZEN = [hashlib.sha256(str(p).encode()).hexdigest()[:16] for p in range(0, 50, 7)]


@query("u06_holdout_split", f"SELECT DISTINCT user_id%50 AS project, left(sha256(CAST(user_id%50 AS VARCHAR)),16) IN ({', '.join(repr(x) for x in FROZEN)}) AS held_out FROM events")
def u06(spark, d):
    return study.holdout(adapters.events(spark, d).select((F.col("user_id") % 50).alias("project")).distinct(), FROZEN)


@query("u04_distinct_kinds", B.sql(B.FINDINGS, "SELECT unit_id, file, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT unit_id, file, kind FROM f WHERE file IS NOT NULL) GROUP BY ALL"))
def u04(spark, d):
    return findings_of(spark, d).where("file is not null").groupBy(big("unit_id"), "file").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("u05_strong_kinds", B.sql(B.FINDINGS, "SELECT unit_id, file, bool_or(kind IN ('rework','failure_loop','flip')) AS strong FROM f WHERE file IS NOT NULL GROUP BY ALL"))
def u05(spark, d):
    strong = F.arrays_overlap(F.collect_set("kind"), F.array(*map(F.lit, ("rework", "failure_loop", "flip"))))
    return findings_of(spark, d).where("file is not null").groupBy(big("unit_id"), "file").agg(strong.alias("strong"))


@query("u03_fabricated_citations", B.sql(B.ACTIONS, ", n AS (SELECT unit_id, max(idx) AS m FROM a GROUP BY ALL), c AS (SELECT unit_id, unnest([0, 1, CAST(unit_id%20 AS BIGINT), 10000]) AS idx FROM n) SELECT DISTINCT unit_id, idx FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.unit_id=c.unit_id AND a.idx=c.idx)"))
def u03(spark, d):
    """Citations in a debrief that no action answers."""
    a = acts(spark, d)
    text = F.concat(F.lit("see #0, #1 and #"), (F.col("unit_id") % 20).cast("string"), F.lit("; also #10000"))
    debrief = a.select("unit_id").distinct().withColumn("text", text)
    cited = debrief.select("unit_id", F.explode(F.regexp_extract_all("text", F.lit(r"#(\d+)"), F.lit(1))).alias("i")).select("unit_id", F.col("i").cast("bigint").alias("idx")).distinct()
    return cited.join(a.select("unit_id", "idx"), ["unit_id", "idx"], "left_anti").select(big("unit_id"), "idx")
