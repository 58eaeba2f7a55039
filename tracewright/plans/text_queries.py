"""Queries of scalar functions, text extraction and review context over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as X
from ..operators import adapters, context, rank
from . import base_sql as B
from .unit_queries import acts, big, joined

QUERIES: dict = {}
SQL: dict[str, str] = {}
SP = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def paths(spark: SparkSession, d: str) -> DataFrame:
    """File paths of many shapes made of page addresses."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("page_id") % len(TAILS) + 1).cast("int"))
    return p.select("page_id", F.concat(F.col("url"), F.lit("/"), tail).alias("path"))


TAILS = [".env", ".env.local", ".netrc", "id_rsa", "id_rsa.pub", "id_ed25519_old", "secrets.yaml", "SECRETS.md", "server.PEM", "a.key", "memory/helper.rs", "notes/x.py", "memory.md", "memory.rs", "Main.RS", "style.scss", "README", "Cargo.lock", "doc.adoc", "x.tar.gz", ".gitignore", "credentials", "app.tsx", "notesctl/main.go"]
PATHS = f"p AS (SELECT page_id, url || '/' || {TAILS!r}[CAST(page_id%{len(TAILS)} AS INT)+1] AS path FROM pages),\nq AS (SELECT *, lower(path) AS low, string_split(lower(path), '/')[-1] AS name FROM p),\nr AS (SELECT *, CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] END AS ext FROM q)"
SECRET = "(name='.env' OR name LIKE '.env.%' OR name IN ('.netrc','.pgpass','credentials') OR (regexp_matches(name, '^(id_rsa|id_ed25519|id_ecdsa|id_dsa)') AND coalesce(ext,'')='') OR (name LIKE 'secrets.%' AND coalesce(ext,'') NOT IN ('md','mdx','txt','rst','adoc','tex')) OR coalesce(ext,'') IN ('pem','key','p12','pfx'))"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


KLASS = f"CASE WHEN {SECRET} THEN 'config' WHEN contains(low,'/memory/') OR contains(low,'/notes/') THEN 'notes' WHEN ext IS NULL THEN 'other' WHEN name LIKE 'memory.%' AND ext IN {_in(X.DOCS_EXT)} THEN 'notes' WHEN ext IN {_in(X.CODE_EXT)} THEN 'code' WHEN ext IN {_in(X.DOCS_EXT)} THEN 'docs' WHEN ext IN {_in(X.CONFIG_EXT)} THEN 'config' WHEN ext IN {_in(X.WEB_EXT)} THEN 'web' ELSE 'other' END"


@query("p23_is_secrets", f"WITH {PATHS} SELECT page_id, {SECRET} AS secret FROM r")
def p23(spark, d):
    return paths(spark, d).select("page_id", X.is_secrets(F.col("path")).alias("secret"))


@query("p24_classify_path", f"WITH {PATHS} SELECT page_id, {KLASS} AS class FROM r")
def p24(spark, d):
    return paths(spark, d).select("page_id", X.classify_path(F.col("path")).alias("class"))


@query("p25_class_tier", f"WITH {PATHS}, k AS (SELECT page_id, {KLASS} AS class FROM r) SELECT page_id, CASE class WHEN 'code' THEN 0 WHEN 'web' THEN 0 WHEN 'notes' THEN 1 WHEN 'docs' THEN 2 ELSE 3 END AS tier FROM k")
def p25(spark, d):
    return paths(spark, d).select("page_id", X.class_tier(X.classify_path(F.col("path"))).alias("tier"))


@query("x13_basename_extension", f"WITH {PATHS} SELECT page_id, string_split(path,'/')[-1] AS base, ext FROM r")
def x13(spark, d):
    return paths(spark, d).select("page_id", X.basename(F.col("path")).alias("base"), X.extension(F.lower("path")).alias("ext"))


@query("x01_norm_cap", f"SELECT doc_id, nullif(left(trim(regexp_replace(text, '{SP}', ' ', 'g')), 2000), '') AS text FROM documents")
def x01(spark, d):
    return docs(spark, d).select("doc_id", X.norm_cap(F.col("text")).alias("text"))


@query("x02_latency_secs", """WITH e AS (SELECT event_id, ts AS a, ts + to_seconds((event_id*7919)%90000 - 5) AS b FROM events)
SELECT event_id, CASE WHEN strftime(a,'%Y-%m-%d')=strftime(b,'%Y-%m-%d') AND b>=a THEN round(epoch(date_trunc('second', b)) - epoch(date_trunc('second', a)), 3) END AS latency FROM e""")
def x02(spark, d):
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    e = adapters.events(spark, d).withColumn("b", F.timestamp_seconds(F.col("ts").cast("double") + (F.col("event_id") * 7919) % 90000 - 5))
    return e.select("event_id", F.round(X.latency_secs(F.date_format("ts", iso), F.date_format("b", iso)), 3).alias("latency"))


@query("x04_ts_secs", """WITH e AS (SELECT event_id, ts, event_id%4 AS m FROM events) SELECT event_id, CASE m WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 1 THEN CAST(floor(epoch(ts)) AS BIGINT)-7200 END AS secs FROM e""")
def x04(spark, d):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.concat(base, F.lit("Z"))).when(m == 1, F.concat(base, F.lit(".250+02:00"))).when(m == 2, F.replace(F.concat(base, F.lit("Z")), F.lit("2024-"), F.lit("2024-9"))).otherwise("")
    text = F.when(m == 2, F.concat(F.date_format("ts", "yyyy"), F.lit("-13-01T00:00:00Z"))).otherwise(text)
    return adapters.events(spark, d).select("event_id", X.ts_secs(text).alias("secs"))


@query("x05_to_epoch_secs", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events")
def x05(spark, d):
    return adapters.events(spark, d).select("event_id", X.to_epoch_secs(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.999+05:00'")).alias("secs"))


@query("x06_duration_min", "SELECT user_id, CAST(floor((max(CAST(floor(epoch(ts)) AS BIGINT))-min(CAST(floor(epoch(ts)) AS BIGINT)))/60.0) AS BIGINT) AS minutes FROM events GROUP BY ALL")
def x06(spark, d):
    e = adapters.events(spark, d).groupBy("user_id").agg(F.min(F.unix_seconds("ts")).alias("a"), F.max(F.unix_seconds("ts")).alias("b"))
    return e.select("user_id", X.duration_min(F.col("a"), F.col("b")).cast("bigint").alias("minutes"))


@query("x07_est_tokens", "SELECT doc_id, CAST(ceil(strlen(text)/3.5) AS BIGINT) AS tokens FROM documents")
def x07(spark, d):
    return docs(spark, d).select("doc_id", X.est_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query("x08_elide_middle", "SELECT doc_id, CASE WHEN length(text)>100 THEN left(text,50) || '…[' || (length(text)-100) || ' chars elided]…' || right(text,50) ELSE text END AS text FROM documents")
def x08(spark, d):
    return docs(spark, d).select("doc_id", X.elide_middle(F.col("text"), 100).alias("text"))


@query("x09_short_id", "SELECT doc_id, left(sha256(text),8) AS id FROM documents")
def x09(spark, d):
    return docs(spark, d).select("doc_id", X.short_id(F.sha2("text", 256)).alias("id"))


@query("x10_round2", "SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(l_quantity AS DOUBLE)/7, 2) AS r FROM lineitem")
def x10(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") / 7, 2).alias("r"))


@query("x12_redact", rf"""WITH i AS (SELECT doc_id, replace(text, ' = ', '=') || CASE WHEN doc_id%10=0 THEN ' Bearer abc ghp_0123456789abcdef sk-short' WHEN doc_id%10=1 THEN chr(10) || '-----BEGIN KEY-----' || chr(10) || 'zz' || chr(10) || '-----END KEY----- tail' WHEN doc_id%10=2 THEN ' password: x API_KEY=hunter2 -----BEGIN X' ELSE '' END AS s FROM documents),
b AS (SELECT doc_id, regexp_replace(s, '(?s)-----BEGIN(?:.*?-----END.*?-----|.*)', '[REDACTED:pem]', 'g') AS s FROM i),
l AS (SELECT doc_id, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS ln FROM b),
ws AS (SELECT doc_id, ln, string_split(trim(regexp_replace(line, '{SP}', ' ', 'g')), ' ') AS w FROM l),
x AS (SELECT doc_id, ln, unnest(w) AS word, generate_subscripts(w, 1) AS wn FROM ws),
y AS (SELECT *, lag(word, 1, '') OVER (PARTITION BY doc_id, ln ORDER BY wn) AS prev, regexp_extract(word, '^([^=:]*)([=:])', 1) AS key, regexp_extract(word, '^([^=:]*)([=:])', 2) AS sep FROM x),
z AS (SELECT doc_id, ln, wn, CASE WHEN lower(prev)='bearer' OR (strlen(word)>=16 AND regexp_matches(word, '^(sk-|sk_live_|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|xoxb-|xoxp-|xoxa-|xoxs-|glpat-|AKIA|eyJ)')) THEN '[REDACTED]' WHEN sep<>'' AND strlen(word)-strlen(key)>1 AND regexp_matches(lower(key), 'key|token|secret|passw|credential|auth') THEN key || sep || '[REDACTED]' ELSE word END AS word FROM y),
j AS (SELECT doc_id, ln, string_agg(word, ' ' ORDER BY wn) AS line FROM z GROUP BY ALL)
SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM j GROUP BY doc_id""")
def x12(spark, d):
    return secretive(spark, d).select("doc_id", X.redact(F.col("s")).alias("text"))


def secretive(spark: SparkSession, d: str) -> DataFrame:
    """Documents with secrets of several forms added."""
    m = F.col("doc_id") % 10
    more = F.when(m == 0, " Bearer abc ghp_0123456789abcdef sk-short").when(m == 1, "\n-----BEGIN KEY-----\nzz\n-----END KEY----- tail").when(m == 2, " password: x API_KEY=hunter2 -----BEGIN X").otherwise("")
    text = F.concat(F.replace("text", F.lit(" = "), F.lit("=")), more)
    return docs(spark, d).select("doc_id", text.alias("s"))


# ---- the same functions called from SQL --------------------------------------------------------

@query("sql_redact", SQL["x12_redact"])
def sql_redact(spark, d):
    X.register_sql(spark)
    return spark.sql("SELECT doc_id, redact(s) AS text FROM {x}", x=secretive(spark, d))


@query("sql_classify_path", f"WITH {PATHS} SELECT {KLASS} AS class, count(*) AS paths FROM r GROUP BY ALL")
def sql_classify(spark, d):
    X.register_sql(spark)
    return spark.sql("SELECT classify_path(path) AS class, count(*) AS paths FROM {p} GROUP BY 1", p=paths(spark, d))


@query("sql_text_functions", f"""SELECT doc_id, nullif(left(trim(regexp_replace(text, '{SP}', ' ', 'g')), 2000), '') AS norm, CASE WHEN length(text)>160 THEN left(text,80) || '…[' || (length(text)-160) || ' chars elided]…' || right(text,80) ELSE text END AS shown,
CAST(ceil(strlen(text)/3.5) AS BIGINT) AS tokens, left(sha256(text),8) AS id FROM documents""")
def sql_text(spark, d):
    X.register_sql(spark)
    return spark.sql("SELECT doc_id, norm_cap(text) AS norm, elide_middle_160(text) AS shown, est_tokens(text) AS tokens, short_id(sha2(text, 256)) AS id FROM {t}", t=docs(spark, d))


@query("x11_excerpt", B.sql(B.ACTIONS, "SELECT unit_id, idx, left(coalesce(command, error, edit_new), 600) AS excerpt FROM a"))
def x11(spark, d):
    return acts(spark, d).select(big("unit_id"), big("idx"), X.excerpt(F.col("command"), F.col("error"), F.col("edit_new")).alias("excerpt"))


@query("x14_category_phrase", B.sql(B.RANKED, "SELECT unit_id, file, category, CASE category WHEN 'churn' THEN 'rewritten '||n||'x' WHEN 'rework' THEN 'reworked '||n||'x' WHEN 're_read' THEN 're-read '||n||'x' WHEN 'failure_loops' THEN n||' looped failing command'||CASE WHEN n=1 THEN '' ELSE 's' END WHEN 'fumbles' THEN n||' blind-write attempt'||CASE WHEN n=1 THEN '' ELSE 's' END ELSE n||' repeated-call loop'||CASE WHEN n=1 THEN '' ELSE 's' END END AS phrase FROM bd"))
def x14(spark, d):
    from .unit_queries import findings_of

    return rank.breakdown(findings_of(spark, d)).select(big("unit_id"), "file", "category", X.category_phrase(F.col("category"), F.col("n")).alias("phrase"))


@query("x16_formats", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS thousands, CASE WHEN o_orderkey//60>0 THEN (o_orderkey//60) || 'h ' || lpad(CAST(o_orderkey%60 AS VARCHAR),2,'0') || 'm' ELSE (o_orderkey%60) || 'm' END AS duration FROM orders")
def x16(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", X.fmt_thousands(F.floor("o_totalprice").cast("bigint")).alias("thousands"), X.fmt_duration(F.col("o_orderkey")).alias("duration"))


@query("x17_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def x17(spark, d):
    return adapters.events(spark, d).select("event_id", X.rfc3339_utc(F.unix_seconds("ts")).alias("at"))


@query("x18_edit_stratum", "SELECT p_partkey, CASE WHEN p_size<=1 THEN '1' WHEN p_size<=3 THEN '2-3' ELSE '4+' END AS stratum FROM part")
def x18(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.edit_stratum(F.col("p_size")).alias("stratum"))


@query("x19_fingerprint", "SELECT c_custkey, left(sha256(c_name),16) AS fp FROM customer")
def x19(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", X.fingerprint(F.col("c_name")).alias("fp"))


@query("x03_hash_call", "SELECT props, min(event_id) AS first, count(*) AS n FROM events GROUP BY props")
def x03(spark, d):
    """Equal calls by the hash of their canonical arguments."""
    e = adapters.events(spark, d).withColumn("h", X.hash_call(F.lit("Call"), F.try_parse_json("props")))
    return e.groupBy("h").agg(F.min("props").alias("props"), F.min("event_id").alias("first"), F.count("*").alias("n")).select("props", "first", "n")


@query("x20_json_access", r"SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x20(spark, d):
    v = F.try_parse_json("props")
    k = F.when(F.schema_of_variant(F.variant_get(v, "$.k", "variant")) == "BIGINT", F.try_variant_get(v, "$.k", "bigint"))
    return adapters.events(spark, d).select("event_id", k.alias("k"))


@query("x21_arrays", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, CAST(sum(CASE WHEN l_quantity>25 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM lineitem GROUP BY ALL")
def x21(spark, d):
    g = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"), F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", F.array_join(F.array_sort(F.array_distinct("f")), ",").alias("flags"), F.size(F.filter("q", lambda x: x > 25)).cast("bigint").alias("large"))


@query("p04_write_volume", "SELECT doc_id, strlen(text) AS bytes, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines FROM documents WHERE text<>''")
def p04(spark, d):
    return docs(spark, d).where("text <> ''").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), X.line_count(F.col("text")).cast("bigint").alias("lines"))


@query("p09_turn_origin", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Human' WHEN 'system' THEN 'NonHuman' ELSE 'Unknown' END AS origin, role IN ('user','assistant') AS boundary, role='user' AS quotable FROM conversations")
def p09(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    origin = F.when(F.col("role") == "user", "Human").when(F.col("role") == "system", "NonHuman").otherwise("Unknown")
    return c.select("conv_id", "turn", origin.alias("origin"), X.is_boundary_turn(origin).alias("boundary"), X.is_quotable_turn(origin).alias("quotable"))


@query("p20_failed_validation", B.sql(B.ACTIONS, "SELECT unit_id, idx, (kind='Bash' AND is_error) AS failed, coalesce(command LIKE '%test%' OR command LIKE '%lint%', false) AS validation FROM a WHERE kind='Bash'"))
def p20(spark, d):
    return acts(spark, d).where("kind = 'Bash'").select(big("unit_id"), big("idx"), F.col("is_error").alias("failed"), F.coalesce(X.is_validation(F.col("command")), F.lit(False)).alias("validation"))


@query("p21_large_instant", B.sql(B.ACTIONS, "SELECT unit_id, idx, write_len>=2000 AS large, latency<=3 AS instant FROM a WHERE kind IN ('Edit','Write')"))
def p21(spark, d):
    return acts(spark, d).where("kind in ('Edit','Write')").select(big("unit_id"), big("idx"), (F.col("write_len") >= 2000).alias("large"), (F.col("approval_latency_s") <= 3.0).alias("instant"))


@query("p22_pushback", "SELECT conv_id, turn, (" + " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in X.PUSHBACK) + ") AS pushback FROM conversations")
def p22(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.is_pushback(F.col("text")).alias("pushback"))


# ---- context -------------------------------------------------------------------------------

def talk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(turns, prose) of conversations; a system turn is sent by no human, every seventh user turn by one unknown."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("unit_id"), F.col("turn").alias("line_no"), "role", "text")
    origin = F.when(F.col("role") == "system", "NonHuman").when(F.col("unit_id") % 7 == 0, "Unknown").otherwise("Human")
    return c.where("role <> 'assistant'").withColumn("origin", origin), c.where("role = 'assistant'")


TALK = "tu AS (SELECT conv_id AS unit_id, turn AS line_no, text, CASE WHEN role='system' THEN 'NonHuman' WHEN conv_id%7=0 THEN 'Unknown' ELSE 'Human' END AS origin FROM conversations WHERE role<>'assistant'),\npr AS (SELECT conv_id AS unit_id, turn AS line_no, text FROM conversations WHERE role='assistant')"


@query("c01_requests", B.sql(B.TURNS, ", n AS (SELECT *, count(*) FILTER (origin='Unknown') OVER (PARTITION BY unit_id) AS unknown FROM t) SELECT unit_id, line_no, text, unknown FROM n WHERE origin='Human'"))
def c01(spark, d):
    return context.requests(adapters.turns_from_events(spark, d)).select(big("unit_id"), big("line_no"), "text", big("unknown"))


@query("c02_files_edited", B.sql(B.ACTIONS, "SELECT unit_id, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT DISTINCT unit_id, file_path AS file FROM a WHERE kind IN ('Edit','Write') AND is_error IS DISTINCT FROM true) GROUP BY ALL"))
def c02(spark, d):
    return context.files_edited(acts(spark, d)).select(big("unit_id"), joined("files"))


DECISIONS = """o AS (SELECT l_orderkey AS q, list(l_returnflag || l_linestatus ORDER BY l_partkey, l_suppkey, l_linenumber) AS options, CASE WHEN l_orderkey%3<>0 THEN max(l_returnflag || l_linestatus) END AS answer, count(*) FILTER (l_linenumber=1) AS matches FROM lineitem GROUP BY l_orderkey)"""


@query("c03_decisions", f"WITH {DECISIONS}, x AS (SELECT q, answer, matches, unnest(options) AS op, generate_subscripts(options,1) AS i FROM o), y AS (SELECT q, string_agg(op, ',' ORDER BY i) AS rejected FROM x WHERE answer IS NULL OR op<>answer GROUP BY q) SELECT o.q AS question, o.answer, coalesce(rejected,'') AS rejected, CASE WHEN matches=1 THEN 'resolved' WHEN matches=0 THEN 'not_found' ELSE 'ambiguous' END AS resolution FROM o LEFT JOIN y USING (q)")
def c03(spark, d):
    op = F.concat("l_returnflag", "l_linestatus")
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    items = F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", op.alias("op"))))
    asked = li.groupBy("l_orderkey").agg(F.transform(items, lambda x: x["op"]).alias("options"), F.max(op).alias("m"), F.count_if(F.col("l_linenumber") == 1).alias("matches"))
    asked = asked.withColumn("answer", F.when(F.col("l_orderkey") % 3 != 0, F.col("m")))
    return context.decisions(asked, F.col("matches")).select(big("l_orderkey", "question"), "answer", F.array_join("rejected", ",").alias("rejected"), "resolution")


@query("c04_unfinished_tasks", "WITH e AS (SELECT o_custkey AS session, o_orderkey%3 AS id, o_orderstatus AS status, CASE WHEN o_orderkey%2=0 THEN o_orderpriority END AS subject, (o_orderdate, o_orderkey) AS k FROM orders) SELECT session, id, arg_max(status, k) AS status, arg_max(subject, k) FILTER (subject IS NOT NULL) AS subject FROM e GROUP BY ALL HAVING arg_max(status, k)<>'F'")
def c04(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    e = o.select(big("o_custkey", "session"), (F.col("o_orderkey") % 3).alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("subject"), F.struct("o_orderdate", "o_orderkey").alias("k"))
    return context.unfinished_tasks(e, ["session", "id"], F.col("k"), ["F"])


@query("c05_failing_commands", B.sql(B.ACTIONS, ", l AS (SELECT unit_id, command, arg_max(is_error, idx) AS err, max(idx) AS idx FROM a WHERE kind='Bash' AND command IN ('cargo test','npm run lint') GROUP BY ALL) SELECT unit_id, command, idx FROM l WHERE err"))
def c05(spark, d):
    return context.failing_commands(acts(spark, d)).select(big("unit_id"), "command", big("idx"))


@query("c06_claims", f"WITH {TALK}, w AS (SELECT *, (SELECT count(*) FROM tu WHERE tu.unit_id=pr.unit_id AND tu.origin<>'NonHuman' AND tu.line_no<pr.line_no) AS win FROM pr) SELECT unit_id, win AS \"window\", arg_max(text, line_no) AS text, max(line_no) AS line_no FROM w GROUP BY ALL")
def c06(spark, d):
    t, p = talk(spark, d)
    return context.claims(p, t).select("unit_id", big("window"), "text", "line_no")


@query("c07_session_label", "SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id)>2 THEN left(sha256(CAST(conv_id AS VARCHAR)),8) END AS label FROM conversations")
def c07(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    many = F.count("*").over(Window.partitionBy("conv_id")) > 2
    return c.select("conv_id", "turn", F.when(many, X.short_id(F.sha2(F.col("conv_id").cast("string"), 256))).alias("label"))


@query("j12_decision_idx", f"WITH {DECISIONS} SELECT q AS question, matches, CASE WHEN matches=1 THEN 'resolved' WHEN matches=0 THEN 'not_found' ELSE 'ambiguous' END AS resolution FROM o")
def j12(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    asked = li.select("l_orderkey").distinct()
    found = li.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    m = asked.join(found, "l_orderkey", "left").withColumn("matches", F.coalesce("n", F.lit(0)))
    return m.select(big("l_orderkey", "question"), "matches", F.when(F.col("matches") == 1, "resolved").when(F.col("matches") == 0, "not_found").otherwise("ambiguous").alias("resolution"))


@query("j01_call_result", "SELECT o_orderkey AS call, o_orderstatus AS status, l.n AS results FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag='R' GROUP BY ALL) l ON l_orderkey=o_orderkey")
def j01(spark, d):
    o, li = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    r = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("results"))
    return o.join(r, o.o_orderkey == r.l_orderkey, "left").select(big("o_orderkey", "call"), F.col("o_orderstatus").alias("status"), "results")


@query("j03_task_confirmation", "SELECT o_orderkey AS task, coalesce(max(l_linestatus), any_value(o_orderstatus)) AS status FROM orders JOIN lineitem ON l_orderkey=o_orderkey WHERE l_returnflag<>'N' GROUP BY o_orderkey")
def j03(spark, d):
    o, li = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus"), spark.read.parquet(f"{d}/lineitem.parquet")
    ok = li.where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("s"))
    return o.join(ok, o.o_orderkey == ok.l_orderkey).select(big("o_orderkey", "task"), F.coalesce("s", "o_orderstatus").alias("status"))


def folded(cap: int) -> str:
    """The greedy walk over it (unit_id, line_no, cost, rn, n), restated as a recursion: a step an item."""
    return f"""g AS (SELECT unit_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT unit_id FROM it)
 UNION ALL SELECT g.unit_id, it.rn, CASE WHEN used+cost<={cap} THEN used+cost ELSE used END, CASE WHEN used+cost<={cap} THEN list_append(kept, CAST(it.line_no AS BIGINT)) ELSE kept END FROM g JOIN it ON it.unit_id=g.unit_id AND it.rn=g.rn+1),
gl AS (SELECT g.unit_id, n, used, kept FROM g JOIN it ON it.unit_id=g.unit_id AND it.rn=g.rn AND it.rn=it.n)"""


@query("r06_greedy_skip", "WITH RECURSIVE " + TALK + ",\nit AS (SELECT unit_id, line_no, CAST(ceil(strlen(text)/3.5) AS BIGINT) AS cost, row_number() OVER (PARTITION BY unit_id ORDER BY line_no) AS rn, count(*) OVER (PARTITION BY unit_id) AS n FROM tu),\n" + folded(400) + "\nSELECT unit_id, n, used, array_to_string(kept, ',') AS kept FROM gl")
def r06(spark, d):
    """Each conversation's requests that still fit a budget of 400 estimated tokens, in order."""
    t, _ = talk(spark, d)
    out = rank.greedy_skip(t.withColumn("cost", X.est_tokens(F.col("text"))), "unit_id", "line_no", "cost", 400)
    return out.select("unit_id", big("n"), "used", joined("kept"))
