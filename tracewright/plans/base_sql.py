"""The adapter's tables as DuckDB common table expressions, for the checking SQL."""

LINES = r"""ev AS (SELECT event_id, ts, user_id AS unit_id, event_type, CAST(round(value*100) AS BIGINT) AS cents, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events),
lines0 AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY ts, event_id)-1 AS line_no, CASE WHEN k%10=0 THEN true WHEN k%10=1 THEN false END AS flag FROM ev),
lines AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS auto_here FROM lines0)"""

ACTIONS = LINES + r""",
act0 AS (SELECT unit_id, unit_id % 50 AS project, line_no, ts, event_id, k, cents, auto_here, CASE WHEN event_id%5=0 THEN 'a' END AS lane,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Write' ELSE 'Bash' END AS kind,
  'f' || (k%12) || ['.rs','.md','.json','.html','.env','.pem','','.txt'][CAST(k%8 AS INT)+1] AS name FROM lines WHERE event_type <> 'signup'),
a AS (SELECT *, CASE WHEN kind<>'Bash' THEN '/p/' || name END AS file_path,
  CASE WHEN kind='Bash' THEN k%2=0 WHEN event_id%10=0 THEN true WHEN event_id%10=1 THEN NULL ELSE false END AS is_error,
  CASE WHEN kind='Bash' THEN ['cargo test','make','npm run lint','ls'][CAST(k%4 AS INT)+1] END AS command,
  CASE WHEN kind='Bash' AND k%2=0 THEN 'failed' || CASE WHEN k%3=0 THEN ' at ' || name ELSE '' END WHEN kind IN ('Edit','Write') AND event_id%20=0 THEN 'File has not been read yet' END AS error,
  (kind IN ('Edit','Write') AND event_id%17=0) AS user_modified,
  CASE WHEN kind IN ('Edit','Write') THEN cents END AS write_len,
  CASE WHEN kind IN ('Edit','Write') THEN CAST(floor(cents/10.0) AS BIGINT) END AS write_lines,
  CASE WHEN kind IN ('Edit','Write') THEN k%10 END AS latency,
  CASE WHEN kind='Read' THEN 100+k END AS total_lines,
  k AS lo, k + event_id%20 AS hi,
  CASE WHEN kind='Edit' THEN 'v' || (k%5) END AS edit_old, CASE WHEN kind='Edit' THEN 'v' || (event_id%5) END AS edit_new,
  kind || ':' || (k%3) AS input_hash,
  row_number() OVER (PARTITION BY unit_id ORDER BY ts, lane IS NOT NULL, lane, line_no)-1 AS idx FROM act0)"""

TURNS = ACTIONS + r""",
t AS (SELECT unit_id, line_no, ts, CASE event_id%3 WHEN 0 THEN 'Human' WHEN 1 THEN 'NonHuman' ELSE 'Unknown' END AS origin,
  CASE WHEN event_id%4=0 THEN 'no revert that' ELSE 'please continue' END AS text FROM lines WHERE event_type='signup')"""

SEGMENTS = TURNS + r""",
seen AS (SELECT a.unit_id, a.idx, (SELECT count(*) FROM t WHERE t.unit_id=a.unit_id AND t.origin<>'NonHuman' AND t.line_no<a.line_no) AS n,
  (SELECT max(t.line_no) FROM t WHERE t.unit_id=a.unit_id AND t.origin<>'NonHuman' AND t.line_no<a.line_no) AS at FROM a WHERE lane IS NULL),
seg AS (SELECT a.*, max(s.n) OVER w AS segment, max(s.at) OVER w AS user_line_no FROM a JOIN seen s USING (unit_id, idx) WINDOW w AS (PARTITION BY a.unit_id ORDER BY a.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

#: path classes of the adapter's names, restated
CLASS = """CASE WHEN file LIKE '%.env' AND file NOT LIKE '%/.env' THEN 'config' WHEN file LIKE '%.pem' THEN 'config' WHEN file LIKE '%.rs' THEN 'code' WHEN file LIKE '%.html' THEN 'web' WHEN file LIKE '%.md' OR file LIKE '%.txt' THEN 'docs' WHEN file LIKE '%.json' THEN 'config' ELSE 'other' END"""
TIER = f"""CASE {CLASS} WHEN 'code' THEN 0 WHEN 'web' THEN 0 WHEN 'notes' THEN 1 WHEN 'docs' THEN 2 ELSE 3 END"""

REVERTS = r""",
rv AS (SELECT b.unit_id, b.lane, b.file_path, b.idx, min(x.idx) AS e FROM a x JOIN a b ON x.unit_id=b.unit_id AND x.lane IS NOT DISTINCT FROM b.lane AND x.file_path IS NOT DISTINCT FROM b.file_path
  AND x.edit_old=b.edit_new AND x.idx<b.idx WHERE x.kind='Edit' AND b.kind='Edit' GROUP BY ALL),
rp AS (SELECT rv.*, b.line_no AS bl, b.ts AS bts, x.line_no AS xl FROM rv JOIN a b ON b.unit_id=rv.unit_id AND b.idx=rv.idx JOIN a x ON x.unit_id=rv.unit_id AND x.idx=rv.e),
pb AS (SELECT rp.*, (SELECT arg_min(t.line_no, t.ts) FROM t WHERE t.unit_id=rp.unit_id AND t.text LIKE '%revert%' AND t.line_no>rp.xl AND t.line_no<rp.bl) AS tl,
  (SELECT min(t.ts) FROM t WHERE t.unit_id=rp.unit_id AND t.text LIKE '%revert%' AND t.line_no>rp.xl AND t.line_no<rp.bl) AS tts FROM rp),
fl AS (SELECT pb.*, (lane IS NULL AND tl IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a v WHERE v.unit_id=pb.unit_id AND v.kind IN ('Read','Bash')
  AND CASE WHEN v.lane IS NULL THEN v.line_no>pb.tl AND v.line_no<pb.bl ELSE v.ts>pb.tts AND v.ts<pb.bts END)) AS flip FROM pb)"""

FAILED = r""",
fb AS (SELECT unit_id, idx, lane, concat_ws(' ', command, error) AS txt FROM a WHERE kind='Bash' AND is_error),
tf AS (SELECT DISTINCT unit_id, file_path AS file, string_split(file_path, '/')[-1] AS b FROM a WHERE file_path IS NOT NULL),
nm AS (SELECT fb.unit_id, fb.idx, arg_max(file, strlen(file)*1000000 + ascii_key) AS nf FROM (SELECT fb.unit_id, fb.idx, tf.file, row_number() OVER (PARTITION BY fb.unit_id, fb.idx ORDER BY strlen(tf.file), tf.file) AS ascii_key FROM fb JOIN tf USING (unit_id) WHERE contains(txt, tf.file) OR (b<>'' AND contains(txt, b))) fb GROUP BY ALL),
nr AS (SELECT fb.unit_id, fb.idx, (SELECT arg_max(v.file_path, v.idx) FROM a v WHERE v.unit_id=fb.unit_id AND v.idx BETWEEN fb.idx-5 AND fb.idx-1 AND v.kind IN ('Edit','Write') AND v.lane IS NOT DISTINCT FROM fb.lane) AS pf FROM fb),
fa AS (SELECT nr.unit_id, nr.idx, coalesce(nf, pf) AS file, nf IS NULL AS near FROM nr LEFT JOIN nm USING (unit_id, idx) WHERE coalesce(nf, pf) IS NOT NULL)"""

FINDINGS = SEGMENTS + REVERTS + FAILED + r""",
runs0 AS (SELECT *, CASE WHEN input_hash IS DISTINCT FROM lag(input_hash) OVER (PARTITION BY unit_id, lane ORDER BY idx) THEN 1 ELSE 0 END AS brk FROM a),
runs1 AS (SELECT *, sum(brk) OVER (PARTITION BY unit_id, lane ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM runs0),
runs AS (SELECT unit_id, lane, run, count(*) AS n, arg_min(file_path, idx) AS file, list(idx ORDER BY idx) AS idxs FROM runs1 GROUP BY ALL),
ow AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY unit_id, segment) AS size FROM seg WINDOW w AS (PARTITION BY unit_id, segment ORDER BY idx)),
om AS (SELECT unit_id, segment, min(pos) FILTER (kind IN ('Edit','Write')) AS fe, min(pos) FILTER (kind='Read') AS fr, avg(CASE WHEN kind IN ('Edit','Write') THEN 1.0 ELSE 0.0 END) AS frac, list(idx ORDER BY idx) AS w FROM ow WHERE pos<10 AND size>=5 GROUP BY ALL HAVING fe IS NOT NULL),
ov AS (SELECT b.unit_id, b.file_path, b.idx, min(x.idx) AS e FROM a x JOIN a b ON x.unit_id=b.unit_id AND x.file_path=b.file_path AND x.idx<b.idx AND x.lo<b.hi AND b.lo<x.hi WHERE x.kind='Edit' AND b.kind='Edit' GROUP BY ALL),
f AS (
SELECT unit_id, 0 AS o, 'churn' AS kind, 'high' AS confidence, file_path AS file, list(idx ORDER BY idx) AS idxs FROM a WHERE kind IN ('Edit','Write') GROUP BY unit_id, file_path HAVING count(*)>=2
UNION ALL SELECT unit_id, 1, 're_read', 'high', file_path, list(idx ORDER BY idx) FROM a WHERE kind='Read' GROUP BY unit_id, file_path HAVING count(*)>=3
UNION ALL SELECT unit_id, 2, 'rework', 'high', file_path, [e, idx] FROM ov
UNION ALL SELECT unit_id, 3, 'blind_write_attempt', 'high', file_path, [idx] FROM a WHERE kind IN ('Edit','Write') AND error LIKE '%File has not been read yet%'
UNION ALL SELECT unit_id, 4, 'failure_loop', CASE WHEN bool_or(near) THEN 'low' ELSE 'medium' END, file, list(idx ORDER BY idx) FROM fa GROUP BY unit_id, file HAVING count(*)>=2
UNION ALL SELECT unit_id, 5, 'action_loop', 'low', file, idxs FROM runs WHERE n>=3
UNION ALL SELECT unit_id, 6, 'opening_move', 'medium', NULL, w[1:fe+1] FROM om
UNION ALL SELECT unit_id, 7, CASE WHEN flip THEN 'flip' ELSE 'true_revert' END, 'high', file_path, [e, idx] FROM fl
UNION ALL SELECT unit_id, 8, 'user_corrected', 'high', file_path, [idx] FROM a WHERE user_modified
UNION ALL SELECT unit_id, 9, 'review_burden', 'medium', NULL, list(idx ORDER BY idx) FROM seg WHERE kind IN ('Edit','Write') GROUP BY unit_id, segment HAVING sum(write_lines)>400
UNION ALL SELECT unit_id, 10, 'large_write_instant_accept', 'medium', file_path, [idx] FROM a WHERE kind IN ('Edit','Write') AND lane IS NULL AND NOT auto_here AND write_len>=2000 AND latency<=3
UNION ALL SELECT unit_id, 11, 'secrets_file_touched', 'high', file_path, list(idx ORDER BY idx) FROM a WHERE kind IN ('Read','Edit','Write') AND file_path LIKE '%.pem' GROUP BY unit_id, file_path)"""

RANKED = FINDINGS + rf""",
fc AS (SELECT *, CASE WHEN kind IN ('churn','rework','re_read') THEN kind WHEN kind='failure_loop' THEN 'failure_loops' WHEN kind='blind_write_attempt' THEN 'fumbles' WHEN kind='action_loop' THEN 'action_loops' END AS category,
  CASE WHEN kind IN ('churn','failure_loop','re_read') THEN len(idxs) ELSE 1 END AS mag FROM f),
bd AS (SELECT unit_id, file, category, CAST(sum(mag) AS BIGINT) AS n FROM fc WHERE file IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
ec AS (SELECT unit_id, file_path AS file, count(*) AS edits FROM a WHERE kind IN ('Edit','Write') GROUP BY ALL),
bf AS (SELECT unit_id, file, string_agg(category || '=' || n, ';' ORDER BY category) AS breakdown FROM bd GROUP BY ALL),
rk AS (SELECT unit_id, file, coalesce(edits,0) AS edits, {CLASS} AS class, breakdown, row_number() OVER (PARTITION BY unit_id ORDER BY coalesce(edits,0)=0, {TIER}, coalesce(edits,0) DESC, file) AS rank FROM bf LEFT JOIN ec USING (unit_id, file))"""

TRANSCRIPTS = r"""tr AS (SELECT user_id%50 AS project, user_id || '/' || strftime(ts, '%Y-%m-%d') AS path, min(CAST(floor(epoch(ts)) AS BIGINT)) AS first, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last, count(*) AS lines FROM events GROUP BY ALL)"""
UNITS = TRANSCRIPTS + r""",
re AS (SELECT *, max(last) OVER (PARTITION BY project ORDER BY first, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rend FROM tr),
nw AS (SELECT *, CASE WHEN rend IS NULL OR first-rend>1800 THEN 1 ELSE 0 END AS new FROM re),
un AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY first, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit FROM nw)"""


def sql(base: str, query: str) -> str:
    return f"WITH {base}\n{query}"
