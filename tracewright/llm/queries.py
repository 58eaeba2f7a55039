"""The thin queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, exact_dedup, lattice_dedup, media, mixing, packing, prefix_trie, quality, repair, simhash, suffix_dedup, token_counts, toxicity
from .common import read_table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", OWN), (-1, 1, "assistant", OWN)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(probe)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels, _remainder(5) != 0))
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels, _remainder(4) != 2))
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, spread evenly over domains, languages and sources, up to two epochs of each."""
    out = mixing.plan_mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_copies").alias("copies"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents as the first snapshot, the others in two batches after it."""
    return exact_dedup.exact_duplicates(exact_dedup.deal(read_table(spark, sf_dir, "documents"), (2, 1, 1), "doc_id"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read_table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the sequences first, then the others into the trie of these."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), (1, 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lattice_dedup, op2_simhash, op4_packing, op5_media, op6_token_counts, op7_mixing, op8_chat, op9_suffix_dedup, op3_toxicity, op10_quality, op11_prefix_trie, op12_exact_dedup, op13_conversation_repair)
}

OWN = "<|im_end|><|im_start|>assistant ok"



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, a byte and then a bit at a time."""
    byte = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda y: CAST(ascii(y) AS BIGINT)), lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


SQL: dict[str, str] = {
    # every pair of usable vectors, and reachability along the links
    "op1_lattice_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_max(list_transform(x, lambda y: abs(y))) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.vec_id),
comp AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)""",
    # an example's characters are those of all segments up to its target's; an escape adds one to each match
    "op8_chat": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{OWN}' UNION ALL SELECT -1, 1, 'assistant', '{OWN}'),
s AS (SELECT *, length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) AS size FROM t),
w AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
coalesce(CAST(sum(upto) FILTER (role = 'assistant') AS BIGINT), 0) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples, coalesce(CAST(sum(upto) FILTER (role = 'assistant') AS BIGINT), 0) AS expanded_chars
FROM w GROUP BY conv_id""",
    # whole prefixes as keys; a node's subtree are the nodes that have it among the prefixes of their least member
    "op11_prefix_trie": f"""WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS donor, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
r AS (SELECT i.conv_id, 0 AS part, pos, role, text FROM ids i JOIN own o ON o.conv_id = i.donor AND o.pos <= i.h UNION ALL SELECT conv_id, 1, pos, role, text FROM ids JOIN own USING (conv_id) WHERE pos > h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, length(role) || ':' || role || length(text) || ':' || text AS s, length(text) AS len FROM r),
p AS (SELECT conv_id, depth, len, sha256(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM t),
a AS (SELECT conv_id, 0 AS depth, '' AS k, NULL AS pk, 0 AS len FROM ids UNION ALL SELECT conv_id, depth, k, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY depth), ''), len FROM p),
z AS (SELECT conv_id, max(depth) AS size FROM a GROUP BY conv_id),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(pk) AS pk, any_value(len) AS len, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256 FROM a JOIN z USING (conv_id) GROUP BY depth, k),
c AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY pk),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
s AS (SELECT a.k, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.len) AS BIGINT) AS saved_tokens FROM m JOIN a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.k)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256 FROM m JOIN s USING (k) LEFT JOIN n q ON q.k = m.pk""",
    # of equal texts the longest original, then the smallest id
    "op12_exact_dedup": r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
    # each state's least (cost, audit) row by row, audits whole; then the rows that an audit leaves
    "op13_conversation_repair": rf"""WITH RECURSIVE src AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
k AS (SELECT *, {_crc32("key || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM src),
hurt AS (SELECT key, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM hurt),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY key ORDER BY pos) AS prev, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM ord),
ins(a, b, w, c) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 3, 'I', 2), (3, 2, 'I', 2), (0, 3, 'II', 4), (1, 3, 'II', 4), (2, 2, 'II', 4), (3, 3, 'II', 4)),
mv(a, b, r) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
way AS (SELECT key, pos, st.s AS a, st.s AS b, 3 AS c, 'D' AS x FROM f, (VALUES (0), (1), (2), (3)) st(s) UNION ALL SELECT key, pos, a, b, CASE WHEN fault IS NULL THEN 0 ELSE 1 END, 'K' FROM f JOIN mv ON r = ini WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate') UNION ALL SELECT key, pos, a, b, CASE WHEN fault IS NULL THEN 2 ELSE 3 END, 'R' FROM f JOIN mv ON r IN ('u', 'a') WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')),
step AS (SELECT way.key, way.pos, ins.a, way.b, min({{'c': CAST(ins.c + way.c AS BIGINT), 'w': ins.w || way.x}}) AS best FROM way JOIN ins ON ins.b = way.a GROUP BY ALL),
dp AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS pos, 0 AS s, {{'c': CAST(0 AS BIGINT), 'w': ''}} AS best FROM f UNION ALL SELECT dp.key, step.pos, step.b, min({{'c': dp.best.c + step.best.c, 'w': dp.best.w || step.best.w}}) FROM dp JOIN step ON step.key = dp.key AND step.pos = dp.pos + 1 AND step.a = dp.s GROUP BY 1, 2, 3),
done AS (SELECT dp.key, min({{'c': dp.best.c + ins.c, 'w': dp.best.w || ins.w}}) AS best FROM dp JOIN (SELECT key, max(pos) AS n FROM f GROUP BY key) z ON z.key = dp.key AND z.n = dp.pos JOIN ins ON ins.a = dp.s AND ins.b IN (0, 3) GROUP BY dp.key),
tok AS (SELECT key, unnest(regexp_extract_all(best.w, 'I*[DKR]|I+$')) AS t, generate_subscripts(regexp_extract_all(best.w, 'I*[DKR]|I+$'), 1) AS pos FROM done),
ltr AS (SELECT key, pos, unnest(string_split(t, '')) AS x, generate_subscripts(string_split(t, ''), 1) AS i FROM tok),
line AS (SELECT ltr.*, f.role, f.text, row_number() OVER (PARTITION BY ltr.key ORDER BY ltr.pos, i) AS j FROM ltr LEFT JOIN f ON f.key = ltr.key AND f.pos = ltr.pos WHERE x <> 'D'),
fin AS (SELECT *, max(CASE WHEN j = 1 AND x = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS sys FROM line),
sha AS (SELECT key, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM fin GROUP BY key),
cnt AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.w, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM src) LEFT JOIN cnt USING (key) LEFT JOIN done USING (key) LEFT JOIN sha USING (key)""",
}
