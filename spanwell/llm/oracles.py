"""DuckDB SQL for the registered queries, over the same tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING count(*) > 1),
bad AS (SELECT doc_id, i FROM win JOIN low USING (h) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
mark AS (SELECT word.doc_id, j, x, max(bad.i) OVER (PARTITION BY word.doc_id ORDER BY j) AS last_bad FROM word LEFT JOIN bad ON bad.doc_id = word.doc_id AND bad.i = word.j),
sums AS (SELECT doc_id, count(*) FILTER (WHERE j - last_bad < 50) AS n, string_agg(x, ' ' ORDER BY j) FILTER (WHERE last_bad IS NULL OR j - last_bad >= 50) AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOWERED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS r FROM d UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.a),
c AS (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP3 = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), l AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(role) + (length(role) - length(replace(role, '%', ''))) * 2 + (length(role) - length(replace(role, chr(10), ''))) * 2 + (length(role) - length(replace(role, '<', ''))) * 2 AS role_chars,
         length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) AS text_chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN before = role THEN length('<|im_sep|>') ELSE length('<|im_start|>') + role_chars + 1 + length('<|im_end|>') + 1 END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op2_minhash_dedup": OP2, "op3_chat_formatting": OP3}

OP10 = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(list_resize(q.v, greatest(1, len(q.v), len(c.v)), 0), list_resize(c.v, greatest(1, len(q.v), len(c.v)), 0))::BIGINT AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ORACLE_SQL["op10_topk"] = OP10

_U = "((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || (k + 1)), 1, 8))::BIGINT + 1) / 4294967296e0)"


def _jumps(shards: int) -> str:
    """Chains of jumps of every key until they leave the shards; the last place below is the shard."""
    return f"""jump{shards} AS (
  SELECT doc_id, -1::BIGINT AS b, 0::BIGINT AS j, 0::BIGINT AS k FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, j, floor((j + 1) / {_U})::BIGINT, k + 1 FROM jump{shards} WHERE j < {shards}), at{shards} AS (SELECT doc_id, b::INTEGER AS shard FROM jump{shards} WHERE j >= {shards})"""


OP8 = f"""
WITH RECURSIVE bits AS (
  SELECT i AS v, i, 0 AS n FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8),
{_jumps(16)}, {_jumps(17)},
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc),
dealt AS (SELECT s.*, a.shard, g.shard AS grown_shard FROM sized s JOIN at16 a ON a.doc_id IS NOT DISTINCT FROM s.doc_id JOIN at17 g ON g.doc_id IS NOT DISTINCT FROM s.doc_id),
grouped AS (SELECT *, ('0x' || substr(md5(concat_ws('|', doc_id, size, text_crc32, shard, grown_shard)), 1, 15))::BIGINT % greatest(1, ((SELECT count(*) FROM documents) + 8191) // 8192) AS g FROM dealt)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot, grown_shard FROM grouped
"""
ORACLE_SQL["op8_sharding"] = OP8
