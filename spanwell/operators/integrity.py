"""Integrity, set, hierarchy and text operators as relational plans."""

from __future__ import annotations


def content_dedup(d) -> str:
    """SET-06, MEM-02: one row for each content, with its owners counted and the first of them."""
    return f"SELECT {d.sha('text')} AS content, count(*) AS owners, min(doc_id) AS first_owner, CAST(max(length(text)) AS BIGINT) AS chars FROM {d.documents} GROUP BY {d.sha('text')}"


def bytes_by_owner(d) -> str:
    """MEM-03, MEM-23: characters of distinct contents held by each source."""
    return f"SELECT source, count(*) AS blobs, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT DISTINCT source, {d.sha('text')} AS h, length(text) AS chars FROM {d.documents}) b GROUP BY source"


def identity_exclusions(d) -> str:
    """JOIN-24: documents whose id, source or content does not occur among those labelled toxic."""
    return f"""WITH bad AS (SELECT t.doc_id, {d.sha('t.text')} AS h FROM {d.documents} t JOIN {d.labels} l ON l.doc_id = t.doc_id WHERE l.toxic = 1)
    SELECT t.doc_id FROM {d.documents} t LEFT JOIN (SELECT DISTINCT doc_id FROM bad) a ON a.doc_id = t.doc_id LEFT JOIN (SELECT DISTINCT h FROM bad) b ON b.h = {d.sha('t.text')} WHERE a.doc_id IS NULL AND b.h IS NULL"""


def disjointness_audit(d) -> str:
    """SET-02, SET-03: for every two languages how many contents they share; a content counts once a language."""
    t = f"SELECT lang, {d.sha('text')} AS h FROM {d.documents} GROUP BY lang, {d.sha('text')}"
    return f"""WITH t AS ({t}), l AS (SELECT lang, count(*) AS contents FROM t GROUP BY lang), s AS (SELECT a.lang AS x, b.lang AS y, count(*) AS n FROM t a JOIN t b ON a.h = b.h AND a.lang < b.lang GROUP BY a.lang, b.lang)
    SELECT a.lang AS lang_a, b.lang AS lang_b, a.contents AS contents_a, b.contents AS contents_b, coalesce(s.n, 0) AS shared FROM l a JOIN l b ON a.lang < b.lang LEFT JOIN s ON s.x = a.lang AND s.y = b.lang"""


def fd_violations(d) -> str:
    """SRC-19, JOIN-27: contents that do not fix their source."""
    return f"SELECT {d.sha('text')} AS content, count(DISTINCT source) AS sources FROM {d.documents} GROUP BY {d.sha('text')} HAVING count(DISTINCT source) > 1"


def duplicate_keys(d) -> str:
    """SET-08, MEM-18: keys that occur more than once."""
    return f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM {d.lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


def set_difference(d) -> str:
    """SET-03, SET-04, SET-10: keys of one side alone."""
    return f"SELECT side, count(*) AS n FROM (SELECT 'unlabelled' AS side, doc_id FROM (SELECT doc_id FROM {d.documents} EXCEPT SELECT doc_id FROM {d.labels}) a UNION ALL SELECT 'unknown', doc_id FROM (SELECT doc_id FROM {d.labels} EXCEPT SELECT doc_id FROM {d.documents}) b) s GROUP BY side"


def three_way_join(d) -> str:
    """JOIN-03, JOIN-10: documents, labels and a benchmark of their size class."""
    return f"SELECT t.lang, l.quality, l.toxic, count(*) AS n, round(avg(t.n_chars), 4) AS chars FROM {d.documents} t JOIN {d.labels} l ON l.doc_id = t.doc_id JOIN (SELECT DISTINCT source FROM {d.documents}) s ON s.source = t.source GROUP BY t.lang, l.quality, l.toxic"


def forest_roots(d) -> str:
    """JOIN-19, MEM-17: cards that no card of their tree has as a child; card n > 0 of a tree, numbered from 0, is a child of floor((n - 1) / 3), but where a merge was undone (n % 7 = 3)."""
    parent = d.floor("(i - 1) / 3e0")
    return f"""WITH e AS (SELECT n_nationkey AS id, n_regionkey AS tree, {d.rn("PARTITION BY n_regionkey ORDER BY n_nationkey")} - 1 AS i FROM {d.nation}),
    c AS (SELECT tree, {parent} AS parent, i AS child FROM e WHERE i > 0 AND i % 7 <> 3)
    SELECT e.id, e.tree FROM e LEFT JOIN (SELECT DISTINCT c.tree, c.child FROM c JOIN e p ON p.tree = c.tree AND p.i = c.parent) k ON k.tree = e.tree AND k.child = e.i WHERE k.child IS NULL"""


def hierarchy_closure(d) -> str:
    """JOIN-17, JOIN-18: ancestors of every node of a ternary hierarchy over the suppliers."""
    n = d.supplier
    parent = d.floor("(s_suppkey - 1) / 3e0")
    return f"""WITH RECURSIVE up AS (SELECT s_suppkey AS node, {parent} AS anc, 1 AS depth FROM {n} WHERE s_suppkey > 0
    UNION ALL SELECT node, {d.floor("(anc - 1) / 3e0")}, depth + 1 FROM up WHERE anc > 0)
    SELECT node, anc, CAST(depth AS BIGINT) AS depth FROM up"""


def interval_containment(d) -> str:
    """JOIN-12: frames inside each true span; spans are dealt to day cells, so that the join has a key."""
    day = "86400e0"
    return f"""WITH c AS (SELECT video_id, query_id, start_s, end_s, {d.floor(f'start_s / {day}')} AS lo, {d.floor(f'end_s / {day}')} AS hi FROM {d.truth}),
    cell AS (SELECT video_id, query_id, start_s, end_s, cell FROM c {d.unnest(d.seq('lo', 'hi'), 'cell')}),
    f AS (SELECT *, {d.floor(f'timestamp_s / {day}')} AS cell FROM {d.frames})
    SELECT cell.video_id, cell.query_id, count(*) AS n, round(avg(f.value), 6) AS mean FROM cell JOIN f ON f.video_id = cell.video_id AND f.cell = cell.cell AND f.timestamp_s BETWEEN cell.start_s AND cell.end_s GROUP BY cell.video_id, cell.query_id"""


def cross_video_negatives(d) -> str:
    """JOIN-21: for each query the first query of the next run of another video, round and round; none only if there is one video.

    Runs are found within buckets; only one row a bucket meets in the windows over all.
    """
    later = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH {d.numbered("o", d.truth, d.floor("s.query_id / 4096e0"), "r.query_id")},
    ends AS (SELECT bucket, max_by(video_id, i) AS last FROM o GROUP BY bucket),
    before AS (SELECT bucket, coalesce(lag(last) OVER (ORDER BY bucket), max_by(last, bucket) OVER ()) AS last FROM ends),
    m AS (SELECT o.query_id, o.bucket, o.i, CASE WHEN coalesce(lag(o.video_id) OVER (PARTITION BY o.bucket ORDER BY o.i), p.last) <> o.video_id THEN o.query_id END AS head FROM o JOIN before p ON p.bucket = o.bucket),
    heads AS (SELECT bucket, min(head) AS head FROM m GROUP BY bucket),
    after AS (SELECT bucket, coalesce(min(head) OVER (ORDER BY bucket DESC {later}), min(head) OVER ()) AS head FROM heads),
    p AS (SELECT m.query_id, coalesce(min(m.head) OVER (PARTITION BY m.bucket ORDER BY m.i DESC {later}), x.head) AS negative FROM m JOIN after x ON x.bucket = m.bucket)
    SELECT query_id, negative FROM p WHERE negative IS NOT NULL"""


def normalized_text(d) -> str:
    """STR-01, HSH-01: normalised texts and their stable ids."""
    return f"SELECT item_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' '{d.all_flag}))) AS text, {d.sha(f"lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' '{d.all_flag})))")} AS id FROM {d.benchmark}"


def _bags(d) -> str:
    """Bags of words and cosines.  Texts are dealt by document first, so that their words, counts and sums stay where they are."""
    return f"""doc_bag AS (SELECT doc_id, w, count(*) AS n FROM (SELECT /*+ REPARTITION(doc_id) */ doc_id, text FROM {d.documents}) t {d.unnest(d.tokens('text'), 'w')} GROUP BY doc_id, w),
    item_bag AS (SELECT item_id, w, count(*) AS n FROM {d.benchmark} {d.unnest(d.tokens('text'), 'w')} GROUP BY item_id, w),
    doc_norm AS (SELECT doc_id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS z FROM doc_bag GROUP BY doc_id), item_norm AS (SELECT item_id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS z FROM item_bag GROUP BY item_id),
    sims AS (SELECT i.item_id, t.doc_id, sum(CAST(i.n AS DOUBLE) * t.n) AS dot FROM item_bag i JOIN doc_bag t ON t.w = i.w GROUP BY i.item_id, t.doc_id),
    cos AS (SELECT s.item_id, s.doc_id, round(s.dot / (a.z * b.z), 6) AS score FROM sims s JOIN item_norm a ON a.item_id = s.item_id JOIN doc_norm b ON b.doc_id = s.doc_id)"""


def lexical_locate(d) -> str:
    """RET-05, STR-02, STR-03: the document nearest each item by bag-of-words cosine, above a floor."""
    return f"WITH {_bags(d)} SELECT item_id, doc_id, score FROM (SELECT *, {d.rn('PARTITION BY item_id ORDER BY score DESC, doc_id')} AS rn FROM cos) r WHERE rn = 1 AND score >= 1e-1"


def rank_cards(d) -> str:
    """RET-04, MTH-09, MTH-10: the five best documents of each item by text score, completeness bonus and length penalty."""
    return f"""WITH {_bags(d)}, s AS (SELECT c.item_id, c.doc_id, round(c.score + 5e-2 * CASE WHEN t.n_chars > 2000 THEN 1e0 WHEN t.n_chars > 500 THEN 5e-1 ELSE 25e-2 END - 1e-2 * ln(1e0 + t.n_chars) / 1e1, 6) AS score FROM cos c JOIN {d.documents} t ON t.doc_id = c.doc_id)
    SELECT item_id, doc_id, score, rn AS rank FROM (SELECT *, {d.rn('PARTITION BY item_id ORDER BY score DESC, doc_id')} AS rn FROM s) r WHERE rn <= 5"""


def token_jaccard(d) -> str:
    """STR-04, MTH-26, WIN-18: likeness of consecutive turns of a conversation by their words."""
    w = "OVER (PARTITION BY conv_id ORDER BY turn)"
    t = d.distinct_list(d.tokens("text"))
    a, b = d.size("w"), d.size("p")
    both = d.size(d.intersect("w", "p"))
    return f"SELECT conv_id, turn, CASE WHEN {a} + {b} > 0 THEN round(CAST({both} AS DOUBLE) / ({a} + {b} - {both}), 6) ELSE 0e0 END AS likeness FROM (SELECT conv_id, turn, w, lag(w) {w} AS p FROM (SELECT conv_id, turn, {t} AS w FROM {d.conversations}) x) y WHERE p IS NOT NULL"


def summary_join(d) -> str:
    """STR-05, STR-08, AGG-38: roles of a conversation, distinct and joined."""
    return f"SELECT conv_id, {d.concat_sorted('role')} AS roles, count(*) AS n, {d.sha(d.concat_sorted('role'))} AS roles_id FROM {d.conversations} GROUP BY conv_id"


def weighted_mode(d) -> str:
    """AGG-37: the language with the most characters of each source, ties in order."""
    return f"SELECT source, lang, chars FROM (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS chars, {d.rn('PARTITION BY source ORDER BY sum(n_chars) DESC, lang')} AS rn FROM {d.documents} GROUP BY source, lang) r WHERE rn = 1"


def group_identity(d) -> str:
    """AGG-39: hash of the sorted distinct members of a group."""
    return f"SELECT user_id, {d.sha(d.concat_sorted('event_type'))} AS identity FROM {d.events} GROUP BY user_id"


def writer_parse_status(d) -> str:
    """JSN-03, JSN-04, JSN-05: valid, repaired or fallback documents."""
    broken = "CASE WHEN event_id % 3 = 1 THEN replace(props, '}}', ',}}') WHEN event_id % 3 = 2 THEN replace(props, '}}', '') ELSE props END".replace("}}", d.brace)
    fixed = f"replace(j, ',{d.brace}', '{d.brace}')"
    return f"SELECT event_id, CASE WHEN {d.json_ok('j')} THEN 'valid' WHEN {d.json_ok(fixed)} THEN 'repaired' ELSE 'fallback' END AS status FROM (SELECT event_id, {broken} AS j FROM {d.events}) x"


def json_projection(d) -> str:
    """SRC-08, PRJ-24: a key of the event documents, by type."""
    return f"SELECT event_type, {d.json_int('props', 'k')} AS k, count(*) AS n FROM {d.events} GROUP BY event_type, {d.json_int('props', 'k')}"


def latest_document(d) -> str:
    """SNK-14: the latest turn of each conversation wins."""
    return f"SELECT conv_id, turn, role, {d.sha('text')} AS content FROM (SELECT *, {d.rn('PARTITION BY conv_id ORDER BY turn DESC')} AS rn FROM {d.conversations}) r WHERE rn = 1"


def event_tail(d) -> str:
    """SNK-15, STM-19, SNK-05: events after each user's last error, in sequence."""
    return f"WITH c AS (SELECT user_id, max(event_id) AS cursor FROM {d.events} WHERE event_type = 'error' GROUP BY user_id) SELECT e.user_id, e.event_id, {d.rn('PARTITION BY e.user_id ORDER BY e.event_id')} AS seq FROM {d.events} e JOIN c ON c.user_id = e.user_id WHERE e.event_id > c.cursor"


def monotonicity(d) -> str:
    """STM-02, MEM-19, SNK-04: neighbours in id order whose times go back."""
    return f"SELECT count(*) AS n, count(CASE WHEN step < 0 THEN 1 END) AS back FROM (SELECT timestamp_s - lag(timestamp_s) OVER (PARTITION BY video_id ORDER BY frame_id) AS step FROM {d.frames}) f"


def snapshot_fingerprint(d) -> str:
    """HSH-07, SNK-06: size and order-free fingerprint of each partition."""
    return f"SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum({d.hash_int('text')} % 1000003) AS BIGINT) AS mark FROM {d.documents} GROUP BY lang"


def evidence_authorization(d) -> str:
    """PRJ-19, JOIN-23: documents that a labelled answer cites."""
    return f"SELECT t.doc_id, t.source FROM {d.documents} t WHERE EXISTS (SELECT 1 FROM {d.labels} l WHERE l.doc_id = t.doc_id AND l.quality = 1)"


def session_windows(d) -> str:
    """Extension: sessions of an hour's silence as the engine's own windows count them."""
    return f"""WITH f AS (SELECT user_id, ts, event_id, CASE WHEN {d.micros('ts')} - lag({d.micros('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM {d.events}),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM f)
    SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n FROM g GROUP BY user_id, s"""


PLANS = {f.__name__: f for f in (content_dedup, bytes_by_owner, identity_exclusions, disjointness_audit, fd_violations, duplicate_keys, set_difference, three_way_join, forest_roots, hierarchy_closure, interval_containment, cross_video_negatives, normalized_text, lexical_locate, rank_cards, token_jaccard, summary_join, weighted_mode, group_identity, writer_parse_status, json_projection, latest_document, event_tail, monotonicity, snapshot_fingerprint, evidence_authorization, session_windows)}
