"""Evidence cards: merge and utility scores, parents, event candidates, as relational plans over ``cards`` (times in days)."""

from __future__ import annotations

#: Length of the vectors that are pooled component by component.
DIM = 64
# Weights of the merge score, of the boundary importance and of the utility.
SEMANTIC, GAP, BOUNDARY = "1e0", "35e-2", "35e-2"
CERTAINTY, HITS, PHASES = "5e-1", "35e-2", "15e-2"
NOVELTY, ENDS, DENSITY, RAW = "3e-1", "3e-1", "25e-2", "15e-2"

_ORDER = "OVER (PARTITION BY video_id ORDER BY t_start, t_end, card_id)"


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1e0 ELSE 0e0 END"


def _clip(x: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def overlaps(name: str, table: str, key: str, a: str, b: str) -> str:
    """CTEs that end in ``name`` (video_id, key, n): how many other spans of the video share a point with each one.

    A sweep: those that start up to its end, less those that end before its start, less itself.
    """
    w = "OVER (PARTITION BY video_id ORDER BY x, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}_a AS (SELECT video_id, {key}, k, sum(one) {w} AS c FROM (SELECT video_id, {key}, 'q' AS k, {b} AS x, 1 AS tag, 0 AS one FROM {table} UNION ALL SELECT video_id, {key}, 's', {a}, 0, 1 FROM {table}) u),
    {name}_b AS (SELECT video_id, {key}, k, sum(one) {w} AS c FROM (SELECT video_id, {key}, 'q' AS k, {a} AS x, 0 AS tag, 0 AS one FROM {table} UNION ALL SELECT video_id, {key}, 'e', {b}, 1, 1 FROM {table}) u),
    {name} AS (SELECT s.video_id, s.{key}, CAST(s.c - e.c - 1 AS BIGINT) AS n FROM {name}_a s JOIN {name}_b e ON e.video_id = s.video_id AND e.{key} = s.{key} WHERE s.k = 'q' AND e.k = 'q')"""


def interval_overlap_count(d) -> str:
    """JOIN-13: other true spans of the video that overlap each span, by a sweep over the video."""
    return f"WITH {overlaps('o', d.truth, 'query_id', 'start_s', 'end_s')} SELECT video_id, query_id, n FROM o"


def _pairs(d) -> str:
    """Neighbouring cards in temporal order: likeness, gap and importance of the boundary between them."""
    nxt = lambda c: f"lead({c}) {_ORDER}"
    certain = "1e0 / (1e0 + greatest(0e0, right_u) + greatest(0e0, next_left_u))"
    return f"""n AS (SELECT video_id, card_id AS lhs, {nxt('card_id')} AS rhs, t_end, {nxt('t_start')} AS next_start, right_u, {nxt('left_u')} AS next_left_u, right_hit, {nxt('left_hit')} AS next_hit, phase, {nxt('phase')} AS next_phase, embedding, {nxt('embedding')} AS next_embedding FROM {d.cards}),
    p AS (SELECT video_id, lhs, rhs, {_clip(d.dot('embedding', 'next_embedding'), '-1e0')} AS likeness, greatest(0e0, next_start - t_end) AS gap,
      least(1e0, {CERTAINTY} * ({certain}) + {HITS} * (({_flag('right_hit')}) + ({_flag('next_hit')})) / 2e0 + {PHASES} * ({_flag("phase = 'complete' AND next_phase = 'complete'")})) AS importance FROM n WHERE rhs IS NOT NULL)"""


def merge_candidates(d) -> str:
    """MTH-12, WIN-18, MTH-26: merge score of neighbours (likeness less gap and boundary penalties), the best first."""
    return f"""WITH {_pairs(d)}, s AS (SELECT *, round({SEMANTIC} * likeness - {GAP} * (gap / (1e0 + gap)) - {BOUNDARY} * importance, 6) AS score FROM p)
    SELECT video_id, lhs, rhs, round(gap, 6) AS gap, score, {d.rn('PARTITION BY video_id ORDER BY score DESC, lhs')} AS place FROM s"""


def boundary_importance(d) -> str:
    """MTH-13: certainty of two facing ends, cached hits there, and whether both phases are complete."""
    return f"WITH {_pairs(d)} SELECT video_id, lhs, rhs, round(importance, 6) AS importance FROM p"


def utility_scores(d) -> str:
    """MTH-11, JOIN-16: novelty against both neighbours, certain and seen ends, few overlaps, a raw frame at hand."""
    near = lambda f: f"CASE WHEN {f}(card_id) {_ORDER} IS NOT NULL THEN {d.dot('embedding', f'{f}(embedding) {_ORDER}')} END"
    sure = "1e0 / (1e0 + greatest(0e0, left_u) + greatest(0e0, right_u))"
    return f"""WITH {overlaps('o', d.cards, 'card_id', 't_start', 't_end')},
    e AS (SELECT *, lag(embedding) {_ORDER} AS p, lead(embedding) {_ORDER} AS q FROM {d.cards}),
    s AS (SELECT e.video_id, e.card_id, {_clip(f"1e0 - coalesce(greatest(CASE WHEN p IS NULL THEN {d.dot('embedding', 'q')} ELSE {d.dot('embedding', 'p')} END, CASE WHEN q IS NULL THEN {d.dot('embedding', 'p')} ELSE {d.dot('embedding', 'q')} END), 0e0)")} AS novelty,
      {_clip(f"({sure} + (({_flag('left_hit')}) + ({_flag('right_hit')})) / 2e0) / 2e0")} AS boundary, 1e0 / (1e0 + o.n) AS sparse, {_flag('raw')} AS raw FROM e JOIN o ON o.video_id = e.video_id AND o.card_id = e.card_id)
    SELECT video_id, card_id, round(novelty, 6) AS novelty, round(boundary, 6) AS boundary, round({NOVELTY} * novelty + {ENDS} * boundary + {DENSITY} * sparse + {RAW} * raw, 6) AS utility FROM s"""


def coverage_anchors(d) -> str:
    """MEM-09, WIN-14: of the cards in each logarithmic bucket of time the one that is worth most stays."""
    return f"""WITH u AS ({utility_scores(d)}), b AS (SELECT c.video_id, c.card_id, u.utility, CAST({d.floor("log2(1e0 + (c.t_start + c.t_end) / 2e0)")} AS BIGINT) AS bucket FROM {d.cards} c JOIN u ON u.video_id = c.video_id AND u.card_id = c.card_id)
    SELECT video_id, bucket, card_id, utility FROM (SELECT *, {d.rn('PARTITION BY video_id, bucket ORDER BY utility DESC, card_id')} AS rn FROM b) r WHERE rn = 1"""


def parent_cards(d) -> str:
    """MEM-11, MTH-27, MTH-28, AGG-36, AGG-37: parents of the cards of two days: weights of length and support, pooled vector, heaviest scene.

    One sum a component in one grouping; a parent has a vector only if all its children have one.
    """
    sums = ", ".join(f"sum(w * {d.at('embedding', i)}) AS v{i}" for i in range(DIM))
    length = " + ".join(f"v{i} * v{i}" for i in range(DIM))
    return f"""WITH c AS (SELECT *, CAST({d.floor('t_start / 2e0')} AS BIGINT) AS bin, greatest(t_end - t_start, 1e-3) * greatest(1, supports) AS w FROM {d.cards}),
    m AS (SELECT video_id, bin, count(*) AS children, min(t_start) AS t_start, max(t_end) AS t_end, sum(w) AS total, sum(w * (t_start + t_end) / 2e0) AS centre, count(embedding) AS vectors, {sums} FROM c GROUP BY video_id, bin),
    z AS (SELECT video_id, bin, scene, {d.rn('PARTITION BY video_id, bin ORDER BY sum(w) DESC, scene')} AS rn FROM c GROUP BY video_id, bin, scene)
    SELECT m.video_id, m.bin, children, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, round(centre / total, 4) AS centre, CASE WHEN vectors = children THEN round(sqrt({length}) / total, 5) END AS length, z.scene FROM m JOIN z ON z.video_id = m.video_id AND z.bin = m.bin AND z.rn = 1"""


def parent_summary(d) -> str:
    """STR-08, AGG-38: distinct summaries of the children in order, joined, and cut with an ellipsis."""
    line = "scene || ' ' || phase"
    return f"""WITH c AS (SELECT video_id, {line} AS summary, min(t_start) AS t0 FROM {d.cards} GROUP BY video_id, {line}), j AS (SELECT video_id, {d.join_ordered('t0', 'summary')} AS text FROM c GROUP BY video_id)
    SELECT video_id, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 39)) || '…' ELSE text END AS summary FROM j"""


def event_candidates(d) -> str:
    """TOP-03, RET-09, RET-20, WIN-03: the eight nearest cards, grouped where gaps stay small, each group widened by one neighbour."""
    line = "PARTITION BY video_id ORDER BY t_start, card_id"
    return f"""WITH t AS (SELECT video_id, card_id, t_start, t_end, duration, round({d.dot('embedding', 'q_emb')}, 6) AS score, {d.rn(line)} AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM {d.cards}),
    k AS (SELECT * FROM (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, t_start, card_id')} AS rank FROM t) r WHERE rank <= 8),
    g AS (SELECT *, sum(fresh) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (SELECT *, CASE WHEN t_start - lag(t_end) OVER ({line}) <= 4e0 THEN 0 ELSE 1 END AS fresh FROM k) f),
    e AS (SELECT video_id, CAST(grp AS BIGINT) AS grp, greatest(1, min(pos) - 1) AS lo, least(max(n), max(pos) + 1) AS hi, max(score) AS score, max(duration) AS duration, count(*) AS hits FROM g GROUP BY video_id, grp)
    SELECT e.video_id, e.grp, e.hits, round(greatest(0e0, a.t_start - 1e-1), 6) AS t_start, round(least(e.duration, b.t_end + 1e-1), 6) AS t_end, e.score, {d.rn('PARTITION BY e.video_id ORDER BY e.score DESC, a.t_start, e.grp')} AS place
    FROM e JOIN t a ON a.video_id = e.video_id AND a.pos = e.lo JOIN t b ON b.video_id = e.video_id AND b.pos = e.hi"""


def event_locate(d) -> str:
    """RET-09: the best event envelope as a fallback answer, with the confidence of its score."""
    return f"WITH c AS ({event_candidates(d)}) SELECT video_id, t_start, t_end, round(greatest(0e0, least(1e0, (score + 1e0) / 2e0)), 6) AS confidence, 'fallback' AS status FROM c WHERE place = 1"


def visible_cards(d) -> str:
    """PRJ-04, JOIN-04: cards that have ended by each arrival time of their video."""
    return f"""WITH a AS (SELECT DISTINCT video_id, rho, t_q / 86400e0 AS t_q FROM {d.arrivals})
    SELECT a.video_id, a.rho, count(*) AS cards, round(max(c.t_end), 6) AS last_end FROM a JOIN {d.cards} c ON c.video_id = a.video_id AND c.t_start < a.t_q AND c.t_end <= a.t_q + 1e-6 GROUP BY a.video_id, a.rho"""


def card_bytes(d) -> str:
    """MEM-04: the four byte classes of a card store and their sum: fields, vectors, frame references, caches."""
    return f"""WITH b AS (SELECT video_id, 96 + length(scene) + length(phase) AS fields, CASE WHEN embedding IS NULL THEN 0 ELSE 2 * {DIM} END AS vectors, CASE WHEN raw THEN 13 ELSE 0 END AS refs, 8 * supports + 2 AS cache FROM {d.cards})
    SELECT video_id, count(*) AS cards, CAST(sum(fields) AS BIGINT) AS fields, CAST(sum(vectors) AS BIGINT) AS vectors, CAST(sum(refs) AS BIGINT) AS refs, CAST(sum(cache) AS BIGINT) AS cache, CAST(sum(fields + vectors + refs + cache) AS BIGINT) AS bytes FROM b GROUP BY video_id"""


PLANS = {f.__name__: f for f in (interval_overlap_count, merge_candidates, boundary_importance, utility_scores, coverage_anchors, parent_cards, parent_summary, event_candidates, event_locate, visible_cards, card_bytes)}
