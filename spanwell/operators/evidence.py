"""Evidence, parsing, allocation and card operators as relational plans."""

from __future__ import annotations

from .selection import _candidates

DAY = "86400e0"


def span_parse(d) -> str:
    """STR-10..12: spans read back from generated answers: strict, lenient, reversed and without numbers."""
    a, b = f"CAST({d.floor('start_s')} AS VARCHAR(20))", f"CAST({d.floor('end_s')} AS VARCHAR(20))"
    text = f"CASE query_id % 4 WHEN 0 THEN '[' || {a} || ', ' || {b} || ']' WHEN 1 THEN 'It happens from ' || {a} || 's to about ' || {b} || ' seconds.' WHEN 2 THEN '[' || {b} || ', ' || {a} || ']' ELSE 'not found' END"
    pat = d.pattern("([0-9]+)[^0-9]+([0-9]+)")
    strict = d.pattern("^\\\\[[0-9]+, [0-9]+\\\\]$")
    return f"""WITH t AS (SELECT query_id, {text} AS answer FROM {d.truth}), p AS (SELECT query_id, answer, regexp_extract(answer, {pat}, 1) AS x, regexp_extract(answer, {pat}, 2) AS y FROM t),
    n AS (SELECT query_id, answer, CASE WHEN x = '' THEN NULL ELSE CAST(x AS BIGINT) END AS x, CASE WHEN y = '' THEN NULL ELSE CAST(y AS BIGINT) END AS y FROM p)
    SELECT query_id, CASE WHEN x IS NULL THEN 'not_found' WHEN y <= x THEN 'invalid' WHEN {d.matches('answer', strict)} THEN 'ok' ELSE 'lenient' END AS status, CASE WHEN y > x THEN x END AS start_s, CASE WHEN y > x THEN y END AS end_s FROM n"""


def prompt_render(d) -> str:
    """STR-09: the turns of a conversation as one prompt, by digest and length."""
    line = "role || ': ' || text"
    return f"SELECT conv_id, {d.sha('prompt')} AS prompt_id, CAST(length(prompt) AS BIGINT) AS chars FROM (SELECT conv_id, {d.join_ordered('turn', line)} AS prompt FROM {d.conversations} GROUP BY conv_id) p"


def reservoir_coverage(d) -> str:
    """AGG-26, AGG-25: the best overlap of a true span with any two kept timestamps."""
    key = d.sha("'7:' || CAST(frame_id AS VARCHAR(20))")
    return f"""WITH r AS (SELECT video_id, timestamp_s FROM (SELECT *, {d.rn(f'PARTITION BY video_id ORDER BY {key}, frame_id')} AS rn FROM {d.frames}) f WHERE rn <= 8),
    b AS (SELECT t.query_id, max({d.iou('t.start_s', 't.end_s', 'x.timestamp_s', 'y.timestamp_s')}) AS best FROM {d.truth} t JOIN r x ON x.video_id = t.video_id JOIN r y ON y.video_id = t.video_id AND y.timestamp_s > x.timestamp_s GROUP BY t.query_id)
    SELECT query_id, round(best, 6) AS best, best >= 1e-1 AS usable FROM b"""


def grid_plan(d) -> str:
    """TOP-14, TIM-05: the first frame at or after each point of a grid over the video."""
    return f"""WITH v AS (SELECT DISTINCT video_id, duration_s FROM {d.frames}), g AS (SELECT video_id, k.i, k.i * duration_s / 8e0 AS at_s FROM v CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) k)
    SELECT g.video_id, CAST(g.i AS BIGINT) AS i, min(f.frame_id) AS frame_id FROM g JOIN {d.frames} f ON f.video_id = g.video_id AND f.timestamp_s >= g.at_s GROUP BY g.video_id, g.i"""


def oracle_positions(d) -> str:
    """TOP-15: positions of a span, uniform or heavy at its edges, as the frames nearest them."""
    steps = "SELECT 'uniform' AS plan, 0e0 AS p UNION ALL SELECT 'uniform', 25e-2 UNION ALL SELECT 'uniform', 5e-1 UNION ALL SELECT 'uniform', 75e-2 UNION ALL SELECT 'uniform', 1e0 UNION ALL SELECT 'edges', 0e0 UNION ALL SELECT 'edges', 125e-3 UNION ALL SELECT 'edges', 25e-2 UNION ALL SELECT 'edges', 75e-2 UNION ALL SELECT 'edges', 1e0"
    return f"""WITH w AS (SELECT t.video_id, t.query_id, s.plan, s.p, t.start_s + s.p * (t.end_s - t.start_s) AS at_s FROM {d.truth} t CROSS JOIN ({steps}) s),
    n AS (SELECT w.query_id, w.plan, w.p, f.frame_id, {d.rn('PARTITION BY w.query_id, w.plan, w.p ORDER BY abs(f.timestamp_s - w.at_s), f.frame_id')} AS rn FROM w JOIN {d.frames} f ON f.video_id = w.video_id)
    SELECT query_id, plan, count(DISTINCT frame_id) AS frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM n WHERE rn = 1 GROUP BY query_id, plan"""


def boundary_allocation(d) -> str:
    """TOP-16, TOP-19: up to four frames near each boundary, two inside by value."""
    near = f"2e0 * {DAY}"
    return f"""WITH r AS (
      SELECT t.query_id, f.frame_id, 'start' AS role, {d.rn('PARTITION BY t.query_id ORDER BY abs(f.timestamp_s - t.start_s), f.frame_id')} AS rn FROM {d.truth} t JOIN {d.frames} f ON f.video_id = t.video_id AND abs(f.timestamp_s - t.start_s) <= {near}
      UNION ALL SELECT t.query_id, f.frame_id, 'end', {d.rn('PARTITION BY t.query_id ORDER BY abs(f.timestamp_s - t.end_s), f.frame_id')} FROM {d.truth} t JOIN {d.frames} f ON f.video_id = t.video_id AND abs(f.timestamp_s - t.end_s) <= {near})
    SELECT query_id, frame_id, role, rn AS place FROM r WHERE rn <= 4
    UNION ALL SELECT query_id, frame_id, role, place FROM (SELECT t.query_id, f.frame_id, 'inside' AS role, {d.rn('PARTITION BY t.query_id ORDER BY f.value DESC, f.frame_id')} AS place FROM {d.truth} t JOIN {d.frames} f ON f.video_id = t.video_id AND f.timestamp_s > t.start_s AND f.timestamp_s < t.end_s) i WHERE place <= 2"""


def frame_layout(d) -> str:
    """TOP-17, TOP-18: frames of each candidate by rank: two to the first four, one more to the first two, one to the others."""
    return f"WITH {_candidates(d)} SELECT video_id, candidate_id, CAST(CASE WHEN rk <= 2 THEN 4 WHEN rk <= 4 THEN 3 ELSE 1 END AS BIGINT) AS frames FROM (SELECT video_id, candidate_id, {d.rn('PARTITION BY video_id ORDER BY score DESC, candidate_id')} AS rk FROM span) s WHERE rk <= 6"


def contiguous_growth(d) -> str:
    """WIN-05, RET-06: the run of frames around the best hit whose gaps stay under a tenth of the video or two hours."""
    w = "PARTITION BY video_id ORDER BY timestamp_s, frame_id"
    return f"""WITH g AS (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER ({w}) <= greatest(7200e0, duration_s / 4e1) THEN 0 ELSE 1 END AS fresh FROM {d.scored}),
    r AS (SELECT *, sum(fresh) OVER ({w}) AS run, {d.rn('PARTITION BY video_id ORDER BY score DESC, timestamp_s, frame_id')} AS rk FROM g)
    SELECT a.video_id, a.frame_id AS anchor, count(*) AS n, round(min(b.timestamp_s), 6) AS start_s, round(max(b.timestamp_s), 6) AS end_s FROM r a JOIN r b ON b.video_id = a.video_id AND b.run = a.run WHERE a.rk = 1 GROUP BY a.video_id, a.frame_id"""


def evidence_cards(d) -> str:
    """MEM-20, MEM-21, STR-06, TIM-07: one leaf card for each event with a stable id and the uncertainty of its ends."""
    w = "OVER (PARTITION BY video_id ORDER BY timestamp_s, frame_id)"
    key = d.sha("CAST(video_id AS VARCHAR(20)) || '|' || CAST(frame_id AS VARCHAR(20)) || '|' || kind")
    return f"""SELECT video_id, frame_id, {key} AS card, kind || ' at day ' || CAST({d.floor(f'timestamp_s / {DAY}')} AS VARCHAR(9)) AS summary, round(coalesce(least(b, a), b, a, 0e0) / 2e0, 6) AS uncertainty
    FROM (SELECT *, timestamp_s - lag(timestamp_s) {w} AS b, lead(timestamp_s) {w} - timestamp_s AS a FROM {d.frames}) f"""


def evidence_thirds(d) -> str:
    """RET-18, RET-07: first, middle and last frame of each best span."""
    return f"""WITH {_candidates(d)}, best AS (SELECT * FROM (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, best_rank, candidate_id')} AS rn FROM span) z WHERE rn = 1),
    e AS (SELECT b.video_id, f.frame_id, {d.rn('PARTITION BY b.video_id ORDER BY f.timestamp_s, f.frame_id')} AS i, count(*) OVER (PARTITION BY b.video_id) AS n FROM best b JOIN {d.frames} f ON f.video_id = b.video_id AND f.timestamp_s BETWEEN b.start_s AND b.end_s)
    SELECT video_id, frame_id, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS place FROM e WHERE i = 1 OR i = n OR i = {d.floor('(n + 1) / 2e0')}"""


def tolerance_parity(d) -> str:
    """CTL-08, MTH-30: spans of two methods that are equal within a relative and an absolute tolerance."""
    return f"""SELECT a.method AS method_a, b.method AS method_b, count(*) AS pairs, count(CASE WHEN abs(a.width - b.width) <= greatest(1e-5, 1e-6 * abs(b.width)) THEN 1 END) AS equal FROM (SELECT DISTINCT method, query_id, video_id, round(pred_end - pred_start, 6) AS width FROM {d.evals}) a JOIN (SELECT DISTINCT method, query_id, video_id, round(pred_end - pred_start, 6) AS width FROM {d.evals}) b ON a.video_id = b.video_id AND a.method < b.method GROUP BY a.method, b.method"""


def keyword_backend(d) -> str:
    """RET-17, RET-05: answers of a keyword backend by the first matching rule."""
    return f"SELECT conv_id, turn, CASE WHEN {d.matches('lower(text)', d.pattern('(^|[^a-z])(the|and)([^a-z]|$)'))} THEN 'en' WHEN {d.matches('lower(text)', d.pattern('(^|[^a-z])(der|die|und)([^a-z]|$)'))} THEN 'de' WHEN {d.matches('lower(text)', d.pattern('(^|[^a-z])(le|la|les)([^a-z]|$)'))} THEN 'fr' ELSE 'other' END AS answer FROM {d.conversations} WHERE role = 'user'"


PLANS = {f.__name__: f for f in (span_parse, prompt_render, reservoir_coverage, grid_plan, oracle_positions, boundary_allocation, frame_layout, contiguous_growth, evidence_cards, evidence_thirds, tolerance_parity, keyword_backend)}
