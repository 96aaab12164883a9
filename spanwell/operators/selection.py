"""Selection, sampling and sequence operators as relational plans."""

from __future__ import annotations

SLOTS, TOP_K, MARGIN_S, GAP_S = 8, 5, 3600.0, 86400.0
DAY = "86400e0"


def _slot(d, source: str) -> str:
    return f"""SELECT *, (slot + 5e-1) * duration_s / {SLOTS} AS target_s FROM (
      SELECT *, least({SLOTS - 1}, {d.floor(f"greatest(0e0, least(timestamp_s, duration_s)) / duration_s * {SLOTS}")}) AS slot FROM {source} WHERE duration_s > 0) s"""


def uniform_slots(d) -> str:
    """TOP-06, TIM-02: per slot the frame nearest the slot's centre, ties to the smaller id."""
    return f"""SELECT video_id, CAST(slot AS BIGINT) AS slot, frame_id, round(timestamp_s, 6) AS timestamp_s, round(target_s, 6) AS target_s FROM (
      SELECT *, {d.rn('PARTITION BY video_id, slot ORDER BY abs(timestamp_s - target_s), frame_id')} AS rn FROM ({_slot(d, d.frames)}) q) r WHERE rn = 1"""


def uniform_slots_asof(d) -> str:
    """STM-01, JOIN-14: the same over the frames that have arrived at each ratio of the stream."""
    f = d.frames
    return f"""WITH seen AS (SELECT f.video_id, f.frame_id, f.timestamp_s, f.duration_s, r.rho FROM {f} f CROSS JOIN (SELECT 25e-2 AS rho UNION ALL SELECT 5e-1 UNION ALL SELECT 75e-2 UNION ALL SELECT 1e0) r WHERE f.timestamp_s <= r.rho * f.duration_s),
    slotted AS ({_slot(d, 'seen')})
    SELECT video_id, rho, CAST(slot AS BIGINT) AS slot, frame_id FROM (
      SELECT *, {d.rn('PARTITION BY video_id, rho, slot ORDER BY abs(timestamp_s - target_s), frame_id')} AS rn FROM slotted) r WHERE rn = 1"""


def slot_resize(d) -> str:
    """TOP-08: slots halved, chosen again from the frames that were kept."""
    half = SLOTS // 2
    return f"""WITH slotted AS ({_slot(d, d.frames)}),
    kept AS (SELECT * FROM (SELECT *, {d.rn('PARTITION BY video_id, slot ORDER BY abs(timestamp_s - target_s), frame_id')} AS rn FROM slotted) r WHERE rn = 1),
    again AS (SELECT video_id, frame_id, timestamp_s, duration_s, CAST(least({half - 1}, {d.floor(f"timestamp_s / duration_s * {half}")}) AS BIGINT) AS slot2 FROM kept)
    SELECT video_id, slot2 AS slot, frame_id FROM (
      SELECT *, {d.rn(f'PARTITION BY video_id, slot2 ORDER BY abs(timestamp_s - (slot2 + 5e-1) * duration_s / {half}), frame_id')} AS rn2 FROM again) z WHERE rn2 = 1"""


def hash_reservoir(d) -> str:
    """TOP-07: a reservoir of fixed size as the bottom k by keyed hash."""
    return f"""SELECT video_id, frame_id, rn AS place FROM (
      SELECT video_id, frame_id, {d.rn(f"PARTITION BY video_id ORDER BY {d.sha("'7:' || CAST(frame_id AS VARCHAR(20))")}, frame_id")} AS rn FROM {d.frames}) r WHERE rn <= {SLOTS}"""


def frame_topk(d) -> str:
    """TOP-01, WIN-01, MTH-04: the best frames of each video for its query, in a total order."""
    return f"""SELECT video_id, frame_id, score, rn AS rank FROM (
      SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, timestamp_s, frame_id')} AS rn FROM {d.scored}) r WHERE rn <= {TOP_K}"""


def _candidates(d) -> str:
    return f"""ranked AS (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, timestamp_s, frame_id')} AS rk, {d.rn('PARTITION BY video_id ORDER BY timestamp_s, frame_id')} AS pos FROM {d.scored}),
    hits AS (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER (PARTITION BY video_id ORDER BY pos) <= {GAP_S} + 1e-9 THEN 0 ELSE 1 END AS fresh FROM ranked WHERE rk <= {TOP_K}),
    grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY pos) AS g FROM hits),
    cand AS (SELECT video_id, CAST(g AS BIGINT) AS candidate_id, min(pos) - 1 AS lo, max(pos) + 1 AS hi, max(score) AS score, min(rk) AS best_rank, count(*) AS n_hits FROM grouped GROUP BY video_id, g),
    span AS (SELECT c.video_id, c.candidate_id, c.score, c.best_rank, c.n_hits, min(r.timestamp_s) AS start_s, max(r.timestamp_s) AS end_s, count(*) AS n_frames, max(r.duration_s) AS duration_s
      FROM cand c JOIN ranked r ON r.video_id = c.video_id AND r.pos BETWEEN c.lo AND c.hi GROUP BY c.video_id, c.candidate_id, c.score, c.best_rank, c.n_hits)"""


def frame_candidates(d) -> str:
    """RET-01, WIN-02, WIN-04: hits in gap groups, widened by a neighbour on each side; overlaps are not merged."""
    return f"WITH {_candidates(d)} SELECT video_id, candidate_id, score, best_rank, n_hits, n_frames, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM span"


def coarse_prediction(d) -> str:
    """RET-02, TIM-06, MTH-08: the best envelope, widened and clamped, as a fallback prediction."""
    return f"""WITH {_candidates(d)},
    best AS (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, best_rank, candidate_id')} AS rn FROM span)
    SELECT video_id, 'fallback' AS status, round(greatest(0e0, start_s - {MARGIN_S}), 6) AS start_s, round(least(duration_s, end_s + {MARGIN_S}), 6) AS end_s,
           round(greatest(0e0, least(1e0, (score + 1e0) / 2e0)), 6) AS confidence FROM best WHERE rn = 1"""


def candidate_labels(d) -> str:
    """STR-14, TOP-27: candidates labelled C01, C02 .. by score."""
    return f"""WITH {_candidates(d)} SELECT video_id, candidate_id, concat('C', lpad(CAST({d.rn('PARTITION BY video_id ORDER BY score DESC, candidate_id')} AS VARCHAR(9)), 2, '0')) AS label FROM span"""


def event_gap_sessions(d) -> str:
    """WIN-03: events of a user in sessions parted by gaps of more than six hours."""
    return f"""WITH flagged AS (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER (PARTITION BY video_id ORDER BY timestamp_s, frame_id) <= 21600e0 THEN 0 ELSE 1 END AS fresh FROM {d.frames}),
    grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY timestamp_s, frame_id) AS g FROM flagged)
    SELECT video_id, CAST(g AS BIGINT) AS session, count(*) AS n, round(min(timestamp_s), 6) AS start_s, round(max(timestamp_s), 6) AS end_s, round(sum(value), 4) AS total FROM grouped GROUP BY video_id, g"""


def sampling_cells(d) -> str:
    """TIM-03, SRC-12: the first frame of each fixed cell."""
    return f"""SELECT video_id, cell, frame_id, n FROM (
      SELECT video_id, frame_id, cell, count(*) OVER (PARTITION BY video_id, cell) AS n, {d.rn('PARTITION BY video_id, cell ORDER BY timestamp_s, frame_id')} AS rn
      FROM (SELECT *, {d.floor(f'(timestamp_s + 1e-9) / {DAY}')} AS cell FROM {d.frames}) f) r WHERE rn = 1"""


def sliding_ring(d) -> str:
    """STM-04: how much a ring of half a day holds at each frame."""
    w = "OVER (PARTITION BY video_id ORDER BY timestamp_s RANGE BETWEEN 43200e0 PRECEDING AND CURRENT ROW)"
    return f"SELECT video_id, frame_id, count(*) {w} AS held, round(max(value) {w}, 4) AS peak FROM {d.frames}"


def endpoint_subset(d) -> str:
    """TOP-13: k positions from first to last, half-even rounding."""
    return f"""WITH numbered AS (SELECT video_id, frame_id, {d.rn('PARTITION BY video_id ORDER BY timestamp_s, frame_id')} - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM {d.frames}),
    wanted AS (SELECT DISTINCT video_id, {d.half_even('CAST(i * (n - 1) AS DOUBLE) / 7e0')} AS pos FROM (SELECT DISTINCT video_id, n FROM numbered) v CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) k)
    SELECT n.video_id, n.pos, n.frame_id FROM numbered n JOIN wanted w ON n.video_id = w.video_id AND n.pos = w.pos"""


def nearest_frame(d) -> str:
    """JOIN-15, SRC-21: the frame nearest the midpoint of each true span."""
    return f"""SELECT video_id, query_id, frame_id, round(gap_s, 6) AS gap_s FROM (
      SELECT t.video_id, t.query_id, f.frame_id, abs(f.timestamp_s - (t.start_s + t.end_s) / 2e0) AS gap_s,
             {d.rn('PARTITION BY t.video_id, t.query_id ORDER BY abs(f.timestamp_s - (t.start_s + t.end_s) / 2e0), f.frame_id')} AS rn
      FROM {d.truth} t JOIN {d.frames} f ON f.video_id = t.video_id) r WHERE rn = 1"""


def temporal_neighbors(d) -> str:
    """JOIN-16, WIN-06, WIN-19: neighbours in time, the gap to them and the local sampling interval."""
    w = "OVER (PARTITION BY video_id ORDER BY timestamp_s, frame_id)"
    return f"""SELECT video_id, frame_id, prev_id, next_id, round(coalesce(least(gap_prev, gap_next), gap_prev, gap_next), 6) AS interval_s FROM (
      SELECT video_id, frame_id, lag(frame_id) {w} AS prev_id, lead(frame_id) {w} AS next_id, timestamp_s - lag(timestamp_s) {w} AS gap_prev, lead(timestamp_s) {w} - timestamp_s AS gap_next FROM {d.frames}) f"""


def stride_levels(d) -> str:
    """WIN-17: groups of 2, 4 and 8 consecutive frames, their support and median step."""
    return f"""WITH numbered AS (SELECT video_id, frame_id, timestamp_s, {d.rn('PARTITION BY video_id ORDER BY timestamp_s, frame_id')} - 1 AS pos, timestamp_s - lag(timestamp_s) OVER (PARTITION BY video_id ORDER BY timestamp_s, frame_id) AS step FROM {d.frames})
    SELECT video_id, level, {d.floor('pos / w')} AS cell, count(*) AS n, round(min(timestamp_s), 6) AS start_s, round(max(timestamp_s), 6) AS end_s, round({d.pct('step', '0.5')}, 4) AS step
    FROM numbered CROSS JOIN (SELECT 1 AS level, 2e0 AS w UNION ALL SELECT 2, 4e0 UNION ALL SELECT 3, 8e0) l GROUP BY video_id, level, {d.floor('pos / w')}"""


def coverage_anchors(d) -> str:
    """MEM-09, WIN-14: the best frame of each logarithmic bucket is an anchor, and is not evicted."""
    return f"""SELECT video_id, bucket, frame_id, round(value, 4) AS value FROM (
      SELECT *, {d.rn('PARTITION BY video_id, bucket ORDER BY value DESC, timestamp_s, frame_id')} AS rn FROM (SELECT *, {d.floor('ln(1e0 + timestamp_s / 3600e0) / ln(2e0) + 1e-12')} AS bucket FROM {d.frames}) f) r WHERE rn = 1"""


def eviction_victims(d) -> str:
    """TOP-05, TOP-31, MEM-13: the frame with the least utility of each video, ties by time and id."""
    return f"SELECT video_id, frame_id, round(value, 4) AS utility FROM (SELECT *, {d.rn('PARTITION BY video_id ORDER BY value, timestamp_s, frame_id')} AS rn FROM {d.frames}) f WHERE rn = 1"


def fifo_retention(d) -> str:
    """MEM-14, STM-10: the newest frames whose summed sizes fit the budget."""
    return f"""SELECT video_id, frame_id, round(used, 4) AS used FROM (
      SELECT video_id, frame_id, {d.running('value', 'PARTITION BY video_id ORDER BY timestamp_s DESC, frame_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS used FROM {d.frames}) f WHERE used <= 2000e0"""


def first_recent_retention(d) -> str:
    """MEM-14: the first frame stays, and the newest of the rest within the budget."""
    return f"""WITH n AS (SELECT *, {d.rn('PARTITION BY video_id ORDER BY timestamp_s, frame_id')} AS rn FROM {d.frames}),
    f AS (SELECT video_id, value AS v0 FROM n WHERE rn = 1),
    u AS (SELECT n.video_id, n.frame_id, {d.running('n.value', 'PARTITION BY n.video_id ORDER BY n.timestamp_s DESC, n.frame_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', 'f.v0')} AS used FROM n JOIN f ON f.video_id = n.video_id WHERE n.rn > 1)
    SELECT video_id, frame_id FROM u WHERE used <= 2000e0 UNION ALL SELECT video_id, frame_id FROM n WHERE rn = 1"""


def limit_then_shard(d) -> str:
    """PRJ-22: the first rows in order, dealt to shards by position."""
    return f"SELECT query_id, CAST((rn - 1) % 4 AS BIGINT) AS shard FROM (SELECT query_id, {d.rn('ORDER BY query_id')} AS rn FROM (SELECT query_id FROM {d.truth} ORDER BY query_id LIMIT 1000) f) t"


def hash_shards(d) -> str:
    """HSH-02: shards by the leading bits of SHA-256."""
    return f"SELECT doc_id, {d.hash_int('CAST(doc_id AS VARCHAR(20))')} % 16 AS shard FROM {d.documents}"


def hash_folds(d) -> str:
    """HSH-03, SET-09: groups in hash order, dealt to five folds; each group lies in one."""
    return f"""WITH g AS (SELECT DISTINCT source FROM {d.documents}), o AS (SELECT source, {d.rn(f"ORDER BY {d.sha("'17:' || source")}")} - 1 AS i FROM g)
    SELECT o.source, CAST(i % 5 AS BIGINT) AS fold, count(*) AS n FROM o JOIN {d.documents} t ON t.source = o.source GROUP BY o.source, i"""


def hash_split(d) -> str:
    """HSH-04: the first four fifths of the groups in hash order train, the others validate."""
    key = d.sha("'3:' || CAST(s.video_id AS VARCHAR(20))")
    rows = f"(SELECT DISTINCT video_id FROM {d.frames})"
    mark = d.sha("'3:' || CAST(r.video_id AS VARCHAR(20))")
    return f"""WITH {d.numbered("o", rows, f"substr({key}, 1, 3)", mark)}
    SELECT video_id, CASE WHEN i <= round(n * 8e-1) THEN 'train' ELSE 'validation' END AS part FROM o"""


def stratified_hash_sample(d) -> str:
    """TOP-30: per stratum, whole groups in hash order until enough members are taken."""
    return f"""WITH g AS (SELECT lang, source, count(*) AS n FROM {d.documents} GROUP BY lang, source),
    o AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY {d.sha("'5:' || source")} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM g)
    SELECT lang, source, n FROM o WHERE before < 50"""


def pareto_skyline(d) -> str:
    """TOP-24..26: methods that no other beats or equals in quality, cost and size with one of them better."""
    return f"""WITH m AS (SELECT method, budget, round(avg({d.iou('gt_start', 'gt_end', 'pred_start', 'pred_end')}), 9) AS miou, round(avg(latency), 9) AS latency, round(avg(pred_end - pred_start), 9) AS width FROM {d.evals} GROUP BY method, budget)
    SELECT method, budget, round(miou, 6) AS miou, round(latency, 6) AS latency, round(width, 6) AS width FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.miou >= a.miou AND b.latency <= a.latency AND b.width <= a.width AND (b.miou > a.miou OR b.latency < a.latency OR b.width < a.width))"""


def best_config_per_budget(d) -> str:
    """TOP-27: the two best methods of each budget by mean overlap, ties by name."""
    return f"""WITH m AS (SELECT method, budget, round(avg({d.iou('gt_start', 'gt_end', 'pred_start', 'pred_end')}), 6) AS miou FROM {d.evals} GROUP BY method, budget)
    SELECT budget, method, miou, rn AS place FROM (SELECT *, {d.rn('PARTITION BY budget ORDER BY miou DESC, method')} AS rn FROM m) r WHERE rn <= 2"""


def margin_winner(d) -> str:
    """TOP-28: of the methods above a floor, the best by several keys."""
    return f"""WITH m AS (SELECT method, budget, round(avg({d.iou('gt_start', 'gt_end', 'pred_start', 'pred_end')}), 6) AS miou, round(avg(latency), 6) AS latency, count(*) AS n FROM {d.evals} GROUP BY method, budget)
    SELECT budget, method, miou FROM (SELECT *, {d.rn('PARTITION BY budget ORDER BY miou DESC, latency, n DESC, method')} AS rn FROM m WHERE miou > 1e-2) r WHERE rn = 1"""


def duration_pick(d) -> str:
    """TOP-29, WIN-13: the two longest videos of each length class."""
    return f"""WITH v AS (SELECT video_id, max(duration_s) AS duration_s FROM {d.frames} GROUP BY video_id),
    b AS (SELECT *, CASE WHEN duration_s < 28e0 * {DAY} THEN 'short' WHEN duration_s < 29e0 * {DAY} THEN 'medium' ELSE 'long' END AS bin FROM v)
    SELECT bin, video_id, round(duration_s, 6) AS duration_s FROM (SELECT *, {d.rn('PARTITION BY bin ORDER BY duration_s DESC, video_id')} AS rn FROM b) r WHERE rn <= 2"""


PLANS = {f.__name__: f for f in (uniform_slots, uniform_slots_asof, slot_resize, hash_reservoir, frame_topk, frame_candidates, coarse_prediction, candidate_labels, event_gap_sessions, sampling_cells, sliding_ring, endpoint_subset, nearest_frame, temporal_neighbors, stride_levels, coverage_anchors, eviction_victims, fifo_retention, first_recent_retention, limit_then_shard, hash_shards, hash_folds, hash_split, stratified_hash_sample, pareto_skyline, best_config_per_budget, margin_winner, duration_pick)}
