"""Validators, list and string operators, lookups and experiment control as relational plans."""

from __future__ import annotations

from .evaluation import _rows
from .selection import _candidates


def span_validity(d) -> str:
    """PRJ-05, PRJ-07, PRJ-26: what is wrong with each prediction: not finite, negative, reversed, empty or beyond the bound."""
    cause = "CASE WHEN isnan(pred_start) OR isnan(pred_end) OR abs(pred_start) > 1e300 OR abs(pred_end) > 1e300 THEN 'not_finite' WHEN pred_start < 0e0 THEN 'negative' WHEN pred_end < pred_start THEN 'reversed' WHEN pred_end = pred_start THEN 'empty' WHEN pred_end > gt_end + 5e0 + 1e-6 THEN 'beyond' ELSE 'ok' END"
    return f"SELECT status, cause, count(*) AS n FROM (SELECT status, {cause} AS cause FROM {d.evals}) x GROUP BY status, cause"


def future_guard(d) -> str:
    """PRJ-03: frames of a video past the time of each arrival; a reader must see none of them."""
    return f"""WITH a AS (SELECT DISTINCT video_id, rho, t_q FROM {d.arrivals})
    SELECT a.video_id, a.rho, count(CASE WHEN f.timestamp_s > a.t_q + 1e-9 THEN 1 END) AS future, count(*) AS frames FROM a JOIN {d.frames} f ON f.video_id = a.video_id GROUP BY a.video_id, a.rho"""


def duration_alias(d) -> str:
    """PRJ-17: one duration from two fields; an error where both are there and differ by more than a millionth."""
    return f"""WITH v AS (SELECT video_id, CASE WHEN video_id % 3 <> 0 THEN max(duration_s) END AS a, CASE WHEN video_id % 3 <> 1 THEN max(duration_s) + CASE WHEN video_id % 5 = 2 THEN 1e-3 ELSE 0e0 END END AS b FROM {d.frames} GROUP BY video_id)
    SELECT video_id, CASE WHEN abs(a - b) > 1e-6 THEN NULL ELSE coalesce(a, b) END AS duration_s, coalesce(abs(a - b) > 1e-6, FALSE) AS conflict FROM v"""


def rho_canonical(d) -> str:
    """PRJ-18: measured ratios matched with the planned ones at eight decimals; the planned value is what counts."""
    return f"""WITH p AS (SELECT DISTINCT rho FROM {d.arrivals}), m AS (SELECT video_id, query_id, rho + CASE WHEN query_id % 3 = 0 THEN 1e-10 WHEN query_id % 3 = 1 THEN 1e-3 ELSE 0e0 END AS measured FROM {d.arrivals})
    SELECT p.rho, count(*) AS n, count(DISTINCT m.video_id) AS videos FROM m JOIN p ON CAST({d.floor('m.measured * 1e8 + 5e-1')} AS BIGINT) = CAST({d.floor('p.rho * 1e8 + 5e-1')} AS BIGINT) GROUP BY p.rho"""


def fixed_samples(d) -> str:
    """PRJ-21: each wanted sample in order, with how many rows match it exactly: one is right, none or more an error."""
    return f"""WITH w AS (SELECT o_orderkey AS query_id, CAST(1 + o_orderkey % 9 AS BIGINT) AS candidate FROM {d.orders})
    SELECT w.query_id, w.candidate, count(e.query_id) AS matches, count(e.query_id) = 1 AS found FROM w LEFT JOIN {d.evals} e ON e.query_id = w.query_id AND e.candidate = w.candidate GROUP BY w.query_id, w.candidate"""


def safe_ids(d) -> str:
    """PRJ-14, PRJ-16: ids that may be file names, and paths that stay inside their root."""
    path = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"
    simple = d.pattern("^[A-Za-z0-9][A-Za-z0-9._-]*$")
    return f"""WITH p AS (SELECT page_id, {path} AS path FROM {d.pages}) SELECT page_id, path, {d.matches('path', simple)} AS simple, path <> '' AND substr(path, 1, 1) <> '/' AND NOT {d.matches('path', d.pattern('(^|/)[.][.](/|$)'))} AS inside FROM p"""


def size_suffix(d) -> str:
    """STR-15: byte sizes written with k or m, read back."""
    text = "CASE event_id % 3 WHEN 0 THEN user_id || 'k' WHEN 1 THEN user_id || 'M' ELSE CAST(user_id AS VARCHAR(20)) END"
    n = "CAST(regexp_extract(s, '^([0-9]+)', 1) AS BIGINT)"
    return f"SELECT event_id, s, {n} * CASE WHEN s LIKE '%k' THEN 1024 WHEN s LIKE '%m' THEN 1048576 ELSE 1 END AS bytes FROM (SELECT event_id, lower({text}) AS s FROM {d.events}) x"


def display_forms(d) -> str:
    """STR-16, STR-13, STR-17: time codes, byte sizes, prediction keys and frame names as they are shown."""
    pad = lambda x, n: f"lpad({d.string(x)}, {n}, '0')"
    seconds = f"CAST({d.floor('timestamp_s')} AS BIGINT)"
    minute = f"CAST({d.floor('timestamp_s / 60e0')} AS BIGINT)"
    kib = f"CAST({d.floor('value / 1024e0 * 1e4 + 5e-1')} AS BIGINT)"
    return f"""SELECT frame_id, CASE WHEN length({d.string(minute)}) < 2 THEN {pad(minute, 2)} ELSE {d.string(minute)} END || ':' || {pad(f'({seconds} % 60)', 2)} AS code, {d.string(kib)} || ' KiB' AS size, {pad('frame_id', 9)} || '.jpg' AS name, video_id || '.rho_' || {d.two_places('25e-2 * (1 + frame_id % 4)')} AS prediction_key FROM {d.frames}"""


def embedding_texts(d) -> str:
    """STR-07, STR-06: what is embedded of a card and of a query, by template."""
    return f"SELECT card_id, 'scene: ' || scene || ' | phase: ' || phase || ' | span: ' || {d.two_places('t_start')} || '-' || {d.two_places('t_end')} AS card_text, 'query: ' || lower(trim(scene)) AS query_text FROM {d.cards}"


def ordered_unique(d) -> str:
    """ARR-01, SET-07: the distinct values of a list in the order of their first place."""
    return f"""WITH u AS (SELECT video_id, kind, min(timestamp_s) AS t FROM {d.frames} GROUP BY video_id, kind)
    SELECT video_id, {d.join_ordered('t', 'kind')} AS kinds, count(*) AS n FROM u GROUP BY video_id"""


def coverage_sample(d) -> str:
    """ARR-02, TOP-13: eight evenly spread members of an ordered list, both ends among them; shorter lists whole."""
    w = "PARTITION BY video_id ORDER BY timestamp_s, frame_id"
    return f"""WITH f AS (SELECT video_id, frame_id, {d.rn(w)} - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM {d.frames}),
    k AS (SELECT video_id, n, k FROM (SELECT DISTINCT video_id, n FROM f) v {d.unnest(d.seq('0', '7'), 'k')})
    SELECT DISTINCT f.video_id, f.i, f.frame_id FROM f JOIN k ON k.video_id = f.video_id AND CASE WHEN f.n <= 8 THEN k.k = f.i ELSE f.i = {d.half_even('k.k * (f.n - 1) / 7e0')} END"""


def zipped_lists(d) -> str:
    """ARR-03, SRC-07: spans and queries of a video as parallel lists, zipped again; an end past the duration counts up to its last second only."""
    lists = f"""l AS (SELECT video_id, max(duration_s) AS duration_s, {d.sorted_list('query_id', 'query_id')} AS ids, {d.sorted_list('query_id', 'start_s')} AS starts, {d.sorted_list('query_id', 'end_s + 4e-1')} AS ends FROM {d.truth} GROUP BY video_id)"""
    at = lambda x: d.at(x, 0).replace("[0]", "[CAST(i AS INT)]").replace("[1]", "[i + 1]")
    return f"""WITH {lists}, z AS (SELECT video_id, duration_s, i, CAST({at('ids')} AS BIGINT) AS query_id, {at('starts')} AS start_s, {at('ends')} AS end_s FROM l {d.unnest(d.seq('0', d.size('ids') + ' - 1'), 'i')})
    SELECT video_id, CAST(i AS BIGINT) AS i, query_id, round(start_s, 6) AS start_s, round(least(end_s, duration_s), 6) AS end_s, end_s <= {d.ceil('duration_s')} AS valid FROM z"""


def padded_batch(d) -> str:
    """ARR-04: the scores of each pool padded to the widest of its batch (128 pools), and the mask of what is real."""
    return f"""WITH p AS (SELECT query_id, {d.floor('query_id / 128e0')} AS batch, {d.sorted_list('candidate', 'candidate')} AS x, count(*) AS n FROM {d.evals} GROUP BY query_id), w AS (SELECT p.*, max(n) OVER (PARTITION BY batch) AS width FROM p)
    SELECT query_id, {d.joined(d.as_text(f"concat(x, {d.repeat_list('CAST(0 AS BIGINT)', 'width - n')})"))} AS padded, {d.joined(d.as_text(f"concat({d.repeat_list('1', 'n')}, {d.repeat_list('0', 'width - n')})"))} AS mask FROM w"""


def point_lookup(d) -> str:
    """SRC-15: frames at increasing targets of each video; a target without a frame is an error."""
    return f"""WITH f AS (SELECT video_id, frame_id, timestamp_s, {d.rn('PARTITION BY video_id ORDER BY timestamp_s, frame_id')} - 1 AS i FROM {d.frames}), t AS (SELECT video_id, k * 16 AS target FROM (SELECT DISTINCT video_id FROM {d.frames}) v {d.unnest(d.seq('0', '5'), 'k')})
    SELECT t.video_id, CAST(t.target AS BIGINT) AS target, f.frame_id, f.frame_id IS NULL AS missing FROM t LEFT JOIN f ON f.video_id = t.video_id AND f.i = t.target"""


def rebased_times(d) -> str:
    """SRC-14, SRC-13: presentation times of a variable-rate stream, counted from its first, in order."""
    return f"SELECT user_id, event_id, {d.micros('ts')} - min({d.micros('ts')}) OVER (PARTITION BY user_id) AS pts, {d.rn('PARTITION BY user_id ORDER BY ts, event_id')} AS seq FROM {d.events}"


def full_load(d) -> str:
    """SRC-20: every eighth frame of a video and the last."""
    w = "PARTITION BY video_id ORDER BY timestamp_s, frame_id"
    return f"SELECT video_id, frame_id FROM (SELECT video_id, frame_id, {d.rn(w)} - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM {d.frames}) f WHERE i % 8 = 0 OR i = n - 1"


def token_loader(d) -> str:
    """SRC-22: all tokens of a video in order of time and reference; a video with more than 64 fails closed."""
    return f"""SELECT video_id, count(*) AS n, count(*) > 64 AS refused, CASE WHEN count(*) <= 64 THEN {d.sha(d.join_ordered('timestamp_s', d.string('frame_id')))} END AS tokens FROM {d.frames} GROUP BY video_id"""


def blob_lookup(d) -> str:
    """JOIN-25, MEM-02: references to blobs with whether the blob is there and its content hashes to its name."""
    ref = "CASE WHEN doc_id % 7 = 0 THEN 'lost' ELSE h END"
    return f"""WITH b AS (SELECT {d.sha('text')} AS h, text FROM {d.documents} GROUP BY {d.sha('text')}, text), r AS (SELECT doc_id, {ref} AS ref FROM (SELECT doc_id, {d.sha('text')} AS h FROM {d.documents}) x)
    SELECT r.doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN {d.sha('b.text')} = r.ref THEN 'ok' ELSE 'corrupt' END AS status FROM r LEFT JOIN b ON b.h = r.ref"""


def snapshot_join(d) -> str:
    """JOIN-04: arrivals with the snapshot of their video at their time (a millionth of a second apart at most), by equal cells of time; a snapshot that holds a later frame is refused."""
    cell = lambda x: f"CAST({d.floor(f'({x}) * 1e6 + 5e-1')} AS BIGINT)"
    return f"""WITH s AS (SELECT DISTINCT video_id, t_q, t_q + CASE WHEN video_id % 4 = 0 THEN 1e0 ELSE 0e0 END AS held FROM {d.arrivals})
    SELECT a.video_id, a.query_id, a.rho, s.held > a.t_q + 1e-9 AS refused FROM {d.arrivals} a JOIN s ON s.video_id = a.video_id AND {cell('s.t_q')} = {cell('a.t_q')}"""


def asset_identity(d) -> str:
    """HSH-05, HSH-06: a source's content hash (of names and hashes in order), against what is registered."""
    h = f"""c AS (SELECT source, count(*) AS files, {d.sha(d.join_ordered('doc_id', "doc_id || ':' || " + d.sha('text')))} AS content FROM {d.documents} GROUP BY source)"""
    return f"""WITH {h}, r AS (SELECT source, files + CASE WHEN length(source) % 2 = 0 THEN 0 ELSE 1 END AS files, content FROM c)
    SELECT c.source, c.content, c.files, r.files = c.files AND r.content = c.content AS identical FROM c JOIN r ON r.source = c.source"""


def observation_checks(d) -> str:
    """SRC-23, SRC-24, CTL-15: observations that are repeated, lack a snapshot, or whose shard does not fit, by cause."""
    return f"""WITH o AS (SELECT query_id, candidate, budget, count(*) OVER (PARTITION BY query_id, candidate) AS copies FROM {d.evals}), s AS (SELECT o_orderkey AS query_id, CAST(o_custkey % 4 AS BIGINT) AS shard FROM {d.orders} WHERE o_orderkey % 11 <> 0)
    SELECT CASE WHEN o.copies > 1 THEN 'repeated' WHEN s.query_id IS NULL THEN 'no_snapshot' WHEN s.shard <> o.budget THEN 'other_shard' ELSE 'ok' END AS cause, count(*) AS n FROM o LEFT JOIN s ON s.query_id = o.query_id GROUP BY 1""".replace("GROUP BY 1", "GROUP BY CASE WHEN o.copies > 1 THEN 'repeated' WHEN s.query_id IS NULL THEN 'no_snapshot' WHEN s.shard <> o.budget THEN 'other_shard' ELSE 'ok' END")


def remaining_jobs(d) -> str:
    """CTL-02, CTL-16, SRC-18: jobs of the matrix without a completed marker, and the marker's state of the others."""
    return f"""WITH j AS (SELECT DISTINCT query_id, budget FROM {d.evals}), m AS (SELECT query_id, budget, min(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS done FROM {d.evals} WHERE candidate <= 3 GROUP BY query_id, budget)
    SELECT j.budget, CASE WHEN m.done = 1 THEN 'completed' WHEN m.done = 0 THEN 'failed' ELSE 'new' END AS state, count(*) AS n FROM j LEFT JOIN m ON m.query_id = j.query_id AND m.budget = j.budget GROUP BY j.budget, CASE WHEN m.done = 1 THEN 'completed' WHEN m.done = 0 THEN 'failed' ELSE 'new' END"""


def data_roles(d) -> str:
    """CTL-11, TOP-30, JOIN-24: roles of videos by a hash; one whose content is excluded gets none, and no content has two roles."""
    h = d.hash_int("'role:' || CAST(video_id AS VARCHAR(20))")
    return f"""WITH v AS (SELECT video_id, {d.sha(d.concat_sorted('kind'))} AS content, count(*) AS n FROM {d.frames} GROUP BY video_id), x AS (SELECT DISTINCT content FROM v WHERE n % 10 = 0)
    SELECT v.video_id, CASE WHEN x.content IS NOT NULL THEN 'excluded' WHEN {h} % 10 < 7 THEN 'train' WHEN {h} % 10 < 9 THEN 'dev' ELSE 'test' END AS role FROM v LEFT JOIN x ON x.content = v.content"""


def golden_compare(d) -> str:
    """CTL-09: expected against found spans by query, equal to a hundredth, and what is missing on either side."""
    e = f"(SELECT query_id, candidate, pred_start AS a, pred_end AS b FROM {d.evals} WHERE candidate % 5 <> 0)"
    f = f"(SELECT query_id, candidate, pred_start + CASE WHEN candidate = 2 THEN 1e0 ELSE 1e-3 END AS a, pred_end AS b FROM {d.evals} WHERE candidate % 7 <> 0)"
    verdict = "CASE WHEN f.query_id IS NULL THEN 'missing' WHEN e.query_id IS NULL THEN 'extra' WHEN abs(e.a - f.a) <= 1e-2 AND abs(e.b - f.b) <= 1e-2 THEN 'equal' ELSE 'different' END"
    return f"SELECT {verdict} AS verdict, count(*) AS n FROM {e} e FULL OUTER JOIN {f} f ON f.query_id = e.query_id AND f.candidate = e.candidate GROUP BY {verdict}"


def staged_selection(d) -> str:
    """TOP-32, TOP-28: configurations that no other dominates (overlap and coverage up, seconds down), and those kept for diagnosis."""
    return f"""WITH {_rows(d)}, c AS (SELECT method || ':' || CAST(budget AS VARCHAR(9)) AS config, round(avg(iou), 9) AS miou, round(avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END), 9) AS coverage, round(avg(latency), 9) AS seconds FROM rows GROUP BY method, budget),
    p AS (SELECT a.config, count(b.config) AS above FROM c a LEFT JOIN c b ON b.config <> a.config AND b.miou >= a.miou AND b.coverage >= a.coverage AND b.seconds <= a.seconds AND (b.miou > a.miou OR b.coverage > a.coverage OR b.seconds < a.seconds) GROUP BY a.config)
    SELECT config, above = 0 AS pareto, config LIKE '1-URGENT%' AS diagnostic FROM p WHERE above = 0 OR config LIKE '1-URGENT%'"""


def grids_by_budget(d) -> str:
    """TOP-34: the configurations of each budget in order."""
    return f"SELECT budget, {d.concat_sorted('method')} AS configs, count(DISTINCT method) AS n FROM {d.evals} GROUP BY budget"


def candidate_union(d) -> str:
    """SET-01, RET-10: a baseline candidate and up to eight others of a video, ids unique: an id that both sides have stays with the baseline."""
    return f"""WITH {_candidates(d)}, b AS (SELECT video_id, candidate_id, start_s, end_s FROM (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, candidate_id')} AS rn FROM span) z WHERE rn = 1),
    x AS (SELECT video_id, candidate_id, start_s, end_s FROM (SELECT *, {d.rn('PARTITION BY video_id ORDER BY end_s - start_s DESC, candidate_id')} AS rn FROM span) z WHERE rn <= 8)
    SELECT video_id, candidate_id, 'baseline' AS origin, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM b UNION ALL SELECT x.video_id, x.candidate_id, 'extent', round(x.start_s, 6), round(x.end_s, 6) FROM x LEFT JOIN b ON b.video_id = x.video_id AND b.candidate_id = x.candidate_id WHERE b.candidate_id IS NULL"""


def candidate_margin(d) -> str:
    """AGG-24: recall of the first five candidates before and after widening, overlap of the coarse span, and boundary hits, by budget."""
    wide = lambda m: ("greatest(0e0, pred_start - {m})".format(m=m), "least(gt_end + 1e1, pred_end + {m})".format(m=m))
    (a, b), (c, e) = wide("2e0"), wide("3e0")
    return f"""WITH r AS (SELECT *, {d.rn('PARTITION BY query_id ORDER BY score DESC, candidate, pred_start, pred_end')} AS rk, {d.iou('gt_start', 'gt_end', 'pred_start', 'pred_end')} AS plain, {d.iou('gt_start', 'gt_end', a, b)} AS wide, {d.iou('gt_start', 'gt_end', c, e)} AS coarse, {a} AS ws, {b} AS we FROM {d.evals}),
    q AS (SELECT query_id, min(budget) AS budget, max(CASE WHEN rk <= 5 AND plain >= 5e-1 THEN 1e0 ELSE 0e0 END) AS base, max(CASE WHEN rk <= 5 AND wide >= 5e-1 THEN 1e0 ELSE 0e0 END) AS cand, max(CASE WHEN rk = 1 THEN coarse END) AS coarse, max(CASE WHEN ws <= gt_start AND gt_start <= we THEN 1e0 ELSE 0e0 END) AS l, max(CASE WHEN ws <= gt_end AND gt_end <= we THEN 1e0 ELSE 0e0 END) AS r FROM r GROUP BY query_id)
    SELECT budget, count(*) AS n, round(avg(base), 6) AS baseline_recall, round(avg(cand), 6) AS recall, round(avg(coarse), 6) AS coarse_miou, round(avg(l), 6) AS left_hits, round(avg(r), 6) AS right_hits FROM q GROUP BY budget"""


def worst_slots(d) -> str:
    """TOP-09: frames of uniform slots in the order of eviction: farthest from the middle of their slot first, ties to the later frame."""
    slot = f"least(7, CAST({d.floor('timestamp_s / duration_s * 8e0')} AS BIGINT))"
    far = "round(abs(timestamp_s - (slot + 5e-1) * duration_s / 8e0), 6)"
    return f"""WITH s AS (SELECT video_id, frame_id, timestamp_s, duration_s, {slot} AS slot FROM {d.frames} WHERE duration_s > 0), k AS (SELECT video_id, frame_id, timestamp_s, slot, {far} AS far FROM s),
    b AS (SELECT * FROM (SELECT *, {d.rn('PARTITION BY video_id, slot ORDER BY far, timestamp_s, frame_id')} AS rn FROM k) r WHERE rn = 1)
    SELECT video_id, frame_id, CAST(slot AS BIGINT) AS slot, {d.rn('PARTITION BY video_id ORDER BY far DESC, timestamp_s DESC, frame_id')} AS evicted FROM b"""


def encode_batches(d) -> str:
    """STM-09: frames in encoding batches of 32, flushed before each snapshot: no batch spans an arrival time."""
    return f"""WITH a AS (SELECT DISTINCT video_id, t_q FROM {d.arrivals}), u AS (SELECT video_id, timestamp_s AS t, frame_id, 0 AS cut FROM {d.frames} UNION ALL SELECT video_id, t_q, NULL, 1 FROM a),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY video_id ORDER BY t, cut ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM u),
    n AS (SELECT video_id, part, {d.rn('PARTITION BY video_id, part ORDER BY t, frame_id')} AS i FROM s WHERE frame_id IS NOT NULL)
    SELECT video_id, CAST(part AS BIGINT) AS snapshot, CAST({d.floor('(i - 1) / 32e0')} AS BIGINT) AS batch, count(*) AS n FROM n GROUP BY video_id, part, {d.floor('(i - 1) / 32e0')}"""


def summary_segments(d) -> str:
    """STM-14, STM-12: fixed segments of three days; memory keeps the first and the seven most recent ones."""
    seg = d.floor("timestamp_s / 259200e0")
    return f"""WITH s AS (SELECT video_id, CAST({seg} AS BIGINT) AS segment, count(*) AS frames, max(timestamp_s) AS last_s FROM {d.frames} GROUP BY video_id, {seg}), r AS (SELECT *, {d.rn('PARTITION BY video_id ORDER BY segment')} AS i, count(*) OVER (PARTITION BY video_id) AS n FROM s)
    SELECT video_id, segment, frames, round(last_s, 6) AS last_s, i = 1 OR i > n - 7 AS kept FROM r"""


def visible_retrieval(d) -> str:
    """RET-19, RET-15, PRJ-03: the three best frames of a video among those that an arrival may see."""
    return f"""WITH a AS (SELECT DISTINCT video_id, rho, t_q FROM {d.arrivals})
    SELECT video_id, rho, frame_id, rank FROM (SELECT a.video_id, a.rho, s.frame_id, {d.rn('PARTITION BY a.video_id, a.rho ORDER BY s.score DESC, s.timestamp_s, s.frame_id')} AS rank FROM a JOIN {d.scored} s ON s.video_id = a.video_id AND s.timestamp_s <= a.t_q + 1e-9) r WHERE rank <= 3"""


def hybrid_query(d) -> str:
    """RET-11: coarse candidates, refinement of the best (here the middle four fifths of its span), and the coarse span where the refined one is too short or its score too low."""
    return f"""WITH {_candidates(d)}, b AS (SELECT * FROM (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, best_rank, candidate_id')} AS rn FROM span) z WHERE rn = 1),
    r AS (SELECT video_id, candidate_id, score, start_s, end_s, start_s + (end_s - start_s) / 1e1 AS fine_start, end_s - (end_s - start_s) / 1e1 AS fine_end FROM b),
    g AS (SELECT *, score >= 2e-1 AND fine_end - fine_start >= 3600e0 AS refined FROM r)
    SELECT video_id, candidate_id, CASE WHEN refined THEN 'ok' ELSE 'fallback' END AS status, round(CASE WHEN refined THEN fine_start ELSE start_s END, 6) AS start_s, round(CASE WHEN refined THEN fine_end ELSE end_s END, 6) AS end_s FROM g"""


def budgeted_refinement(d) -> str:
    """RET-08, RET-03: candidates of a video are refined by rank while calls are left (four), empty ones cost none; the rest stay coarse, and the best of all is the answer."""
    return f"""WITH {_candidates(d)}, r AS (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, best_rank, candidate_id')} AS rk, CASE WHEN end_s - start_s >= 3600e0 THEN 1 ELSE 0 END AS costs FROM span),
    c AS (SELECT *, sum(costs) OVER (PARTITION BY video_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS calls FROM r),
    f AS (SELECT *, costs = 1 AND calls <= 4 AS refined, score + CASE WHEN costs = 1 AND calls <= 4 THEN 1e-1 * (end_s - start_s) / (end_s - start_s + 86400e0) ELSE 0e0 END AS final FROM c)
    SELECT video_id, candidate_id, rk, refined, round(final, 6) AS final, {d.rn('PARTITION BY video_id ORDER BY round(final, 9) DESC, rk')} = 1 AS answer FROM f WHERE rk <= 8"""


PLANS = {f.__name__: f for f in (span_validity, future_guard, duration_alias, rho_canonical, fixed_samples, safe_ids, size_suffix, display_forms, embedding_texts, ordered_unique, coverage_sample, zipped_lists, padded_batch, point_lookup, rebased_times, full_load, token_loader, blob_lookup, snapshot_join, asset_identity, observation_checks, remaining_jobs, data_roles, golden_compare, staged_selection, grids_by_budget, candidate_union, candidate_margin, worst_slots, encode_batches, summary_segments, visible_retrieval, hybrid_query, budgeted_refinement)}
