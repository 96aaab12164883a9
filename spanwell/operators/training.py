"""Features, targets, losses and decoding of span heads, and signals of consecutive frames, as relational plans."""

from __future__ import annotations

# Weights of the parts of the temporal loss, and bounds of its quality bins.
LOSS_WEIGHTS = {"quality": "1e0", "gain": "1e0", "left_boundary": "5e-1", "right_boundary": "5e-1", "listwise": "1e0", "abstention": "5e-1", "relative_regret": "2e0"}
BIN_LOW, BIN_HIGH = "3e-1", "7e-1"
LIST_TEMPERATURE, ABSTAIN_TEMPERATURE = "1e-1", "5e-2"


def _sigmoid(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def _tanh(x: str) -> str:
    return f"(2e0 / (1e0 + exp(-2e0 * ({x}))) - 1e0)"


def _smooth(x: str, y: str) -> str:
    """Smooth L1: half the square below a difference of one, then straight."""
    return f"(CASE WHEN abs({x} - {y}) < 1e0 THEN 5e-1 * ({x} - {y}) * ({x} - {y}) ELSE abs({x} - {y}) - 5e-1 END)"


def _softplus(x: str) -> str:
    return f"(greatest({x}, 0e0) + ln(1e0 + exp(-abs({x}))))"


def _targets(d) -> str:
    """CTE t: one row a candidate: overlap, gain over the pool's baseline (its first candidate), closeness of both ends."""
    return f"""e AS (SELECT *, {d.rn('PARTITION BY query_id ORDER BY candidate, pred_start, pred_end')} AS i, {d.iou('gt_start', 'gt_end', 'pred_start', 'pred_end')} AS q FROM {d.evals}),
    t AS (SELECT *, q - max(CASE WHEN i = 1 THEN q END) OVER (PARTITION BY query_id) AS gain, exp(-abs(pred_start - gt_start) / greatest(gt_end - gt_start, 1e-6)) AS l, exp(-abs(pred_end - gt_end) / greatest(gt_end - gt_start, 1e-6)) AS r FROM e)"""


def supervision_targets(d) -> str:
    """ML-20, MTH-22, MTH-23: quality, gain and boundary targets of each candidate."""
    return f"WITH {_targets(d)} SELECT query_id, i, round(q, 6) AS quality, round(gain, 6) AS gain, round(l, 6) AS left_target, round(r, 6) AS right_target FROM t"


def _observed(d) -> str:
    """CTE o: one row a pool with the parts of its loss.  Logits are columns: a head's outputs, here of score and latency."""
    soft = f"q / {LIST_TEMPERATURE}"
    return f"""{_targets(d)},
    h AS (SELECT *, 1e1 * score AS sel, 2e1 * score - 1e0 AS ql, 1e1 * latency - 3e-1 AS gl, 5e0 * score AS ll, 5e0 * latency AS rl, CASE WHEN q <= {BIN_LOW} THEN 0 WHEN q <= {BIN_HIGH} THEN 1 ELSE 2 END AS bin FROM t),
    m AS (SELECT *, max(sel) OVER (PARTITION BY query_id) AS top, max({soft}) OVER (PARTITION BY query_id) AS qtop, max(CASE WHEN i = 1 THEN sel END) OVER (PARTITION BY query_id) AS base_sel FROM h),
    n AS (SELECT *, ln(sum(exp(sel - top)) OVER (PARTITION BY query_id)) + top AS lse, sum(exp({soft} - qtop)) OVER (PARTITION BY query_id) AS z FROM m),
    b AS (SELECT query_id, bin, avg({_smooth(_sigmoid('ql'), 'q')}) AS part FROM n GROUP BY query_id, bin), bq AS (SELECT query_id, avg(part) AS quality FROM b GROUP BY query_id),
    p AS (SELECT query_id, min(video_id) AS video_id, count(*) AS pool, avg({_smooth(_tanh('gl'), 'gain')}) AS gain, avg({_smooth(_sigmoid('ll'), 'l')}) AS left_boundary, avg({_smooth(_sigmoid('rl'), 'r')}) AS right_boundary,
      sum(exp({soft} - qtop) / z * (lse - sel)) AS listwise, avg(sel) AS abstain_logit, max(CASE WHEN i = 1 THEN q END) AS base, max(CASE WHEN i > 1 THEN q END) AS successor,
      coalesce(avg(CASE WHEN gain < 0e0 AND i > 1 THEN -gain * {_softplus('sel - base_sel')} END), 0e0) AS relative_regret FROM n GROUP BY query_id),
    o AS (SELECT p.*, bq.quality, {_softplus('abstain_logit')} - abstain_logit * CASE WHEN successor IS NULL THEN 1e0 ELSE {_sigmoid(f'(base - successor) / {ABSTAIN_TEMPERATURE}')} END AS abstention FROM p JOIN bq ON bq.query_id = p.query_id)"""


def pool_losses(d) -> str:
    """ML-07: the parts of the loss of each pool: binned smooth L1, listwise cross entropy, abstention, regret against the baseline."""
    parts = ", ".join(f"round({p}, 6) AS {p}" for p in LOSS_WEIGHTS)
    return f"WITH {_observed(d)} SELECT query_id, pool, {parts} FROM o"


def temporal_loss(d) -> str:
    """ML-07, AGG-12: the parts and their weighted sum over all pools, each video counting the same."""
    parts = ", ".join(f"sum(w * {p}) / sum(w) AS {p}" for p in LOSS_WEIGHTS)
    total = " + ".join(f"{w} * {p}" for p, w in LOSS_WEIGHTS.items())
    shown = ", ".join(f"round({p}, 5) AS {p}" for p in LOSS_WEIGHTS)
    return f"WITH {_observed(d)}, w AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY video_id) AS w FROM o), s AS (SELECT {parts} FROM w) SELECT {shown}, round({total}, 5) AS total FROM s"


def region_tokens(d) -> str:
    """MTH-17, WIN-06: tokens inside each true span: score, place in the span (-1 to 1), place in the video, step of score, step of time."""
    day = "86400e0"
    w = "OVER (PARTITION BY query_id ORDER BY timestamp_s, frame_id)"
    width = "greatest(end_s - start_s, 1e-6)"
    return f"""WITH c AS (SELECT video_id, query_id, start_s, end_s, cell FROM (SELECT video_id, query_id, start_s, end_s, {d.floor(f'start_s / {day}')} AS lo, {d.floor(f'end_s / {day}')} AS hi FROM {d.truth}) t {d.unnest(d.seq('lo', 'hi'), 'cell')}),
    s AS (SELECT *, {d.floor(f'timestamp_s / {day}')} AS cell FROM {d.scored}),
    t AS (SELECT c.query_id, s.frame_id, s.timestamp_s, s.duration_s, s.score, c.start_s, c.end_s FROM c JOIN s ON s.video_id = c.video_id AND s.cell = c.cell AND s.timestamp_s BETWEEN c.start_s AND c.end_s)
    SELECT query_id, frame_id, score, round(greatest(-1e0, least(1e0, 2e0 * (timestamp_s - start_s) / {width} - 1e0)), 6) AS relative, round(timestamp_s / duration_s, 6) AS at, round(score - coalesce(lag(score) {w}, score), 6) AS score_step, round((timestamp_s - coalesce(lag(timestamp_s) {w}, timestamp_s)) / {width}, 6) AS time_step FROM t"""


#: Offsets of the neighbourhood in a token's features, and the weights of the two heads that decode extents (fixed values of this query).
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
LEFT_HEAD = ("9e-1", "4e-1", "-3e-1", "2e-1", "5e-2", "1e-1")
RIGHT_HEAD = ("7e-1", "3e-1", "2e-1", "1e-1", "1e-1", "5e-2")


def _token_features(d) -> str:
    """CTE f: the eight best day cells of a video by (score, centre, cell) with their features; cells are scored by their best frame."""
    near = ", ".join(f"coalesce(max(CASE WHEN n.cell = k.cell + ({o}) THEN n.score END), -1e0) AS o{i}" for i, o in enumerate(OFFSETS))
    return f"""c AS (SELECT video_id, CAST({d.floor('(timestamp_s + 1e-9) / 86400e0')} AS BIGINT) AS cell, max(score) AS score, count(*) AS support, max(duration_s) / 86400e0 AS bound FROM {d.scored} GROUP BY video_id, {d.floor('(timestamp_s + 1e-9) / 86400e0')}),
    k AS (SELECT * FROM (SELECT *, cell + 5e-1 AS centre, {d.rn('PARTITION BY video_id ORDER BY score DESC, cell')} AS rank FROM c) r WHERE rank <= 8),
    f AS (SELECT k.video_id, k.cell, k.rank, k.centre, k.bound, k.score AS f0, 1e0 / k.rank AS f1, k.centre / k.bound AS f2, ln(1e0 + k.support) AS f3, {near} FROM k JOIN c n ON n.video_id = k.video_id AND n.cell BETWEEN k.cell - 4 AND k.cell + 4 GROUP BY k.video_id, k.cell, k.rank, k.centre, k.bound, k.score, k.support)"""


def token_features(d) -> str:
    """MTH-18, TOP-02, WIN-08: score, inverse rank, place, support and the scores of the nine cells around."""
    shown = ", ".join(f"round({c}, 6) AS {c}" for c in [*(f"f{i}" for i in range(4)), *(f"o{i}" for i in range(len(OFFSETS)))])
    return f"WITH {_token_features(d)} SELECT video_id, cell, rank, {shown} FROM f"


def extent_candidates(d) -> str:
    """RET-10, MTH-20: spans decoded from two linear heads: exp less one, half a cell at least, kept within the video."""
    head = lambda w: " + ".join([w[0], *(f"{b} * f{i}" for i, b in enumerate(w[1:5])), f"{w[5]} * o4"])
    reach = lambda w: f"greatest(5e-1, exp(greatest(0e0, {head(w)})) - 1e0)"
    return f"""WITH {_token_features(d)}, x AS (SELECT video_id, cell, rank, bound, f0, greatest(0e0, centre - {reach(LEFT_HEAD)}) AS a, least(bound, centre + {reach(RIGHT_HEAD)}) AS b FROM f),
    y AS (SELECT video_id, cell, rank, f0, CASE WHEN b > a THEN a ELSE cell END AS a, CASE WHEN b > a THEN b ELSE cell + 1e0 END AS b FROM x)
    SELECT video_id, cell, rank, round(a, 6) AS start_d, round(b, 6) AS end_d, {d.rn('PARTITION BY video_id ORDER BY f0 DESC, a, cell')} AS place FROM y"""


def physical_decode(d) -> str:
    """MTH-21: offsets at points decoded in strides or in widths of their support, kept within the video."""
    scale = "CASE WHEN query_id % 2 = 0 THEN end_s - start_s ELSE 3600e0 END"
    centre = "(start_s + end_s) / 2e0"
    return f"SELECT query_id, round(greatest(0e0, {centre} - (query_id % 5) / 2e0 * {scale}), 6) AS start_s, round(least(duration_s, {centre} + (query_id % 3) / 2e0 * {scale}), 6) AS end_s FROM {d.truth}"


def token_accounting(d) -> str:
    """MTH-25, AGG-31: patches of a frame's grid (time, height, width) and the tokens they make in merges of two by two; a grid that does not divide is an error."""
    high, wide = f"(2 * (1 + CAST({d.floor('value / 64e0')} AS BIGINT)) + CASE WHEN frame_id % 97 = 0 THEN 1 ELSE 0 END)", "(2 * (1 + frame_id % 7) + CASE WHEN frame_id % 97 = 0 THEN 1 ELSE 0 END)"
    return f"""WITH g AS (SELECT video_id, {high} * {wide} AS patches FROM {d.frames})
    SELECT video_id, CAST(sum(patches) AS BIGINT) AS patches, CAST(sum(CASE WHEN patches % 4 = 0 THEN {d.floor('patches / 4e0')} ELSE 0 END) AS BIGINT) AS tokens, count(CASE WHEN patches % 4 <> 0 THEN 1 END) AS refused FROM g GROUP BY video_id"""


def token_fit(d) -> str:
    """CTL-14: the most frames, spread evenly, whose tokens stay within the budget of their video: a planned count falls until they do."""
    return f"""WITH g AS (SELECT video_id, 64 + 8 * (frame_id % 9) AS tokens FROM {d.frames}), v AS (SELECT video_id, count(*) AS n, max(tokens) AS widest FROM g GROUP BY video_id)
    SELECT video_id, n, CAST(least(n, greatest(1, {d.floor('4096e0 / widest')})) AS BIGINT) AS fitted, least(n, greatest(1, {d.floor('4096e0 / 128e0')})) * widest <= 4096 AS first_try FROM v"""


#: Pixels of the thumbnails that :func:`frame_signals` compares, and bins of their histograms.
PIXELS = 12
HUE_BINS, OTHER_BINS = 16, 4


def _pixels(d) -> str:
    """CTEs: p, the pixels of each frame with hue, saturation and value (0 to 1); thumbnails here are made of the frame's numbers."""
    channel = lambda a, b: f"CAST((CAST({d.floor('value')} AS BIGINT) * {a} + frame_id % 13 * {b} + k * k * {b} + k * {a}) % 256 AS DOUBLE)"
    return f"""x AS (SELECT video_id, frame_id, timestamp_s, k, {channel(7, 11)} AS r, {channel(5, 3)} AS g, {channel(2, 17)} AS b FROM {d.frames} {d.unnest(d.seq('0', str(PIXELS - 1)), 'k')}),
    y AS (SELECT *, greatest(r, g, b) / 255e0 AS top, least(r, g, b) / 255e0 AS low FROM x),
    p AS (SELECT video_id, frame_id, timestamp_s, k, 299e-3 * r + 587e-3 * g + 114e-3 * b AS grey, top AS v, CASE WHEN top > 1e-12 THEN (top - low) / top ELSE 0e0 END AS s,
      CASE WHEN top - low <= 1e-12 THEN 0e0 WHEN b / 255e0 = top THEN (r - g) / 255e0 / (top - low) + 4e0 WHEN g / 255e0 = top THEN (b - r) / 255e0 / (top - low) + 2e0 ELSE (g - b) / 255e0 / (top - low) + CASE WHEN g < b THEN 6e0 ELSE 0e0 END END / 6e0 AS h FROM y)"""


def frame_signals(d) -> str:
    """WIN-10, MTH-14: Hellinger distance of the colour histograms and loss of structural similarity of each frame to the one before.

    Histograms meet bin by bin, pixels place by place; each frame is joined with its successor once.
    """
    bin_ = lambda c, n: f"least({n - 1}, CAST({d.floor(f'{c} * {n}')} AS BIGINT))"
    return f"""WITH {_pixels(d)}, n AS (SELECT frame_id, lag(frame_id) OVER (PARTITION BY video_id ORDER BY timestamp_s, frame_id) AS before FROM {d.frames}),
    c AS (SELECT frame_id, {bin_('h', HUE_BINS)} * 16 + {bin_('s', OTHER_BINS)} * 4 + {bin_('v', OTHER_BINS)} AS bin, count(*) / {PIXELS}e0 AS share FROM p GROUP BY frame_id, {bin_('h', HUE_BINS)} * 16 + {bin_('s', OTHER_BINS)} * 4 + {bin_('v', OTHER_BINS)}),
    b AS (SELECT {d.sorted_join('a', 'z')}n.frame_id, sum(sqrt(a.share * z.share)) AS coefficient FROM n JOIN c a ON a.frame_id = n.before JOIN c z ON z.frame_id = n.frame_id AND z.bin = a.bin GROUP BY n.frame_id),
    m AS (SELECT {d.sorted_join('a', 'z')}n.frame_id, avg(a.grey) AS ma, avg(z.grey) AS mz, avg(a.grey * a.grey) AS aa, avg(z.grey * z.grey) AS zz, avg(a.grey * z.grey) AS az FROM n JOIN p a ON a.frame_id = n.before JOIN p z ON z.frame_id = n.frame_id AND z.k = a.k GROUP BY n.frame_id)
    SELECT m.frame_id, round(sqrt(greatest(0e0, 1e0 - least(1e0, coalesce(coefficient, 0e0)))), 5) AS colour, round(greatest(0e0, least(2e0, 1e0 - (2e0 * ma * mz + 65025e-4) * (2e0 * (az - ma * mz) + 585225e-4) / ((ma * ma + mz * mz + 65025e-4) * ((aa - ma * ma) + (zz - mz * mz) + 585225e-4)))), 5) AS structure FROM m LEFT JOIN b ON b.frame_id = m.frame_id"""


def readout_latency(d) -> str:
    """AGG-49: readout latencies of each method in milliseconds: count, median and 95th percentile, and whether that stays within the gate."""
    return f"SELECT method, count(*) AS n, round({d.pct('latency * 1e3', '0.5')}, 6) AS p50_ms, round({d.pct('latency * 1e3', '0.95')}, 6) AS p95_ms, {d.pct('latency * 1e3', '0.95')} <= 25e1 AS passes FROM {d.evals} GROUP BY method"


PLANS = {f.__name__: f for f in (supervision_targets, pool_losses, temporal_loss, region_tokens, token_features, extent_candidates, physical_decode, token_accounting, token_fit, frame_signals, readout_latency)}
