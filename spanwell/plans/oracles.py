"""DuckDB SQL for queries that are not written as shared plans."""

from __future__ import annotations

from ..sources.adapters import ctes
from .dialect import expand_rounds


def _with(names: list[str], body: str, recursive: bool = False) -> str:
    return expand_rounds(f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes(names))}{',' if body.lstrip().startswith('AND ') else ''} {body.replace('AND ', '', 1) if body.lstrip().startswith('AND ') else body}")


_SEQ = "AND seq AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_s, frame_id) AS i FROM frames),"

ORACLE_SQL = {
    "ewma_zscore": _with(
        ["frames"],
        _SEQ
        + """ run AS (
  SELECT video_id, frame_id, i, 0e0::DOUBLE AS z, value AS mean, 0e0::DOUBLE AS var FROM seq WHERE i = 1
  UNION ALL
  SELECT s.video_id, s.frame_id, s.i, CASE WHEN s.i > 5 AND r.var > 0 THEN (s.value - r.mean) / sqrt(r.var) ELSE 0e0 END,
         r.mean + 2e-1 * (s.value - r.mean), 8e-1 * (r.var + 2e-1 * (s.value - r.mean) * (s.value - r.mean))
  FROM run r JOIN seq s ON s.video_id = r.video_id AND s.i = r.i + 1)
SELECT video_id, frame_id, round(z, 6) AS z, round(z, 6) >= 2 AS active FROM run""",
        True,
    ),
    "token_bucket": _with(
        ["frames"],
        _SEQ
        + """ run AS (
  SELECT video_id, frame_id, i, timestamp_s AS t, TRUE AS admitted, least(1e0, 1e0 + timestamp_s / 86400e0 * 2e0) - 1e0 AS tokens, 1::BIGINT AS calls FROM seq WHERE i = 1
  UNION ALL
  SELECT video_id, frame_id, i, t, ok, CASE WHEN ok THEN tok - 1e0 ELSE tok END, calls + CASE WHEN ok THEN 1 ELSE 0 END FROM (
    SELECT *, tok >= 1e0 AND calls < greatest(1, floor(t / 86400e0 * 2e0)::BIGINT + 1) AS ok FROM (
      SELECT s.video_id, s.frame_id, s.i, s.timestamp_s AS t, least(1e0, r.tokens + (s.timestamp_s - r.t) / 86400e0 * 2e0) AS tok, r.calls FROM run r JOIN seq s ON s.video_id = r.video_id AND s.i = r.i + 1)))
SELECT video_id, frame_id, admitted FROM run""",
        True,
    ),
    "due_clock": _with(
        ["frames"],
        _SEQ
        + """ run AS (
  SELECT video_id, frame_id, i, timestamp_s AS last, TRUE AS due FROM seq WHERE i = 1
  UNION ALL
  SELECT s.video_id, s.frame_id, s.i, CASE WHEN s.timestamp_s - r.last >= 43200e0 THEN s.timestamp_s ELSE r.last END, s.timestamp_s - r.last >= 43200e0 FROM run r JOIN seq s ON s.video_id = r.video_id AND s.i = r.i + 1)
SELECT video_id, frame_id FROM run WHERE due""",
        True,
    ),
    "joint_trigger": _with(
        ["frames"],
        _SEQ
        + """ run AS (
  SELECT video_id, frame_id, i, timestamp_s AS last, 'first' AS reason FROM seq WHERE i = 1
  UNION ALL
  SELECT video_id, frame_id, i, CASE WHEN reason IS NULL THEN last ELSE t END, reason FROM (
    SELECT *, CASE WHEN kind = 'error' THEN 'hard_cut' WHEN t - last >= 172800e0 THEN 'max_gap' WHEN t - last < 21600e0 THEN NULL WHEN score >= 7e-1 THEN 'threshold' END AS reason FROM (
      SELECT s.video_id, s.frame_id, s.i, s.kind, s.timestamp_s AS t, r.last, CASE WHEN s.kind = 'view' THEN s.value / 500e0 ELSE (6e-1 * (s.value / 500e0) + 4e-1 * ((s.frame_id % 100) / 100e0)) / (6e-1 + 4e-1) END AS score
      FROM run r JOIN seq s ON s.video_id = r.video_id AND s.i = r.i + 1)))
SELECT video_id, frame_id, reason FROM run WHERE reason IS NOT NULL""",
        True,
    ),
    "temporal_nms": _with(
        ["evals"],
        """AND o AS (SELECT query_id, candidate, pred_start AS a, pred_end AS b, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate, pred_start, pred_end) AS place FROM evals),
run AS (
  SELECT query_id, place, candidate, TRUE AS kept, 0::BIGINT AS suppressor, [{'k': place, 'a': a, 'b': b}] AS held FROM o WHERE place = 1
  UNION ALL
  SELECT query_id, place, candidate, sup = 0 AND len(held) < 5, sup, CASE WHEN sup = 0 AND len(held) < 5 THEN list_append(held, {'k': place, 'a': a, 'b': b}) ELSE held END FROM (
    SELECT o.query_id, o.place, o.candidate, o.a, o.b, r.held,
      coalesce(list_min(list_transform(list_filter(r.held, lambda h: least(o.b, h.b) - greatest(o.a, h.a) > 0 AND (least(o.b, h.b) - greatest(o.a, h.a)) / ((o.b - o.a) + (h.b - h.a) - (least(o.b, h.b) - greatest(o.a, h.a))) >= 0.3::DOUBLE), lambda h: h.k)), 0) AS sup
    FROM run r JOIN o ON o.query_id = r.query_id AND o.place = r.place + 1))
SELECT query_id, place, candidate, kept, suppressor FROM run""",
        True,
    ),
    "cell_tokens": _with(
        ["vector_frames"],
        """AND x AS (SELECT video_id, floor((timestamp_s + 1e-9) / 86400e0)::BIGINT AS cell, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM vector_frames), m AS (SELECT video_id, cell, i, avg(v) AS m, count(*) AS n FROM x GROUP BY ALL)
SELECT video_id, cell, max(n) AS n, round(sqrt(sum(m * m)), 6) AS length FROM m GROUP BY video_id, cell""",
    ),
    "cell_change": _with(
        ["vector_frames"],
        """AND x AS (SELECT video_id, floor((timestamp_s + 1e-9) / 86400e0)::BIGINT AS cell, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM vector_frames), m AS (SELECT video_id, cell, i, avg(v) AS m FROM x GROUP BY ALL),
z AS (SELECT video_id, cell, i, m / sqrt(sum(m * m) OVER (PARTITION BY video_id, cell)) AS u FROM m),
c AS (SELECT video_id, cell, lag(cell) OVER (PARTITION BY video_id ORDER BY cell) AS p, lead(cell) OVER (PARTITION BY video_id ORDER BY cell) AS q FROM (SELECT DISTINCT video_id, cell FROM m)),
l AS (SELECT c.video_id, c.cell, sqrt(sum((a.u - b.u) * (a.u - b.u))) AS d FROM c JOIN z a ON a.video_id = c.video_id AND a.cell = c.cell JOIN z b ON b.video_id = c.video_id AND b.cell = c.p AND b.i = a.i GROUP BY ALL),
r AS (SELECT c.video_id, c.cell, sqrt(sum((a.u - b.u) * (a.u - b.u))) AS d FROM c JOIN z a ON a.video_id = c.video_id AND a.cell = c.cell JOIN z b ON b.video_id = c.video_id AND b.cell = c.q AND b.i = a.i GROUP BY ALL)
SELECT c.video_id, c.cell, round(l.d, 5) AS left_change, round(r.d, 5) AS right_change FROM c LEFT JOIN l ON l.video_id = c.video_id AND l.cell = c.cell LEFT JOIN r ON r.video_id = c.video_id AND r.cell = c.cell""",
    ),
    "offset_scores": _with(
        ["scored"],
        """AND c AS (SELECT video_id, floor((timestamp_s + 1e-9) / 86400e0)::BIGINT AS cell, max(score) AS s FROM scored GROUP BY ALL)
SELECT c.video_id, c.cell, """
        + ", ".join(f"coalesce(max(CASE WHEN n.cell = c.cell + {o} THEN n.s END), -1e0) AS s_{o + 2}" for o in range(-2, 3))
        + " FROM c JOIN c n ON n.video_id = c.video_id AND n.cell BETWEEN c.cell - 2 AND c.cell + 2 GROUP BY c.video_id, c.cell",
    ),
    "quantized_vectors": expand_rounds(
        """SELECT vec_id, round(scale, 8) AS scale, list_sum(codes)::BIGINT AS code_sum, list_max(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - codes[i] * scale))) <= scale * 5e-1 + 1e-9 AS within_half
FROM (SELECT vec_id, e, scale, list_transform(e, lambda x: round_even(x / scale, 0)::INTEGER) AS codes FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127e0 AS scale FROM embeddings))"""
    ),
    "ridge_fit": expand_rounds(
        """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS d1, stddev_pop(l_discount) AS d2, covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem),
k AS (SELECT *, n + 1e0 AS a, n * c12 / (d1 * d2) AS b, n * c1 / d1 AS p, n * c2 / d2 AS q FROM s),
t AS (SELECT *, (a * p - b * q) / (a * a - b * b) / d1 AS b1, (a * q - b * p) / (a * a - b * b) / d2 AS b2 FROM k)
SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 6) AS beta FROM t UNION ALL SELECT 'l_quantity', round(b1, 6) FROM t UNION ALL SELECT 'l_discount', round(b2, 6) FROM t"""
    ),
    "tumbling_watermark": """SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY ALL""",
    "hopping_windows": """SELECT event_type, s // 3600000000 AS hour, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // 3600000000 * 3600000000, epoch_us(ts) // 3600000000 * 3600000000 - 3600000000]) AS s FROM events) GROUP BY ALL""",
    "native_sessions": """SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS f FROM events)) GROUP BY ALL) GROUP BY ALL""",
}

_LAST = "FROM run r JOIN (SELECT video_id, max(i) AS i FROM run GROUP BY video_id) m ON m.video_id = r.video_id AND m.i = r.i"

ORACLE_SQL["adjacent_forest"] = _with(
    ["frames"],
    _SEQ
    + """ run AS (
  SELECT video_id, i, [{'a': timestamp_s, 'b': timestamp_s, 'n': 1::BIGINT, 'd': 0}] AS g FROM seq WHERE i = 1
  UNION ALL
  SELECT video_id, i, CASE WHEN len(g) > 8 THEN list_concat(list_append(g[:pl - 1], {'a': g[pl].a, 'b': g[pl + 1].b, 'n': g[pl].n + g[pl + 1].n, 'd': greatest(g[pl].d, g[pl + 1].d) + 1}), g[pl + 2:]) ELSE g END FROM (
    SELECT *, list_position(w, list_min(w)) AS pl FROM (SELECT *, list_transform(range(1, len(g)), lambda k: g[k + 1].b - g[k].a) AS w FROM (
      SELECT r.video_id, s.i, list_append(r.g, {'a': s.timestamp_s, 'b': s.timestamp_s, 'n': 1::BIGINT, 'd': 0}) AS g FROM run r JOIN seq s ON s.video_id = r.video_id AND s.i = r.i + 1))))
SELECT video_id, (k - 1)::INTEGER AS root, g[k].a AS start_s, g[k].b AS end_s, g[k].n AS leaves, g[k].d AS depth FROM (SELECT r.video_id, r.g, unnest(range(1, len(r.g) + 1)) AS k """
    + _LAST
    + ")",
    True,
)
ORACLE_SQL["near_far_pool"] = _with(
    ["frames"],
    _SEQ
    + """ run AS (
  SELECT video_id, i, [{'a': timestamp_s, 'b': timestamp_s, 'n': 1::BIGINT}] AS near, []::STRUCT(a DOUBLE, b DOUBLE, n BIGINT)[] AS far FROM seq WHERE i = 1
  UNION ALL
  SELECT video_id, i, near, CASE WHEN len(far) > 12 THEN list_concat(list_append(far[:pl - 1], {'a': far[pl].a, 'b': far[pl + 1].b, 'n': far[pl].n + far[pl + 1].n}), far[pl + 2:]) ELSE far END FROM (
    SELECT *, coalesce(list_position(list_transform(w, lambda x: x <= 43200e0), TRUE), list_position(w, list_min(w))) AS pl FROM (SELECT *, list_transform(range(1, len(far)), lambda k: far[k + 1].a - far[k].b) AS w FROM (
      SELECT video_id, i, CASE WHEN len(q) > 8 THEN q[2:] ELSE q END AS near, CASE WHEN len(q) > 8 THEN list_append(far, q[1]) ELSE far END AS far FROM (
        SELECT r.video_id, s.i, list_append(r.near, {'a': s.timestamp_s, 'b': s.timestamp_s, 'n': 1::BIGINT}) AS q, r.far FROM run r JOIN seq s ON s.video_id = r.video_id AND s.i = r.i + 1)))))
SELECT video_id, pool, (k - 1)::INTEGER AS place, x[k].a AS start_s, x[k].b AS end_s, x[k].n AS support FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM (
  SELECT r.video_id, 'near' AS pool, r.near AS x """
    + _LAST
    + " UNION ALL SELECT r.video_id, 'far', r.far "
    + _LAST
    + "))",
    True,
)


def _mmr(k: int = 5) -> str:
    """Picks one after the other: the n-th picks with their vectors, and each frame's likeness to, and nearness in time of, all picked so far."""
    steps = ["f0 AS (SELECT video_id, frame_id, timestamp_s / greatest(duration_s, 1e-9) AS t, embedding::DOUBLE[] AS v, score, 0e0::DOUBLE AS l, 0e0::DOUBLE AS n FROM u)"]
    for i in range(1, k + 1):
        steps.append(f"p{i} AS (SELECT * FROM (SELECT *, score - (5e-1 * l + 2e-1 * n) AS gain, row_number() OVER (PARTITION BY video_id ORDER BY round(score - (5e-1 * l + 2e-1 * n), 9) DESC, frame_id) AS rn FROM f{i - 1}) WHERE rn = 1)")
        first = "greatest(0e0, list_cosine_similarity(f.v, p.v))" if i == 1 else "greatest(f.l, list_cosine_similarity(f.v, p.v))"
        near = "1e0 - abs(f.t - p.t)" if i == 1 else "greatest(f.n, 1e0 - abs(f.t - p.t))"
        steps.append(f"f{i} AS (SELECT f.video_id, f.frame_id, f.t, f.v, f.score, {first} AS l, {near} AS n FROM f{i - 1} f JOIN p{i} p ON p.video_id = f.video_id WHERE f.frame_id <> p.frame_id)")
    rows = " UNION ALL ".join(f"SELECT video_id, {i}::INTEGER AS place, frame_id, round(gain, 6) AS gain FROM p{i}" for i in range(1, k + 1))
    return f"AND u AS (SELECT *, list_cosine_similarity(embedding::DOUBLE[], q_emb::DOUBLE[]) AS score FROM vector_frames), {', '.join(steps)} {rows}"


ORACLE_SQL["mmr_select"] = _with(["vector_frames"], _mmr())
ORACLE_SQL["cross_fit_errors"] = _with(
    ["evals"],
    """AND r AS (SELECT video_id % 4 AS fold, score AS y, pred_end - pred_start AS a, latency AS b FROM evals), k AS (SELECT unnest(range(4)) AS k),
s AS (SELECT k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS da, stddev_pop(b) AS db, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM r JOIN k ON r.fold <> k.k GROUP BY k),
m AS (SELECT *, n + 1e0 AS p, n * ab / (da * db) AS q, n * ay / da AS u, n * yb / db AS v FROM s),
c AS (SELECT *, (p * u - q * v) / (p * p - q * q) / da AS ca, (p * v - q * u) / (p * p - q * q) / db AS cb FROM m)
SELECT r.fold, count(*) AS n, round(sqrt(avg((my + ca * (a - ma) + cb * (b - mb) - y) ** 2)), 5) AS rmse FROM r JOIN c ON c.k = r.fold GROUP BY r.fold""",
)
