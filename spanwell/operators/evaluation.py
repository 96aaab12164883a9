"""Evaluation, cost and gate operators as relational plans."""

from __future__ import annotations

import math


def _rows(d) -> str:
    """Predictions with their overlap; invalid statuses null the span (PRJ-06)."""
    return f"""rows AS (SELECT *, CASE WHEN lower(status) IN ('not_found', 'error', 'invalid') THEN 0e0 ELSE {d.iou('gt_start', 'gt_end', 'pred_start', 'pred_end')} END AS iou,
      lower(status) NOT IN ('not_found', 'error', 'invalid') AS valid FROM {d.evals})"""


_METRICS = """count(*) AS n, count(DISTINCT video_id) AS videos, round(avg(iou) * 100, 6) AS miou, round(avg(CASE WHEN iou >= 3e-1 THEN 1e0 ELSE 0e0 END) * 100, 6) AS r3,
      round(avg(CASE WHEN iou >= 5e-1 THEN 1e0 ELSE 0e0 END) * 100, 6) AS r5, round(avg(CASE WHEN iou >= 7e-1 THEN 1e0 ELSE 0e0 END) * 100, 6) AS r7, count(CASE WHEN valid THEN 1 END) AS valid_n, count(CASE WHEN NOT valid THEN 1 END) AS invalid_n,
      round(avg(CASE WHEN valid THEN abs(pred_start - gt_start) END), 6) AS start_error, round(avg(CASE WHEN valid THEN pred_end - gt_end END), 6) AS end_bias"""


def vtg_metrics(d) -> str:
    """AGG-01: overlap, recalls and endpoint errors over all predictions."""
    return f"WITH {_rows(d)} SELECT {_METRICS} FROM rows"


def vtg_metrics_grouped(d) -> str:
    """AGG-02, AGG-21: the same by method and budget."""
    return f"WITH {_rows(d)} SELECT method, budget, {_METRICS} FROM rows GROUP BY method, budget"


def vtg_empty_groups(d) -> str:
    """AGG-02, AGG-45: every label has a row, empty ones a zero."""
    return f"""WITH {_rows(d)}, labels AS (SELECT '(0,10]' AS bin, 0e0 AS lo, 1e1 AS hi UNION ALL SELECT '(10,60]', 1e1, 6e1 UNION ALL SELECT '(60,120]', 6e1, 12e1 UNION ALL SELECT '(120,)', 12e1, 1e9)
    SELECT bin, count(query_id) AS n, round(coalesce(avg(iou), 0e0), 6) AS miou FROM labels LEFT JOIN rows ON gt_end - gt_start > lo AND gt_end - gt_start <= hi GROUP BY bin"""


def oracle_condition_metrics(d) -> str:
    """AGG-03, AGG-04, AGG-47: metrics by condition and mode."""
    return f"WITH {_rows(d)} SELECT budget, status, count(*) AS n, round(avg(iou), 6) AS miou, round(avg(CASE WHEN valid THEN abs(pred_end - gt_end) END), 6) AS end_error FROM rows GROUP BY budget, status"


def oracle_gate(d) -> str:
    """AGG-05, CTL-05: go, fix or stop by drop and bias."""
    return f"""WITH {_rows(d)}, m AS (SELECT budget, avg(iou) AS miou, avg(pred_end - gt_end) AS bias, min(pred_end - pred_start) AS step FROM rows GROUP BY budget), t AS (SELECT max(miou) AS top FROM m)
    SELECT budget, CASE WHEN top - miou <= 5e-2 AND abs(bias) <= step THEN 'go' WHEN top - miou <= 5e-2 THEN 'fix' ELSE 'stop' END AS decision FROM m CROSS JOIN t"""


def candidate_recall(d) -> str:
    """AGG-06, AGG-07, AGG-10, AGG-11: best overlap among the first 1, 4 and 6 candidates."""
    return f"""WITH {_rows(d)}, ranked AS (SELECT *, {d.rn('PARTITION BY query_id ORDER BY score DESC, candidate, pred_start, pred_end')} AS rk FROM rows),
    best AS (SELECT query_id, method, max(CASE WHEN rk <= 1 THEN iou END) AS b1, max(CASE WHEN rk <= 4 THEN iou END) AS b4, max(CASE WHEN rk <= 6 THEN iou END) AS b6, max(iou) AS oracle FROM ranked GROUP BY query_id, method)
    SELECT method, count(*) AS n, round(avg(CASE WHEN b1 >= 5e-1 THEN 1e0 ELSE 0e0 END), 6) AS r1, round(avg(CASE WHEN b4 >= 5e-1 THEN 1e0 ELSE 0e0 END), 6) AS r4, round(avg(CASE WHEN b6 >= 5e-1 THEN 1e0 ELSE 0e0 END), 6) AS r6, round(avg(oracle), 6) AS oracle FROM best GROUP BY method"""


def candidate_oracle(d) -> str:
    """AGG-11, TOP-04, JOIN-11: the candidate of the highest overlap, ties to the smaller id."""
    return f"WITH {_rows(d)} SELECT query_id, candidate, round(iou, 6) AS iou FROM (SELECT *, {d.rn('PARTITION BY query_id ORDER BY round(iou, 9) DESC, candidate, pred_start')} AS rn FROM rows) r WHERE rn = 1"


def ranked_span_metrics(d) -> str:
    """AGG-08: recall of the first and the first five spans at three thresholds."""
    return f"""WITH {_rows(d)}, ranked AS (SELECT *, {d.rn('PARTITION BY query_id ORDER BY score DESC, candidate, pred_start, pred_end')} AS rk FROM rows),
    best AS (SELECT query_id, budget, max(CASE WHEN rk = 1 THEN iou END) AS one, max(CASE WHEN rk <= 5 THEN iou END) AS five FROM (SELECT r.*, min(budget) OVER (PARTITION BY query_id) AS b FROM ranked r) q GROUP BY query_id, budget)
    SELECT t, count(*) AS n, round(avg(CASE WHEN one >= t THEN 1e2 ELSE 0e0 END), 6) AS r1, round(avg(CASE WHEN five >= t THEN 1e2 ELSE 0e0 END), 6) AS r5 FROM best CROSS JOIN (SELECT 3e-1 AS t UNION ALL SELECT 5e-1 UNION ALL SELECT 7e-1) q GROUP BY t"""


def readout_diagnostics(d) -> str:
    """AGG-09, WIN-16: counts of status and rank, and how many are kept."""
    return f"""SELECT status, candidate AS rank, count(*) AS n, round(avg(CASE WHEN score >= 5e-2 THEN 1e0 ELSE 0e0 END), 6) AS keep_rate FROM {d.evals} GROUP BY status, candidate"""


def arrival_plan(d) -> str:
    """TIM-01, WIN-12, PRJ-01, PRJ-02, PRJ-20, TOP-23: queries at four ratios with eligibility and lag bin."""
    return f"SELECT video_id, query_id, rho, round(t_q, 6) AS t_q, eligible, fixed, lag_bin FROM {d.arrivals}"


def cohort_counts(d) -> str:
    """AGG-34: videos, queries and eligible observations of each ratio."""
    return f"SELECT rho, count(DISTINCT video_id) AS videos, count(*) AS n, count(CASE WHEN eligible THEN 1 END) AS eligible_n, count(CASE WHEN fixed THEN 1 END) AS fixed_n FROM {d.arrivals} GROUP BY rho"


def lag_bins(d) -> str:
    """AGG-02, AGG-22, AGG-23: eligible arrivals by lag bin and cohort."""
    return f"SELECT lag_bin, fixed, count(*) AS n, round(avg(t_q - end_s), 3) AS mean_lag FROM {d.arrivals} WHERE eligible GROUP BY lag_bin, fixed"


def prediction_join(d) -> str:
    """JOIN-01, JOIN-02, JOIN-05: plan and predictions by video and ratio; one prediction serves every eligible arrival."""
    from .selection import _candidates

    a = d.arrivals
    return f"""WITH {_candidates(d)}, best AS (SELECT video_id, start_s, end_s FROM (SELECT *, {d.rn('PARTITION BY video_id ORDER BY score DESC, best_rank, candidate_id')} AS rn FROM span) z WHERE rn = 1)
    SELECT a.video_id, a.query_id, a.rho, round({d.iou('a.start_s', 'a.end_s', 'b.start_s', 'least(b.end_s, a.t_q)')}, 6) AS iou FROM {a} a JOIN best b ON b.video_id = a.video_id WHERE a.eligible"""


def missing_predictions(d) -> str:
    """JOIN-01, JOIN-09, JOIN-26, SET-04: cells of the expected matrix that no prediction fills."""
    return f"""SELECT q.query_id, c.candidate FROM (SELECT DISTINCT query_id FROM {d.evals}) q CROSS JOIN (SELECT DISTINCT candidate FROM {d.evals}) c
    LEFT JOIN {d.evals} e ON e.query_id = q.query_id AND e.candidate = c.candidate WHERE e.query_id IS NULL"""


def _paired(d) -> str:
    return f"{_rows(d)}, paired AS (SELECT video_id, query_id, avg(CASE WHEN candidate % 2 = 0 THEN iou END) - avg(CASE WHEN candidate % 2 = 1 THEN iou END) AS delta FROM rows GROUP BY video_id, query_id HAVING count(DISTINCT candidate % 2) = 2)"


def paired_delta(d) -> str:
    """JOIN-06, JOIN-07, JOIN-08: difference of two methods on the samples that both have."""
    return f"WITH {_paired(d)} SELECT video_id, query_id, round(delta, 6) AS delta FROM paired"


def video_equal_delta(d) -> str:
    """AGG-12: mean over videos of the mean within a video."""
    return f"WITH {_paired(d)}, v AS (SELECT video_id, avg(delta) AS m FROM paired GROUP BY video_id) SELECT count(*) AS videos, round(avg(m), 6) AS delta FROM v"


#: Prime modulus of the bootstrap's hashes, and the share of a Poisson variable of mean 1 at or below 0, 1, 2, ...
_PRIME = 2147483647
_POISSON = tuple(int(_PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))


def bootstrap_weight(video: str, replicate: str) -> tuple[str, str, str]:
    """Three steps (a, x, y) whose last is a number below the prime that video and replicate fix: squares modulo a prime, in whole numbers that fit 63 bits."""
    a = f"(({video} % {_PRIME}) * 48271 + 11) % {_PRIME}"
    x = f"((a + {replicate} * 40692) % {_PRIME})"
    return a, f"({x} * {x} + a) % {_PRIME}", f"((x * x + {replicate} * 69621) % {_PRIME})"


def hash_bootstrap_ci(d, replicates: int = 10_000) -> str:
    """AGG-13..15: percentile interval of resampled video means.

    How often a replicate takes a video is a Poisson draw of mean 1 that a hash of
    both fixes, so one pass over the videos serves all replicates and only sums by
    replicate are shuffled.
    """
    a, x, y = bootstrap_weight("video_id", "r")
    times = " + ".join(f"CASE WHEN z < {t} THEN 0 ELSE 1 END" for t in _POISSON)
    return f"""WITH {_paired(d)}, v AS (SELECT /*+ REPARTITION(64) */ video_id, m, {a} AS a FROM (SELECT video_id, avg(delta) AS m FROM paired GROUP BY video_id) g),
    e AS (SELECT video_id, m, a, CAST(r AS BIGINT) AS r FROM v {d.unnest(d.seq(1, replicates), 'r')}),
    f AS (SELECT r, m, {x} AS x FROM e), h AS (SELECT r, m, {y} AS y FROM f), i AS (SELECT r, m, (y * y + 1013904223) % {_PRIME} AS z FROM h),
    w AS (SELECT r, m, {times} AS k FROM i), means AS (SELECT r, sum(k * m) / nullif(sum(k), 0) AS m FROM w GROUP BY r)
    SELECT count(*) AS n, round({d.pct('m', '0.025')}, 5) AS low, round({d.pct('m', '0.975')}, 5) AS high FROM means"""


def resource_summary(d) -> str:
    """AGG-18, AGG-19: sums, peaks and cold queries of each phase and component."""
    return f"SELECT phase, component, count(*) AS calls, round(sum(wall_s), 3) AS wall_s, round(sum(cpu_s), 3) AS cpu_s, round(sum(cuda_s), 3) AS cuda_s, max(peak_bytes) AS peak_bytes, count(CASE WHEN cold THEN 1 END) AS cold_n FROM {d.costs} GROUP BY phase, component"


def amortized_cost(d) -> str:
    """AGG-18: ingest cost of a video shared by its first 1, 5 and all queries."""
    return f"""WITH ingest AS (SELECT video_id, sum(wall_s) AS wall FROM {d.costs} WHERE phase = 'ingest' GROUP BY video_id),
    q AS (SELECT video_id, query_id, sum(wall_s) AS wall FROM {d.costs} WHERE phase = 'query' GROUP BY video_id, query_id),
    r AS (SELECT q.*, {d.rn('PARTITION BY video_id ORDER BY query_id')} AS rn FROM q)
    SELECT i.video_id, round(max(i.wall) + sum(CASE WHEN rn <= 1 THEN r.wall ELSE 0e0 END), 4) AS at_1, round((max(i.wall) + sum(CASE WHEN rn <= 5 THEN r.wall ELSE 0e0 END)) / least(5, count(*)), 4) AS at_5, round((max(i.wall) + sum(r.wall)) / count(*), 4) AS at_all
    FROM ingest i JOIN r ON r.video_id = i.video_id GROUP BY i.video_id"""


def distinct_resources(d) -> str:
    """AGG-20: records counted once, then summed."""
    return f"SELECT component, count(*) AS n, round(sum(wall_s), 3) AS wall_s FROM (SELECT DISTINCT video_id, component, wall_s FROM {d.costs}) x GROUP BY component"


def percentiles_linear(d) -> str:
    """AGG-16, AGG-32: percentiles by linear interpolation."""
    return f"SELECT component, round({d.pct('wall_s', '0.5')}, 6) AS p50, round({d.pct('wall_s', '0.95')}, 6) AS p95, round(avg(wall_s), 6) AS mean, max(wall_s) AS top FROM {d.costs} GROUP BY component"


def percentiles_disc(d) -> str:
    """AGG-17: percentiles by nearest rank."""
    return f"SELECT component, {d.pct_disc('wall_s', '0.5')} AS p50, {d.pct_disc('wall_s', '0.95')} AS p95 FROM {d.costs} GROUP BY component"


def state_correlation(d) -> str:
    """AGG-33: correlation of state size and duration, and its gate."""
    return f"SELECT round(corr(n, span), 6) AS r, corr(n, span) > 9e-1 AS passes FROM (SELECT CAST(count(*) AS DOUBLE) AS n, max(duration_s) AS span FROM {d.frames} GROUP BY video_id) v"


def feature_scaler(d) -> str:
    """AGG-40: population mean and deviation; a deviation near zero counts as one."""
    return f"SELECT status, round(avg(score), 6) AS mean, round(CASE WHEN stddev_pop(score) < 1e-8 THEN 1e0 ELSE stddev_pop(score) END, 6) AS scale FROM {d.evals} GROUP BY status"


def pool_features(d) -> str:
    """WIN-15, MTH-15, MTH-16, MTH-29: scores within a pool, standardised and against the best and the next, and geometry."""
    p = "PARTITION BY query_id"
    return f"""SELECT query_id, candidate, round(CASE WHEN sd < 1e-8 THEN 0e0 ELSE (score - mean) / sd END, 6) AS z, round(best - score, 6) AS to_best, round(score - coalesce(next_score, 0e0), 6) AS to_next, rk, round((pred_start + pred_end) / 2e0, 6) AS centre, round(pred_end - pred_start, 6) AS width, pool FROM (
      SELECT *, avg(score) OVER ({p}) AS mean, stddev_pop(score) OVER ({p}) AS sd, max(score) OVER ({p}) AS best, lead(score) OVER ({p} ORDER BY score DESC, candidate, pred_start, pred_end) AS next_score, {d.rn(p + ' ORDER BY score DESC, candidate, pred_start, pred_end')} AS rk, count(*) OVER ({p}) AS pool FROM {d.evals}) q"""


def pairwise_iou(d) -> str:
    """JOIN-22: highest and mean overlap of a candidate with the others of its pool."""
    return f"SELECT a.query_id, a.candidate, round(max({d.iou('a.pred_start', 'a.pred_end', 'b.pred_start', 'b.pred_end')}), 6) AS top, round(avg({d.iou('a.pred_start', 'a.pred_end', 'b.pred_start', 'b.pred_end')}), 6) AS mean FROM {d.evals} a JOIN {d.evals} b ON a.query_id = b.query_id AND a.candidate <> b.candidate GROUP BY a.query_id, a.candidate"


def boundary_quality(d) -> str:
    """MTH-22, MTH-23: closeness of the start and end of a prediction, in widths of the truth."""
    return f"SELECT query_id, candidate, round(exp(-abs(pred_start - gt_start) / (gt_end - gt_start)), 6) AS start_q, round(exp(-abs(pred_end - gt_end) / (gt_end - gt_start)), 6) AS end_q FROM {d.evals}"


def confidence_calibration(d) -> str:
    """MTH-07: logistic confidence with a signed feature of the status."""
    return f"SELECT query_id, candidate, round(1e0 / (1e0 + exp(-(4e0 * score - 1e0 + CASE WHEN status = 'ok' THEN 5e-1 ELSE -5e-1 END))), 6) AS confidence FROM {d.evals}"


def selection_with_fallback(d) -> str:
    """RET-12, RET-13, RET-14: the best scored candidate, unless it gains too little over the first, which stays then."""
    return f"""WITH r AS (SELECT query_id, candidate, score, max(score) OVER (PARTITION BY query_id) AS top, {d.rn('PARTITION BY query_id ORDER BY score DESC, candidate, pred_start, pred_end')} AS rk, min(candidate) OVER (PARTITION BY query_id) AS base FROM {d.evals}),
    s AS (SELECT query_id, max(CASE WHEN rk = 1 THEN candidate END) AS best, max(base) AS base, max(top) - max(CASE WHEN candidate = base THEN score END) AS gain FROM r GROUP BY query_id)
    SELECT query_id, CASE WHEN gain > 2e-2 + 1e-12 THEN best ELSE base END AS selected, gain <= 2e-2 + 1e-12 AS fell_back FROM s"""


def gate_checks(d) -> str:
    """AGG-27..30, AGG-43, AGG-44, AGG-46, AGG-50, CTL-04, CTL-06, CTL-07: checks of each budget and their conjunction."""
    return f"""WITH {_rows(d)}, g AS (SELECT budget, avg(iou) AS miou, count(DISTINCT video_id) AS videos, {d.pct('latency', '0.95')} AS p95, avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END) AS usable FROM rows GROUP BY budget)
    SELECT budget, miou >= 2e-2 AS quality, videos >= 12 AS support, p95 <= 9e-2 AS latency, usable >= 5e-1 AS usable, miou >= 2e-2 AND videos >= 12 AND p95 <= 9e-2 AND usable >= 5e-1 AS passes FROM g"""


def matrix_expansion(d) -> str:
    """JOIN-20, CTL-01, PRJ-25, RET-16: every combination of method, budget and ratio with the hash of its job."""
    return f"""WITH m AS (SELECT DISTINCT method FROM {d.evals}), b AS (SELECT DISTINCT budget FROM {d.evals}), r AS (SELECT DISTINCT rho FROM {d.arrivals})
    SELECT method, budget, rho, {d.sha("method || '|' || CAST(budget AS VARCHAR(9)) || '|' || CAST(CAST(rho * 100 AS INTEGER) AS VARCHAR(9))")} AS job FROM m CROSS JOIN b CROSS JOIN r"""


def epoch_choice(d) -> str:
    """AGG-48: the budget with the highest video-equal mean of what is selected at the best score."""
    return f"""WITH {_rows(d)}, s AS (SELECT * FROM (SELECT *, {d.rn('PARTITION BY query_id, budget ORDER BY score DESC, candidate, pred_start, pred_end')} AS rn FROM rows) q WHERE rn = 1), v AS (SELECT budget, video_id, avg(iou) AS m FROM s GROUP BY budget, video_id), e AS (SELECT budget, round(avg(m), 6) AS m FROM v GROUP BY budget)
    SELECT budget, m, {d.rn('ORDER BY m DESC, budget')} AS place FROM e"""


PLANS = {f.__name__: f for f in (vtg_metrics, vtg_metrics_grouped, vtg_empty_groups, oracle_condition_metrics, oracle_gate, candidate_recall, candidate_oracle, ranked_span_metrics, readout_diagnostics, arrival_plan, cohort_counts, lag_bins, prediction_join, missing_predictions, paired_delta, video_equal_delta, hash_bootstrap_ci, resource_summary, amortized_cost, distinct_resources, percentiles_linear, percentiles_disc, state_correlation, feature_scaler, pool_features, pairwise_iou, boundary_quality, confidence_calibration, selection_with_fallback, gate_checks, matrix_expansion, epoch_choice)}
