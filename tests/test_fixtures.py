"""Plans on rows small enough to work out by hand; the values come from the rules, not from the plan texts."""

import math

import pytest
from pyspark.sql import functions as F

from spanwell.operators import cards, checks, evaluation, integrity, training
from spanwell.plans.dialect import on

CARDS = "video_id long, card_id long, t_start double, t_end double, duration double, supports long, left_u double, right_u double, left_hit boolean, right_hit boolean, phase string, scene string, raw boolean, embedding array<double>, q_emb array<double>"


def vec(*head):
    return [float(x) for x in head] + [0.0] * (cards.DIM - len(head))


def deck(spark, rows):
    full = [(1, i, a, b, 20.0, n, lu, ru, lh, rh, phase, scene, raw, vec(*v), vec(1, 0)) for i, a, b, n, lu, ru, lh, rh, phase, scene, raw, v in rows]
    return {"cards": spark.createDataFrame(full, CARDS)}


@pytest.fixture(scope="module")
def three(spark):
    return deck(spark, [
        (1, 0.0, 1.0, 0, 0.0, 1.0, False, True, "complete", "kitchen", True, (1, 0)),
        (2, 2.0, 3.0, 4, 0.0, 0.0, False, False, "complete", "street", False, (0.6, 0.8)),
        (3, 2.5, 6.5, 2, 0.5, 0.5, True, True, "partial", "street", True, (0, 1)),
    ])


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_boundaries_and_merges(spark, three):
    # 1-2: certainty 1 / (1 + 1 + 0), one hit of two, both complete; 2-3: 1 / (1 + 0 + 0.5), one hit, one partial
    first, second = 0.5 * 0.5 + 0.35 * 0.5 + 0.15, 0.5 / 1.5 + 0.35 * 0.5
    got = {r[0]: r[1] for r in rows(on(spark, cards.boundary_importance, three), "lhs", "importance")}
    assert math.isclose(got[1], first, abs_tol=1e-6) and math.isclose(got[2], second, abs_tol=1e-6)
    got = {r[0]: r[1:] for r in rows(on(spark, cards.merge_candidates, three), "lhs", "score", "place")}
    # 1-2: likeness 0.6, gap 1; 2-3: likeness 0.8, they overlap, so no gap
    assert math.isclose(got[1][0], 0.6 - 0.35 * 0.5 - 0.35 * first, abs_tol=1e-6) and got[1][1] == 2
    assert math.isclose(got[2][0], 0.8 - 0.35 * second, abs_tol=1e-6) and got[2][1] == 1


def test_utility(spark, three):
    got = {r[0]: r[1] for r in rows(on(spark, cards.utility_scores, three), "card_id", "utility")}
    assert math.isclose(got[1], 0.3 * 0.4 + 0.3 * (0.5 + 0.5) / 2 + 0.25 + 0.15, abs_tol=1e-6)
    assert math.isclose(got[2], 0.3 * 0.2 + 0.3 * 0.5 + 0.25 / 2, abs_tol=1e-6)
    assert math.isclose(got[3], 0.3 * 0.2 + 0.3 * (0.5 + 1) / 2 + 0.25 / 2 + 0.15, abs_tol=1e-6)
    kept = rows(on(spark, cards.coverage_anchors, three), "bucket", "card_id")
    # middles 0.5, 2.5 and 4.5: buckets 0, 1 and 2
    assert sorted(kept) == [(0, 1), (1, 2), (2, 3)]


def test_parents(spark, three):
    got = {r[0]: r[1:] for r in rows(on(spark, cards.parent_cards, three), "bin", "children", "t_start", "t_end", "centre", "length", "scene")}
    # cards 2 and 3 are pooled with weights 1 * 4 and 4 * 2
    assert got[0][:3] == (1, 0.0, 1.0) and got[0][4:] == (1.0, "kitchen")
    centre, x, y = (4 * 2.5 + 8 * 4.5) / 12, 4 * 0.6 / 12, (4 * 0.8 + 8) / 12
    assert got[1][:3] == (2, 2.0, 6.5) and math.isclose(got[1][3], centre, abs_tol=1e-4) and math.isclose(got[1][4], math.hypot(x, y), abs_tol=1e-5) and got[1][5] == "street"
    lacking = {"cards": three["cards"].withColumn("embedding", F.when(F.col("card_id") == 3, F.lit(None)).otherwise(F.col("embedding")))}
    assert {r[0]: r[1] for r in rows(on(spark, cards.parent_cards, lacking), "bin", "length")} == {0: 1.0, 1: None}


def test_event_candidates(spark):
    flat = lambda i, a, b, v: (i, a, b, 1, 0.0, 0.0, False, False, "complete", "x", True, v)
    got = on(spark, cards.event_candidates, deck(spark, [flat(1, 0.0, 1.0, (0, 1)), flat(2, 1.5, 2.0, (0.8, 0.6)), flat(3, 9.0, 10.0, (1, 0)), flat(4, 19.5, 19.9, (0.6, 0.8))]))
    # gaps of 7 and 9.5 part three groups; every one takes a neighbour on each side
    assert sorted(rows(got, "place", "hits", "t_start", "t_end", "score")) == [(1, 1, 1.4, 20.0, 1.0), (2, 2, 0.0, 10.1, 0.8), (3, 1, 8.9, 20.0, 0.6)]
    best = rows(on(spark, cards.event_locate, deck(spark, [flat(1, 1.0, 2.0, (0.6, 0.8))])), "t_start", "t_end", "confidence", "status")
    assert best == [(0.9, 2.1, 0.8, "fallback")]


def test_overlaps_touch(spark):
    truth = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 2.0, 3.0), (1, 3, 2.5, 2.6), (1, 4, 7.0, 7.0), (2, 5, 0.0, 9.0)], "video_id long, query_id long, start_s double, end_s double")
    assert dict(rows(on(spark, cards.interval_overlap_count, {"truth": truth}), "query_id", "n")) == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0}


def test_forest_roots(spark):
    nation = spark.createDataFrame([(10 + i, 0) for i in range(12)] + [(50, 1)], "n_nationkey int, n_regionkey int")
    # of the cards 0 to 11 those at 0, 3 and 10 are no one's child
    assert sorted(rows(on(spark, integrity.forest_roots, {"nation": nation}), "id")) == [(10,), (13,), (20,), (50,)]


EVALS = "query_id long, video_id long, candidate long, method string, budget long, status string, gt_start double, gt_end double, pred_start double, pred_end double, score double, latency double"


def evals(spark, data):
    return {"evals": spark.createDataFrame([(q, v, c, "m", 0, s, 0.0, 2.0, a, b, score, 0.03) for q, v, c, s, a, b, score in data], EVALS)}


def test_metric_rows(spark):
    # three queries of two videos: a hit, half a hit with fallback, and none found
    data = evals(spark, [(1, 1, 1, "ok", 0.0, 2.0, 0.5), (2, 1, 1, "fallback", 0.0, 1.0, 0.5), (3, 2, 1, "not_found", 0.0, 2.0, 0.5)])
    r = on(spark, evaluation.vtg_metrics, data).first()
    assert (r["miou"], r["videos"], r["invalid_n"], r["end_bias"]) == (50.0, 2, 1, -0.5) and math.isclose(r["r5"], 200 / 3, abs_tol=1e-5) and math.isclose(r["r7"], 100 / 3, abs_tol=1e-5)


def test_losses(spark):
    data = evals(spark, [(1, 1, 1, "ok", 0.0, 1.0, 0.2), (1, 1, 2, "ok", 0.0, 2.0, 0.4), (1, 1, 3, "ok", 3.0, 4.0, 0.6)])
    t = {r["i"]: r for r in on(spark, training.supervision_targets, data).collect()}
    assert [(t[i]["quality"], t[i]["gain"]) for i in (1, 2, 3)] == [(0.5, 0.0), (1.0, 0.5), (0.0, -0.5)]
    assert math.isclose(t[3]["left_target"], math.exp(-1.5), abs_tol=1e-6) and math.isclose(t[1]["right_target"], math.exp(-0.5), abs_tol=1e-6)
    r = on(spark, training.pool_losses, data).first()
    sig = lambda x: 1 / (1 + math.exp(-x))
    q, sel, ql = [0.5, 1.0, 0.0], [2.0, 4.0, 6.0], [3.0, 7.0, 11.0]
    # every candidate is alone in its bin
    assert math.isclose(r["quality"], sum(0.5 * (sig(a) - b) ** 2 for a, b in zip(ql, q)) / 3, abs_tol=1e-6)
    target = [math.exp(x / 0.1) for x in q]
    lse = math.log(sum(map(math.exp, sel)))
    assert math.isclose(r["listwise"], sum(a / sum(target) * (lse - s) for a, s in zip(target, sel)), abs_tol=1e-6)
    # the third candidate loses half against the baseline
    assert math.isclose(r["relative_regret"], 0.5 * math.log(1 + math.exp(6.0 - 2.0)), abs_tol=1e-6)
    want = sig((0.5 - 1.0) / 0.05)
    assert math.isclose(r["abstention"], math.log(1 + math.exp(4.0)) - 4.0 * want, abs_tol=1e-6)
    assert math.isclose(r["gain"], sum(0.5 * (math.tanh(0.0) - g) ** 2 for g in (0.0, 0.5, -0.5)) / 3, abs_tol=1e-6)


def test_spans_and_margins(spark):
    bad = evals(spark, [(1, 1, 1, "ok", -1.0, 1.0, 0.1), (1, 1, 2, "ok", 2.0, 1.0, 0.1), (1, 1, 3, "ok", 1.0, 1.0, 0.1), (1, 1, 4, "ok", 0.0, 7.1, 0.1), (1, 1, 5, "ok", 0.0, 7.0, 0.1), (1, 1, 6, "ok", math.nan, 7.0, 0.1)])
    assert dict(rows(on(spark, checks.span_validity, bad), "cause", "n")) == {"negative": 1, "reversed": 1, "empty": 1, "beyond": 1, "ok": 1, "not_finite": 1}
    # a span of [3, 5] against [0, 2] misses; widened by 2 it holds the end of the truth: [1, 7]
    r = on(spark, checks.candidate_margin, evals(spark, [(1, 1, 1, "ok", 3.0, 5.0, 0.9)])).first()
    assert (r["baseline_recall"], r["recall"], r["left_hits"], r["right_hits"]) == (0.0, 0.0, 0.0, 1.0) and math.isclose(r["coarse_miou"], 2 / 8, abs_tol=1e-6)


FRAMES = "video_id long, frame_id long, timestamp_s double, duration_s double, value double, kind string"


def test_samples_and_signals(spark):
    frames = spark.createDataFrame([(1, i, float(i), 19.0, float(i % 4) * 64, "abc"[i % 3]) for i in range(20)] + [(2, 50 + i, float(i), 2.0, 0.0, "z") for i in range(3)], FRAMES)
    tables = {"frames": frames}
    got = sorted(rows(on(spark, checks.coverage_sample, tables), "video_id", "i"))
    # 19 k / 7 rounded half to even: 0, 2.71, 5.43, 8.14, 10.86, 13.57, 16.29, 19
    assert got == [(1, i) for i in (0, 3, 5, 8, 11, 14, 16, 19)] + [(2, 0), (2, 1), (2, 2)]
    assert dict(rows(on(spark, checks.ordered_unique, tables), "video_id", "kinds")) == {1: "a|b|c", 2: "z"}
    assert [r[0] for r in sorted(rows(on(spark, checks.full_load, tables), "frame_id"))] == [0, 8, 16, 19, 50, 52]
    # frames 0 and 52 * 1 have equal numbers: no change; a change of value shows in both signals
    same = spark.createDataFrame([(1, 0, 0.0, 9.0, 5.0, "a"), (1, 13, 1.0, 9.0, 5.0, "a"), (1, 14, 2.0, 9.0, 300.0, "a")], FRAMES)
    s = {r[0]: r[1:] for r in rows(on(spark, training.frame_signals, {"frames": same}), "frame_id", "colour", "structure")}
    assert s[13] == (0.0, 0.0) and s[14][0] > 0.2 and s[14][1] > 0.05 and 0 not in s


def test_token_grid(spark):
    frames = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0, "a"), (1, 2, 1.0, 1.0, 130.0, "a"), (1, 97, 2.0, 1.0, 0.0, "a")], FRAMES)
    # grids 2 x 4, 6 x 6 and 3 x 15; the last does not divide by two
    r = on(spark, training.token_accounting, {"frames": frames}).first()
    assert (r["patches"], r["tokens"], r["refused"]) == (8 + 36 + 45, 2 + 9, 1)
