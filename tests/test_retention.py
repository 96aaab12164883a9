"""Budgets of retention hold for the exact sum of the sizes, in whatever order doubles are added."""

from spanwell.operators import selection
from spanwell.plans.dialect import on

COLUMNS = "video_id long, frame_id long, timestamp_s double, duration_s double, value double, kind string"


def frames(spark, *videos):
    """Videos of the given sizes, newest first, numbered down from 100 times the video's number."""
    rows = [(v, 100 * v - i, 1000.0 - i, 1000.0, x, "view") for v, sizes in enumerate(videos, 1) for i, x in enumerate(sizes)]
    return {"frames": spark.createDataFrame(rows, COLUMNS)}


def test_fifo_keeps_what_sums_to_the_budget(spark):
    whole = [398.39, 366.66, 95.47, 252.45, 320.67, 390.66, 175.7]  # 2000, added as doubles 2000.0000000000002
    got = on(spark, selection.fifo_retention, frames(spark, [*whole, 0.01], [2000.0, 1e-7], [1e300, 1.0], [1999.0, float("nan")], [None, 1.5]))
    kept = {(r[0], r[1]): r[2] for r in got.collect()}
    assert [kept[1, 100 - i] for i in range(7)][-1] == 2000.0 and (1, 93) not in kept
    # a little more than the budget, sizes that are no decimals, and none at all
    assert {k: v for k, v in kept.items() if k[0] > 1} == {(2, 200): 2000.0, (4, 400): 1999.0, (5, 499): 1.5}


def test_first_and_recent_keep_what_sums_to_the_budget(spark):
    newest = [205.71, 398.41, 219.73, 126.27, 248.52, 131.4, 214.91, 251.92, 193.03]  # with 10.1 2000, added as doubles 2000.0000000000002
    got = on(spark, selection.first_recent_retention, frames(spark, [*newest, 0.01, 10.1], [1.0, None], [1e300, 1.0], [5.0, 1999.0]))
    kept = {tuple(r) for r in got.collect()}
    assert kept == {*((1, 100 - i) for i in range(9)), (1, 90), (2, 199), (3, 299), (4, 399)}
