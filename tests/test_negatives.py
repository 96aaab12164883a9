"""Cross-video negatives held against brute force, as the oracle shares their text."""

import random
from itertools import pairwise

import pytest

from spanwell.operators import integrity
from spanwell.plans.dialect import SparkDialect, expand_rounds


def videos(shape):
    rng = random.Random(5)
    if shape == "block":  # a third of all rows is one video in a row, over several buckets
        return [i % 7 for i in range(9000)] + [99] * 9000 + [i % 5 for i in range(9000)]
    if shape == "wrap":
        return [99] * 6000 + [1, 2, 1] + [99] * 6000
    return [99 if rng.random() < 0.34 else rng.randrange(40) for _ in range(9000)] if shape == "mixed" else [4] * 50


@pytest.mark.parametrize("shape", ["block", "wrap", "mixed", "single"])
def test_every_query_has_a_negative(spark, shape):
    v = videos(shape)
    ids = [3 * i + 1 for i in range(len(v))]
    frame = spark.createDataFrame([(i, x) for i, x in zip(ids, v, strict=True)], "query_id long, video_id long")
    d = SparkDialect()
    got = dict(spark.sql(expand_rounds(integrity.cross_video_negatives(d)), truth=frame).collect())
    starts = [j for j, (a, b) in enumerate(pairwise([v[-1], *v])) if a != b]
    want, nxt = {}, starts[0] if starts else None
    for i in range(len(v) - 1, -1, -1):
        if nxt is not None:
            want[ids[i]] = ids[nxt]
        if i in set(starts[-1:]) or (starts and v[i] != v[i - 1]):
            nxt = i
    assert got == want and len(got) == (0 if shape == "single" else len(v))
