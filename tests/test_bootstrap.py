"""Bootstrap draws held against brute force, as the oracle shares their text."""

import math

import duckdb
import numpy as np
import pytest

from spanwell.operators import evaluation
from spanwell.plans import catalogue
from spanwell.plans.dialect import RAW, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in RAW:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_bootstrap_draws_ten_thousand(spark, duck):
    rows = duck.sql(oracle(lambda d: f"WITH {evaluation._paired(d)} SELECT video_id, avg(delta) AS m FROM paired GROUP BY video_id ORDER BY video_id")).fetchall()
    video, means = (np.array(x) for x in zip(*rows))
    got = catalogue.QUERIES["hash_bootstrap_ci"](spark, SF).collect()[0]
    assert got["n"] == 10_000
    # the draws, one replicate after the other, in whole numbers of any size
    prime, out = 2147483647, []
    steps = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    for r in range(1, 10_001):
        times = []
        for v in video.tolist():
            a = (v % prime * 48271 + 11) % prime
            x = (((a + r * 40692) % prime) ** 2 + a) % prime
            y = (x * x + r * 69621) % prime
            times.append(sum((y * y + 1013904223) % prime >= int(prime * t) for t in steps))
        out.append(np.dot(times, means) / sum(times))
    low, high = np.percentile(out, [2.5, 97.5])
    assert math.isclose(got["low"], low, abs_tol=2e-5) and math.isclose(got["high"], high, abs_tol=2e-5)
    # and they spread as those of a generator that draws as many videos as there are
    rng = np.random.default_rng(5)
    drawn = means[rng.integers(0, len(means), (10_000, len(means)))].mean(1)
    assert abs(np.std(out) / np.std(drawn) - 1) < 0.05 and abs(np.mean(out) - np.mean(drawn)) < 0.05 * np.std(drawn)
