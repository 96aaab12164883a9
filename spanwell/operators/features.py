"""Feature operators in the DataFrame API: cell tokens, change features, quantised vectors, ridge regression by normal equations.

Every function names the ids of the inventory that it covers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, norm, quantize_int8

DAY = 86400.0


def _r(x, n: int = 6):
    return F.floor(x * 10.0**n + 0.5) / 10.0**n


def cell_tokens(frames: DataFrame, width: float = DAY) -> DataFrame:
    """AGG-35: the mean vector of each occupied cell: one average a component in one grouping, so only cells are shuffled, not components.

    Vectors are as wide as the first one; shorter ones lack the rest, which their averages skip.
    """
    first = frames.select(F.size("embedding").alias("n")).where("n > 0").first()
    cells = frames.groupBy("video_id", F.floor((F.col("timestamp_s") + 1e-9) / width).alias("cell"))
    parts = [F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(first["n"] if first else 1)]
    means = cells.agg(*parts, F.count(F.lit(1)).alias("n"))
    return means.select("video_id", "cell", F.array(*[F.col(f"m{i}") for i in range(len(parts))]).alias("mean"), "n")


def cell_summary(frames: DataFrame) -> DataFrame:
    return cell_tokens(frames).select("video_id", "cell", "n", _r(norm(F.col("mean"))).alias("length"))


def cell_change(frames: DataFrame) -> DataFrame:
    """WIN-07: distance of each cell's normalised mean to those of the occupied cells before and after.

    Two unit vectors are sqrt(2 - 2 cos) apart, so one product and the lengths do; a mean of length zero has no direction and no distance.
    """
    w = Window.partitionBy("video_id").orderBy("cell")
    t = cell_tokens(frames).select("video_id", "cell", "mean", norm(F.col("mean")).alias("len"))
    near = [F.lag(c).over(w).alias(f"p_{c}") for c in ("mean", "len")] + [F.lead(c).over(w).alias(f"q_{c}") for c in ("mean", "len")]
    t = t.select("video_id", "cell", "mean", "len", *near)
    both = lambda k: F.col("len") * F.col(f"{k}_len")
    far = lambda k: F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(F.col("mean"), F.col(f"{k}_mean")) / F.when(both(k) > 0, both(k))))
    return t.select("video_id", "cell", F.when(both("p") > 0, _r(far("p"), 5)).alias("left_change"), F.when(both("q") > 0, _r(far("q"), 5)).alias("right_change"))


def offset_scores(scored: DataFrame, reach: int = 2) -> DataFrame:
    """WIN-08: best score of the cells around each cell, -1 where none is occupied."""
    cells = scored.groupBy("video_id", F.floor((F.col("timestamp_s") + 1e-9) / DAY).alias("cell")).agg(F.max("score").alias("score"))
    at = cells.withColumn("o", F.explode(F.array(*[F.lit(o) for o in range(-reach, reach + 1)])))
    near = cells.select(F.col("video_id").alias("v"), F.col("cell").alias("c"), F.col("score").alias("s"))
    found = at.join(near, (F.col("v") == F.col("video_id")) & (F.col("c") == F.col("cell") + F.col("o")), "left")
    return found.groupBy("video_id", "cell").agg(*[F.coalesce(F.max(F.when(F.col("o") == o, F.col("s"))), F.lit(-1.0)).alias(f"s_{o + reach}") for o in range(-reach, reach + 1)])


def quantized(embeddings: DataFrame) -> DataFrame:
    """MTH-06: symmetric 8-bit codes and the largest error they make."""
    q = embeddings.select("vec_id", "embedding", quantize_int8(F.col("embedding")).alias("q"))
    worst = F.array_max(F.zip_with("embedding", "q.codes", lambda x, c: F.abs(x.cast("double") - c * F.col("q.scale"))))
    return q.select("vec_id", _r(F.col("q.scale"), 8).alias("scale"), F.aggregate("q.codes", F.lit(0), lambda s, c: s + c).cast("long").alias("code_sum"), (worst <= F.col("q.scale") * 0.5 + 1e-9).alias("within_half"))


def ridge_fit(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0, weight: str | None = None) -> np.ndarray:
    """AGG-41, AGG-42, ML-01: intercept and slopes on standardised features from one pass of sums; only (f + 2)**2 numbers reach the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    sums = rows.agg(*[F.sum(w * a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    k = len(features)
    s = np.zeros((k + 2, k + 2))
    for i in range(k + 2):
        for j in range(i, k + 2):
            s[i, j] = s[j, i] = sums[f"s{i}_{j}"] or 0.0
    n = max(s[0, 0], 1e-12)
    mean = s[0, 1:] / n
    cov = s[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k] / n, 0.0))
    sd[sd < 1e-8] = 1.0
    beta = np.linalg.solve(cov[:k, :k] / np.outer(sd, sd) + alpha * np.eye(k), cov[:k, k] / sd)
    slopes = beta / sd
    return np.concatenate(([mean[k] - slopes @ mean[:k]], slopes))


def ridge_table(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    beta = ridge_fit(rows, features, target, alpha)
    return rows.sparkSession.createDataFrame([(n, float(np.floor(b * 1e6 + 0.5) / 1e6)) for n, b in zip(["intercept", *features], beta, strict=True)], "term string, beta double")


def cross_fit(rows: DataFrame, features: list[str], target: str, fold: str, folds: int) -> DataFrame:
    """ML-08, ML-09: each fold is predicted by coefficients fitted on the others."""
    out = None
    for k in range(folds):
        beta = ridge_fit(rows.where(F.col(fold) != k), features, target)
        part = rows.where(F.col(fold) == k).withColumn("prediction", F.lit(float(beta[0])) + sum((F.col(f) * float(b) for f, b in zip(features, beta[1:], strict=True)), F.lit(0.0)))
        out = part if out is None else out.unionByName(part)
    return out


def cross_fit_errors(rows: DataFrame) -> DataFrame:
    r = rows.select(F.pmod("video_id", F.lit(4)).alias("fold"), "score", (F.col("pred_end") - F.col("pred_start")).alias("width"), "latency")
    return cross_fit(r, ["width", "latency"], "score", "fold", 4).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), _r(F.sqrt(F.avg((F.col("prediction") - F.col("score")) ** 2)), 5).alias("rmse"))
