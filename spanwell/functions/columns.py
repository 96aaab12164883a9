"""Column functions: intervals (MTH-01/02/15/22, TIM-06), vectors (MTH-03/04/05), text (STR-01..04), hashes (HSH-01/02), confidence (MTH-07/08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 if either is null, empty or reversed."""
    valid = a0.isNotNull() & b0.isNotNull() & (a1 > a0) & (b1 > b0)
    common = overlap(a0, a1, b0, b1)
    return F.when(valid, common / ((a1 - a0) + (b1 - b0) - common)).otherwise(F.lit(0.0))


def expand_span(start: Column, end: Column, margin: Column, bound: Column) -> tuple[Column, Column]:
    """A span widened on both sides, kept within [0, bound]."""
    return F.greatest(F.lit(0.0), start - margin), F.least(bound, end + margin)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; null for a vector of length zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def normalize_query(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def hash_int(text: Column) -> Column:
    """The first 60 bits of SHA-256 as a non-negative long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def hash_shard(text: Column, shards: int) -> Column:
    return F.pmod(hash_int(text), F.lit(shards))


def stable_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def score_confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1.0) / 2.0))


def quantize_int8(a: Column) -> Column:
    """(codes, scale) of symmetric 8-bit quantisation with half-even rounding (MTH-06)."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127.0
    safe = F.when(scale > 0, scale).otherwise(F.lit(1.0))
    return F.struct(F.transform(a, lambda x: F.bround(x.cast("double") / safe).cast("int")).alias("codes"), safe.alias("scale"))


def coverage_bucket(mid: Column, base: float) -> Column:
    """Logarithmic coverage bucket (WIN-14)."""
    return F.floor(F.log2(1.0 + mid / F.lit(base))).cast("long")
