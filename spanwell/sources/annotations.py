"""Annotation and prediction files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names under which annotation files give one and the same field, in order.
ALIASES = {"video_id": ("video_id", "vid", "video"), "query": ("query", "description", "sentence"), "duration": ("duration", "video_duration"), "span": ("gt_span", "span", "timestamps")}


def _first(df: DataFrame, field: str, kind: str) -> Column:
    have = [F.col(f"`{a}`").cast(kind) for a in ALIASES[field] if a in df.columns]
    if not have:
        raise ValueError(f"annotations have none of {ALIASES[field]}")
    return F.coalesce(*have)


def annotations(rows: DataFrame, strict: bool = True) -> DataFrame:
    """SRC-06, HSH-02: (video_id, query_id, query, start_s, end_s, duration, problem), one row a span.

    Spans may be one pair or a list of pairs, as JSON text.  A query's id hashes
    video, query and span.  With ``strict`` a row with a problem (missing field,
    duration, span outside the video, repeated id) raises when it is read;
    otherwise it is named in ``problem``.
    """
    text = _first(rows, "span", "string")
    # a single pair counts as a list of one
    spans = F.from_json(F.when(text.rlike(r"^\s*\[\s*\["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<array<double>>")
    df = rows.select(_first(rows, "video_id", "string").alias("video_id"), _first(rows, "query", "string").alias("query"), _first(rows, "duration", "double").alias("duration"), F.explode_outer(spans).alias("s"))
    df = df.select("video_id", "query", "duration", F.try_element_at("s", F.lit(1)).alias("start_s"), F.try_element_at("s", F.lit(2)).alias("end_s"))
    df = df.withColumn("query_id", F.sha1(F.concat_ws("|", "video_id", "query", F.col("start_s").cast("string"), F.col("end_s").cast("string"))))
    missing = F.col("video_id").isNull() | F.col("query").isNull() | F.col("start_s").isNull() | F.col("end_s").isNull()
    fits = (F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s")) & (F.col("end_s") <= F.col("duration"))
    repeated = df.groupBy("query_id").count().where("count > 1").select(F.col("query_id").alias("r"))
    df = df.join(repeated, F.col("query_id") == F.col("r"), "left")
    finite = F.col("duration").isNotNull() & ~F.isnan("duration") & (F.col("duration") > 0) & (F.col("duration") < float("inf"))
    problem = F.when(missing, "missing").when(~finite, "duration").when(~F.coalesce(fits, F.lit(False)), "span").when(F.col("r").isNotNull(), "repeated")
    out = df.select("video_id", "query_id", "query", "start_s", "end_s", "duration", problem.alias("problem"))
    if strict:
        out = out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "problem", "video_id")).cast("string")))
    return out


def benchmark_videos(text: DataFrame) -> DataFrame:
    """SRC-07: {video: {duration, spans, queries}} (one JSON object a row, column ``value``) as one row a query: (query_id, video_id, query, start_s, end_s, duration).

    An end within the last, rounded-up second of a video is cut to its duration; other ends beyond it, and lists of different lengths, raise.
    """
    entry = "map<string, struct<duration: double, spans: array<array<double>>, queries: array<string>>>"
    v = text.select(F.explode(F.from_json("value", entry)).alias("video_id", "v"))
    v = v.withColumn("v", F.when(F.size("v.spans") == F.size("v.queries"), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("lists differ: "), F.col("video_id"))).cast("struct<duration: double, spans: array<array<double>>, queries: array<string>>")))
    q = v.select("video_id", F.col("v.duration").alias("duration"), F.posexplode(F.arrays_zip("v.spans", "v.queries")).alias("i", "z"))
    start, end = F.col("z.spans")[0], F.col("z.spans")[1]
    good = (start >= 0) & (start < end) & (end <= F.ceil("duration")) & (F.length(F.trim("z.queries")) > 0)
    query_id = F.concat("video_id", F.lit("__"), F.lpad(F.col("i").cast("string"), 4, "0"))
    return q.select(F.when(good, query_id).otherwise(F.raise_error(F.concat(F.lit("invalid: "), query_id)).cast("string")).alias("query_id"), "video_id", F.col("z.queries").alias("query"), start.alias("start_s"), F.least(end, "duration").alias("end_s"), "duration")


def prediction_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-09: predictions below ``folder``, with the ratio and margin that their file names give and the job folder that holds them."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rho_*.qg_*.json").json(folder).select("*", F.col("_metadata.file_path").alias("file"))
    name = F.element_at(F.split("file", "/"), -1)
    number = lambda key: F.regexp_extract(name, rf"\.{key}_([0-9.]+?)(?=\.[a-z])", 1).cast("double")
    return df.where(F.col("file").contains("/predictions/")).withColumn("rho", number("rho")).withColumn("margin", number("qg")).withColumn("job", F.regexp_extract("file", r"([^/]+)/predictions/", 1)).drop("file")
