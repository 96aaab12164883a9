"""Sinks and sources of snapshots, traces and documents (SNK-01..05, 10, 11, 14, 15; SRC-01, 08..11; MEM-16; HSH-06).

A snapshot is one partition of Parquet files with a manifest row of counts and an
order-free content hash; a reader verifies both before it hands out any row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes); independent of row order and partitioning."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    return int(r[0]), int(r[1] or 0)


def write_snapshot(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Files, then the manifest: a snapshot without one was not finished."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/data")
    spark = df.sparkSession
    rows, mark = fingerprint(spark.read.parquet(f"{path}/data"))
    spark.createDataFrame([(rows, str(mark), df.columns)], "rows long, mark string, columns array<string>").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """A verified snapshot; raises where rows, content or columns differ from the manifest or the allow-list (SET-05)."""
    m = spark.read.schema("rows long, mark string, columns array<string>").json(f"{path}/manifest").first()
    df = spark.read.parquet(f"{path}/data")
    if m is None or (m["rows"], m["mark"]) != tuple(map(lambda x: x if isinstance(x, int) and x == m["rows"] else str(x), fingerprint(df))) or sorted(m["columns"]) != sorted(df.columns):
        raise ValueError(f"snapshot {path} differs from its manifest")
    if allowed is not None and set(df.columns) - set(allowed):
        raise ValueError(f"columns that are not allowed: {sorted(set(df.columns) - set(allowed))}")
    return df


def assert_columns(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """PRJ-08..12: ``df`` unless its schema, nested fields included, names a forbidden key; dashes count as underscores."""

    def names(t) -> list[str]:
        if hasattr(t, "fields"):
            return [x for f in t.fields for x in [f.name, *names(f.dataType)]]
        return names(t.elementType) if hasattr(t, "elementType") else names(t.valueType) if hasattr(t, "valueType") else []

    bad = {n.lower().replace("-", "_") for n in names(df.schema)} & {n.lower().replace("-", "_") for n in forbidden}
    if bad:
        raise ValueError(f"forbidden columns: {sorted(bad)}")
    return df


def public_columns(df: DataFrame) -> DataFrame:
    """PRJ-13: without columns that end in ``_internal``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.endswith("_internal")])


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """SRC-01: JSON lines of frames with base64 payloads; malformed lines fail."""
    schema = "video_id string, fps int, timestamp_s double, frame_index long, image_b64 string, width int, height int"
    reader = spark.readStream if stream else spark.read.option("mode", "FAILFAST")
    df = reader.schema(schema).json(path)
    return df.select("video_id", "fps", "timestamp_s", F.col("frame_index").alias("frame_id"), F.unbase64("image_b64").alias("payload"), "width", "height")


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """SNK-14: the row with the highest sequence of each key wins."""
    both = current.unionByName(changes)
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), sequence).alias("r")).select(key, "r.*").select(*both.columns)


def append_trace(trace: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-05, SNK-15: new rows of each video go on from the highest sequence of its trace."""
    top = trace.groupBy("video_id").agg(F.max("sequence").alias("_top"))
    order = Window.partitionBy("video_id").orderBy("t", "kind")
    added = new.withColumn("_n", F.row_number().over(order)).join(top, "video_id", "left")
    added = added.withColumn("sequence", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_top")
    return trace.unionByName(added.select(*trace.columns))


RESOURCE_COLUMNS = ["video_id", "phase", "component", "wall_s", "cpu_s", "cuda_s", "peak_bytes", "cold"]


def write_resources(costs: DataFrame, path: str) -> None:
    """SNK-10: resource records as CSV with a header and eight fixed columns."""
    costs.select(*RESOURCE_COLUMNS).write.mode("errorifexists").csv(path, header=True)


def concatenated(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """SNK-11: the rows of all shards of one schema, malformed ones refused; their order counts for nothing."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def write_plan(plan: DataFrame, path: str, overwrite: bool = False) -> str:
    """SNK-03: an arrival plan in canonical order as JSON lines, and its hash beside it; an existing one stays unless told."""
    mode = "overwrite" if overwrite else "errorifexists"
    lines = plan.select(F.struct("video_id", "query_id", "rho").alias("k"), F.to_json(F.struct(*sorted(plan.columns))).alias("value"))
    lines.orderBy("k").select("value").write.mode(mode).text(f"{path}/plan")
    mark = plan_hash(plan.sparkSession, path)
    plan.sparkSession.createDataFrame([(mark,)], "sha string").coalesce(1).write.mode(mode).json(f"{path}/sha")
    return mark


def plan_hash(spark: SparkSession, path: str) -> str:
    """Hash over the hashes of the lines, which carry their own order."""
    rows = spark.read.text(f"{path}/plan").select(F.sha2("value", 256).alias("h"))
    total = rows.agg(F.count(F.lit(1)), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return f"{total[0]}:{total[1] or 0}"


def read_plan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SNK-04: a plan whose hash is that beside it."""
    stated = spark.read.schema("sha string").json(f"{path}/sha").first()
    if stated is None or stated["sha"] != plan_hash(spark, path):
        raise ValueError(f"plan {path} differs from its hash")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/plan")


#: What an event snapshot may hold: nothing of a query.
EVENT_COLUMNS = ["video_id", "level", "event", "start_s", "end_s", "support", "first_frame", "last_frame"]


def write_events(events: DataFrame, path: str) -> None:
    """SNK-16, SNK-02: a snapshot of events alone, written once."""
    write_snapshot(assert_columns(events, {"query", "query_id", "query_embedding", "gt_span"}).select(*EVENT_COLUMNS), path)


def register(spark: SparkSession, path: str, record: dict[str, str]) -> None:
    """CTL-12: one more row of an experiment registry; an experiment that stands there already raises."""
    row = spark.createDataFrame([(record["experiment"], record)], "experiment string, fields map<string,string>")
    try:
        known = spark.read.schema(row.schema).parquet(path)
        if known.where(F.col("experiment") == record["experiment"]).limit(1).count():
            raise ValueError(f"{record['experiment']} is registered")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    row.coalesce(1).write.mode("append").parquet(path)
