"""Domain tables from the driver's tables (SRC-01, SRC-06, SRC-07, SRC-13, SRC-14; TIM-01, WIN-12, PRJ-01/02).

``frames``   events as stream elements: seconds since the first event of a user
``scored``   frames with the cosine of their vector and the vector of their video's query
``truth``    spans around purchases: the events before and after
``arrivals`` truth at four arrival ratios
``evals``    order lines as span predictions for the shipping span of their order
``costs``    order lines as resource records
``cards``    truth as evidence cards with vectors
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine

RATIOS = (0.25, 0.5, 0.75, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(start, end):
    """Exact microseconds between two timestamps without a time zone, in seconds."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_id, timestamp_s, duration_s, value, kind)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    w = Window.partitionBy("user_id")
    e = e.withColumn("t0", F.min("ts").over(w)).withColumn("t1", F.max("ts").over(w))
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), _seconds(F.col("t0"), F.col("ts")).alias("timestamp_s"), _seconds(F.col("t0"), F.col("t1")).alias("duration_s"), "value", F.col("event_type").alias("kind")
    )


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` with ``embedding`` and the query vector ``q_emb`` of their video."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    f = frames(spark, sf_dir).crossJoin(F.broadcast(n))  # one row
    f = f.withColumn("fv", F.pmod("frame_id", "n")).withColumn("qv", F.pmod("video_id", "n")).drop("n")
    f = f.join(v.select(F.col("vec_id").alias("fv"), "embedding"), "fv")
    return f.join(v.select(F.col("vec_id").alias("qv"), F.col("embedding").alias("q_emb")), "qv").drop("fv", "qv")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_id, timestamp_s, duration_s, score), the score rounded to 6 places (MTH-04)."""
    f = vector_frames(spark, sf_dir)
    return f.select("video_id", "frame_id", "timestamp_s", "duration_s", (F.floor(cosine(F.col("embedding"), F.col("q_emb")) * 1e6 + 0.5) / 1e6).alias("score"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, query_id, start_s, end_s, duration_s) of purchases that have a neighbour on both sides."""
    w = Window.partitionBy("video_id").orderBy("timestamp_s", "frame_id")
    f = frames(spark, sf_dir).withColumn("start_s", F.lag("timestamp_s").over(w)).withColumn("end_s", F.lead("timestamp_s").over(w))
    f = f.where((F.col("kind") == "purchase") & F.col("start_s").isNotNull() & F.col("end_s").isNotNull())
    return f.select("video_id", F.col("frame_id").alias("query_id"), "start_s", "end_s", "duration_s")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth at each ratio: t_q, eligibility (natural, fixed cohort) and lag bin."""
    t = truth(spark, sf_dir).withColumn("rho", F.explode(F.array(*[F.lit(r) for r in RATIOS])))
    t = t.withColumn("t_q", F.col("rho") * F.col("duration_s"))
    lag = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t_q") - F.col("end_s")) / F.col("duration_s")))
    bin_ = F.when(lag < 0.1, "[0,0.1)").when(lag < 0.25, "[0.1,0.25)").when(lag < 0.5, "[0.25,0.5)").otherwise("[0.5,1)")
    return t.select("video_id", "query_id", "start_s", "end_s", "duration_s", "rho", "t_q", (F.col("end_s") <= F.col("t_q")).alias("eligible"), (F.col("end_s") <= 0.25 * F.col("duration_s")).alias("fixed"), bin_.alias("lag_bin"))


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as predictions: (query_id, video_id, candidate, method, budget, status, gt and pred spans in days, score, latency)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_suppkey")
    day = F.timestamp_diff("MICROSECOND", F.lit("1990-01-01").cast("timestamp_ntz"), F.col("l_shipdate")) / F.lit(86400e6)
    line = line.withColumn("d", day)
    hull = line.groupBy("l_orderkey").agg(F.min("d").alias("gt_start"), (F.max("d") + 1.0).alias("gt_end"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return (
        line.join(hull, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("query_id"),
            F.col("o_custkey").alias("video_id"),
            F.col("l_linenumber").cast("long").alias("candidate"),
            F.col("o_orderpriority").alias("method"),
            F.pmod("l_suppkey", F.lit(4)).cast("long").alias("budget"),
            F.when(F.col("l_returnflag") == "R", "not_found").when(F.col("l_returnflag") == "A", "fallback").otherwise("ok").alias("status"),
            "gt_start",
            "gt_end",
            (F.col("d") - F.col("l_quantity") / 5.0).alias("pred_start"),
            (F.col("d") + F.col("l_quantity") / 5.0).alias("pred_end"),
            F.col("l_discount").alias("score"),
            F.col("l_tax").alias("latency"),
        )
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as resource records (D19): phase and component, seconds, bytes; the first line of an order is a cold query."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("video_id"),
        F.when(F.col("l_linestatus") == "O", "ingest").otherwise("query").alias("phase"),
        F.col("l_returnflag").alias("component"),
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_quantity").alias("wall_s"),
        F.col("l_discount").alias("cpu_s"),
        F.col("l_tax").alias("cuda_s"),
        (F.col("l_linenumber") == 1).alias("cold"),
        F.col("l_extendedprice").alias("peak_bytes"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth as evidence cards, in days: span, uncertainty of its ends, cached boundary hits, support, phase, scene, raw frame, vector."""
    t = truth(spark, sf_dir)
    v = vector_frames(spark, sf_dir).select(F.col("frame_id").alias("card_id"), "embedding", "q_emb")
    k = F.col("query_id")
    rest = lambda n: F.pmod(k, F.lit(n))
    t = t.select(
        "video_id", k.alias("card_id"), (F.col("start_s") / 86400.0).alias("t_start"), (F.col("end_s") / 86400.0).alias("t_end"), (F.col("duration_s") / 86400.0).alias("duration"),
        rest(5).cast("long").alias("supports"), (rest(7) / 10.0).alias("left_u"), (rest(4) / 10.0).alias("right_u"), (rest(2) == 0).alias("left_hit"), (rest(3) == 0).alias("right_hit"),
        F.when(rest(4) == 0, "partial").otherwise("complete").alias("phase"), F.when(rest(3) == 0, "kitchen").when(rest(3) == 1, "street").otherwise("office").alias("scene"), (rest(3) != 1).alias("raw"),
    )
    return t.join(v, "card_id")


#: The same tables in DuckDB, as common table expressions.
SQL = {
    "frames": """frames AS (
  SELECT user_id AS video_id, event_id AS frame_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS timestamp_s,
         (epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS duration_s, value, event_type AS kind FROM events)""",
    "vector_frames": """vector_frames AS (
  SELECT f.*, e.embedding, q.embedding AS q_emb FROM frames f CROSS JOIN (SELECT count(*) AS n FROM embeddings) c
  JOIN embeddings e ON e.vec_id = f.frame_id % c.n JOIN embeddings q ON q.vec_id = f.video_id % c.n)""",
    "scored": """scored AS (
  SELECT video_id, frame_id, timestamp_s, duration_s, round(list_cosine_similarity(embedding::DOUBLE[], q_emb::DOUBLE[]), 6) AS score FROM vector_frames)""",
    "truth": """truth AS (
  SELECT video_id, query_id, start_s, end_s, duration_s FROM (
    SELECT video_id, frame_id AS query_id, kind, duration_s, lag(timestamp_s) OVER w AS start_s, lead(timestamp_s) OVER w AS end_s FROM frames
    WINDOW w AS (PARTITION BY video_id ORDER BY timestamp_s, frame_id)) WHERE kind = 'purchase' AND start_s IS NOT NULL AND end_s IS NOT NULL)""",
    "arrivals": """arrivals AS (
  SELECT *, end_s <= t_q AS eligible, end_s <= 0.25::DOUBLE * duration_s AS fixed,
         CASE WHEN lag < 0.1::DOUBLE THEN '[0,0.1)' WHEN lag < 0.25 THEN '[0.1,0.25)' WHEN lag < 0.5 THEN '[0.25,0.5)' ELSE '[0.5,1)' END AS lag_bin
  FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (t_q - end_s) / duration_s)) AS lag FROM (
    SELECT *, rho * duration_s AS t_q FROM truth CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS rho))))""",
    "evals": """evals AS (
  SELECT l_orderkey AS query_id, o_custkey AS video_id, l_linenumber::BIGINT AS candidate, o_orderpriority AS method, (l_suppkey % 4)::BIGINT AS budget,
         CASE l_returnflag WHEN 'R' THEN 'not_found' WHEN 'A' THEN 'fallback' ELSE 'ok' END AS status,
         min(d) OVER (PARTITION BY l_orderkey) AS gt_start, max(d) OVER (PARTITION BY l_orderkey) + 1.0::DOUBLE AS gt_end,
         d - l_quantity / 5.0::DOUBLE AS pred_start, d + l_quantity / 5.0::DOUBLE AS pred_end, l_discount AS score, l_tax AS latency
  FROM (SELECT *, (epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1990-01-01')) / 86400e6 AS d FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)""",
    "costs": """costs AS (
  SELECT l_suppkey AS video_id, CASE WHEN l_linestatus = 'O' THEN 'ingest' ELSE 'query' END AS phase, l_returnflag AS component, l_orderkey AS query_id, l_linenumber::BIGINT AS seq,
         l_quantity AS wall_s, l_discount AS cpu_s, l_tax AS cuda_s, l_linenumber = 1 AS cold, l_extendedprice AS peak_bytes FROM lineitem)""",
    "cards": """cards AS (
  SELECT t.video_id, t.query_id AS card_id, t.start_s / 86400e0 AS t_start, t.end_s / 86400e0 AS t_end, t.duration_s / 86400e0 AS duration, t.query_id % 5 AS supports, (t.query_id % 7) / 1e1 AS left_u, (t.query_id % 4) / 1e1 AS right_u,
         t.query_id % 2 = 0 AS left_hit, t.query_id % 3 = 0 AS right_hit, CASE WHEN t.query_id % 4 = 0 THEN 'partial' ELSE 'complete' END AS phase, CASE t.query_id % 3 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'street' ELSE 'office' END AS scene, t.query_id % 3 <> 1 AS raw, v.embedding, v.q_emb
  FROM truth t JOIN vector_frames v ON v.frame_id = t.query_id)""",
}
NEEDS = {"cards": ["truth", "vector_frames"], "vector_frames": ["frames"], "scored": ["vector_frames"], "truth": ["frames"], "arrivals": ["truth"]}
BUILD = {"frames": frames, "vector_frames": vector_frames, "scored": scored, "truth": truth, "arrivals": arrivals, "evals": evals, "costs": costs, "cards": cards}


def ctes(names: list[str]) -> list[str]:
    """DuckDB definitions of the named tables and all they need, in order."""
    out: list[str] = []
    for n in names:
        for c in [*ctes(NEEDS.get(n, [])), *([SQL[n]] if n in SQL else [])]:
            if c not in out:
                out.append(c)
    return out
