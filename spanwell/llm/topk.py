"""Exact top-k search by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it.  A cell (the
vectors of one pivot) is sorted by distance and cut into annuli, blocks of
bounded size with known smallest and largest distance and largest norm.  For a
query q with distance d(q, p) to a pivot, every x of an annulus has
|q - x| >= |d(q, p) - d(x, p)|, and as 2 q.x = |q|^2 + |x|^2 - |q - x|^2 the
annulus cannot hold a score above (|q|^2 + M^2 - gap^2) / 2.  A first pass reads
the annuli around each query in its own cell and gives it a k-th score to beat;
the second expands to every annulus whose bound reaches that score, nearest gaps
first, and stops where the bounds fall below it.  The bound rounds outwards, so
the result is exact.

Pivots come from a bounded sample (``SAMPLE`` vectors, lowest hashes); every row
is indexed.  Vectors that are null or hold null or non-finite components take no
part; of two vectors of different lengths the shorter counts as zero beyond its
end.  Ties go to the smaller id.  Repeated ids are candidates of their own; a
query skips every row with its own id.  Queries of one id and different vectors
are answered apart, equal ones once.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

#: Vectors that pivots are chosen from.
SAMPLE = 4096
#: Rows of an annulus at most, and queries of a block at most.
BLOCK = 2048
QUERIES = 512


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, v): components floor(scale * x), x as double; rows that take no part are left out."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull() & ok & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Means of ``count`` clusters of ``sample``, seeded by its first rows."""
    pivots = np.unique(sample[: 4 * count], axis=0)[:count].astype(float)
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(1)
        total = np.zeros_like(pivots)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(pivots))
        pivots = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], pivots)
    return pivots


def _even(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider has, zeros added."""
    width = max(x.shape[1], y.shape[1])
    return tuple(a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, y))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = _even(x, pivots)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _matrix(v: pd.Series) -> np.ndarray:
    rows = v.to_numpy()
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), max(width, 1)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floats while every sum stays below 2**53, in whole numbers beyond."""
    q, x = _even(q, x)
    most = (np.abs(q).max() if q.size else 0.0) * (np.abs(x).max() if x.size else 0.0) * q.shape[1]
    if most < 2.0**53:
        return q @ x.T
    whole = lambda a: np.array([[int(c) for c in r] for r in a], dtype=object)
    return whole(q).dot(whole(x).T)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 8 * k and score.dtype != object:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= kth)
    else:
        keep = np.arange(len(score))
    order = sorted(keep, key=lambda i: (-score[i], ids[i]))
    return np.array(order[:k], dtype=int)


def _top_rows(keys, qids, q, cand_ids, x, k) -> list[tuple[int, int, int, int]]:
    rows = []
    s = scores(q, x)
    for n, (key, qid) in enumerate(zip(keys, qids, strict=True)):
        other = np.flatnonzero(cand_ids != qid)
        pick = other[best(cand_ids[other], s[n][other], k)] if len(other) else []
        rows += [(int(key), int(qid), int(cand_ids[i]), int(s[n][i])) for i in pick]
    return rows


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id, v) tables of candidates and queries."""
    spark = vectors.sparkSession
    vectors = Stored(vectors, "topk-vectors").df
    found = vectors.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not found:
        return empty
    centres = choose_pivots(_matrix(pd.Series([r["v"] for r in found])), pivots)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _matrix(b["v"])
            if not len(m):
                continue
            d = _distances(m, centres)
            near = d.argmin(1)
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "pivot": near.astype("int32"), "dist": d[np.arange(len(m)), near], "norm2": (m * m).sum(1)})

    schema = "id long, v array<double>, pivot int, dist double, norm2 double"
    index = Stored(vectors.mapInPandas(keyed, schema), "topk-index").df
    # annuli: a cell is cut at quantiles of its distances; ties at one distance are cut again by hash
    cells = index.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000)).alias("cuts"))
    cells = cells.withColumn("rings", F.least(F.lit(64), F.ceil(F.col("n") / BLOCK)).cast("int"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("rings") - 1), lambda i: F.element_at(F.col("cuts"), F.greatest(F.lit(1), F.floor(i * 64 / F.col("rings")).cast("int"))))
    cells = cells.select("pivot", F.when(F.col("rings") > 1, cuts).otherwise(F.expr("cast(array() as array<double>)")).alias("cuts"))
    ringed = index.join(F.broadcast(cells), "pivot")  # one row a pivot
    ringed = ringed.withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
    counts = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    ringed = ringed.join(F.broadcast(counts), ["pivot", "ring"])  # at most 64 rows a pivot
    ringed = ringed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    blocks = Stored(ringed, "topk-blocks").df
    annuli = blocks.groupBy("pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm2").alias("norm2"), F.count(F.lit(1)).alias("n"), (F.max("part") + 1).alias("parts"))
    rings = [tuple(r) for r in annuli.orderBy("pivot", "ring").collect()]  # bounded: 64 a pivot
    ring_pivot, ring_no, low, high, norm2, size, parts = (np.array(x) for x in zip(*rings, strict=True))

    def bounds(m: np.ndarray) -> np.ndarray:
        """Highest score that each annulus can hold for each query, rounded outwards."""
        d = _distances(m, centres)[:, ring_pivot]
        gap = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]) - 1e-6 * (1.0 + d), 0.0)
        square = (m * m).sum(1)[:, None]
        return (square + norm2[None, :] - gap * gap) / 2.0 * (1.0 + 1e-12) + 1e-3

    def first_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _matrix(b["v"])
            if not len(m):
                continue
            top = bounds(m)
            order = np.argsort(-top, axis=1, kind="stable")
            # the annuli with the highest bounds, until k rows besides the query itself are sure
            sure = np.cumsum(size[order], axis=1)
            n = np.minimum((sure < k + 1).sum(1) + 1, len(low))
            for i in range(len(m)):
                go = order[i, : n[i]]
                yield pd.DataFrame({"q": b["q"].iloc[i], "id": b["id"].iloc[i], "v": [m[i]] * len(go), "pivot": ring_pivot[go].astype("int32"), "ring": ring_no[go].astype("int32"), "parts": parts[go].astype("int32")})

    visit = "q long, id long, v array<double>, pivot int, ring int, parts int"

    def dealt(visits: DataFrame) -> DataFrame:
        """Visits by block: each goes to every part of its annulus, and those of one block in groups of ``QUERIES`` on average."""
        v = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        load = v.groupBy("pivot", "ring", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("loads"))
        v = v.join(load, ["pivot", "ring", "part"])
        v = v.withColumn("load", F.pmod(F.xxhash64("q"), F.col("loads")).cast("int")).drop("loads")
        held = blocks.select("id", "v", "pivot", "ring", "part").join(load, ["pivot", "ring", "part"])
        held = held.withColumn("load", F.explode(F.sequence(F.lit(0), F.col("loads") - 1))).drop("loads")
        keys = ["pivot", "ring", "part", "load"]

        def search(_: tuple, qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(xs):
                return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
            rows = _top_rows(qs["q"].to_numpy(), qs["id"].to_numpy(), _matrix(qs["v"]), xs["id"].to_numpy(), _matrix(xs["v"]), k)
            return pd.DataFrame(rows, columns=["q", "query_id", "vec_id", "score"]).astype("int64")

        return v.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "q long, query_id long, vec_id long, score long")

    queries = queries.select("id", "v").distinct().withColumn("q", F.xxhash64("id", "v"))
    first = Stored(queries.mapInPandas(first_visits, visit), "topk-first").df
    near = Stored(dealt(first), "topk-near").df
    beat = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("s")).select("q", F.try_element_at("s", F.lit(1)).alias("beat"))
    seen = first.groupBy("q").agg(F.collect_set(F.struct("pivot", "ring")).alias("seen"))
    todo = queries.join(beat, "q", "left").join(seen, "q", "left")

    def more_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {(int(p), int(r)): i for i, (p, r) in enumerate(zip(ring_pivot, ring_no, strict=True))}
        for b in batches:
            m = _matrix(b["v"])
            if not len(m):
                continue
            top = bounds(m)
            to_beat = b["beat"].to_numpy(float)
            for i in range(len(m)):
                go = np.ones(len(low), bool) if np.isnan(to_beat[i]) else top[i] >= to_beat[i]
                for s in b["seen"].iloc[i] if b["seen"].iloc[i] is not None else ():
                    go[place[(int(s["pivot"]), int(s["ring"]))]] = False
                go = np.flatnonzero(go)
                if len(go):
                    go = go[np.argsort(-top[i, go], kind="stable")]
                    yield pd.DataFrame({"q": b["q"].iloc[i], "id": b["id"].iloc[i], "v": [m[i]] * len(go), "pivot": ring_pivot[go].astype("int32"), "ring": ring_no[go].astype("int32"), "parts": parts[go].astype("int32")})

    rest = dealt(Stored(todo.mapInPandas(more_visits, visit), "topk-more").df)

    def ranked(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        pick = best(g["vec_id"].to_numpy(), g["score"].to_numpy(), k)
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "rank": np.arange(1, len(pick) + 1, dtype="int32"), "vec_id": g["vec_id"].to_numpy()[pick], "score": g["score"].to_numpy()[pick]})

    # at most k rows a query and annulus part
    return near.unionByName(rest).groupBy("q").applyInPandas(ranked, "query_id long, rank int, vec_id long, score long")
