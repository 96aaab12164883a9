"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target over
source size.  Its whole part is given outright; the fractions are rounded by the
pivotal method: two documents with fractional copies trade probability mass,
weighed by their sizes, until one of them is integral, so the words that a source
takes stay where they were.  Groups of documents are rounded apart, each leaves
at most one fractional document, and these residuals meet in the next level of a
reduction tree, until one is left for each source; a last draw settles it.  The
words taken from a source so differ from its target by less than one document.

All draws hash the document, so reruns agree and a lost task repeats itself.

Defined results: null text has size 0 and takes nothing; a null source sorts
last and is a source of its own; a null doc_id is an id of its own; repeated rows
are numbered and rounded as documents of their own, in groups of their own; an
empty table gives no rows; further columns are ignored by :func:`mix`, and by
:func:`mixed_documents` kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, content_hash, packed, repeated, scratch, word_count

#: No source takes more than this many times its own size.
MOST_COPIES = 3

#: Documents that one task of the reduction tree rounds together, on average.
FAN_IN = 512


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, the number of each source (from 0) in code point order, nulls last.

    Sources are sorted over all partitions; a partition's numbers start at the
    count of those before it, one number a partition.
    """
    runs = Stored(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("run", F.spark_partition_id()), "mix-sources").df
    before, start = {}, 0
    for r in runs.groupBy("run").count().orderBy("run").collect():
        before[r["run"]], start = start, start + r["count"]
    inside = Window.partitionBy("run").orderBy(F.col("source").asc_nulls_last())
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return runs.withColumn("place", F.element_at(first, F.col("run")) + F.row_number().over(inside) - 1).drop("run")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size and more; one row a source) with its ``target``.

    Sources in code point order, nulls last, weigh ``weights`` in turn and share
    the sum of all sizes.  A target stops at ``most`` times its source's size;
    what is cut is shared anew by weight, until no target is above.  A round is
    one sum over the sources, in whole numbers, so its outcome has no rounding.
    """
    table = F.array(*[F.lit(w) for w in weights])
    s = _ranked(sizes).withColumn("w", F.element_at(table, F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1))
    s = Stored(s.withColumn("cap", F.col("source_size").cast("decimal(38,0)") * most), "mix-ranked").df
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    total, weight = int(whole["size"] or 0), int(whole["w"] or 0)
    cut, held = 0, 0  # what the capped sources take, and their weight
    while True:
        share = F.col("w").cast("decimal(38,0)") * F.lit(total - cut).cast("decimal(38,0)")
        above = share.cast("decimal(38,0)") > (F.col("cap").cast("decimal(38,0)") * F.lit(weight - held).cast("decimal(38,0)")).cast("decimal(38,0)")
        found = s.where(above).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).first()
        now = int(found["cap"] or 0), int(found["w"] or 0)
        if now == (cut, held):
            break
        cut, held = now
    level = (total - cut) / (weight - held) if weight > held else 0.0
    return s.withColumn("target", F.when(above, F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(float(level)))).drop("place", "w", "cap")


def _draw(*parts: object) -> float:
    digest = hashlib.blake2b("|".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def pivot(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions ``p`` pair by pair; returns them and the place of the fraction left, or -1.

    A pair (i, j) keeps size[i] * p[i] + size[j] * p[j]; which of the two ends of
    the trade is taken is drawn so that both expectations hold.
    """
    p = p.copy()
    i = -1
    for j in range(len(p)):
        if size[j] <= 0 or p[j] <= 0.0 or p[j] >= 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]
        up = min((1.0 - p[i]) * a, p[j] * b)  # mass that i can gain from j
        down = min(p[i] * a, (1.0 - p[j]) * b)  # mass that i can give to j
        gain = up if draws[j] * (up + down) < down else -down
        # the one that reaches its end is set to it exactly
        if gain > 0:
            i_ends = (1.0 - p[i]) * a <= p[j] * b
            p[i], p[j] = (1.0, p[j] - gain / b) if i_ends else (p[i] + gain / a, 0.0)
        else:
            i_ends = p[i] * a <= (1.0 - p[j]) * b
            p[i], p[j] = (0.0, p[j] - gain / b) if i_ends else (p[i] + gain / a, 1.0)
        if i_ends:
            i = j
        if not 1e-12 < p[i] < 1.0 - 1e-12:
            p[i] = round(p[i])
            i = -1
    return p, i


def _round_group(seed: int, level: int):
    def run(_: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "size"], kind="stable").reset_index(drop=True)
        draws = np.array([_draw(seed, level, h) for h in g["h"]])
        p, left = pivot(g["size"].to_numpy(float), g["p"].to_numpy(float), draws)
        if left >= 0 and g["groups"][0] <= 1:  # all that is left of a source
            p[left] = 1.0 if _draw(seed, "last", g["h"][left]) < p[left] else 0.0
            left = -1
        g["p"] = p
        g["open"] = np.arange(len(g)) == left
        return g

    return run


def _copies(base: DataFrame, weights: tuple[int, ...], seed: int) -> DataFrame:
    """``base`` (id, source, size, key) with source_size, target and copies, one row a row; equal rows are numbered first."""
    cells = base.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    base = repeated(cells, "n", "i").select("id", "source", "size", "key", F.xxhash64(F.lit(seed), "key", "i").alias("h"))
    base = Stored(base, "mix-sizes").df
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = Stored(source_targets(sources, weights), "mix-targets").df
    base = base.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = base.withColumn("ratio", F.least(ratio, F.lit(float(MOST_COPIES))))
    whole = F.floor(F.col("ratio") + 1e-12)
    base = base.withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(F.col("ratio") - whole, F.lit(0.0))).drop("ratio")
    most = sources.agg(F.max("source_rows")).first()[0] or 0
    open_rows, done, level = base.withColumn("open", F.lit(True)), None, 0
    while True:
        fan = FAN_IN ** (level + 1)
        # a source's rows are dealt by hash to groups of FAN_IN on average; each group leaves one row at most
        dealt = open_rows.withColumn("groups", F.ceil(F.col("source_rows") / fan)).withColumn("g", F.pmod(F.xxhash64(F.lit(level), "h"), F.col("groups")))
        rounded = Stored(dealt.groupBy("source", "g").applyInPandas(_round_group(seed, level), dealt.schema), f"mix-level{level}").df
        settled = rounded.where(~F.col("open"))
        done = settled if done is None else done.unionByName(settled)
        if most <= fan:
            break
        open_rows = rounded.where("open").drop("groups", "g")
        level += 1
    return done.select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"), "key")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs`` (doc_id, source, text)."""
    base = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    return _copies(base, weights, seed).withColumnRenamed("id", "doc_id").drop("key")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """``docs`` with every document as often as the mix takes it; rows that differ in any column are documents of their own."""
    rows = packed(docs)
    rows = rows.withColumn("key", content_hash(rows))
    field: dict[str, Column] = {c: F.col("row").getField(c) for c in ("source", "text")}
    base = rows.select(F.lit(0).alias("id"), field["source"].alias("source"), word_count(field["text"]).alias("size"), "key")
    with scratch() as kept:
        plan = _copies(base, weights, seed).where(F.col("copies") > 0)
        # equal rows share a key; their copies add up and are dealt to them again
        plan = Stored(plan.groupBy("key").agg(F.sum("copies").alias("copies")), "mix-plan").df
        kept.append(plan)
    one = rows.groupBy("key").agg(F.first("row").alias("row"))
    return repeated(one.join(plan, "key"), "copies", "copy").select("row.*")
