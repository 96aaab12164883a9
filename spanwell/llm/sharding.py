"""Sharding by jump consistent hashing, in Spark expressions only.

The shard of a key is where a chain of ever larger jumps last landed below the
shard count.  No ring table exists, and with one more shard a key either stays
or moves into the new shard.

Defined results: a null key hashes as the text ``null``; repeated rows land in
the same shard; an empty table gives an empty result; an input column named like
an output is kept as ``input_`` and its name; all other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import packed, repeated, set_aside

#: Jumps grow with the logarithm of the shard count; more than this many have a chance below 1e-40 for any count up to 2**31.
MOST_JUMPS = 160

#: Rows that one slot group holds on average.
GROUP_ROWS = 8192


def _uniform(key: Column, step: Column) -> Column:
    """A number in (0, 1] that key and step fix, from 32 bits of an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), step.cast("string"))), 1, 8), 16, 10).cast("long")
    return (bits + 1) / F.lit(4294967296.0)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. ``shards`` - 1 of ``key`` (any type that casts to string)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, step: Column) -> Column:
        nxt = F.floor((s["j"] + 1) / _uniform(name, step)).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), nxt.alias("j"))).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS)))
    return F.aggregate(steps, start, jump, lambda s: s["b"].cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Every row of ``df`` with its shard; a projection, so nothing is shuffled."""
    names = [*set_aside(df, name).columns, name]
    return packed(df).withColumn("made", jump_shard(F.col("row").getField(key), shards)).select("row.*", "made").toDF(*names)


def number_slots(df: DataFrame, shard: str, rows: int, name: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, whatever the size of a shard or of a group of equal rows.

    ``rows`` (a count of ``df``) sets how many groups a shard is cut into.  Groups
    are numbered apart, and their first numbers come from a running sum over one
    small row for each shard and group.  Equal rows travel as one row with a count.
    """
    names = [*set_aside(df, name).columns, name]
    groups = max(1, -(-rows // GROUP_ROWS))
    cells = packed(df).groupBy("row").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.col("row").getField(shard))
    text = F.concat_ws("|", *[F.col("row").getField(c).cast("string") for c in df.columns])
    cells = cells.withColumn("g", F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(groups)))
    sizes = cells.groupBy("shard", "g").agg(F.sum("n").alias("size"))
    order = Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("shard").alias("s"), F.col("g").alias("h"), F.coalesce(F.sum("size").over(order), F.lit(0)).alias("first"))
    cells = cells.join(first, (F.col("shard") == F.col("s")) & (F.col("g") == F.col("h")))
    within = Window.partitionBy("shard", "g").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("from", F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    # equal rows come back in blocks, so that no array holds them all
    return repeated(cells, "n", "i").withColumn("made", F.col("from") + F.col("i")).select("row.*", "made").toDF(*names)
