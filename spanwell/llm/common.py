"""Helpers that the operators of this subpackage share: shared storage, sizes, column handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression class of the bytes that part words: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode, where there is one machine, a temporary folder does instead;
    a cluster without a shared folder raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spanwell-")
    return _fallback[app]


#: Tables that this process has stored and not yet deleted, in order.
_open: list[Stored] = []


class Stored:
    """A DataFrame written to the shared folder: lineage ends there, and lost executors cost nothing."""

    def __init__(self, df: DataFrame, label: str):
        _open.append(self)
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read ``df`` afterwards."""
        if self not in _open:
            return
        _open.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to and reread from the shared folder."""
    return Stored(df, label).df


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes at its end what was stored inside, but for the DataFrames put into the list that it gives."""
    before, kept = list(_open), []
    yield kept
    for x in list(_open):
        if x not in before and not any(x.df is k for k in kept):
            x.drop()


def packed(df: DataFrame) -> DataFrame:
    """One struct column ``row`` of all columns, so that no name of theirs meets one of an operator's own."""
    return df.select(F.struct("*").alias("row"))


def content_hash(df: DataFrame, row: str = "row") -> Column:
    """64-bit hash of all columns of the packed ``df``."""
    fields = df.schema[row].dataType.fields
    plain = lambda f: F.col(row).getField(f.name)
    return F.xxhash64(*[F.to_json(F.struct(plain(f))) if "map<" in f.dataType.simpleString() else plain(f) for f in fields])


def set_aside(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column called ``name`` (in any case) renamed to ``input_name``, so that an output can have that name."""
    taken = {c.lower() for c in df.columns}
    other = f"input_{name}"
    while other.lower() in taken:
        other = f"input_{other}"
    return df.toDF(*[other if c.lower() == name.lower() else c for c in df.columns])


BLOCK = 8192


def repeated(df: DataFrame, times: str, name: str) -> DataFrame:
    """Every row ``times`` times, numbered from 0 in column ``name``; in blocks, so that no array holds all numbers of a row."""
    out = df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / BLOCK))))
    low = F.col(name) * BLOCK
    return out.withColumn(name, F.explode(F.sequence(low, F.least(low + BLOCK, F.col(times)) - 1)))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
