"""Stored tables: where they go, and when they are deleted."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spanwell.llm import common


def test_a_cluster_must_share_a_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", applicationId="x", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(spark)


def test_scratch_keeps_what_it_is_told(spark):
    with common.scratch() as kept:
        a, b = common.Stored(spark.range(3), "a"), common.Stored(spark.range(4), "b")
        kept.append(b.df)
    there = lambda x: Path(x.path.removeprefix("file://")).exists()
    assert not there(a) and there(b) and b.df.count() == 4
    b.drop()
    assert not there(b)


def test_rows_are_repeated_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 4)
    df = spark.createDataFrame([("x", 9), ("y", 1), ("z", 4)], "k string, n long")
    got = sorted((r["k"], r["i"]) for r in common.repeated(df, "n", "i").collect())
    assert got == [(k, i) for k, n in (("x", 9), ("y", 1), ("z", 4)) for i in range(n)]


def test_names_set_aside(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Shard int, input_shard int, k int")
    out = common.set_aside(df, "shard")
    assert out.columns == ["input_input_shard", "input_shard", "k"] and tuple(out.first()) == (1, 2, 3)
    rows = common.packed(spark.createDataFrame([({"a": 1}, 2.0), ({"a": 1}, 2.0), ({"a": 2}, 2.0)], "m map<string,int>, x double"))
    assert rows.select(common.content_hash(rows).alias("h")).agg(F.countDistinct("h")).first()[0] == 2
