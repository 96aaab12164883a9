"""Every registered query with an oracle gives the oracle's rows; every query runs on empty tables."""

import math

import duckdb
import pytest

from spanwell.plans import catalogue
from spanwell.plans.dialect import RAW

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in RAW:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bare")
    for t in RAW:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, bare, name):
    df = catalogue.QUERIES[name](spark, bare)
    assert df.columns == catalogue.QUERIES[name](spark, SF).columns
    df.collect()
