"""Document functions and model hooks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwell.functions import documents
from spanwell.operators import hooks


@pytest.mark.parametrize(
    ("text", "status"),
    [('x {"a": [1, 2]} y {', "valid"), ('{"a": [1, 2,],}', "repaired"), ('{"a": "}, ]"}', "valid"), ("none", "fallback"), (None, "fallback"), ('{"a": ', "fallback"), ('{"a": "\\"}"}', "valid")],
)
def test_parse(spark, text, status):
    got = spark.createDataFrame([(text,)], "t string").select(documents.parse(F.col("t")).alias("p")).first()["p"]
    assert got["status"] == status and json.loads(got["document"]) is not None


def test_canonical_and_sized():
    assert documents.canonical({"b": 1, "a": [1.5, None]}) == '{"a":[1.5,null],"b":1}'
    with pytest.raises(ValueError):
        documents.canonical(float("nan"))
    d = documents.sized({"text": "x" * 90})
    assert len(documents.canonical(d).encode()) == d["byte_size"]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, text string")
    v = {r["id"]: r["embedding"] for r in hooks.map_model(df, hooks.fixture_encoder(4), "id long, embedding array<double>").collect()}
    assert v[1] == v[2] != v[3] and abs(np.linalg.norm(v[1]) - 1) < 1e-9
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 5.0)], "id long, start_s double, end_s double")
    got = {r["id"]: r for r in hooks.map_model(spans, hooks.fixture_refiner(), "id long, start_s double, end_s double, status string").collect()}
    assert (got[1]["start_s"], got[1]["end_s"], got[2]["status"]) == (1.0, 9.0, "not_found")
    x = spark.createDataFrame([(1, [1.0, 2.0])], "id long, features array<double>")
    assert hooks.map_model(x, hooks.linear_head([1.0, 2.0], 0.5, [0.0, 1.0], [1.0, 2.0]), "id long, score double").first()["score"] == 2.5
