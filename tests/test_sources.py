"""Configuration, annotation files and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from spanwell.functions import config as C
from spanwell.sources import adapters, annotations
from spanwell.streaming import sinks

SF = "/root/testdata/sf0.001"


def test_layers_and_guards():
    schema = {"run": {"seed": int, "ratio": float}, "name": str}
    got = C.layered([{"run": {"seed": 1, "ratio": 1}, "name": "a"}, {"run": {"seed": 2}}], schema)
    assert got == {"run": {"seed": 2, "ratio": 1}, "name": "a"}
    for bad in ({"other": 1}, {"run": {"seed": True}}, {"run": 3}, {"name": 4}):
        with pytest.raises(ValueError):
            C.layered([{"run": {"seed": 1, "ratio": 1.0}, "name": "a"}, bad], schema)
    with pytest.raises(ValueError, match="missing"):
        C.layered([{"name": "a", "run": {"seed": 1}}], schema)
    with pytest.raises(ValueError, match="forbidden"):
        C.layered([{"name": "a"}], schema, {"name"})
    assert C.in_ranges(got, {"run.ratio": (0, 1)}, {(2, "a")}, ("run.seed", "name")) == got
    with pytest.raises(ValueError):
        C.in_ranges(got, {"run.seed": (3, 9)})
    assert C.differ_only_in(got, got | {"name": "b"}, {"name"}) == {"name"}
    with pytest.raises(ValueError):
        C.differ_only_in(got, {"name": "a"}, {"name"})
    assert [C.size_of(x) for x in ("256k", "1M", "77", "1.5k")] == [262144, 1048576, 77, 1536]
    assert C.inside("a/b.json") and not any(map(C.inside, ("/a", "a/../../b", "")))
    assert C.versioned("x/results/a.json", "v1") == "x/results/v1/a.json" == C.versioned("x/results/v1/a.json", "v1")
    assert C.backfill(["results/a", "results/v1/b"], "v1") == [("results/a", "results/v1/a")]
    with pytest.raises(ValueError):
        C.backfill(["results/a", "results/v1/a"], "v1")
    assert C.freeze({"k": 1}, {"g": True})["status"] == "frozen"
    with pytest.raises(ValueError):
        C.freeze({"k": 1}, {"g": False})
    timer = C.Timer()
    with pytest.raises(KeyError), timer.component("x"):
        raise KeyError
    assert timer.records[0]["component"] == "x" and not timer.records[0]["ok"]
    assert C.report([{"a": "y", "b": 1.0}, {"a": "x", "b": None}], ["a", "b"], 2).splitlines()[2:] == ["| x |  |", "| y | 1.0000 |"]
    guard = C.read_guard(["a.json"], "/r")
    assert str(guard("a.json")) == "/r/a.json"
    with pytest.raises(PermissionError):
        guard("b.json")
    assert json.loads(C.provenance({"b": 1}, "v", {}))["config"] == {"b": 1}


def test_annotations(spark):
    rows = [("v1", None, "opens a door", 10.0, "[1, 4]"), (None, "v2", "walks", 8.0, "[[0, 2], [3, 9]]"), ("v3", None, "sits", -1.0, "[0, 1]"), ("v1", None, "opens a door", 10.0, "[1, 4]"), ("v4", None, None, 5.0, "[1, 2]")]
    df = spark.createDataFrame(rows, "video_id string, vid string, sentence string, duration double, span string")
    got = [tuple(r) for r in annotations.annotations(df, strict=False).select("video_id", "start_s", "end_s", "problem").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([("v1", 1.0, 4.0, "repeated"), ("v1", 1.0, 4.0, "repeated"), ("v2", 0.0, 2.0, None), ("v2", 3.0, 9.0, "span"), ("v3", 0.0, 1.0, "duration"), ("v4", 1.0, 2.0, "missing")], key=key)
    with pytest.raises(Exception, match="repeated"):
        annotations.annotations(df.where("video_id = 'v1'")).collect()
    assert annotations.annotations(df.where("vid = 'v2'").withColumn("span", F.lit("[0, 2]"))).count() == 1
    with pytest.raises(ValueError):
        annotations.annotations(df.drop("span"))


def test_benchmark_videos(spark):
    doc = {"a": {"duration": 34.93, "spans": [[0, 5], [20, 35]], "queries": ["one", "two"]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    got = [tuple(r) for r in annotations.benchmark_videos(df).collect()]
    assert got == [("a__0000", "a", "one", 0.0, 5.0, 34.93), ("a__0001", "a", "two", 20.0, 34.93, 34.93)]
    doc["a"]["spans"][0] = [0, 36]
    with pytest.raises(Exception, match="invalid"):
        annotations.benchmark_videos(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()


def test_prediction_files(spark, tmp_path):
    for job, name in (("job1", "v.rho_0.25.qg_1.5.json"), ("job2", "v.rho_1.00.qg_2.json")):
        (tmp_path / job / "predictions").mkdir(parents=True)
        (tmp_path / job / "predictions" / name).write_text(json.dumps({"span": [1, 2]}))
    (tmp_path / "job2" / "v.rho_1.qg_1.json").write_text("{}")
    got = sorted((r["job"], r["rho"], r["margin"]) for r in annotations.prediction_files(spark, str(tmp_path)).collect())
    assert got == [("job1", 0.25, 1.5), ("job2", 1.0, 2.0)]


def test_sinks(spark, tmp_path):
    costs = adapters.costs(spark, SF).limit(20)
    sinks.write_resources(costs, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == sinks.RESOURCE_COLUMNS
    plan = adapters.arrivals(spark, SF)
    sinks.write_plan(plan, f"{tmp_path}/plan")
    schema = plan.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    assert sinks.read_plan(spark, f"{tmp_path}/plan", schema).count() == plan.count()
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_plan(plan, f"{tmp_path}/plan")
    plan.limit(3).selectExpr("to_json(struct(*)) AS value").write.mode("append").text(f"{tmp_path}/plan/plan")
    with pytest.raises(ValueError):
        sinks.read_plan(spark, f"{tmp_path}/plan", schema)
    events = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, 3, 1, 2)], "video_id long, level int, event int, start_s double, end_s double, support long, first_frame long, last_frame long")
    sinks.write_events(events, f"{tmp_path}/events")
    assert sinks.read_snapshot(spark, f"{tmp_path}/events", sinks.EVENT_COLUMNS).count() == 1
    with pytest.raises(ValueError):
        sinks.write_events(events.withColumn("query_id", F.lit(1)), f"{tmp_path}/e2")
    for i in (0, 1):
        (tmp_path / f"s{i}.jsonl").write_text('{"a": %d}\n' % i)
    assert sinks.concatenated(spark, [f"{tmp_path}/s0.jsonl", f"{tmp_path}/s1.jsonl"], "a int").count() == 2
    for name in ("e1", "e2"):
        sinks.register(spark, f"{tmp_path}/registry", {"experiment": name, "seed": "1"})
    with pytest.raises(ValueError):
        sinks.register(spark, f"{tmp_path}/registry", {"experiment": "e1"})
    assert spark.read.parquet(f"{tmp_path}/registry").count() == 2
