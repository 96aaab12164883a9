"""Operators of the engine against brute force, literal fixtures and the SQL of the catalogue."""

import base64
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwell.functions import columns as C
from spanwell.operators import features, folds
from spanwell.plans.dialect import expand_rounds
from spanwell.sources import adapters
from spanwell.streaming import sinks, stateful, windows

SF = "/root/testdata/sf0.001"


def test_interval_functions(spark):
    rows = [(0.0, 2.0, 0.0, 2.0, 1.0), (0.0, 2.0, 0.0, 1.0, 0.5), (0.0, 2.0, None, None, 0.0), (0.0, 1.0, 2.0, 3.0, 0.0), (1.0, 1.0, 0.0, 2.0, 0.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").select(C.temporal_iou(*[F.col(x) for x in "abcd"]).alias("i"), "e").collect()
    assert all(r["i"] == r["e"] for r in got)


def test_vector_functions(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in rng.normal(size=5)], [float(x) for x in rng.normal(size=5)]) for _ in range(20)] + [([0.0] * 5, [1.0] * 5)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", C.cosine(F.col("a"), F.col("b")).alias("c"), C.quantize_int8(F.col("a")).alias("q")).collect()
    for r in got[:-1]:
        a, b = np.array(r["a"]), np.array(r["b"])
        assert math.isclose(r["c"], a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel_tol=1e-9)
        assert np.abs(np.array(r["q"]["codes"]) * r["q"]["scale"] - a).max() <= r["q"]["scale"] / 2 + 1e-9
    assert got[-1]["c"] is None


def test_expand_rounds():
    assert expand_rounds("round(a + max(b, 1), 2)") == "(floor((a + max(b, 1)) * 1e2 + 5e-1) / 1e2)"
    assert expand_rounds("bround(x)") == "bround(x)"


def stream(n=40, seed=1):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.random(n) * 40000)
    return [{"video_id": 1, "frame_id": i, "timestamp_s": float(t[i]), "duration_s": float(t[-1]), "value": float(rng.random() * 490), "kind": ["view", "click", "error", "purchase"][i % 4], "embedding": [float(x) for x in rng.normal(size=6)]} for i in range(n)]


def test_event_memory_by_hand():
    # frames too far apart to join: seven closed events fit the bottom level beside the open one
    rows = [{"video_id": 1, "frame_id": i, "timestamp_s": i * 1e6, "embedding": [1.0, 0.0]} for i in range(10)]
    shape = lambda n, caps: [(r["level"], r["support"]) for r in folds.fold_rows(folds.EventMemory(caps), iter(rows[:n]))]
    assert shape(8, (8, 4, 2)) == [(0, 1)] * 8
    # the ninth frame closes an eighth event: the two oldest go up as one
    assert shape(9, (8, 4, 2)) == [(1, 2)] + [(0, 1)] * 7
    # two levels of two and one: pairs carried up meet at the top and stay there
    assert shape(3, (2, 1)) == [(1, 2), (0, 1)] and shape(5, (2, 1)) == [(1, 4), (0, 1)]
    # near and alike frames are one event, whose direction is the mean
    near = [{"video_id": 1, "frame_id": i, "timestamp_s": float(i), "embedding": v} for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [-1.0, -0.2]])]
    fold = folds.EventMemory(alike=0.5)
    state = fold.start()
    for r in near[:1] + near[2:3]:
        fold.step(state, r)
    assert state["open"][0] == 2 and np.allclose(state["open"][1], np.array([1.6, 0.8]) / math.hypot(1.6, 0.8))
    fold.step(state, near[3])
    assert state["open"][0] == 1 and len(state["levels"][0]) == 1


def test_event_memory_conserves_support():
    for n in (0, 1, 5, 300):
        out = folds.fold_rows(folds.EventMemory(), iter(stream(n)))
        assert sum(r["support"] for r in out) == n
        assert all(a["end_s"] < b["start_s"] for a, b in zip(out, out[1:]))
        assert len(out) <= sum(folds.EventMemory().caps)


def test_reservoirs_are_bounded():
    rows = stream(500)
    out = folds.fold_rows(folds.SemanticReservoir(), iter(rows))
    assert len([r for r in out if r["selection"] == "anchor"]) == 4 and len(out) <= 8
    pool = folds.fold_rows(folds.NearFarPool(), iter(rows))
    assert sum(r["support"] for r in pool) == 500 and len(pool) <= 20
    forest = folds.fold_rows(folds.AdjacentForest(), iter(rows))
    assert sum(r["leaves"] for r in forest) == 500 and len(forest) == 8
    seg = folds.fold_rows(folds.SegmentReservoir(), iter(rows))
    assert len({r["frame_id"] for r in seg}) == len(seg)


def test_trigger_rules():
    t = folds.JointTrigger(least=10, most=100, threshold=0.7)
    row = lambda i, ts, value, kind="click": {"video_id": 1, "frame_id": i, "timestamp_s": ts, "value": value, "kind": kind}
    rows = [row(99, 0.0, 0.0), row(99, 5.0, 500.0), row(99, 11.0, 500.0), row(0, 12.0, 0.0, "error"), row(0, 60.0, 0.0), row(0, 112.0, 0.0), row(1, 130.0, 400.0, "view")]
    assert [r["reason"] for r in folds.fold_rows(t, iter(rows))] == ["first", "threshold", "hard_cut", "max_gap", "threshold"]


def test_as_of_snapshots():
    rows = [{**r, "timestamp_s": ts} for r, ts in zip(stream(4), [1.0, 2.0, 2.0, 3.0])]
    out = stateful.snapshots(rows, folds.NearFarPool(), {1: [0.5, 1.5, 2.0, 9.0]})
    n = {t: sum(r["support"] for r in out if r["t_q"] == t) for t in (0.5, 1.5, 2.0, 9.0)}
    # at a time of two frames only the first has arrived
    assert n == {0.5: 0, 1.5: 1, 2.0: 2, 9.0: 4}


def test_stream_equals_batch(spark, tmp_path):
    rows = [{k: v for k, v in r.items() if k != "embedding"} | {"video_id": v} for v in (1, 2) for r in stream(30, v)]
    schema = "video_id long, frame_id long, timestamp_s double, duration_s double, value double, kind string"
    rows.sort(key=lambda r: r["timestamp_s"])
    cut = sorted(r["timestamp_s"] for r in rows)[30]
    for i, part in enumerate(([r for r in rows if r["timestamp_s"] <= cut], [r for r in rows if r["timestamp_s"] > cut])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("ewma_zscore", "joint_trigger"):
        fold = folds.FOLDS[name]()
        (tmp_path / name / "src").mkdir(parents=True)
        for i in (0, 1):  # a restart from the checkpoint in between
            for p in (tmp_path / f"in{i}").glob("part*"):
                (tmp_path / name / "src" / f"{i}-{p.name}").write_bytes(p.read_bytes())
            live = stateful.stream_fold(spark.readStream.schema(schema).json(f"{tmp_path}/{name}/src"), fold)
            live.writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/cp").trigger(availableNow=True).start().awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/out").collect()))
        want = sorted(map(tuple, folds.run_fold(spark.createDataFrame(rows, schema), fold).collect()))
        assert got == want and want


def test_streaming_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "ts")
    events.write.parquet(f"{tmp_path}/in")
    live = windows.tumbling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = live.writeStream.format("memory").queryName("tumbling_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling_test").collect())) == sorted(map(tuple, windows.tumbling(events).collect()))


def test_frames_source(spark, tmp_path):
    def line(video, t, size):
        return json.dumps({"video_id": video, "fps": 3, "timestamp_s": t, "frame_index": round(t * 3), "image_b64": base64.b64encode(bytes(range(size))).decode(), "width": size, "height": 2})

    (tmp_path / "a.jsonl").write_text("\n".join([line("cat", 1 / 3, 5), line("cat", 1.0, 0), line("dog", 7 / 3, 9)]) + "\n")
    df = sinks.read_frames(spark, f"{tmp_path}/a.jsonl")
    assert sorted((r["video_id"], r["frame_id"], len(r["payload"])) for r in df.collect()) == [("cat", 1, 5), ("cat", 3, 0), ("dog", 7, 9)]
    (tmp_path / "b.jsonl").write_text(line("cat", 1.0, 1) + '\n{"video_id": "cat", "fps": \n')
    with pytest.raises(Exception):
        sinks.read_frames(spark, f"{tmp_path}/b.jsonl").collect()


def test_snapshots_are_verified(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    sinks.write_snapshot(df, f"{tmp_path}/s")
    assert sinks.read_snapshot(spark, f"{tmp_path}/s", ["id", "x"]).count() == 10
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, f"{tmp_path}/s", ["id"])
    with pytest.raises(Exception):
        sinks.write_snapshot(df, f"{tmp_path}/s")
    df.limit(9).write.mode("overwrite").parquet(f"{tmp_path}/s/data")
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        sinks.assert_columns(df.select(F.struct("x").alias("gt-span")), {"gt_span"})


def test_documents_and_trace(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, seq long, doc string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "id long, seq long, doc string")
    assert sorted(map(tuple, sinks.upsert_latest(old, new, "id", "seq").collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    trace = spark.createDataFrame([(1, 1, 0.0, "start"), (1, 2, 1.0, "write")], "video_id long, sequence long, t double, kind string")
    more = spark.createDataFrame([(1, 2.0, "end"), (2, 0.0, "start")], "video_id long, t double, kind string")
    assert sorted(map(tuple, sinks.append_trace(trace, more).collect()))[2:] == [(1, 3, 2.0, "end"), (2, 1, 0.0, "start")]


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 10, 0.1] + [5, 0, 1]
    y = x @ [2.0, -0.3, 7.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    got = features.ridge_fit(df, ["a", "b", "c"], "y")
    assert np.allclose(got[1:], beta) and math.isclose(got[0], y.mean() - beta @ x.mean(0))


def test_mmr_and_nms(spark):
    f = adapters.vector_frames(spark, SF)
    out = folds.mmr_select(f, k=3).groupBy("video_id").count().collect()
    assert {r["count"] for r in out} == {3}
    c = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.9), (1, 2, 1.0, 10.0, 0.8), (1, 3, 20.0, 30.0, 0.7)], "query_id long, candidate long, pred_start double, pred_end double, score double")
    got = {r["candidate"]: (r["kept"], r["suppressor"]) for r in folds.temporal_nms(c).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (True, 0)}
