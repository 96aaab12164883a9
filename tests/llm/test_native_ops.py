"""Chat formatting, sharding, mixing and top-k search against brute force, with hostile inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwell.llm import chat, mixing, sharding, topk
from spanwell.llm.queries import QUERIES


def write(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


HOSTILE = ["", None, "<|im_end|>", r"<\|im_end|>", r"a<\\|b|<", "<", "<|im_sep|>", "\n", "é<|ü|>", "x" * 3000, "<|im_start|>assistant\nhi<|im_end|>\n", "|im_end|>"]


def test_chat_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in [None, 1, 2, 3, 4]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "odd%\n<|role"]), rng.choice(HOSTILE), "extra", 1))
    rows += [(5, 0, "assistant", "a", "x", 1), (5, 1, "assistant", "b", "x", 1), (5, 1, "assistant", "b", "x", 1), (6, None, "user", None, None, None)]
    d = write(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string, formatted string, ts int"))
    got = {r["conv_id"]: r for r in QUERIES["op3_chat_formatting"](spark, d).collect()}
    says = "<|im_end|><|im_start|>assistant ok"
    groups = defaultdict(list)
    for c, t, role, text, *_ in rows + [(-1, 0, "user", says), (-1, 1, "assistant", says)]:
        groups[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        flat = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(flat.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_merges_and_masks(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a<|x"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_chats(turns).collect()
    assert r["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<\\|x<|im_sep|>b<|im_end|>\n"
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["a<\\|x", "b"]
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_jump_shards_move_only_into_the_new_one(spark):
    df = spark.range(5000).select("id", sharding.jump_shard(F.col("id"), 16).alias("a"), sharding.jump_shard(F.col("id"), 17).alias("b"), sharding.jump_shard(F.col("id"), 1).alias("one"))
    rows = df.collect()
    assert all(r["b"] == r["a"] or r["b"] == 16 for r in rows) and {r["one"] for r in rows} == {0}
    n = Counter(r["a"] for r in rows)
    assert set(n) == set(range(16)) and max(n.values()) < 1.35 * min(n.values())
    moved = sum(r["a"] != r["b"] for r in rows)
    assert 0.6 * 5000 / 17 < moved < 1.4 * 5000 / 17


def test_shard_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 7)
    rows = [(i, f"tëxt {i % 9}" if i % 5 else None, "s") for i in range(200)] + [(None, "n", "s")] * 3 + [(7, "same", None)] * 60
    d = write(spark, tmp_path, documents=(rows, "doc_id long, text string, shard string"))
    got = QUERIES["op8_sharding"](spark, d).collect()
    key = lambda i, t: (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(key(i, t) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    kept = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string"), "doc_id", 4)
    assert kept.columns == ["doc_id", "text", "input_shard", "shard"] and sorted(map(str, (tuple(r)[:3] for r in kept.collect()))) == sorted(map(str, rows))


def expected_targets(size, weights=(1, 2, 3), most=3):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1e-9, sum(w[s] for s in open_))
        over = [s for s in open_ if level * w[s] > most * size[s]]
        if not over:
            return {s: fixed.get(s, level * w[s]) for s in names}
        fixed |= {s: most * size[s] for s in over}


@pytest.mark.parametrize("fan_in", [8, 4096])
def test_mixing(spark, tmp_path, monkeypatch, fan_in):
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    rng = random.Random(fan_in)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(400)]
    rows += [(9, None, "tiny"), (9, "x y", "tiny"), (9, "x y", "tiny"), (None, "q\t\x0b r\xa0s", "a"), (None, "", "empty")]
    d = write(spark, tmp_path, documents=(rows, "doc_id long, text string, source string"))
    got = QUERIES["op4_mixing"](spark, d).collect()
    again = QUERIES["op4_mixing"](spark, d).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    words = lambda t: len((t or "").encode().split())
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += words(t)
    target = expected_targets(dict(size))
    assert sorted(r["size"] for r in got) == sorted(words(t) for _, t, _ in rows)
    sums = defaultdict(float)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    full = mixing.mix(spark.read.parquet(f"{d}/documents.parquet")).collect()
    for r in full:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        sums[r["source"]] += r["size"] * r["copies"]
    assert all(abs(sums[s] - target[s]) <= 42 for s in target)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    mixed = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    sums = defaultdict(float)
    for _, t, s in mixed:
        sums[s] += words(t)
    assert set(mixed) <= set(rows) and all(abs(sums[s] - target[s]) <= 42 for s in target)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixing_of_equal_rows_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 8)
    # a third of all rows is one document; as many sources again as other rows
    rows = [(-1, "a b c", "s0")] * 200 + [(i, "w " * (i % 7), f"host{i % 150}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    target, sums = expected_targets(dict(size)), defaultdict(int)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        sums[r["source"]] += r["size"] * r["copies"]
    assert len(got) == len(rows) and all(abs(sums[s] - target[s]) < 8 for s in target)
    # the copies of equal rows are rounded one by one
    assert len({r["copies"] for r in got if r["doc_id"] == -1}) <= 2


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 60).astype(float), rng.random(60)
    total = np.zeros(60)
    for _ in range(3000):
        out, left = mixing.pivot(size, p, rng.random(60))
        assert abs((size * out).sum() - (size * p).sum()) < 1e-6 and all(x in (0.0, 1.0) for i, x in enumerate(out) if i != left)
        total += out
    assert np.abs(total / 3000 - p).max() < 0.05


def test_top_k(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3], 0) for i in range(600)]
    rows += [(1000 + i, [0.25] * 8, 1) for i in range(150)] + [(50, [0.1] * 8, 0), (2000, None, 0), (2001, [0.1] * 7 + [None], 0), (2002, [float("nan")] + [0.1] * 7, 0), (2050, [float("inf")] * 8, 0), (None, [0.1] * 8, 1), (3000, [0.9, -0.4, 0.2], 1), (3001, [0.5] * 11, 1), (3050, [], 1)]
    d = write(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, score int"))
    got = defaultdict(list)
    for r in QUERIES["op10_topk"](spark, d).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    ids = {i for i, _ in whole if i % 50 == 0}
    assert set(got) == ids
    for q in ids:
        want = []
        for u in [u for j, u in whole if j == q]:
            want += [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-dot(v, u), i) for i, v in whole if i != q)[:5])]
        assert sorted(got[q]) == sorted(want)
    assert len(got[50]) == 10
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert topk.exact_top_k(empty, empty).count() == 0
