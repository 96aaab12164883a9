"""Heads against the same sums written out one number at a time."""

import json
import math

import numpy as np
import pytest

from spanwell.operators import heads
from spanwell.operators.heads import Weights

RNG = np.random.default_rng(4)


def layer(name, out, into):
    return {f"{name}.w": RNG.normal(size=(out, into)), f"{name}.b": RNG.normal(size=out)}


def norm(name, n):
    return {f"{name}.w": RNG.normal(size=n), f"{name}.b": RNG.normal(size=n)}


def gru(name, size, into):
    return {f"{name}.wx": RNG.normal(size=(3 * size, into)), f"{name}.wh": RNG.normal(size=(3 * size, size)), f"{name}.bx": RNG.normal(size=3 * size), f"{name}.bh": RNG.normal(size=3 * size), f"{name}.missing": RNG.normal(size=size)}


def test_mlp():
    w = Weights(norm("input", 3) | layer("score.0", 4, 3) | layer("score.1", 2, 4) | layer("score.2", 1, 2))
    x = RNG.normal(size=(5, 3))
    act = lambda v: [0.5 * a * (1 + math.erf(a / math.sqrt(2))) for a in v]
    dense = lambda n, v: [sum(a * b for a, b in zip(row, v)) + c for row, c in zip(w[f"{n}.w"], w[f"{n}.b"])]
    want = []
    for row in x:
        m = sum(row) / 3
        d = math.sqrt(sum((a - m) ** 2 for a in row) / 3 + 1e-5)
        v = [(a - m) / d * g + b for a, g, b in zip(row, w["input.w"], w["input.b"])]
        want.append(dense("score.2", act(dense("score.1", act(dense("score.0", v)))))[0])
    assert np.allclose(heads.joint_quality(w, x), want)


def test_gru_steps():
    w = Weights(gru("g", 2, 3))
    seqs = [RNG.normal(size=(n, 3)) for n in (4, 0, 1)]
    got = w.gru("g", seqs)
    s = lambda v: 1 / (1 + math.exp(-v))
    for seq, state in zip(seqs, got):
        if not len(seq):
            assert np.array_equal(state, w["g.missing"])
            continue
        h = [0.0, 0.0]
        for x in seq:
            a = [float(r @ x) + b for r, b in zip(w["g.wx"], w["g.bx"])]
            c = [float(r @ np.array(h)) + b for r, b in zip(w["g.wh"], w["g.bh"])]
            h = [s(a[2 + i] + c[2 + i]) * h[i] + (1 - s(a[2 + i] + c[2 + i])) * math.tanh(a[4 + i] + s(a[i] + c[i]) * c[4 + i]) for i in (0, 1)]
        assert np.allclose(state, h)


def test_temporal_head():
    size, states = 2, 3
    w = Weights(gru("center", size, 5) | gru("left", size, 5) | gru("right", size, 5) | norm("scalar_norm", 4) | layer("scalar", 6, 4) | layer("state", states, 3 * size + 6) | layer("pair.0", 4, 6 * states) | layer("pair.1", 3, 4) | layer("abstain.0", 3, 3 * states) | layer("abstain.1", 1, 3))
    for k in ("quality", "gain", "left_quality", "right_quality", "rank"):
        w |= layer(k, 1, 3)
    w = Weights(w)
    tokens = lambda: [RNG.normal(size=(n, 5)) for n in (2, 0, 3)]
    scalars, c, le, r = RNG.normal(size=(3, 4)), tokens(), tokens(), tokens()
    out = heads.temporal_quality(w, scalars, c, le, r, baseline=1)
    assert out["selection"][1] == out["abstention"] and all(len(out[k]) == 3 for k in ("quality", "gain", "left_quality", "right_quality", "selection"))
    # the order of the candidates does not matter
    turn = [2, 0, 1]
    again = heads.temporal_quality(w, scalars[turn], [c[i] for i in turn], [le[i] for i in turn], [r[i] for i in turn], baseline=2)
    assert all(np.allclose(again[k], out[k][turn]) for k in ("quality", "gain", "selection"))


def test_late_fusion():
    n, h, geo = 6, 4, 3
    w = layer("video", h, n) | layer("query", h, n) | layer("time.0", 5, 2) | layer("time.1", h, 5) | norm("token_norm", h) | norm("fusion_norm", h) | layer("fusion", h, 3 * h) | layer("saliency", 1, h) | {"missing": RNG.normal(size=h)}
    for k in "q k v out".split():
        w |= layer(f"attention.{k}", h, h)
    w |= layer("quality.0", h, 2 * h + geo) | layer("quality.1", 1, h) | layer("gain.0", h, 5 * h + geo) | layer("gain.1", 1, h)
    w = Weights(w)
    tokens, query, times = RNG.normal(size=(5, n)), RNG.normal(size=n), RNG.random((5, 2))
    masks, geometry = np.array([[1, 1, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 1, 1, 1]], float), np.array([[0.1, 0.2, 0], [0.3, 0.1, 1], [0.2, 0.2, 0]])
    out = heads.late_fusion(w, tokens, query, times, masks, geometry, heads=2)
    assert math.isclose(out["attention"].sum(), 1.0) and out["selection"][1] == 0.0
    # a token that no candidate covers changes what is attended to, not the pool of one that covers none
    turn = [4, 3, 2, 1, 0]
    again = heads.late_fusion(w, tokens[turn], query, times[turn], masks[:, turn], geometry, heads=2)
    assert np.allclose(again["quality"], out["quality"]) and np.allclose(again["saliency"], out["saliency"][turn])
    # one head, written out
    video = w.linear("video", tokens) + w.stack("time", times)
    q, k = w.linear("attention.q", w.linear("query", query)), w.linear("attention.k", video)
    per = [np.exp([float(q[a : a + 2] @ t[a : a + 2]) / math.sqrt(2) for t in k]) for a in (0, 2)]
    assert np.allclose(out["attention"], np.mean([p / p.sum() for p in per], axis=0))


def test_checkpoints():
    w = layer("score.0", 2, 3)
    text = heads.save(w, ["a", "b", "c"])
    got = heads.load(text, ["a", "b", "c"])
    assert all(np.array_equal(got[k], w[k]) for k in w)
    with pytest.raises(ValueError, match="other features"):
        heads.load(text, ["b", "a", "c"])
    broken = json.loads(text)
    broken["payload"]["features"] = ["a", "b", "d"]
    with pytest.raises(ValueError, match="damaged"):
        heads.load(json.dumps(broken), ["a", "b", "d"])
    rows = np.array([[0.0, 0.5, 1.0]])
    assert heads.contract(rows, ["a", "b", "c"], {"b": (0, 1)}, 4) is rows
    for bad, cap in ((np.array([[0.0, 2.0, 1.0]]), 4), (np.array([[math.nan, 0.0, 0.0]]), 4), (rows, 0)):
        with pytest.raises(ValueError):
            heads.contract(bad, ["a", "b", "c"], {"b": (0, 1)}, cap)
