"""Inference of the span heads from given weights, in NumPy: one batch at a time inside an Arrow or pandas function.

Weights are a dictionary of arrays under dotted names (``score.0.w``, ``score.0.b``).
:func:`save` and :func:`load` keep them with a digest, and a head refuses features
whose names are not those it was made for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0))) if x.size else x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Weights(dict):
    """Arrays by name, with the layers that read them."""

    def linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self[f"{name}.w"].T + self[f"{name}.b"]

    def norm(self, name: str, x: np.ndarray) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * self[f"{name}.w"] + self[f"{name}.b"]

    def stack(self, name: str, x: np.ndarray) -> np.ndarray:
        """Linear layers ``name.0``, ``name.1``, ... with GELU between them, none after the last."""
        depth = sum(k.startswith(f"{name}.") and k.endswith(".w") for k in self)
        for i in range(depth):
            x = self.linear(f"{name}.{i}", gelu(x) if i else x)
        return x

    def gru(self, name: str, tokens: list[np.ndarray]) -> np.ndarray:
        """Last state of a gated recurrent unit over each sequence; the learned ``missing`` row for an empty one.

        Sequences advance together, step by step; one that has ended keeps its state.
        """
        size = self[f"{name}.missing"].shape[-1]
        out = np.zeros((len(tokens), size))
        length = np.array([len(t) for t in tokens], int)
        for step in range(length.max(initial=0)):
            live = np.flatnonzero(length > step)
            x = np.stack([tokens[i][step] for i in live])
            gx, gh = x @ self[f"{name}.wx"].T + self[f"{name}.bx"], out[live] @ self[f"{name}.wh"].T + self[f"{name}.bh"]
            reset, keep = (sigmoid(gx[:, k * size : (k + 1) * size] + gh[:, k * size : (k + 1) * size]) for k in (0, 1))
            new = np.tanh(gx[:, 2 * size :] + reset * gh[:, 2 * size :])
            out[live] = keep * out[live] + (1.0 - keep) * new
        out[length == 0] = self[f"{name}.missing"]
        return out

    def attend(self, name: str, query: np.ndarray, tokens: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
        """(attended state, mean weight of each token) of one query over the tokens."""
        q, k, v = (self.linear(f"{name}.{x}", y).reshape(-1, heads, query.shape[-1] // heads) for x, y in (("q", query[None]), ("k", tokens), ("v", tokens)))
        weight = softmax(np.einsum("qhd,thd->ht", q, k) / math.sqrt(q.shape[-1]))
        mixed = np.einsum("ht,thd->hd", weight, v).reshape(1, -1)
        return self.linear(f"{name}.out", mixed)[0], weight.mean(0)


def joint_quality(w: Weights, features: np.ndarray) -> np.ndarray:
    """ML-03: quality logit of each candidate from its standardised features."""
    return w.stack("score", w.norm("input", features))[:, 0]


def temporal_quality(w: Weights, scalars: np.ndarray, center: list, left: list, right: list, baseline: int) -> dict[str, np.ndarray]:
    """ML-04: the candidates of one observation: three recurrent views, compared with the baseline and with the pool as a whole.

    ``selection`` has the abstention logit in the baseline's place.
    """
    views = [w.gru(n, t) for n, t in (("center", center), ("left", left), ("right", right))]
    state = gelu(w.linear("state", np.hstack([*views, gelu(w.linear("scalar", w.norm("scalar_norm", scalars)))])))
    base, mean, top = state[baseline], state.mean(0), state.max(0)
    every = lambda x: np.broadcast_to(x, state.shape)
    pair = gelu(w.stack("pair", np.hstack([state, every(base), state - base, state * base, every(mean), every(top)])))
    out = {k: w.linear(k, pair)[:, 0] for k in ("quality", "gain", "left_quality", "right_quality", "rank")}
    out["abstention"] = w.stack("abstain", np.concatenate([base, mean, top])[None])[0, 0]
    out["selection"] = out.pop("rank").copy()
    out["selection"][baseline] = out["abstention"]
    return out


def late_fusion(w: Weights, tokens: np.ndarray, query: np.ndarray, times: np.ndarray, masks: np.ndarray, geometry: np.ndarray, heads: int = 4) -> dict[str, np.ndarray]:
    """ML-05: tokens of a video fused with the query that attends to them; candidates pool the salient ones that they cover.

    ``masks`` (candidates, tokens) says which; the last column of ``geometry`` marks the baseline.
    """
    video, asked = w.linear("video", tokens) + w.stack("time", times), w.linear("query", query)
    whole, weight = w.attend("attention", asked, video, heads)
    same = lambda x, n: np.broadcast_to(x, (n, len(x)))
    fused = w.norm("fusion_norm", gelu(w.linear("fusion", np.hstack([video, same(asked, len(video)), same(whole, len(video))]))))
    state = w.norm("token_norm", video) + fused
    salient = w.linear("saliency", state)[:, 0]
    share = np.exp(salient - salient.max(initial=-1e4)) * masks
    total = share.sum(1, keepdims=True)
    pooled = np.where(total > 0, share / np.maximum(total, 1e-300) @ state, w["missing"])
    n, base = len(pooled), pooled[int(geometry[:, -1].argmax())]
    quality = w.stack("quality", np.hstack([pooled, same(whole, n), geometry]))[:, 0]
    gain = w.stack("gain", np.hstack([pooled, same(base, n), pooled - base, pooled * base, same(whole, n), geometry]))[:, 0]
    selection = gain.copy()
    selection[int(geometry[:, -1].argmax())] = 0.0
    return {"attention": weight, "saliency": salient, "quality": quality, "gain": gain, "selection": selection}


def _digest(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save(weights: dict[str, np.ndarray], features: list[str]) -> str:
    """ML-18, ML-19: a checkpoint as text: arrays, feature names in order, and the digest of both."""
    arrays = {k: [list(v.shape), base64.b64encode(np.ascontiguousarray(v, "<f8").tobytes()).decode()] for k, v in weights.items()}
    payload = {"format": 1, "features": features, "arrays": arrays}
    return json.dumps({"payload": payload, "sha256": _digest(payload)}, sort_keys=True)


def load(text: str, features: list[str]) -> Weights:
    """The weights of a checkpoint; raises where its digest, format or feature names are not what they should be."""
    found = json.loads(text)
    if set(found) != {"payload", "sha256"} or _digest(found["payload"]) != found["sha256"]:
        raise ValueError("the checkpoint is damaged")
    payload = found["payload"]
    if payload["format"] != 1 or payload["features"] != features:
        raise ValueError("the checkpoint was made for other features")
    return Weights({k: np.frombuffer(base64.b64decode(b), "<f8").reshape(shape) for k, (shape, b) in payload["arrays"].items()})


def contract(rows: np.ndarray, features: list[str], bounds: dict[str, tuple[float, float]], cap: int) -> np.ndarray:
    """ML-19: ``rows`` if they are as wide as the schema, finite, within the bounds of their features and no more than ``cap``."""
    if rows.ndim != 2 or rows.shape[1] != len(features) or len(rows) > cap or not np.isfinite(rows).all():
        raise ValueError("features break their schema")
    for name, (lo, hi) in bounds.items():
        x = rows[:, features.index(name)]
        if ((x < lo) | (x > hi)).any():
            raise ValueError(f"{name} leaves {lo} to {hi}")
    return rows
