"""Places where models plug in: batch encoders, refiners, writers and span readers (ML-10..13, 16).

A hook is a factory: it is called once in each Python worker and gives a function of
a batch, so that a model is loaded once and never pickled.  Without models, the
fixtures below are deterministic functions of their input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Factory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def map_model(df: DataFrame, factory: Factory, schema: str) -> DataFrame:
    """Rows through a model, batch by batch, with lazy set-up per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or factory()
            yield model(b)

    return df.mapInPandas(run, schema)


def fixture_encoder(dim: int = 16) -> Factory:
    """Unit vectors that a text's digest fixes: (id, text) to (id, embedding)."""

    def make():
        def encode(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t in b["text"]:
                seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "big")
                v = np.random.default_rng(seed).normal(size=dim)
                out.append((v / np.linalg.norm(v)).tolist())
            return pd.DataFrame({"id": b["id"], "embedding": out})

        return encode

    return make


def fixture_refiner(margin: float = 0.1) -> Factory:
    """A span shrunk by a share of its length; a refusal where nothing is left: (id, start_s, end_s) to (id, start_s, end_s, status)."""

    def make():
        def refine(b: pd.DataFrame) -> pd.DataFrame:
            w = (b["end_s"] - b["start_s"]) * margin
            ok = (b["end_s"] - b["start_s"]) > 0
            return pd.DataFrame({"id": b["id"], "start_s": (b["start_s"] + w).where(ok), "end_s": (b["end_s"] - w).where(ok), "status": np.where(ok, "ok", "not_found")})

        return refine

    return make


def linear_head(weights: list[float], bias: float, mean: list[float], scale: list[float]) -> Factory:
    """Inference of a standardised linear head (MTH-19): (id, features) to (id, score)."""

    def make():
        w, m, s = (np.asarray(x, float) for x in (weights, mean, scale))

        def predict(b: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(b["features"].to_numpy()) if len(b) else np.zeros((0, len(w)))
            return pd.DataFrame({"id": b["id"], "score": ((x - m) / s) @ w + bias})

        return predict

    return make
