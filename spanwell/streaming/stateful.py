"""Folds over live streams, and the single-pass ingest with as-of snapshots.

``stream_fold`` runs a fold of :mod:`spanwell.operators.folds` under
``transformWithStateInPandas``: the state of a stream is one JSON value in the
state store (RocksDB), so a restart from the checkpoint goes on where it stopped
(STM-18), and every row is consumed once (SRC-05).  ``snapshots`` is STM-01: a
snapshot is taken before the first frame after its time, or right after the
first frame at exactly its time; arrivals later than the last frame come from a
flush at the end of the input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import fold_rows, frame_of


def _plain(x):
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return x.tolist()
    return {_plain(k): _plain(v) for k, v in x.items()} if isinstance(x, dict) else [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def dump(state: dict) -> str:
    """State as JSON; integer keys are marked, so that they come back as integers."""

    def keys(x):
        if isinstance(x, dict):
            return {("#" + str(k) if isinstance(k, int) else k): keys(v) for k, v in x.items()}
        return [keys(v) for v in x] if isinstance(x, list) else x

    return json.dumps(keys(_plain(state)))


def load(text: str) -> dict:
    def keys(x):
        if isinstance(x, dict):
            return {(int(k[1:]) if k.startswith("#") else k): keys(v) for k, v in x.items()}
        return [keys(v) for v in x] if isinstance(x, list) else x

    return keys(json.loads(text))


class FoldProcessor(StatefulProcessor):
    """One fold per key.  Rows of a micro-batch are sorted; a row older than the last one seen is late and raises (STM-02)."""

    def __init__(self, fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "state string, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state, last = (load(held[0]), held[1]) if held else (self.fold.start(), float("-inf"))
        batch = pd.concat(list(rows)).sort_values(["timestamp_s", "frame_id"], kind="stable")
        out: list[dict] = []
        for r in batch.to_dict("records"):
            if r["timestamp_s"] < last:
                raise ValueError(f"stream {key} went back from {last} to {r['timestamp_s']}")
            last = r["timestamp_s"]
            out += self.fold.step(state, r)
        self.state.update((dump(state), last))
        yield frame_of(out, self.fold.schema)

    def close(self) -> None:
        pass


def stream_fold(frames: DataFrame, fold) -> DataFrame:
    """Outputs of ``fold`` over a streaming ``frames`` (video_id, frame_id, timestamp_s, ...)."""
    return frames.groupBy("video_id").transformWithStateInPandas(statefulProcessor=FoldProcessor(fold), outputStructType=fold.schema, outputMode="append", timeMode="none")


class AsOf:
    """STM-01, STM-17: a fold that hands out what another fold holds at the times of a plan, each once."""

    def __init__(self, fold, times: dict[int, list[float]]):
        self.fold, self.times = fold, times
        self.schema = f"t_q double, {fold.schema}"

    def start(self) -> dict:
        return {"inner": self.fold.start(), "done": 0}

    def _take(self, s: dict, t_q: float) -> list[dict]:
        s["done"] += 1
        inner = load(dump(s["inner"]))  # a copy: taking a snapshot changes nothing
        return [{"t_q": t_q, **r} for r in self.fold.finish(inner)]

    def step(self, s: dict, r: dict) -> list[dict]:
        plan, out = self.times.get(r["video_id"], []), []
        while s["done"] < len(plan) and plan[s["done"]] < r["timestamp_s"]:
            out += self._take(s, plan[s["done"]])
        self.fold.step(s["inner"], r)
        while s["done"] < len(plan) and plan[s["done"]] == r["timestamp_s"]:
            out += self._take(s, plan[s["done"]])
        s["video_id"] = r["video_id"]
        return out

    def finish(self, s: dict) -> list[dict]:
        out = []
        for t_q in self.times.get(s.get("video_id"), [])[s["done"] :]:
            out += self._take(s, t_q)
        return out


def snapshots(rows: list[dict], fold, times: dict[int, list[float]]) -> list[dict]:
    """Snapshots of one stream in a single pass."""
    return fold_rows(AsOf(fold, times), iter(rows))
