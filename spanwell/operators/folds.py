"""Order-dependent operators as pure folds over one stream at a time.

A fold has ``start()`` and ``step(state, row) -> outputs``; rows come in (time, id)
order.  :func:`run_fold` applies it in batch, one stream a group, and
:mod:`spanwell.streaming.stateful` applies the same object to micro-batches, so
both give the same rows.  State is bounded by the parameters of the fold, never
by the length of the stream.

Every class and function names the ids of the inventory that it covers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Ewma:
    """WIN-09, MTH-24: past-only z-score against an exponentially weighted mean and variance; the output precedes the update."""

    schema = "video_id long, frame_id long, z double, active boolean"

    def __init__(self, alpha: float = 0.2, warm: int = 5):
        self.alpha, self.warm = alpha, warm

    def start(self) -> dict:
        return {"n": 0, "mean": 0.0, "var": 0.0}

    def step(self, s: dict, r: dict) -> list[dict]:
        x = r["value"]
        delta = x - s["mean"] if s["n"] else 0.0
        z = delta / math.sqrt(s["var"]) if s["n"] >= self.warm and s["var"] > 0 else 0.0
        s["mean"] = s["mean"] + self.alpha * delta if s["n"] else x
        s["var"] = (1 - self.alpha) * (s["var"] + self.alpha * delta * delta)
        s["n"] += 1
        z = math.floor(z * 1e6 + 0.5) / 1e6
        return [{"video_id": r["video_id"], "frame_id": r["frame_id"], "z": z, "active": z >= 2.0}]


class TokenBucket:
    """STM-07: a bucket of capacity one beside a ceiling that grows with time; what is rejected is never queued."""

    schema = "video_id long, frame_id long, admitted boolean"

    def __init__(self, per_day: float = 2.0, day: float = 86400.0):
        self.rate, self.day = per_day, day

    def start(self) -> dict:
        return {"tokens": 1.0, "last": 0.0, "calls": 0}

    def step(self, s: dict, r: dict) -> list[dict]:
        t = r["timestamp_s"]
        s["tokens"] = min(1.0, s["tokens"] + (t - s["last"]) / self.day * self.rate)
        s["last"] = t
        ceiling = max(1, math.floor(t / self.day * self.rate) + 1)
        ok = s["tokens"] >= 1.0 and s["calls"] < ceiling
        if ok:
            s["tokens"] -= 1.0
            s["calls"] += 1
        return [{"video_id": r["video_id"], "frame_id": r["frame_id"], "admitted": ok}]


class DueClock:
    """TIM-04, STM-06: a frame is due once a period has passed since the last accepted one."""

    schema = "video_id long, frame_id long"

    def __init__(self, period: float = 43200.0):
        self.period = period

    def start(self) -> dict:
        return {"last": None}

    def step(self, s: dict, r: dict) -> list[dict]:
        if s["last"] is not None and r["timestamp_s"] - s["last"] < self.period:
            return []
        s["last"] = r["timestamp_s"]
        return [{"video_id": r["video_id"], "frame_id": r["frame_id"]}]


class JointTrigger:
    """STM-05: the longest gap beats the shortest, a hard cut passes both; weights renormalise where the semantic signal is missing."""

    schema = "video_id long, frame_id long, reason string"

    def __init__(self, least: float = 21600.0, most: float = 172800.0, threshold: float = 0.7, weights: tuple[float, float] = (0.6, 0.4)):
        self.least, self.most, self.threshold, self.weights = least, most, threshold, weights

    def start(self) -> dict:
        return {"last": None}

    def step(self, s: dict, r: dict) -> list[dict]:
        t, lite = r["timestamp_s"], r["value"] / 500.0
        semantic = None if r["kind"] == "view" else (r["frame_id"] % 100) / 100.0
        a, b = self.weights
        score = lite if semantic is None else (a * lite + b * semantic) / (a + b)
        gap = None if s["last"] is None else t - s["last"]
        if gap is None:
            reason = "first"
        elif r["kind"] == "error":
            reason = "hard_cut"
        elif gap >= self.most:
            reason = "max_gap"
        elif gap < self.least:
            return []
        elif score >= self.threshold:
            reason = "threshold"
        else:
            return []
        s["last"] = t
        return [{"video_id": r["video_id"], "frame_id": r["frame_id"], "reason": reason}]


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


class SemanticReservoir:
    """TOP-10, MTH-05: temporal anchors and the most novel frames; novelty is fixed on arrival, a displaced anchor is dropped."""

    schema = "video_id long, frame_id long, selection string, slot int, novelty double"

    def __init__(self, slots: int = 4, novel: int = 4):
        self.slots, self.novel = slots, novel

    def start(self) -> dict:
        return {"anchors": {}, "novel": []}

    def step(self, s: dict, r: dict) -> list[dict]:
        v = _unit(r["embedding"])
        kept = [a["v"] for a in s["anchors"].values()] + [n["v"] for n in s["novel"]]
        novelty = 1.0 if not kept else min(2.0, max(0.0, 1.0 - max(float(v @ np.asarray(k)) for k in kept)))
        d = max(r["duration_s"], 1e-9)
        slot = min(self.slots - 1, int(r["timestamp_s"] / d * self.slots))
        far = abs(r["timestamp_s"] - (slot + 0.5) * d / self.slots)
        item = {"id": r["frame_id"], "video_id": r["video_id"], "v": v.tolist(), "novelty": novelty, "far": far, "slot": slot}
        old = s["anchors"].get(slot)
        if old is None or far < old["far"]:
            s["anchors"][slot] = item
        else:
            s["novel"].append(item)
            s["novel"].sort(key=lambda n: (-n["novelty"], n["id"]))
            del s["novel"][self.novel :]
        return []

    def finish(self, s: dict) -> list[dict]:
        rows = [(a, "anchor") for a in s["anchors"].values()] + [(n, "novel") for n in s["novel"]]
        return [{"video_id": a["video_id"], "frame_id": a["id"], "selection": kind, "slot": a["slot"], "novelty": math.floor(a["novelty"] * 1e6 + 0.5) / 1e6} for a, kind in rows]


class EventMemory:
    """MEM-10, WIN-11, AGG-36, STM-13: a hierarchy of events: frames join the open event while alike and near, closed events age upwards.

    Every level is a queue with a capacity; the bottom one counts the open event.
    An event that finds its queue full sends the two oldest there up as one, like
    the carry of a counter; at the top the pair goes back to the front instead.
    So supports always add up to the frames seen.  An event is
    [support, direction, start, end, first frame, last frame].
    """

    schema = "video_id long, level int, event int, start_s double, end_s double, support long, first_frame long, last_frame long"

    def __init__(self, caps: tuple[int, ...] = (8, 4, 2), alike: float = 0.1, span: float = 172800.0):
        self.rooms = (caps[0] - 1, *caps[1:])
        self.caps, self.alike, self.span = caps, alike, span

    def start(self) -> dict:
        return {"video_id": None, "open": [], "levels": [[] for _ in self.caps]}

    @staticmethod
    def fuse(a: list, b: list) -> list:
        """Two events in order as one; its direction is the mean of theirs by support, of length one."""
        return [a[0] + b[0], _unit(a[0] * np.asarray(a[1]) + b[0] * np.asarray(b[1])), a[2], b[3], a[4], b[5]]

    def carry(self, levels: list[list], event: list) -> None:
        for queue, room in zip(levels, self.rooms, strict=True):
            queue.append(event)
            if len(queue) <= room:
                return
            event = self.fuse(queue[0], queue[1])
            del queue[:2]
        levels[-1].insert(0, event)

    def step(self, s: dict, r: dict) -> list[dict]:
        t, now = r["timestamp_s"], [1, _unit(r["embedding"]), r["timestamp_s"], r["timestamp_s"], r["frame_id"], r["frame_id"]]
        s["video_id"] = r["video_id"]
        if s["open"]:
            held = s["open"]
            if t - held[2] <= self.span and float(np.dot(held[1], now[1])) >= self.alike:
                now = self.fuse(held, now)
            else:
                self.carry(s["levels"], held)
        s["open"] = now
        return []

    def finish(self, s: dict) -> list[dict]:
        found = [(e, i) for i, queue in enumerate(s["levels"]) for e in queue] + ([(s["open"], 0)] if s["open"] else [])
        names = ("support", "", "start_s", "end_s", "first_frame", "last_frame")
        return [{"video_id": s["video_id"], "level": i, "event": k} | {n: x for n, x in zip(names, e, strict=True) if n} for k, (e, i) in enumerate(sorted(found, key=lambda x: x[0][2]))]


class NearFarPool:
    """STM-16, MEM-15: a queue of near items; what leaves it joins the far pool, where the first gap-free adjacent pair is merged when full."""

    schema = "video_id long, pool string, place int, start_s double, end_s double, support long"

    def __init__(self, near: int = 8, far: int = 12, gap: float = 43200.0):
        self.near, self.far, self.gap = near, far, gap

    def start(self) -> dict:
        return {"near": [], "far": [], "video_id": None}

    def step(self, s: dict, r: dict) -> list[dict]:
        s["video_id"] = r["video_id"]
        s["near"].append([r["timestamp_s"], r["timestamp_s"], 1])
        if len(s["near"]) > self.near:
            s["far"].append(s["near"].pop(0))
        if len(s["far"]) > self.far:
            gaps = [b[0] - a[1] for a, b in zip(s["far"], s["far"][1:])]
            at = next((i for i, g in enumerate(gaps) if g <= self.gap), int(np.argmin(gaps)))
            a, b = s["far"][at], s["far"].pop(at + 1)
            s["far"][at] = [a[0], b[1], a[2] + b[2]]
        return []

    def finish(self, s: dict) -> list[dict]:
        return [{"video_id": s["video_id"], "pool": k, "place": i, "start_s": x[0], "end_s": x[1], "support": x[2]} for k in ("far", "near") for i, x in enumerate(s[k])]


class SegmentReservoir:
    """TOP-11, TOP-12, TOP-33, STM-08: half of a segment by greedy farthest times, half by value; a segment closes at a hard cut."""

    schema = "video_id long, segment int, frame_id long, part string"

    def __init__(self, capacity: int = 6, window: int = 64):
        self.capacity, self.window = capacity, window

    def start(self) -> dict:
        return {"segment": 0, "held": [], "video_id": None}

    def _close(self, s: dict) -> list[dict]:
        held, s["held"] = s["held"], []
        if not held:
            return []
        chosen = [held[0]]
        while len(chosen) < min(self.capacity // 2, len(held)):
            rest = [h for h in held if h not in chosen]
            chosen.append(max(rest, key=lambda h: (min(abs(h[0] - c[0]) for c in chosen), -h[1])))
        rest = sorted((h for h in held if h not in chosen), key=lambda h: (-h[2], h[1]))[: self.capacity - len(chosen)]
        out = [{"video_id": s["video_id"], "segment": s["segment"], "frame_id": h[1], "part": p} for p, hs in (("uniform", chosen), ("novel", rest)) for h in hs]
        s["segment"] += 1
        return out

    def step(self, s: dict, r: dict) -> list[dict]:
        s["video_id"] = r["video_id"]
        out = self._close(s) if r["kind"] == "error" or len(s["held"]) >= self.window else []
        s["held"].append([r["timestamp_s"], r["frame_id"], r["value"]])
        return out

    def finish(self, s: dict) -> list[dict]:
        return self._close(s)


class AdjacentForest:
    """MEM-06, MEM-07, MEM-12, MEM-22, STM-15, MTH-12: leaves in time order; beyond the cap the best adjacent pair of roots merges."""

    schema = "video_id long, root int, start_s double, end_s double, leaves long, depth int"

    def __init__(self, roots: int = 8):
        self.roots = roots

    def start(self) -> dict:
        return {"roots": [], "video_id": None}

    def step(self, s: dict, r: dict) -> list[dict]:
        s["video_id"] = r["video_id"]
        s["roots"].append([r["timestamp_s"], r["timestamp_s"], 1, 0])
        if len(s["roots"]) > self.roots:
            pairs = list(zip(s["roots"], s["roots"][1:]))
            at = min(range(len(pairs)), key=lambda i: (pairs[i][1][1] - pairs[i][0][0], i))
            a, b = pairs[at]
            s["roots"][at : at + 2] = [[a[0], b[1], a[2] + b[2], max(a[3], b[3]) + 1]]
        return []

    def finish(self, s: dict) -> list[dict]:
        return [{"video_id": s["video_id"], "root": i, "start_s": x[0], "end_s": x[1], "leaves": x[2], "depth": x[3]} for i, x in enumerate(s["roots"])]


FOLDS: dict[str, Callable] = {"ewma_zscore": Ewma, "token_bucket": TokenBucket, "due_clock": DueClock, "joint_trigger": JointTrigger, "semantic_reservoir": SemanticReservoir, "hierarchical_events": EventMemory, "near_far_pool": NearFarPool, "segment_reservoir": SegmentReservoir, "adjacent_forest": AdjacentForest}


def fold_rows(fold, rows: Iterator[dict]) -> list[dict]:
    state, out = fold.start(), []
    for r in rows:
        out += fold.step(state, r)
    return out + (fold.finish(state) if hasattr(fold, "finish") else [])


def frame_of(rows: list[dict], schema: str) -> pd.DataFrame:
    kinds = {"long": "int64", "int": "int32", "double": "float64", "boolean": "bool", "string": "object"}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pd.DataFrame(rows, columns=[n for n, _ in fields]).astype({n: kinds[k] for n, k in fields})


def _records(b: pd.DataFrame) -> Iterator[dict]:
    names = list(b.columns)
    for values in zip(*(b[c].tolist() for c in names), strict=True):
        yield dict(zip(names, values, strict=True))


def run_fold(frames: DataFrame, fold) -> DataFrame:
    """The outputs of ``fold`` over every video.

    Videos are dealt to tasks and sorted by the engine (which can spill); a task
    reads batch after batch and holds the state of one video, never its rows.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        end = lambda s: fold.finish(s) if s is not None and hasattr(fold, "finish") else []
        for b in batches:
            out: list[dict] = []
            for r in _records(b):
                if state is None or r["video_id"] != key:
                    out += end(state)
                    key, state = r["video_id"], fold.start()
                out += fold.step(state, r)
            yield frame_of(out, fold.schema)
        yield frame_of(end(state), fold.schema)

    dealt = frames.where(F.col("video_id").isNotNull()).repartition("video_id").sortWithinPartitions("video_id", "timestamp_s", "frame_id")
    return dealt.mapInPandas(apply, fold.schema)


def temporal_nms(candidates: DataFrame, threshold: float = 0.3, most: int = 5) -> DataFrame:
    """TOP-20, TOP-21: greedy suppression in (score, start, id) order, with the suppressor of each candidate.

    (query_id, candidate, pred_start, pred_end, score) to (query_id, place, candidate, kept, suppressor).
    A fold over the sorted pool of a query, in the JVM; pools are a handful of candidates.
    """
    entry = "struct<k:bigint,a:double,b:double>"
    row = "struct<place:bigint,candidate:bigint,kept:boolean,suppressor:bigint>"
    pool = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("candidate").alias("c"), F.col("pred_start").alias("a"), F.col("pred_end").alias("b")))).alias("cs")
    )

    def step(s, x):
        place = (F.size(s["out"]) + 1).cast("long")
        common = lambda k: F.least(x["b"], k["b"]) - F.greatest(x["a"], k["a"])
        union = lambda k: (x["b"] - x["a"]) + (k["b"] - k["a"]) - common(k)
        near = F.filter(s["held"], lambda k: (common(k) > 0) & (union(k) > 0) & (common(k) / union(k) >= threshold))
        by = F.when(F.size(near) > 0, F.element_at(near, F.when(F.size(near) > 0, 1).otherwise(-1))["k"]).otherwise(F.lit(0).cast("long"))
        ok = (F.size(near) == 0) & (F.size(s["held"]) < most)
        grown = F.concat(s["held"], F.array(F.struct(place.alias("k"), x["a"].alias("a"), x["b"].alias("b"))))
        return F.struct(F.when(ok, grown).otherwise(s["held"]).alias("held"), F.concat(s["out"], F.array(F.struct(place.alias("place"), x["c"].alias("candidate"), ok.alias("kept"), by.alias("suppressor")))).alias("out"))

    start = F.struct(F.expr(f"cast(array() as array<{entry}>)").alias("held"), F.expr(f"cast(array() as array<{row}>)").alias("out"))
    return pool.select("query_id", F.explode(F.aggregate("cs", start, step, lambda s: s["out"])).alias("r")).select("query_id", "r.*")


def mmr_select(frames: DataFrame, k: int = 5, like: float = 0.5, near: float = 0.2) -> DataFrame:
    """TOP-22, RET-06: greedy picks by score less likeness to, and nearness in time of, what is picked."""
    schema = "video_id long, place int, frame_id long, gain double"

    def apply(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["timestamp_s", "frame_id"], kind="stable").reset_index(drop=True)
        v = np.stack([_unit(x) for x in g["embedding"]])
        q = np.stack([_unit(x) for x in g["q_emb"]])
        score, t = (v * q).sum(1), g["timestamp_s"].to_numpy() / max(g["duration_s"].iloc[0], 1e-9)
        left, picked, out = list(range(len(g))), [], []
        while left and len(picked) < k:
            gains = {i: score[i] - (like * max(max(0.0, float(v[i] @ v[j])) for j in picked) + near * max(1 - abs(t[i] - t[j]) for j in picked) if picked else 0.0) for i in left}
            i = min(left, key=lambda i: (-round(gains[i], 12), g["frame_id"][i]))
            picked.append(i)
            left.remove(i)
            out.append({"video_id": g["video_id"][i], "place": len(picked), "frame_id": g["frame_id"][i], "gain": math.floor(float(gains[i]) * 1e6 + 0.5) / 1e6})
        return frame_of(out, schema)

    return frames.groupBy("video_id").applyInPandas(apply, schema)
