"""Configuration layers and run control on the driver: plain dictionaries, no cluster needed."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path, PurePosixPath


def layered(layers: list[dict], schema: dict, forbidden: set[str] = frozenset()) -> dict:
    """SRC-16, SRC-17, SRC-25: later layers over earlier ones, section by section.

    ``schema`` gives every key its type (or a nested schema); an unknown or
    forbidden key, a missing one or a value of another type raises.
    """

    def put(into: dict, layer: dict, shape: dict, path: str) -> None:
        for k, v in layer.items():
            name = f"{path}{k}"
            if k in forbidden:
                raise ValueError(f"forbidden key: {name}")
            if k not in shape:
                raise ValueError(f"unknown key: {name}")
            if isinstance(shape[k], dict):
                if not isinstance(v, dict):
                    raise ValueError(f"{name} is a section")
                put(into.setdefault(k, {}), v, shape[k], f"{name}.")
            elif isinstance(v, bool) and shape[k] is not bool or not isinstance(v, (int, float) if shape[k] is float else shape[k]):
                raise ValueError(f"{name} is no {shape[k].__name__}")
            else:
                into[k] = v

    def whole(got: dict, shape: dict, path: str) -> None:
        for k, t in shape.items():
            if k not in got:
                raise ValueError(f"missing key: {path}{k}")
            if isinstance(t, dict):
                whole(got[k], t, f"{path}{k}.")

    out: dict = {}
    for layer in layers:
        put(out, layer, schema, "")
    whole(out, schema, "")
    return out


def in_ranges(config: dict, ranges: dict[str, tuple[float, float]], pairs: set[tuple] | None = None, pair: tuple[str, str] | None = None) -> dict:
    """PRJ-27: ``config`` if the values at dotted keys are finite and in their closed ranges, and a pair of keys is a supported one."""

    def at(key: str):
        v = config
        for k in key.split("."):
            v = v[k]
        return v

    for key, (lo, hi) in ranges.items():
        if not math.isfinite(at(key)) or not lo <= at(key) <= hi:
            raise ValueError(f"{key} is {at(key)}, not within {lo} to {hi}")
    if pairs is not None and (at(pair[0]), at(pair[1])) not in pairs:
        raise ValueError(f"unsupported pair: {at(pair[0])}, {at(pair[1])}")
    return config


def flat(config: dict, path: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flat(v, f"{path}{k}.") if isinstance(v, dict) else {f"{path}{k}": v}
    return out


def differ_only_in(a: dict, b: dict, allowed: set[str]) -> set[str]:
    """PRJ-23: the dotted keys in which two configurations differ; raises where one of them is not ``allowed``."""
    x, y = flat(a), flat(b)
    keys = {k for k in x.keys() | y.keys() if x.get(k, ...) != y.get(k, ...)}
    if keys - allowed:
        raise ValueError(f"configurations differ in {sorted(keys - allowed)}")
    return keys


def size_of(text: str) -> int:
    """STR-15: bytes of ``256k``, ``1m`` or a plain number."""
    found = re.fullmatch(r"\s*([0-9.]+)([kKmM]?)\s*", text)
    if not found:
        raise ValueError(f"no size: {text}")
    number, unit = float(found[1]), {"": 1, "k": 1 << 10, "m": 1 << 20}[found[2].lower()]
    return int(number * unit)


def inside(path: str) -> bool:
    """PRJ-14: a relative path that never leaves its root."""
    p = PurePosixPath(path)
    return bool(path) and not p.is_absolute() and ".." not in p.parts


def versioned(path: str, version: str, root: str = "results") -> str:
    """SNK-09: the version right under ``root``; a path that has it there already stays."""
    parts = list(PurePosixPath(path).parts)
    if root not in parts:
        raise ValueError(f"{path} is not under {root}")
    at = parts.index(root) + 1
    return str(PurePosixPath(*parts)) if parts[at : at + 1] == [version] else str(PurePosixPath(*parts[:at], version, *parts[at:]))


def provenance(config: dict, version: str, runtime: dict[str, str], command: list[str] | None = None, overrides: dict | None = None) -> str:
    """SNK-07, SNK-08: what a run is made of, as canonical JSON."""
    record = {"config": config, "version": version, "runtime": runtime} | ({"command": command} if command else {}) | ({"overrides": overrides} if overrides else {})
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


def backfill(paths: list[str], version: str, root: str = "results") -> list[tuple[str, str]]:
    """CTL-21: (old, new) of outputs that are not yet under their version; two that would meet raise."""
    moves = [(p, versioned(p, version, root)) for p in paths]
    moves = [(a, b) for a, b in moves if a != b]
    targets = [b for _, b in moves]
    if len(set(targets)) != len(targets) or set(targets) & set(paths):
        raise ValueError("outputs would overwrite one another")
    return moves


def freeze(config: dict, gates: dict[str, bool]) -> dict:
    """CTL-03: the configuration marked frozen, only if every gate passed; a frozen one is not frozen again."""
    if config.get("status") == "frozen":
        raise ValueError("frozen already")
    failed = sorted(k for k, ok in gates.items() if not ok)
    if failed or not gates:
        raise ValueError(f"gates not passed: {failed}")
    return config | {"status": "frozen", "gates": sorted(gates)}


class Timer:
    """CTL-19: wall and CPU seconds of named components, also of those that raise."""

    def __init__(self):
        self.records: list[dict] = []

    @contextmanager
    def component(self, name: str) -> Iterator[None]:
        wall, cpu, ok = time.perf_counter(), time.process_time(), False
        try:
            yield
            ok = True
        finally:
            self.records.append({"component": name, "wall_s": time.perf_counter() - wall, "cpu_s": time.process_time() - cpu, "ok": ok})


def report(rows: list[dict], columns: list[str], expected: int | None = None) -> str:
    """SNK-12, SNK-13: a Markdown table in the order of its first column; a table that lacks rows raises."""
    if expected is not None and len(rows) != expected:
        raise ValueError(f"{len(rows)} rows instead of {expected}")
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in sorted(rows, key=lambda r: str(r.get(columns[0])))]
    return "\n".join(lines) + "\n"


def read_guard(allowed: list[str], root: str):
    """PRJ-15: a function that hands a path on only if it is one of ``allowed`` below ``root``."""
    names = set(allowed)

    def check(path: str) -> Path:
        if not inside(path) or path not in names:
            raise PermissionError(path)
        return Path(root) / path

    return check
