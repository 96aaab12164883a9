"""Document functions that Spark has no expression for, as Arrow-batched pandas UDFs (JSN-01, JSN-02, JSN-04, JSN-05; MEM-05)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def first_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` of a text; braces inside strings do not count."""
    if not text:
        return None
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text):
        if start < 0:
            if c == "{":
                start, depth = i, 1
        elif quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def parse_document(text: str | None) -> tuple[str, str]:
    """(status, canonical document): valid, repaired (a trailing comma removed) or fallback."""
    found = first_object(text)
    if found is not None:
        for status, candidate in (("valid", found), ("repaired", _without_trailing_commas(found))):
            try:
                return status, canonical(json.loads(candidate))
            except ValueError:
                continue
    return "fallback", canonical({"events": [], "unknown": True})


def _without_trailing_commas(text: str) -> str:
    out: list[str] = []
    quoted = escaped = False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "}]":
            at = len(out)
            while at and out[at - 1].isspace():
                at -= 1
            if at and out[at - 1] == ",":
                del out[at - 1]
        out.append(c)
    return "".join(out)


def sized(document: dict) -> dict:
    """A document with its own serialised size in ``byte_size``, as a fixed point (MEM-05)."""
    size = 0
    while True:
        now = len(canonical({**document, "byte_size": size}).encode())
        if now == size:
            return {**document, "byte_size": size}
        size = now


@F.pandas_udf(StringType())
def extract_object(text: pd.Series) -> pd.Series:
    return text.map(first_object)


@F.pandas_udf(StructType([StructField("status", StringType()), StructField("document", StringType())]))
def parse(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_document(t) for t in text], columns=["status", "document"])
