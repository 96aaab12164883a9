"""Substring dedup by level-wise doubling.

Level 1 looks at windows of half the wanted length.  Of the half windows inside
each whole window only the one with the smallest hash is taken (equal windows
take the same one), about one in fourteen.  Those found in one document alone
are dropped; windows around the others are extended to twice the length, hashed
and counted again; windows that repeat there are paired with the window that
follows them for the next doubling, until no candidates survive.

A window goes where its word sequence also starts in a document with a smaller
doc_id, and so does every word it covers.  Windows are judged on the input.
Documents with the same words are searched once: the copies of a document are
covered by it as a whole.

Defined results: null or empty texts have no words; texts shorter than a window
lose nothing; a null doc_id counts as the largest (two nulls as equal); rows with
equal doc_id never cover one another; repeated rows get equal results; an empty
table gives no rows; further columns are ignored.

Hashes have 64 bits at the first level, where a clash only costs work.  Where
words are removed they have 128: two window hashes over word hashes of two
independent keys, or a SHA-256 of the whole text cut to 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Stored, scratch

LAST = 9223372036854775807


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over ``width`` values."""
    have, low = 1, x
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if width > have else low


def anchors(w: np.ndarray, woffs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows of ``length`` words, hash of the least half window inside each)."""
    half = length // 2
    starts = W.ranges(woffs[:-1], W.row_windows(woffs, length))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    return starts, _smallest(W.window_hashes(w, half), length - half + 1)[starts]


def _runs(data, offs):
    for lo, hi in W.slices(offs):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        yield lo, hi, d, o, W.Words(d, o)


def _plain(text: np.ndarray):
    """SHA-256 of the words of a text joined by single spaces."""
    return hashlib.sha256(b" ".join(text.tobytes().split()))


def _profile(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = W.buffers(b.column("text"))
            for lo, hi, d, o, found in _runs(data, offs):
                wo = found.rows
                starts, least = anchors(found.hash(), wo, length)
                row = np.searchsorted(wo, starts, "right") - 1
                if len(starts):
                    new = np.ones(len(starts), bool)
                    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                    row, least = row[new], least[new]
                sha = [_plain(d[o[i] : o[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column("doc_id").slice(lo, hi - lo),
                        "th": b.column("th").slice(lo, hi - lo),
                        "node": pa.array([x.digest()[:16] for x in sha], pa.binary()),
                        "n_words": pa.array(np.diff(wo)),
                        "sha": pa.array([x.hexdigest() for x in sha]),
                        "seeds": W.list_array(W.long_bytes(least), np.searchsorted(row, np.arange(hi - lo + 1))),
                    }
                )

    return run


def _extend(length: int):
    """Windows of ``length`` around surviving seeds: (rank, th, at, hash, check), two hashes each, of independent word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = W.buffers(b.column("text"))
            live = b.column("seeds")
            for lo, hi, _, _, found in _runs(data, offs):
                w, wo = found.hash(), found.rows
                starts, least = anchors(w, wo, length)
                row = np.searchsorted(wo, starts, "right") - 1
                keep = np.zeros(len(starts), bool)
                for i in range(hi - lo):
                    a, z = np.searchsorted(row, [i, i + 1])
                    keep[a:z] = np.isin(least[a:z].view(np.int64), live[lo + i].values.to_numpy(zero_copy_only=False))
                starts, row = starts[keep], row[keep]
                at = starts - wo[row]
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                two = [W.window_hashes(x, length)[starts] if len(starts) else np.zeros(0, np.uint64) for x in (w, found.hash(1))]
                yield pa.RecordBatch.from_pydict(
                    {
                        "rank": b.column("rank").slice(lo, hi - lo),
                        "th": b.column("th").slice(lo, hi - lo),
                        "at": W.list_array(at.astype(np.int32), cut),
                        "hash": W.list_array(W.long_bytes(two[0]), cut),
                        "check": W.list_array(W.long_bytes(two[1]), cut),
                    }
                )

    return run


WINDOWS = "rank long, th long, at array<int>, hash array<long>, check array<long>"


def _merge(length: int):
    """(texts, starts of windows to remove) to (text kept, removed word ranges, sha), a text at a time and a slice a batch."""
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = W.buffers(b.column("text"))
            for lo, hi in W.slices(offs):
                out: dict[str, list] = {"n_removed": [], "removed": [], "kept_text": [], "sha": []}
                for i in range(lo, hi):
                    raw = data[offs[i] : offs[i + 1]].tobytes().split()
                    at = b.column("bad")[i].values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
                    kept = b" ".join(raw[j] for j in np.flatnonzero(~covered))
                    out["removed"].append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                    out["n_removed"].append(int(covered.sum()))
                    out["kept_text"].append(kept.decode("utf-8"))
                    out["sha"].append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_pydict(
                    {"node": b.column("node").slice(lo, hi - lo), "n_removed": pa.array(out["n_removed"], pa.int64()), "removed": pa.array(out["removed"], ranges), "kept_text": pa.array(out["kept_text"], pa.string()), "kept_sha256": pa.array(out["sha"], pa.string())}
                )

    return run


class SubstringDedup:
    """One run over ``docs`` (doc_id, text) for windows of ``length`` (even) words."""

    def __init__(self, docs: DataFrame, length: int = 50):
        if length < 2 or length % 2:
            raise ValueError("length must be even: its half is the first level")
        self.length = length
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.docs = self.docs.withColumn("th", F.xxhash64("text"))
        self.profile = Stored(self.docs.mapInArrow(_profile(length), "doc_id long, th long, node binary, n_words long, sha string, seeds array<long>"), "sub-profile").df

    def _texts(self) -> DataFrame:
        """(rank, th, node, text, seeds) of one document of each content that holds a repeated seed; (rank, th) names it in two longs."""
        slim = self.profile.where(F.size("seeds") > 0).groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "th")).alias("p"), F.first("seeds").alias("seeds"))
        slim = slim.select("node", "p.rank", "p.th", "seeds")
        seeds = slim.select("rank", "th", F.explode("seeds").alias("seed"))
        shared = seeds.groupBy("seed").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("seed")
        # stored, so that both sides of the join have a shuffle of their own, and hot seeds can be split
        live = seeds.join(Stored(shared, "sub-shared").df, "seed").groupBy("rank", "th").agg(F.collect_set("seed").alias("live"))
        live = live.join(slim.select("rank", "th", "node"), ["rank", "th"]).select(F.col("rank"), F.col("th").alias("h"), "node", F.col("live").alias("seeds"))
        docs = self.docs.withColumn("r", F.coalesce("doc_id", F.lit(LAST)))
        found = docs.join(live, (F.col("r") == F.col("rank")) & (F.col("th") == F.col("h")))
        return found.select("rank", "th", "node", "text", "seeds").dropDuplicates(["rank", "th"])

    def windows(self) -> DataFrame:
        """Stores and gives (hash, check, rank, th, at) of every window whose seed repeats."""
        self.texts = Stored(self._texts(), "sub-texts").df
        per_text = Stored(self.texts.mapInArrow(_extend(self.length), WINDOWS), "sub-windows").df
        z = F.explode(F.arrays_zip("at", "hash", "check")).alias("z")
        return per_text.select("rank", "th", z).select("rank", "th", "z.at", "z.hash", "z.check")

    def removals(self) -> DataFrame:
        """(rank, th, bad): starts of the windows that an earlier document holds."""
        w = self.windows()
        lead = w.groupBy("hash", "check").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("hash", "check", "low")
        self.repeated = w.join(Stored(lead, "sub-lead").df, ["hash", "check"])
        return self.repeated.where(F.col("rank") > F.col("low")).groupBy("rank", "th").agg(F.collect_list("at").alias("bad"))

    def cleaned(self) -> DataFrame:
        """(node, n_removed, removed, kept_text, kept_sha256) of contents that lose some words to another content."""
        bad = self.removals()
        return self.texts.select("rank", "th", "node", "text").join(bad, ["rank", "th"]).select("node", "text", "bad").mapInArrow(
            _merge(self.length), "node binary, n_removed long, removed array<struct<start:int,end:int>>, kept_text string, kept_sha256 string"
        )

    def result(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) for every row."""
        with scratch() as kept:
            cut = Stored(self.cleaned().select("node", "n_removed", F.col("kept_sha256").alias("cut_sha")), "sub-cut").df
            kept.append(cut)
        first = self.profile.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("rank"))
        # stored, so that one join of two shuffles is left, in which a text with many copies can be split
        known = Stored(first.join(cut, "node", "left"), "sub-known").df
        rows = self.profile.select("doc_id", "node", "n_words", "sha").join(known, "node")
        copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("rank")) & (F.col("n_words") >= self.length)
        none = hashlib.sha256(b"").hexdigest()
        return rows.select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(none)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        )


def longest_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, longest): the largest doubling of ``length`` at which a document still holds a window of another one; 0 for none.

    A window of 2L words is known by the two windows of L words it consists of,
    so a level joins survivors to survivors and never reads a text again.
    """
    run = SubstringDedup(docs, length)
    run.removals()
    level, size = Stored(run.repeated.select("rank", "th", "at", "hash", "check"), "sub-level").df, length
    best = level.select("rank", "th", F.lit(size).alias("longest")).distinct()
    while level.limit(1).count():
        nxt = level.select(F.col("rank").alias("r2"), F.col("th").alias("t2"), (F.col("at") - size).alias("a2"), F.col("hash").alias("h2"), F.col("check").alias("c2"))
        pair = level.join(nxt, (F.col("rank") == F.col("r2")) & (F.col("th") == F.col("t2")) & (F.col("at") == F.col("a2")))
        pair = pair.select("rank", "th", "at", F.xxhash64("hash", "h2", "check").alias("hash"), F.xxhash64("check", "c2", "hash").alias("check"))
        lead = pair.groupBy("hash", "check").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("hash", "check")
        size *= 2
        level = Stored(pair.join(lead, ["hash", "check"]), "sub-level").df
        best = best.unionByName(level.select("rank", "th", F.lit(size).alias("longest")).distinct())
    best = best.groupBy("rank", "th").agg(F.max("longest").alias("longest")).join(run.texts.select("rank", "th", "node"), ["rank", "th"]).select("node", "longest")
    copies = run.profile.groupBy("node").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    rows = run.profile.select("doc_id", "node", "n_words").join(copies, "node").join(best, "node", "left")
    # a content that several documents share repeats as a whole
    whole = F.when((F.col("a") < F.col("b")) & (F.col("n_words") >= length), F.lit(length) * F.pow(F.lit(2), F.floor(F.log2(F.col("n_words") / length)))).otherwise(0)
    return rows.select("doc_id", F.greatest(F.coalesce("longest", F.lit(0)), whole).cast("long").alias("longest"))
