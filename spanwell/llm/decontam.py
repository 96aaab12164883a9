"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of words (lower case, parted by every ASCII byte
that is no letter or digit).  An item of n words is found where a passage is
within k = floor(0.2 n) word edits of it (similarity 0.8 or more).

* Windows: within k edits, one of k + 1 pieces of the item survives untouched,
  so only item-sized windows that hold a run of floor(n / (k + 1)) of the item's
  words in a row are looked at, on the diagonal that the run gives.  This is
  exact; it drops no passage.
* CGK: a random walk over a window copies the word under its pointer to the
  output and moves on by a bit that the step and the word fix.  Two sequences
  with few edits fall back into step, so edit distance becomes Hamming distance.
* LSH: each of ``TABLES`` tables samples ``SAMPLED`` places of one of ``WALKS``
  walks; an item and a window that agree in one table are a candidate pair.
* Verification: the least edit distance of the item to any passage around the
  window, by dynamic programming.  Nothing is reported unverified.

Items are broadcast in blocks of at most ``BLOCK_WORDS`` words; a larger
benchmark takes one pass over the documents for each block.

Defined results: null or empty texts hold nothing; null or empty items are found
nowhere; repeated items are reported under each id, repeated rows on their own;
a null id stays null; empty tables give no rows; further columns are ignored, or
kept by :func:`clean_documents`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import packed

WALKS, TABLES, SAMPLED = 16, 64, 2
#: Share of an item's words that may be edited, as a fraction.
EDITS, OF = 1, 5
BLOCK_WORDS = 2_000_000
#: Windows, or words of windows, that are held at once.
EXPANDED = 1 << 20
_PAD = np.uint64(0xA0761D6478BD642F)

_rng = np.random.default_rng(77003141)
_STEPS = _rng.integers(1, 2**63, (WALKS, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PICKS = _rng.random((TABLES, SAMPLED))


def tolerance(n: int) -> int:
    return n * EDITS // OF


def run_length(n: int) -> int:
    """Words in a row that survive ``tolerance(n)`` edits somewhere; runs are looked up at up to 4 words."""
    return min(4, n // (tolerance(n) + 1))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = W.Words(data, offs, W.PUNCT, lower=True)
    return found.hash(), found.rows


def embed_keys(x: np.ndarray) -> np.ndarray:
    """(windows, TABLES) keys of CGK embeddings of the rows of ``x`` (windows, n)."""
    m, n = x.shape
    flat = np.hstack([x, np.full((m, 1), _PAD)]).reshape(-1)
    base = np.arange(m) * (n + 1)
    places = np.minimum((_PICKS * 2 * n).astype(int), 2 * n - 1)  # the walk has read all n words after 2n steps on average
    keys = np.zeros((m, TABLES), np.uint64) + W.mix64(np.arange(1, TABLES + 1, dtype=np.uint64))
    for walk in range(WALKS):
        wanted = defaultdict(list)
        for t in range(walk, TABLES, WALKS):
            for i, j in enumerate(places[t]):
                wanted[int(j)].append((t, i))
        at = np.zeros(m, np.int64)
        for j in range(max(wanted) + 1):
            word = flat[base + at]
            for t, i in wanted.get(j, ()):
                keys[:, t] += word * np.uint64(2 * i + 3)  # the same two places, told apart
            at = np.minimum(at + ((word * _STEPS[walk, j % 4096]) >> np.uint64(63)).astype(np.int64), n)
    return W.mix64(keys)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edits from ``item`` to any passage of ``text``, end of that passage)."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """Items of one block: runs of words to look up, and LSH keys."""

    def __init__(self, ids: list, texts: list[str]):
        data, offs = W.buffers(pa.array(texts, pa.string()))
        h, to = word_hashes(data, offs)
        self.ids = ids
        self.words = [h[to[i] : to[i + 1]] for i in range(len(ids))]
        self.size = np.array([len(w) for w in self.words], np.int64)
        runs = defaultdict(list)
        for i, w in enumerate(self.words):
            q = run_length(len(w))
            if q:
                g = W.window_hashes(w, q)
                runs[q].append((g, np.full(len(g), i), np.arange(len(g))))
        self.runs = {}
        for q, parts in runs.items():
            g, i, o = (np.concatenate(x) for x in zip(*parts, strict=True))
            # items of one length that share a run at one place ask for the same window
            order = np.lexsort((o, self.size[i], g))
            g, i, o = g[order], i[order], o[order]
            order = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (o[1:] != o[:-1]) | (self.size[i[1:]] != self.size[i[:-1]]))))
            seen = np.zeros(1 << 22, bool)
            seen[(g & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.runs[q] = (g[order], self.size[i[order]], o[order], seen)
        self.keys = {}
        for n in np.unique(self.size[self.size > 0]):
            own = np.flatnonzero(self.size == n)
            self.keys[int(n)] = (own, embed_keys(np.stack([self.words[i] for i in own])))

    def windows(self, w: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Distinct (row, start, length) of the windows to embed, ordered."""
        out = []
        for q, (g, size, o, seen) in self.runs.items():
            h = W.window_hashes(w, q)
            at = np.flatnonzero(seen[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if not len(at):
                continue
            row = np.searchsorted(to, at, "right") - 1
            inside = at + q <= to[row + 1]
            at, row = at[inside], row[inside]
            lo, hi = np.searchsorted(g, h[at], "left"), np.searchsorted(g, h[at], "right")
            # a run that many windows hold is expanded in blocks, and what they have in common is kept once
            cut = np.unique(np.searchsorted(np.cumsum(hi - lo), np.arange(0, int((hi - lo).sum()) + 1, EXPANDED), "left"))
            for x, y in zip(cut, [*cut[1:], len(at)], strict=True):
                n = hi[x:y] - lo[x:y]
                hit = W.ranges(lo[x:y], n)
                found = np.stack([np.repeat(row[x:y], n), np.repeat(at[x:y], n) - o[hit], size[hit]], 1)
                out.append(np.unique(found, axis=0))
        if not out:
            return np.zeros((0, 3), np.int64)
        return np.unique(np.concatenate(out), axis=0)

    def find(self, w: np.ndarray, to: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """{(row, item): (edits, start word)} of every item within its tolerance, verified."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        wanted = self.windows(w, to)
        for n in np.unique(wanted[:, 2]):
            own, keys = self.keys[int(n)]
            order = [np.argsort(keys[:, t], kind="stable") for t in range(TABLES)]
            mine = wanted[wanted[:, 2] == n]
            step = max(1, EXPANDED // int(n))
            for lo in range(0, len(mine), step):
                rows, starts = mine[lo : lo + step, 0], mine[lo : lo + step, 1]
                place = starts[:, None] + np.arange(n)
                ok = (place >= to[rows][:, None]) & (place < to[rows + 1][:, None])
                x = np.where(ok, w[np.clip(place, 0, len(w) - 1)], _PAD)
                got = embed_keys(x)
                pairs = []
                for t in range(TABLES):
                    ranked = keys[order[t], t]
                    a, b = np.searchsorted(ranked, got[:, t], "left"), np.searchsorted(ranked, got[:, t], "right")
                    some = np.flatnonzero(b > a)
                    if len(some):
                        pairs.append(np.stack([np.repeat(some, (b - a)[some]), own[order[t][W.ranges(a[some], (b - a)[some])]]], 1))
                for z, i in np.unique(np.concatenate(pairs), axis=0) if pairs else ():
                    row, start, k = int(rows[z]), int(starts[z]), tolerance(int(n))
                    if found.get((row, int(i)), (1 << 30, 0))[0] == 0:
                        continue
                    a, b = max(int(to[row]), start - k), min(int(to[row + 1]), start + int(n) + k)
                    edits, _ = edit_distance(self.words[i], w[a:b])
                    if edits <= k:
                        found[row, int(i)] = min(found.get((row, int(i)), (1 << 30, 0)), (edits, max(start - int(to[row]), 0)))
        return found


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of items, streamed to the driver one after the other."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].split()) + 1
        if size > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def _scan(texts: pa.Array, items: Items):
    data, offs = W.buffers(texts)
    for lo, hi in W.slices(offs):
        w, to = word_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        yield lo, hi, items.find(w, to)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_word) of every item that a document holds."""
    spark = docs.sparkSession
    item_type, doc_type = benchmark.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, edits int, item_words int, start_word int"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("doc_id")
                for lo, _, found in _scan(b.column("text"), shared.value):
                    hits = sorted(found)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": ids.take(pa.array([lo + r for r, _ in hits], pa.int64())),
                            "item_id": pa.array([shared.value.ids[i] for _, i in hits]).cast(to_arrow(item_type)),
                            "edits": pa.array([found[h][0] for h in hits], pa.int32()),
                            "item_words": pa.array([int(shared.value.size[i]) for _, i in hits], pa.int32()),
                            "start_word": pa.array([found[h][1] for h in hits], pa.int32()),
                        }
                    )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def to_arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; a narrow pass for each block of items, nothing is shuffled."""
    rows = packed(docs)
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, found in _scan(b.column("row").field("text"), shared.value):
                    keep[[lo + r for r, _ in found]] = False
                yield b.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")
