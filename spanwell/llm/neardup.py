"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

A document's set is its distinct word shingles.  Each of ``PERMUTATIONS`` hash
functions is evaluated once for a shingle and gives two signature values, the
smallest and the largest hash; each agrees between two sets with a chance equal
to their Jaccard similarity, so 64 evaluations give 128 values.  They are banded
into ``BANDS`` bands of ``ROWS``: a pair of similarity 0.8 meets in no band with
a chance of 5e-8, one of 0.85 with 6e-11.

Texts with the same words are one node, so copies cost nothing further.  Within
a bucket, nodes are first compared with one leader each, then with the leader of
every bucket they share; only nodes of a bucket that are still in different
components are compared with one another, but for those whose count of shingles
that nobody shares, or whose bit maps, rule a link out for certain.  So no pair of nodes that share a
bucket is left open, and a large group of near copies is a star of links, not a
square of pairs.  Every link is confirmed on the full sets.

Texts are told apart by a SHA-256 cut to 128 bits, shingles by 64-bit hashes of
keyed word hashes (two sets of a million shingles hold a wrong match with a
chance of 1e-7).

Defined results: null or empty texts and texts without words have an empty set
and are linked with nothing; fewer words than a shingle are one shingle of all;
rows with a null doc_id are linked, and never give a component its number while
another row can; repeated rows are members of one group; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import WORD_CLASS, Stored, content_hash, packed, scratch
from .components import components

PERMUTATIONS = 64
BANDS = 32
ROWS = 2 * PERMUTATIONS // BANDS
MAP_BITS = 4096
#: Keys of repeated rows (16 bytes each) that are broadcast; more are joined by a sort.
BROADCAST_KEYS = 100_000

_rng = np.random.default_rng(8254729)
_MULTIPLIERS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_hashes(w: np.ndarray, woffs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row offsets): all windows of ``size`` words, or one of all words of a shorter row."""
    n = np.diff(woffs)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    offs = np.concatenate(([0], np.cumsum(count)))
    lo = W.ranges(woffs[:-1], count)
    full = np.repeat(n >= size, count)
    out = np.zeros(len(lo), np.uint64)
    if full.any():
        out[full] = W.window_hashes(w, size)[lo[full]]
    for short in range(1, size):
        rows = np.flatnonzero(n == short)
        if len(rows):
            out[offs[rows]] = W.window_hashes(w, short)[woffs[rows]]
    return out, offs


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offs = W.buffers(texts)
    out: list[np.ndarray] = []
    for lo, hi in W.slices(offs):
        found = W.Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lower=True)
        h, so = shingle_hashes(found.hash(), found.rows, size)
        out += [np.unique(h[so[i] : so[i + 1]]) for i in range(hi - lo)]
    return out


def _once(part: pa.RecordBatch, side: str, size: int) -> list[np.ndarray]:
    """Sets of the texts of one side of a batch of pairs, made once for each node."""
    ids = part.column(side).to_pylist()
    first = {x: i for i, x in reversed(list(enumerate(ids)))}
    made = dict(zip(first, _sets(part.column("text_" + side).take(pa.array(list(first.values()), pa.int64())), size), strict=True))
    return [made[x] for x in ids]


def signatures(h: np.ndarray, so: np.ndarray) -> np.ndarray:
    """(rows, 128) smallest and largest hash of each permutation; rows must not be empty."""
    sig = np.empty((len(so) - 1, 2 * PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        x = (h ^ _MASKS[i]) * _MULTIPLIERS[i]
        sig[:, i] = np.minimum.reduceat(x, so[:-1])
        sig[:, PERMUTATIONS + i] = np.maximum.reduceat(x, so[:-1])
    return sig


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = W.buffers(b.column("text"))
            for lo, hi in W.slices(offs):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                found = W.Words(d, o, lower=True)
                h, so = shingle_hashes(found.hash(), found.rows, size)
                n = np.array([len(np.unique(h[so[i] : so[i + 1]])) for i in range(hi - lo)], np.int64)
                some = np.flatnonzero(np.diff(so) > 0)
                node = [hashlib.sha256(b" ".join(d[o[i] : o[i + 1]].tobytes().lower().split())).digest()[:16] for i in range(hi - lo)]
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                if len(some):
                    sig = signatures(h, np.append(so[:-1][some], so[-1]))
                    key = np.zeros((len(some), BANDS), np.uint64) + W.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
                    for r in range(ROWS):
                        key = W.mix64(key ^ sig[:, r::ROWS]) + np.uint64(r)
                    bands[some] = key
                empty = n == 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column("doc_id").slice(lo, hi - lo),
                        "th": b.column("th").slice(lo, hi - lo),
                        "n_shingles": pa.array(n),
                        "node": pa.array([None if z else x for z, x in zip(empty, node, strict=True)], pa.binary()),
                        "bands": W.list_array(W.long_bytes(bands.reshape(-1)), np.arange(hi - lo + 1) * BANDS),
                    }
                )

    return run


PROFILE = "doc_id long, th long, n_shingles long, node binary, bands array<long>"


def _confirm(size: int, percent: int):
    """Links among (a, b, text_a, text_b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                left, right = _once(part, "a", size), _once(part, "b", size)
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - common
                keep = pa.array((100 * common >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_pydict({"u": part.column("a").filter(keep), "v": part.column("b").filter(keep)})

    return run


def _shingles(size: int):
    """(node, s, bits): the set of each text, and a map of ``MAP_BITS`` bits with one set for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = _sets(part.column("text"), size)
                offs = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                bits = np.zeros((len(sets), MAP_BITS // 64), np.uint64)
                at = (flat >> np.uint64(17)) % np.uint64(MAP_BITS)
                np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), np.diff(offs)), (at >> np.uint64(6)).astype(int)), np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "s": W.list_array(W.long_bytes(flat), offs), "bits": W.list_array(W.long_bytes(bits.reshape(-1)), np.arange(len(sets) + 1) * (MAP_BITS // 64))})

    return run


class NearDuplicates:
    """One run over ``docs`` (doc_id, text); ``result()`` has one row a document."""

    def __init__(self, docs: DataFrame, percent: int = 80, shingle: int = 5):
        self.percent, self.shingle = percent, shingle
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.docs = self.docs.withColumn("th", F.xxhash64("text"))
        self.profile = Stored(self.docs.mapInArrow(_profile(shingle), PROFILE), "near-profile").df

    def _texts(self, buckets: DataFrame) -> DataFrame:
        """One text for every node that shares a bucket."""
        # first one row a node, so that a text with many copies is no hot key of the join
        pick = self.profile.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("p"))
        pick = pick.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("p.doc_id").alias("d"), F.col("p.th").alias("h"))
        found = self.docs.join(Stored(pick, "near-pick").df.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
        return found.select("node", "text").dropDuplicates(["node"])

    def _verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(self.shingle, self.percent), "u binary, v binary")

    def links(self) -> DataFrame:
        """(node, component) of nodes with a link to another text."""
        with scratch() as kept:
            kept.append(self._links())
        return kept[0]

    def _links(self) -> DataFrame:
        nodes = self.profile.where(F.col("node").isNotNull()).dropDuplicates(["node"]).select("node", "n_shingles", "bands")
        keyed = Stored(nodes.select("node", F.explode("bands").alias("h")), "near-bands").df
        shared = keyed.groupBy("h").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").select("h", "lead")
        # stored, so that the join is of two shuffles, and a band that many near copies share can be split
        buckets = Stored(keyed.join(Stored(shared, "near-shared").df, "h"), "near-buckets").df
        texts = Stored(self._texts(buckets), "near-texts").df
        sizes = nodes.select("node", "n_shingles")
        # round 1: each node with the smallest leader of its buckets
        star = buckets.where("node != lead").groupBy("node").agg(F.min("lead").alias("lead"))
        first = Stored(self._verify(star.select(F.col("lead").alias("a"), F.col("node").alias("b")), texts), "near-links").df
        label = Stored(components(first), "near-components").df
        # round 2: with every leader it meets and is not yet joined with
        named = lambda df, col, out: df.join(label.select(F.col("node").alias(col), F.col("component").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))
        met = buckets.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        open_ = named(named(met, "a", "ca"), "b", "cb").where("ca != cb").join(star.select(F.col("node").alias("b"), F.col("lead").alias("a")), ["a", "b"], "left_anti")
        second = Stored(self._verify(open_.select("a", "b"), texts), "near-links").df
        label = self._joined(label, second)
        # round 3: nodes of one bucket that are still apart, with one another
        member = named(buckets, "node", "c")
        member = self._apart(member).where("node != lead").join(sizes, "node").select("h", "node", "c", "n_shingles")
        member = Stored(self._apart(self._possible(member, texts)), "near-apart").df
        near = nodes.select("node", "bands").join(member.select("node").distinct(), "node", "left_semi").join(self.held.select("node", "bits"), "node")
        member = Stored(member.join(near, "node"), "near-members").df
        side = lambda x: member.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "c", "n_shingles", "most", "bands", "bits")])
        x, y = side("a"), side("b")
        first_shared = F.array_compact(F.zip_with("bands_a", "bands_b", lambda i, j: F.when(i == j, i)))[0]
        able = (F.col("c_a") < F.col("c_b")) & (F.col("n_shingles_b") <= F.col("most_a")) & (F.col("n_shingles_a") <= F.col("most_b"))
        # sets share no more shingles than bits, and those that share a bit within one of them
        ones = lambda v: F.aggregate(v, F.lit(0), lambda n, w: n + F.bit_count(w))
        alike = ones(F.zip_with("bits_a", "bits_b", lambda i, j: i.bitwiseAND(j))) + F.least(F.col("n_shingles_a") - ones("bits_a"), F.col("n_shingles_b") - ones("bits_b"))
        enough = alike * (100 + self.percent) >= self.percent * (F.col("n_shingles_a") + F.col("n_shingles_b"))
        cross = x.join(y, (x["h"] == y["h"]) & able & (first_shared == x["h"]) & enough)
        cross = Stored(cross.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "near-cross").df
        return self._joined(label, Stored(self._verify(cross, texts), "near-links").df)

    @staticmethod
    def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
        """(node, component) after further links; unchanged if there are none."""
        if not links.limit(1).count():
            return label
        return Stored(components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)), "near-components").df

    @staticmethod
    def _apart(member: DataFrame) -> DataFrame:
        """Rows of buckets (h) whose nodes lie in more than one component (c)."""
        open_ = member.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("h")
        return member.join(open_, "h", "left_semi")

    def _possible(self, member: DataFrame, texts: DataFrame) -> DataFrame:
        """``member`` without nodes that cannot be similar enough to any other node of their bucket.

        Shingles that no other member holds are never shared, so a node of n
        shingles shares at most e, and only with nodes of at most
        e * (100 + percent) / percent - n shingles (column ``most``).  That is exact.
        """
        held = texts.join(member.select("node").distinct(), "node", "left_semi").mapInArrow(_shingles(self.shingle), "node binary, s array<long>, bits array<long>")
        self.held = Stored(held, "near-sets").df
        alone = self.held.select("node", F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
        alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        most = F.floor((F.col("n_shingles") - F.coalesce("own", F.lit(0))) * (100 + self.percent) / self.percent + 1e-9) - F.col("n_shingles")
        member = member.join(alone, "node", "left").withColumn("most", most).drop("own")
        least = member.groupBy("h").agg(F.min("n_shingles").alias("least"))
        return member.join(least, "h").where("most >= least").drop("least")

    def result(self) -> DataFrame:
        """(doc_id, th, n_shingles, component_id, kept) for every row."""
        label = self.links()
        rows = self.profile.select("doc_id", "th", "n_shingles", "node").join(label, "node", "left")
        rows = rows.withColumn("component", F.coalesce("component", "node"))
        # stored, so that the join with it can split a component of a great many documents
        first = Stored(rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-first").df
        out = rows.where(F.col("component").isNotNull()).join(first, "component").unionByName(rows.where(F.col("component").isNull()).withColumn("component_id", F.col("doc_id")))
        return out.select("doc_id", "th", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "node")


def one_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: one row of each component stays.

    It is the row with the smallest doc_id (null last, then by content, of all
    columns); rows without words have no duplicates and all stay.  The rows are
    sorted by key once, against the keys of those that go; those that stay but
    stand there more than once are few, and fetched by their counted keys.
    """
    rows = packed(docs)
    text = F.col("row.text")
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), content_hash(rows).alias("all"), F.coalesce(text.rlike(WORD_CLASS), F.lit(False)).alias("worded"))
    key = ["th", "all"]  # 128 bits that name a row's content
    with scratch() as kept:
        found = NearDuplicates(docs, percent, shingle)
        named = found.profile.where(F.col("node").isNotNull()).select("doc_id", "th", "node").distinct().join(found.links(), "node", "left")
        named = named.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.coalesce("component", "node").alias("c"))
        slim = Stored(rows.where("worded").groupBy("doc_id", "th", "all").count(), "near-rows").df
        slim = Stored(slim.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))), "near-named").df
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "all")
        first = Stored(slim.groupBy("c").agg(F.min(place).alias("p")), "near-first").df
        slim = slim.join(first, "c").select(*key, (place != F.col("p")).alias("gone"), "count")
        # rows to leave out, and those that stay but stand there more than once; no text travels for the others
        marked = Stored(slim.where("gone or count > 1").select(*key, "gone"), "near-marked").df
        kept.append(marked)
    once = rows.join(marked.hint("merge"), key, "left_anti").select("row")
    stay = marked.where("not gone")
    stay = F.broadcast(stay) if stay.count() <= BROADCAST_KEYS else stay.hint("merge")
    repeated = rows.join(stay, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")
