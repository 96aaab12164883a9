"""Word and window hashes on sequences that collide under every polynomial modulo 2**64."""

import hashlib

import numpy as np
import pyarrow as pa

from spanwell.llm import neardup, substrings
from spanwell.llm import words as W


def thue_morse(a, b, n):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_words_and_windows():
    texts = [" ".join(["".join(thue_morse("a", "b", 1024)), "x", ""]), " ".join(["".join(thue_morse("b", "a", 1024)), "x"]), "Ünï ünï", None]
    found = W.Words(*W.buffers(pa.array(texts)), lower=True)
    h, check = found.hash(), found.hash(1)
    assert found.rows.tolist() == [0, 2, 4, 6, 6] and h[1] == h[3] and h[0] != h[2] and check[0] != check[2] and h[4] != h[5]
    assert not (h == check).any()
    seq = np.array([thue_morse(h[0], h[1], 2048), thue_morse(h[1], h[0], 2048)])
    for length in (1, 2, 3, 5, 25, 50, 64, 1024, 2048):
        a, b = (W.window_hashes(x, length) for x in seq)
        assert len(a) == 2049 - length and a[0] != b[0]
        # a window's hash is that of its words, wherever it stands
        assert W.window_hashes(seq[0][7 : 7 + length], length)[0] == a[7] if length < 2042 else True


def test_sequences_without_a_common_window(spark):
    a, b = " ".join(thue_morse("p" * 3, "q" * 3, 1024)), " ".join(thue_morse("q" * 3, "p" * 3, 1024))
    long_a, long_b = "".join(thue_morse("a", "b", 1024)), "".join(thue_morse("b", "a", 1024))
    rows = [(1, " ".join([long_a] * 60)), (2, " ".join([long_b] * 60)), (3, a + " end"), (4, b + " stop")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.SubstringDedup(docs).result().collect()}
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = t.split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert got[2]["n_removed"] == 0
    near = {r["doc_id"]: r["component_id"] for r in neardup.NearDuplicates(docs, 85).result().collect()}
    assert near[1] == 1 and near[2] == 2
