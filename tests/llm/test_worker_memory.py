"""What a Python worker holds while it works on one batch of Arrow's, as small_batches sets them: its share of an executor's memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docketspark.llm import jaccard, quality, toxicity, wordhash


LETTERS = str.maketrans("0123456789", "ghijklmnop")


def texts_of(n, words, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x:x}q{x % 97}" for x in rng.integers(0, 1 << 20, words)) for _ in range(n)]


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_a_batch_of_texts_is_surveyed_a_chunk_at_a_time():
    raw = [t.encode() for t in texts_of(400, 1000)]
    size = sum(map(len, raw)) / 1e6
    assert 2 < size < 5
    ids = pa.array(range(len(raw)), pa.int64())
    names = ["doc_id", "n", "h1", "h2", "shingle", "seen"]
    wordhash._Powers.up = wordhash._Powers.down = np.ones(1, np.uint64)  # as in a new worker
    peak, rows = peak_mb(lambda: sum(b.num_rows for b in jaccard._surveyed(ids, raw, 4, names)))
    assert rows >= len(raw)
    assert peak < 7 * size  # 10.9 with the chunks of a megabyte before


def test_the_survey_counts_copies_of_a_batch_once_across_chunks(monkeypatch):
    monkeypatch.setattr(wordhash, "CHUNK_BYTES", 64)
    monkeypatch.setattr(wordhash.chunks, "__defaults__", (64,))
    raw = [b"a b c d e", b"x y z u v w", b"a b c d e", b"k a b c d", b"", b"a b c d e", b"x y z u q"]
    names = ["doc_id", "n", "h1", "h2", "shingle", "seen"]
    table = pa.Table.from_batches(list(jaccard._surveyed(pa.array(range(7), pa.int64()), raw, 4, names))).to_pylist()
    assert [(r["doc_id"], r["n"]) for r in table if r["n"] is not None] == [(0, 2), (1, 3), (2, 2), (3, 2), (4, 0), (5, 2), (6, 2)]
    one = lambda t: jaccard._sets([t], 4)[0].view(np.int64)[0]
    assert {r["shingle"]: r["seen"] for r in table if r["seen"] is not None} == {one(b"a b c d"): 2, one(b"x y z u"): 2}


def test_context_vectors_work_on_small_chunks():
    raw = [t.encode() for t in texts_of(400, 1000)]
    wordhash._Powers.up = wordhash._Powers.down = np.ones(1, np.uint64)
    peak, _ = peak_mb(lambda: [quality.buckets(raw[a:b])[0].sum() for a, b in wordhash.chunks(raw)])
    assert peak < 30  # 70 before


def test_features_of_a_sample_are_listed_in_small_parts():
    rows = [t.translate(LETTERS) for t in texts_of(100, 1000)]
    factors = np.ones((4, 4), np.uint64)
    parts = list(wordhash.chunks(rows, toxicity.LISTED_BYTES))
    assert parts[0][0] == 0 and parts[-1][1] == len(rows) and len(parts) > 5
    peak, sizes = peak_mb(lambda: [len(toxicity.listed_features(rows[a:b], factors)[2]) for a, b in parts])
    assert sum(sizes) == len(rows)
    whole, _ = peak_mb(lambda: len(toxicity.listed_features(rows, factors)[2]))
    assert peak < 0.3 * whole  # as before, all texts of a batch at once


def test_words_without_features_share_what_they_have():
    field = toxicity.Field({"abc|": (0, 1)}, np.zeros(toxicity.n_weights(1)), 0.0, np.zeros((2, 2)))
    assert field.own("abc") == ((0,), 1) and field.own("xyz") is toxicity.PLAIN
