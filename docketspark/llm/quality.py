"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each word of a text falls into one of `BUCKETS` buckets by its hash, and a bucket has a
sparse random index vector. Over the whole corpus, a bucket's context vector sums the
index vectors of the buckets next to it. A document is the mean of its words' vectors. A
two-layer network, trained on a bounded sample of labelled rows, gives the logit, and a
temperature found on rows kept apart calibrates its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm import wordhash
from docketspark.llm.common import small_batches
from docketspark.llm.labelled import held_out, training_sample

#: Bound of the training sample: labelled rows, as they come by a hash of the id.
SAMPLE_ROWS = 8000
BUCKETS, SIGNS, DIMENSIONS, NONZERO = 4096, 512, 64, 4
REACH, THRESHOLD = 2, 0.7
#: Buckets of what a word is rather than which: all capitals, the same as the one before.
CAPITALS, REPEATED, FIRST_WORD = 0, 1, SIGNS


def _kinds() -> np.ndarray:
    """Kind of a byte: 0 white space, 1 letter (or not ASCII), 2 digit, 3 other sign."""
    kind = np.full(256, 3, np.int8)
    kind[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    return kind


_KIND = _kinds()
_SMALL = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1))
_LARGE = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words in order and n + 1 offsets.

    Words are runs of letters, of digits or of other signs. Runs of signs and digits have
    the first buckets, runs of letters the others; a word of two or more capitals and no small
    letter, or one that repeats the word before, has a bucket of its own kind.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths) + np.arange(1, len(texts) + 1)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[data]
    starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    stops = np.concatenate((starts[1:], [len(data)]))
    word = kind[starts] > 0
    starts, stops = starts[word], stops[word]
    up, down = wordhash._Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(wordhash._LOWERED[data].astype(np.uint64) * up[: len(data)], out=sums[1:])
    hashed = wordhash.mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    letters = kind[starts] == 1
    out = np.where(letters, FIRST_WORD + (hashed >> np.uint64(33)) % np.uint64(BUCKETS - FIRST_WORD), 2 + (hashed >> np.uint64(33)) % np.uint64(SIGNS - 2)).astype(np.int32)
    small, large = (np.concatenate(([0], np.cumsum(t[data]))) for t in (_SMALL, _LARGE))
    out[letters & (large[stops] - large[starts] >= 2) & (small[stops] == small[starts])] = CAPITALS
    offsets = np.concatenate(([0], np.searchsorted(starts, ends)))
    same = np.zeros(len(out), bool)
    same[1:] = hashed[1:] == hashed[:-1]
    at = offsets[:-1][offsets[:-1] < len(out)]
    same[at] = False
    out[same & letters] = REPEATED
    return out, offsets


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the places and signs of its index vector's components that aren't 0."""
    rng = np.random.default_rng(17)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def context_vectors(docs: DataFrame, lots: int = 128) -> np.ndarray:
    """BUCKETS x DIMENSIONS vectors of unit length (or 0), from every document.

    A task sums its documents into one table; tables are summed by lots of buckets, so what
    reaches the driver is one table, whatever the corpus's size.
    """
    each = BUCKETS // lots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        table = np.zeros(BUCKETS * DIMENSIONS, np.int64)
        for batch in batches:
            texts = _texts(batch.column(0))
            for begin, end in wordhash.chunks(texts):
                words, offsets = buckets(texts[begin:end])
                owner = np.repeat(np.arange(end - begin), np.diff(offsets))
                for reach in range(1, REACH + 1):
                    inside = owner[reach:] == owner[:-reach]
                    a, b = words[:-reach][inside].astype(np.int64), words[reach:][inside].astype(np.int64)
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            table += np.bincount(x * DIMENSIONS + places[y, k], signs[y, k], len(table)).astype(np.int64)
        rows = table.reshape(lots, each * DIMENSIONS)
        full = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[i].tobytes() for i in full], pa.binary())], ["lot", "sums"])

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(each * DIMENSIONS, np.int64)
        for x in part.column("sums"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"lot": part.column("lot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "lot int, sums binary").groupBy("lot").applyInArrow(add, "lot int, sums binary")
    out = np.zeros((lots, each * DIMENSIONS))
    for row in parts.collect():  # at most `lots` rows
        out[row["lot"]] = np.frombuffer(row["sums"], np.int64)
    out = out.reshape(BUCKETS, DIMENSIONS)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """A bucket's vector: its context's, after its own index vector."""
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), axis=1)
    return np.concatenate([contexts, own], axis=1).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """The mean of each text's word vectors; 0 for a text without words."""
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for begin, end in wordhash.chunks(texts, 1 << 16):
        words, offsets = buckets(texts[begin:end])
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        if len(full):
            out[begin + full] = np.add.reduceat(vectors[words], offsets[full], axis=0) / n[full, None]
    return out


@dataclass
class Network:
    """tanh layer and logit, over standardised inputs; probabilities at a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Trains on four fifths of the rows (Adam, small batches) and sets the temperature on the rest."""
    rng = np.random.default_rng(23)
    if len(np.unique(y)) < 2:  # nothing to learn from: the class that there is, or one half
        bias = 0.0 if not len(y) else (6.0 if y[0] else -6.0)
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), bias)
    order = rng.permutation(len(y))
    kept, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    d = x.shape[1]
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        shuffled = rng.permutation(used)
        for at in range(0, len(shuffled), 64):
            rows = shuffled[at : at + 64]
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = g[:, None] * p[2][None, :] * (1 - h**2)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            t += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(kept):
        logits, truth = net.logits(x[kept]), y[kept]
        options = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / c).mean() for c in options]
        net.temperature = float(options[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all of `docs`, and the network from at most `most` labelled rows."""
    vectors = word_vectors(context_vectors(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(_texts(batch.column(2)), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    rows = training_sample(docs, labels, "quality", most, per_class=False).mapInArrow(run, "doc_id long, y int, x array<float>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))  # the same model, however rows came
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), vectors.shape[1])
    return vectors, fit(x, np.array([r["y"] for r in rows], float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, extra: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    A null or empty text has the score of the zero vector. Repeated rows each give a row.
    Texts are read whole, without a shuffle. `extra` names columns of `docs` to carry along.
    """
    small_batches(docs.sparkSession)
    extra = extra or []
    vectors, net = train(docs, labels)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(extra)])
    kinds = [f.dataType.simpleString() for f in docs.select(*extra).schema] if extra else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = net.probabilities(pooled(_texts(batch.column(1)), vectors))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), *batch.columns[2:]],
                ["doc_id", "score", "predicted", *(f"_{i}" for i in range(len(extra)))],
            )

    schema = "doc_id long, score double, predicted int" + "".join(f", _{i} {k}" for i, k in enumerate(kinds))
    out = chosen.mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *[F.col(f"_{i}").alias(c) for i, c in enumerate(extra)])
