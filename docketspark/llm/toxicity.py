"""Toxicity: a linear-chain conditional random field over words.

Documents carry labels, words do not. Training first finds, on a bounded sample without
near copies, the words and word beginnings that are more frequent in toxic documents than chance
explains; these are the field's vocabulary, weak ones too. Words of toxic documents with such a feature are the
tokens labelled toxic, all others are labelled clean. The field has two states. A word's score is a sum of trained weights: of all
its features in the vocabulary, of the kinds of its neighbours, of its position, and of the step
from the state before; what a feature is worth the field learns from all words that have it. Forward-backward
marginals give each word's probability. The largest of them, their sums and their share
of the words make the document's score in a logistic function, fitted on the sample and
set to the classes' true shares; words over one half are the offending spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm import wordhash
from docketspark.llm.common import durable, small_batches
from docketspark.llm.labelled import held_out, training_sample

#: Bound of the training sample: labelled rows of each class; their texts are read whole.
SAMPLE_ROWS = 3000
#: Lengths of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A document's uses of a feature that count, so that one text that repeats a word isn't many.
USES = 4
THRESHOLD = 0.3
#: Words whose features a worker remembers, and bytes of text whose features it lists at a time.
CACHED_WORDS, LISTED_BYTES = 100_000, 1 << 16
#: What a word without features has.
PLAIN: tuple[tuple[int, ...], int] = ((), 0)
#: Kinds of words by the odds of their best feature (0: none), and positions by the logarithm of a word's place.
KINDS, PLACES = 4, 8

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word's own feature and those of its beginnings; whole words end with a bar."""
    return [f"{word}|", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Field:
    """The vocabulary {feature: (number, kind)} and the weights of state 1 against state 0.

    `weights` are those of the features, then those of the kinds 1 to 3 of the word before, of the word after, and of the
    position. `scoring` are the weights of the document's score.
    """

    vocabulary: dict[str, tuple[int, int]]
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    scoring: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def __post_init__(self):
        self.known: dict[str, tuple[tuple[int, ...], int]] = {}

    def own(self, word: str) -> tuple[tuple[int, ...], int]:
        """The numbers of a word's features, and its kind."""
        if word not in self.known:
            if len(self.known) > CACHED_WORDS:  # a cache, emptied when it is large
                self.known.clear()
            found = [self.vocabulary[f] for f in features(word) if f in self.vocabulary]
            self.known[word] = (tuple(n for n, _ in found), max(k for _, k in found)) if found else PLAIN
        return self.known[word]

    def marked(self, words: list[str]) -> list[tuple[int, list[int], int]]:
        """(place, numbers of weights, kind) of the words that have a feature or stand beside one that has; in order."""
        own, base, n = self.own, len(self.vocabulary), len(words)
        kinds = {i: k for i, w in enumerate(words) if (k := own(w)[1])}
        out = []
        for i in sorted({j for i in kinds for j in (i - 1, i, i + 1) if 0 <= j < n}):
            at = list(own(words[i])[0])
            at += [base + kinds[i - 1] - 1] if i - 1 in kinds else []
            at += [base + KINDS - 1 + kinds[i + 1] - 1] if i + 1 in kinds else []
            at += [base + 2 * (KINDS - 1) + min(PLACES, (i + 1).bit_length()) - 1] if i in kinds else []
            out.append((i, at, kinds.get(i, 0)))
        return out


def n_weights(vocabulary: int) -> int:
    return vocabulary + 2 * (KINDS - 1) + PLACES


def summary(p: np.ndarray, n: int) -> np.ndarray:
    """What a document's score is made of: 1, the largest marginal, logarithms of the sums over sure, likely and
    doubtful words, and the marginals' share of the words in percent, at most 10."""
    sums = [p[(p >= low) & (p < high)].sum() for low, high in ((0.9, 2), (0.5, 0.9), (0, 0.5))]
    return np.array([1.0, p.max(initial=0.0), *map(math.log1p, sums), min(10.0, 100 * p.sum() / max(1, n))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge on all weights but the first."""
    w, r = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(r + 1e-6)
        step = np.linalg.solve(h, x.T @ (y - p) - r * w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w


class Chain:
    """Forward-backward over a document, with runs of plain words taken as one matrix power."""

    def __init__(self, field: Field):
        self.field = field
        self.move = np.exp(field.transition - field.transition.max())
        plain = self.move * np.array([1.0, math.exp(field.bias)])[None, :]
        self.plain = plain / np.abs(np.linalg.eigvals(plain)).max()
        self.run = lru_cache(4096)(self._run)

    def _run(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.plain, n)

    def read(self, words: list[str]) -> tuple[list[tuple[int, list[int], int]], np.ndarray, np.ndarray]:
        """The words that aren't plain, their marginals, and the document's summary."""
        marked = self.field.marked(words)
        p = self.marginals(marked, len(words))
        return marked, p, summary(p, len(words))

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.field.scoring, -30, 30))))

    def marginals(self, marked: list[tuple[int, list[int], int]], n: int) -> np.ndarray:
        """Probability of the toxic state at each marked word of a text of n words."""
        odds = np.exp(np.clip([self.field.bias + self.field.weights[at].sum() for _, at, _ in marked], -30, 30))
        forward, f, last = [], np.ones(2), -1
        for (place, _, _), odd in zip(marked, odds, strict=True):
            gap = place - last - 1
            # the first word of all has no step before it
            f = (np.array([1.0, math.exp(self.field.bias)]) @ self.run(gap - 1) if gap else f) if last < 0 else (f @ self.run(gap) if gap else f)
            f = (f @ self.move if place else f) * np.array([1.0, odd])
            f = f / f.sum()
            forward.append(f)
            last = place
        out, b, after = np.zeros(len(marked)), np.ones(2), n
        for at in range(len(marked) - 1, -1, -1):
            gap = after - marked[at][0] - 1
            b = self.run(gap) @ b if gap else b
            p = forward[at] * b
            out[at] = p[1] / p.sum()
            b = self.move @ (np.array([1.0, odds[at]]) * b)
            b = b / b.sum()
            after = marked[at][0]
        return out


def choose_vocabulary(counts: dict[str, tuple[int, int]], toxic: int, clean: int, bar: float = 8.0) -> dict[str, tuple[int, int]]:
    """{feature: (number, kind)} of features that chance doesn't explain, from {feature: (uses in toxic, in clean texts)} and both totals of words.

    With k of a feature's n uses toxic and a share p of all words, n * KL(k / n, p) bounds
    the tail's exponent; it must pass `bar`. A beginning is left out where one word accounts for it. Kinds are
    3, 2, 1 by the logarithm of the odds: over 5, over 3.5, the rest.
    """
    share = toxic / max(1, toxic + clean)

    def strength(k: int, c: int) -> float:
        n, q = k + c, k / (k + c)
        if q <= share or not 0 < share < 1:
            return 0.0
        return n * (q * math.log(q / share) + (1 - q) * (math.log((1 - q) / (1 - share)) if q < 1 else 0))

    kept = {f: c for f, c in counts.items() if strength(*c) > bar}
    words = {f[:-1]: c[0] for f, c in kept.items() if f.endswith("|")}
    alone = Counter()  # of each beginning: the most uses of one word that begins so
    for w, n in words.items():
        for k in BEGINNINGS:
            alone[w[:k]] = max(alone[w[:k]], n)
    chosen = [f for f in sorted(kept) if f.endswith("|") or alone[f] < 0.8 * kept[f][0]]
    odds = lambda k, c: math.log((k + 0.5) / (c + 0.5) * clean / max(1, toxic))
    return {f: (i, 3 if (o := odds(*kept[f])) > 5 else 2 if o > 3.5 else 1) for i, f in enumerate(chosen)}


def likelihood(at: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, times: np.ndarray, weights: np.ndarray, bias: float, transition: np.ndarray):
    """Log-likelihood of the states of windows, and its gradients by weight, bias and transition. `at`: window, place and weight of each feature that is there."""
    window, place, number = at
    score = np.full(state.shape, bias)
    np.add.at(score, (window, place), weights[number])
    e = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], axis=2)
    t, length, total = np.exp(transition), state.shape[1], np.zeros(len(state))
    forward, backward = np.empty_like(e), np.ones_like(e)
    for i in range(length):
        f = e[:, 0] if i == 0 else (forward[:, i - 1] @ t) * e[:, i]
        scale = f.sum(1, keepdims=True)
        total += np.log(scale[:, 0])
        forward[:, i] = f / scale
    for i in range(length - 2, -1, -1):
        b = (backward[:, i + 1] * e[:, i + 1]) @ t.T
        backward[:, i] = b / b.sum(1, keepdims=True)
    p = forward * backward
    p = p[:, :, 1] / p.sum(2)
    pair = forward[:, :-1, :, None] * t[None, None] * (backward * e)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    truth = np.eye(2)[state]
    moved = np.einsum("n,ntj,ntk->jk", times, truth[:, :-1], truth[:, 1:])
    path = (np.clip(score, -30, 30) * state).sum(1)
    rest = (state - p) * times[:, None]
    gradient = np.bincount(number, rest[window, place], len(weights))
    value = float(times @ (path - total) + (moved * transition).sum())
    return value, gradient, float(rest.sum()), moved - np.einsum("n,ntjk->jk", times, pair)


def fit_weights(at: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, times: np.ndarray, n: int, steps: int = 150, rate: float = 0.5, ridge: float = 0.1) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum-likelihood weights, with a ridge, by gradient steps scaled by how often each weight is used."""
    toxic = float((state.sum(1) * times).sum())
    weights, transition = np.zeros(n), np.zeros((2, 2))
    bias = math.log((toxic + 1) / (times.sum() * state.shape[1] - toxic + 1))  # what it is without any feature
    used = np.bincount(at[2], times[at[0]], n) + ridge
    cells = times.sum() * state.shape[1]
    for _ in range(steps):
        _, gw, gb, gt = likelihood(at, state, times, weights, bias, transition)
        weights = weights + rate * (gw - ridge * weights) / used
        bias += 2 * rate * gb / cells
        transition = transition + rate * (gt / cells - 1e-3 * transition)
    return weights, bias, transition


def listed_features(texts: list[str], factors: np.ndarray) -> list[pa.Array]:
    """Of each text the uses of its features, its four keys (least hashes by each row of `factors`), and its number of words."""
    rows, keys, sizes = [], [], []
    for text in texts:
        found = WORD.findall(text.lower())
        uses: Counter[str] = Counter()
        for w, n in Counter(found).items():
            for f in features(w):
                uses[f] += n
        rows.append([(f, min(n, USES)) for f, n in sorted(uses.items())])
        sizes.append(len(found))
        x = wordhash.words([" ".join([f for f, _ in rows[-1]] or [""]).encode()])[0]
        least = [[int((x * f).min()) if len(x) else 0 for f in row] for row in factors]
        keys.append([hash(tuple(k)) for k in least])  # numbers only, so the same in every process
    return [pa.array(rows, pa.map_(pa.string(), pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, window: int = 25, bar: float = 8.0) -> Field:
    """The field, from at most `most` labelled rows of each class, whole texts in windows of `window` words.

    Features are counted over the sample in one Spark aggregation, up to USES times in a text. Without toxic rows the
    vocabulary is empty and every score is near 0.
    """
    sample = durable(training_sample(docs, labels, "toxic", most, per_class=True))
    factors = np.random.default_rng(7).integers(1, 1 << 62, (4, 4), np.int64).astype(np.uint64) | np.uint64(1)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in wordhash.chunks(texts, LISTED_BYTES):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *listed_features(texts[begin:end], factors)], ["doc_id", "y", "features", "keys", "words"])

    held = durable(sample.mapInArrow(listed, "doc_id long, y int, features map<string,int>, keys array<long>, words long"))
    # of documents that agree on four least hashes of four functions (near copies), the first counts
    seen: set[tuple[int, int]] = set()
    chosen, sizes = [], Counter()
    for row in sorted(held.select("doc_id", "y", "keys", "words").collect(), key=lambda r: (r["doc_id"], r["keys"])):
        marks = {(i, k) for i, k in enumerate(row["keys"])}
        if not marks & seen:
            chosen.append((row["doc_id"],))
            sizes[row["y"]] += row["words"]
        seen |= marks
    kept = F.broadcast(docs.sparkSession.createDataFrame(chosen or [(None,)], "doc_id long"))
    counts = (
        held.join(kept, "doc_id", "left_semi").select("y", F.explode("features").alias("f", "n")).groupBy("f")
        .agg(F.sum("y").alias("texts"), F.sum(F.col("y") * F.col("n")).alias("toxic"), F.sum((1 - F.col("y")) * F.col("n")).alias("clean")).where("texts >= 2")
    )
    even = sizes[1] / max(1, sizes[0])  # at least three times as frequent in toxic texts
    good = counts.where(F.col("clean") * 3 * even <= F.col("toxic")).collect()  # few of a bounded sample's features
    vocabulary = choose_vocabulary({r["f"]: (r["toxic"], r["clean"]) for r in good}, sizes[1], sizes[0], bar)
    first = Field(vocabulary, np.zeros(n_weights(len(vocabulary))), 0.0, np.zeros((2, 2)))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows of every text, the last one filled up with plain words: their features (place, number) and states; equal ones counted."""
        for batch in batches:
            out: Counter[tuple[bytes, bytes]] = Counter()
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = WORD.findall(text.lower())
                cells: dict[int, list[int]] = {}
                states: dict[int, bytearray] = {}
                for place, at, kind in first.marked(found):
                    w, i = divmod(place, window)
                    cells.setdefault(w, []).extend(x for n in at for x in (i, n))
                    states.setdefault(w, bytearray(window))[i] = int(bool(kind) and y == 1)
                for w in cells:
                    out[np.array(cells[w], np.int32).tobytes(), bytes(states[w])] += 1
                out[b"", bytes(window)] += -(-max(1, len(found)) // window) - len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in out], pa.binary()) for i in (0, 1)] + [pa.array(out.values(), pa.int64())], ["cells", "states", "times"])

    patterns = sample.mapInArrow(labelled, "cells binary, states binary, times long").groupBy("cells", "states").agg(F.sum("times").alias("times"))
    rows = sorted(patterns.where("times > 0").collect(), key=lambda r: (bytes(r["cells"]), bytes(r["states"])))  # of at most 2 * `most` documents, alike ones once
    cells = [np.frombuffer(r["cells"], np.int32).reshape(-1, 2) for r in rows]
    state = np.array([np.frombuffer(r["states"], np.int8) for r in rows], int).reshape(-1, window)
    at = (np.repeat(np.arange(len(cells)), [len(c) for c in cells]), *np.concatenate([*cells, np.zeros((0, 2), np.int32)]).astype(int).T)
    field = Field(vocabulary, *fit_weights(at, state, np.array([r["times"] for r in rows], float), len(first.weights))) if len(rows) and vocabulary else first

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(field)
        for batch in batches:
            rows = [chain.read(WORD.findall(text.lower()))[2].tolist() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.mapInArrow(summed, "y int, x array<double>").collect()  # at most 2 * `most` rows
    y = np.array([r["y"] for r in rows], float)
    if 0 < y.sum() < len(y):
        field.scoring = logistic(np.array([r["x"] for r in rows]), y)
        share = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
        field.scoring[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    else:
        field.scoring[0] = 6.0 if y.sum() else -6.0
    return field


SCHEMA = "doc_id long, score double, predicted int, spans array<struct<start:int,stop:int,p:double>>"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, field: Field | None = None, extra: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, spans (code points and probability of toxic words).

    A null or empty text has the score of a text without matches and no spans. Repeated
    rows each give a row. Texts are read whole, in one pass without a shuffle. `extra` names columns
    of `docs` to carry along.
    """
    small_batches(docs.sparkSession)
    field = field or train(docs, labels)
    extra = extra or []
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(extra)])
    kinds_of = [f.dataType.simpleString() for f in docs.select(*extra).schema] if extra else []
    schema = SCHEMA + "".join(f", _{i} {k}" for i, k in enumerate(kinds_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(field)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                low = (text or "").lower()
                found = WORD.findall(low)
                marked, p, x = chain.read(found)
                scores.append(chain.score(x))
                if not marked:
                    spans.append([])
                    continue
                own = text if len(low) == len(text) else low  # lower-casing can lengthen a text; offsets are then its own
                at = [m.span() for m in WORD.finditer(own)]
                spans.append([{"start": at[i][0], "stop": at[i][1], "p": float(q)} for (i, _, _), q in zip(marked, p, strict=True) if q > 0.5])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, kind), *batch.columns[2:]],
                ["doc_id", "score", "predicted", "spans", *(f"_{i}" for i in range(len(extra)))],
            )

    out = chosen.mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans", *[F.col(f"_{i}").alias(c) for i, c in enumerate(extra)])
