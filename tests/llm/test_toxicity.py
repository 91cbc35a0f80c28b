"""The random field against enumeration and finite differences; held-out documents, spans, odd rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, source string, score int, predicted int, spans int, _0 int"


def field_of(seed):
    rng = np.random.default_rng(seed)
    return T.Field({"bad|": (0, 3), "awf": (1, 2), "awfu": (2, 1)}, rng.normal(size=T.n_weights(3)), rng.normal() - 1, rng.normal(size=(2, 2)))


@pytest.mark.parametrize("words", ["a bad b c d e bad", "bad", "awful aww x", "x", "x y z w awf", "bad bad x aw", "x bad"])
def test_marginals_equal_enumeration(words):
    field, words = field_of(len(words)), words.split()
    marked, p, x = T.Chain(field).read(words)
    at = {i: w for i, w, _ in marked}
    score = [field.bias + field.weights[at.get(i, [])].sum() for i in range(len(words))]
    total, on = 0.0, defaultdict(float)
    for code in range(2 ** len(words)):
        y = [code >> i & 1 for i in range(len(words))]
        w = np.exp(sum(s for s, z in zip(score, y, strict=True) if z) + sum(field.transition[a][b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        for i in range(len(words)):
            on[i] += w * y[i]
    assert [on[i] / total for i, _, _ in marked] == pytest.approx(list(p)) and len(x) == 6


def test_a_words_weights_are_its_features_neighbours_and_place():
    field = field_of(0)
    assert field.marked("x awful bad y z".split()) == [(0, [6 + 1], 0), (1, [1, 2, 6 + 2, 9 + 1], 2), (2, [0, 3 + 1, 9 + 1], 3), (3, [3 + 2], 0)]
    assert field.marked([]) == field.marked(["x"]) == []


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    at = (rng.integers(0, 4, 20), rng.integers(0, 6, 20), rng.integers(0, 5, 20))
    state, times = rng.integers(0, 2, (4, 6)), np.array([1.0, 2.0, 5.0, 1.0])
    w, b, t = rng.normal(size=5), -0.3, rng.normal(size=(2, 2))
    value = lambda w, b, t: T.likelihood(at, state, times, w, b, t)[0]
    _, gw, gb, gt = T.likelihood(at, state, times, w, b, t)
    e = 1e-6
    for i in range(5):
        assert (value(w + e * (np.arange(5) == i), b, t) - value(w - e * (np.arange(5) == i), b, t)) / (2 * e) == pytest.approx(gw[i], abs=1e-4)
    assert (value(w, b + e, t) - value(w, b - e, t)) / (2 * e) == pytest.approx(gb, abs=1e-4)
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        d = np.zeros((2, 2))
        d[i, j] = e
        assert (value(w, b, t + d) - value(w, b, t - d)) / (2 * e) == pytest.approx(gt[i, j], abs=1e-4)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(4)
    at = (np.repeat(np.arange(40), 2), rng.integers(0, 25, 80), rng.integers(0, 6, 80))
    state = np.zeros((40, 25), int)
    state[at[0], at[1]] = at[2] < 2
    times = np.ones(40)
    w, b, t = T.fit_weights(at, state, times, 6)
    assert T.likelihood(at, state, times, w, b, t)[0] > T.likelihood(at, state, times, np.zeros(6), b, np.zeros((2, 2)))[0] and w[:2].min() > 1 > w[2:].max()


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def trained(tables):
    return T.train(*tables)


def test_held_out_documents_beat_the_bare_vocabulary(tables, trained):
    d, lab = tables
    rows = T.toxicity(d, lab, field=trained).where("held_out").join(d.select("doc_id", "text"), "doc_id").join(lab, "doc_id").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in toxic) >= 12 and sum(r["predicted"] for r in clean) <= 1
    bare = lambda r, least: any(trained.own(w)[1] >= least for w in T.WORD.findall((r["text"] or "").lower()))
    wrong = lambda told: sum(not told(r) for r in toxic) + sum(told(r) for r in clean)
    assert wrong(lambda r: r["predicted"]) < min(wrong(lambda r, k=k: bare(r, k)) for k in (1, 2, 3))


def test_spans_are_the_words(spark, trained):
    text = "Ré oh, you IDIOT and İstanbul trashİ clown!"
    d = spark.createDataFrame([(1, text, "x", "y", 1, 2, 3, 4)], SCHEMA)
    spans = T.toxicity(d, d, field=trained).first()["spans"]
    low = text.lower()
    assert {low[s["start"] : s["stop"]] for s in spans} >= {"idiot", "clown"} and all(0.5 < s["p"] <= 1 for s in spans)
    plain = T.toxicity(spark.createDataFrame([(1, "you IDIOT", "", "", 0, 0, 0, 0)], SCHEMA), d, field=trained).first()
    assert [("you IDIOT"[s["start"] : s["stop"]]) for s in plain["spans"]] == ["IDIOT"] and plain["predicted"] == 1


def test_odd_rows(spark, tables, trained):
    long = "word " * 200_000 + "idiot"
    rows = [(1, None), (2, ""), (None, "idiot trash scum"), (4, " \n1 2 3"), (4, " \n1 2 3"), (5, long)]
    d = spark.createDataFrame([(i, t, "l", "s", 1, 2, 3, 9) for i, t in rows], SCHEMA)
    out = T.toxicity(d.withColumnRenamed("score", "other"), tables[1], field=trained, extra=["other", "_0"]).collect()
    assert len(out) == 6 and [r["predicted"] for r in out if r["doc_id"] is None] == [1] and {r["_0"] for r in out} == {9}
    assert {r["predicted"] for r in out if r["doc_id"] in (1, 2, 4)} == {0} and all(r["spans"] == [] for r in out if r["doc_id"] in (1, 2, 4))
    assert [len(text) for text in (long[s["start"] : s["stop"]] for r in out if r["doc_id"] == 5 for s in r["spans"])] == [5]
    assert T.toxicity(d.limit(0), tables[1], field=trained).count() == 0
    untaught = T.train(tables[0], tables[1].limit(0))
    assert untaught.vocabulary == {} and T.toxicity(d, tables[1], field=untaught).where("predicted = 1").count() == 0
