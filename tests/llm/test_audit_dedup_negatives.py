"""Source divergence, exact duplicates and hard negatives against brute force, with nulls, ties, repeats, clashing names and nothing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.llm import bond, divergence, exactdedup

R = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, key long, n long, rank int"


def divergence_of(rows, least, most):
    """The contract, pair by pair and term by term."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        price = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        total = sum(counts.values(), Counter())
        for s, c in counts.items():
            pair = [(sum(abs(price(c[t], c.total()) - price(o[t], o.total())) for t in kept), x) for x, o in counts.items() if x != s]
            term = [(price(c[t], c.total()) - price(total[t], total.total()), t) for t in kept if c[t]]
            for part, found in (("pair", pair), ("term", [x for x in term if x[0] > 0])):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, i) for i, (v, x) in enumerate(ranked, 1) if part == "pair" or i <= most]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block": 2, "cells_each": 7}, {"block": 16, "cells_each": 40}])
def test_divergence_equals_brute_force(spark, options):
    words = ["Ah", "bé", "c—d", "zu", "漢", "e", "f", "g1h", "Éa"] + [f"t{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    rows = [(" ".join(R.choices(words, k=R.randint(0, 30))), R.choice(["en", "de"]), f"s{R.randint(0, 20)}") for _ in range(220)]
    rows += [(None, None, None), ("", "en", "alone"), (None, "xx", "a"), ("one two", "xx", "b"), ("Ah " * 9000, "en", None), ("Ah-ah.AH", "en", ""), ("Ah-ah.AH", "en", "")]
    d = spark.createDataFrame([(i, t, lang, s, 5, 6, 7) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)
    out = divergence.source_divergence(d, least_docs=3, most_terms=6, **options)
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in out.collect()) == divergence_of(rows, 3, 6)
    assert divergence.source_divergence(d.limit(0)).count() == 0


def test_terms_come_in_pieces():
    text = "Ab cD\x00é x-y " * 300
    want = [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    assert [t for part in divergence.terms_of(text, 7) for t in part] == want and list(divergence.terms_of("")) == []


def test_quadtree_visits_shared_leaves_only():
    rows, columns = np.array([0, 1, 40, 40, 41]), np.array([0, 70, 1, 700, 900])
    tree = divergence.Quadtree(rows, columns, np.full(5, 9), np.ones(48, np.int64))
    a, b, c = tree.joint_leaves(range(0, 48), range(0, 48))
    assert sorted(zip(a, b, c, strict=True)) == [(0, 0, 0), (0, 0, 8), (0, 5, 0), (5, 5, 0), (5, 5, 87), (5, 5, 112)]


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: (F.length(c) % 3).cast("long"), lambda c: F.lit(-1).cast("long")])
def test_exact_dedup_equals_brute_force(spark, key):
    texts = ["a  b", "a b", " a b", "a\tb ", None, "", " ", "\n\n", "é", "long " * 3000, "long " * 3000, "a b", "c" * 5, "d" * 5]
    rows = [(i if i % 11 else None, R.choice(texts), "l", "s", 1, 2, 3) for i in range(90)] + [(5, "a b", None, None, None, None, None)] * 2
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r[0], least[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = exactdedup.exact_dedup(d, key=key, capacity=2).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and {r["text_sha256"] for r in kept} == {x[3] for x in want} and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exactdedup.exact_dedup(d.limit(0)).count() == 0


def test_all_texts_are_compared_where_repeated_keys_are_many(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "BROADCAST_KEYS", 1)
    d = spark.createDataFrame([(i, f"t{i // 3}") for i in range(30)], "doc_id long, text string")
    out = exactdedup.exact_dedup(d, key=lambda c: (F.length(c) % 2).cast("long")).collect()
    assert all(r["keep_id"] == r["doc_id"] // 3 * 3 and r["group_size"] == 3 for r in out) and len(out) == 30


def test_overfull_buckets_split_until_they_fit(spark):
    low = [i for i in range(64)]  # alike in their first 58 bits
    keys = low + [R.getrandbits(64) - (1 << 63) for _ in range(500)]
    entries = spark.createDataFrame([(k, 1) for k in keys], "key long, n long")
    buckets, g = exactdedup.buckets_of(entries, 40)
    made = {(r["bits"], r["depth"]): r["n"] for r in buckets.collect()}
    assert max(made.values()) <= 40 and sum(made.values()) == len(keys) and g > 50 and len({d for _, d in made}) > 3
    for k in keys:  # each key lies in one bucket
        assert sum(((k % (1 << 64)) >> (64 - d) if d else 0) == b for b, d in made) == 1
    index = exactdedup.build_index(spark.createDataFrame([(k, 1) for k in keys[64:]], "key long, n long"), 40, owners=3)
    spans = [(r["f"], r["a"], r["b"]) for r in index.groupBy(F.input_file_name().alias("f")).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).collect()]
    spans.sort(key=lambda x: x[1])
    assert index.count() == 500 and all(x[2] <= y[1] for x, y in zip(spans, spans[1:], strict=False))


def negatives_of(rows, every=100, k=5):
    v = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256.0 * x)) for x in e]) for i, label, e in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, label, a) in enumerate(v):
        if i % every == 0:
            best = sorted(((-dot(a, b), j) for m, (j, other, b) in enumerate(v) if m != n and other == label))[:5]
            for s, p in best:
                hard = sorted((-dot(a, b), j) for j, other, b in v if other != label and 80 * -s <= 100 * dot(a, b) <= 100 * -s)[:k]
                out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "block_rows": 2}])
def test_hard_negatives_equal_brute_force(spark, options):
    rng = np.random.default_rng(5)
    e = np.round(rng.normal(size=(600, 21)) + 0.7, 2)
    e[200:230] = e[0]
    e[300] = -e[300]
    rows = [(i, int(rng.integers(0, 4)), x.tolist()) for i, x in enumerate(e)] + [(500, 1, e[500].tolist()), (601, 1, e[0].tolist()[:9]), (700, 2, []), (800, 8, [1e9] * 21)]
    bad = [(None, 1, e[1].tolist()), (602, None, e[1].tolist()), (603, 1, None), (604, 1, [None] * 21), (605, 1, [float("nan")] * 21), (900, 1, [float("inf")] * 21)]
    d = spark.createDataFrame([(i, x, label, 1, 2, 3) for i, label, x in rows + bad], "vec_id long, embedding array<double>, label int, rid int, v int, block int").repartition(3)
    got = sorted(tuple(r) for r in bond.hard_negatives(d, **options).collect())
    assert got == negatives_of(rows) and len({x[0] for x in got}) > 4
    assert bond.hard_negatives(d.limit(0)).count() == 0 and bond.hard_negatives(d.where("vec_id = 100")).count() == 0


def test_scores_beyond_53_bits_are_exact(spark):
    rows = [(100, 1, [1e6, 3.0, 1.0]), (1, 1, [1e6, 5.0, 7.0]), (2, 2, [1e6, 4.0, 1.0]), (3, 2, [1e6, 4.0, 1.01]), (4, 3, [9e5, 0.0, 0.0]), (5, 3, [1e6, 5.0, 7.01]), (7, 5, [1e14, -1.0, 2.0])]
    d = spark.createDataFrame([(i, label, x) for i, label, x in rows], "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in bond.hard_negatives(d).collect()) == negatives_of(rows)
    with pytest.raises(Exception, match="64 bits"):
        bond.hard_negatives(spark.createDataFrame([(100, 1, [1e12]), (1, 1, [1e12])], "vec_id long, label int, embedding array<double>")).count()


def test_the_bitmap_shrinks_before_all_columns_are_read():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(3000, 64)) * 256)
    anchor = np.floor(rng.normal(size=64) ** 3 * 256)
    shard, read = bond.Shard(rows), []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            read.append(at)
            return np.asarray(self).__getitem__(at)

    shard.columns = shard.columns.view(Seen)
    found, scores = bond.scan(shard, anchor, np.arange(3000), [(-np.inf, np.inf)], 5)
    true = rows @ anchor
    assert len(found) < 200 and (scores == true[found]).all() and set(np.argsort(-true)[:5]) <= set(found)
    assert [d for d in read if np.ndim(d) == 0] == np.argsort(-np.abs(anchor), kind="stable").tolist()
