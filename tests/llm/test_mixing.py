"""The draw of the mix: multinomial counts by shard, exact sums, all slots numbered once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.llm import mixing

MICRO = mixing.MICRO


def due_of(spark, shares, blocks=10_000):
    rows, upto = [], 0
    for i, d in enumerate(shares):
        upto += int(d * MICRO)
        rows.append((i + 1, blocks, int(d * MICRO), upto, int(sum(shares) * MICRO)))
    return spark.createDataFrame(rows, "nth int, blocks long, due long, upto long, all long")


def test_counts_are_multinomial_and_sums_are_due(spark):
    shares = [20_000.5, 9_999.25, 6_000.0, 3.75, 0.5, 0.0]
    counts, totals = mixing.shard_counts(due_of(spark, shares), 100, 7)
    total = {r["nth"]: r["total"] for r in totals.collect()}
    rows = counts.collect()
    n = sum(total.values())
    assert all(abs(total[i + 1] - s) < 1 for i, s in enumerate(shares) if s)
    for i in total:
        assert sum(r["n"] for r in rows if r["nth"] == i) == total[i]
    shards = -(-n // 100)
    by = np.zeros((shards, 7), int)
    for r in rows:
        by[r["shard"], r["nth"]] = r["n"]
    assert (by[:-1].sum(1) == 100).all() and by[-1].sum() == n - 100 * (shards - 1)
    for i in (1, 2, 3):
        p = total[i] / n
        assert by[:-1, i].var() == pytest.approx(100 * p * (1 - p), rel=0.25)  # one number for all shards would have no spread
    assert np.corrcoef(by[:-1, 1], by[:-1, 2])[0, 1] == pytest.approx(-np.sqrt(total[1] * total[2] / (n - total[1]) / (n - total[2])), abs=0.12)
    again, _ = mixing.shard_counts(due_of(spark, shares), 100, 7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    other, _ = mixing.shard_counts(due_of(spark, shares), 100, 8)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_slots_are_numbered_once_through_the_shards(spark):
    slots = mixing.drawn_slots(due_of(spark, [500.0, 250.0, 1.0], blocks=90), 64, 3).collect()
    for i, n in ((1, 500), (2, 250), (3, 1)):
        own = sorted((r["k"], r["shard"]) for r in slots if r["nth"] == i)
        assert [k for k, _ in own] == list(range(n)) and [s for _, s in own] == sorted(s for _, s in own)
    assert mixing.drawn_slots(due_of(spark, [0.0]), 64, 3).count() == 0


@pytest.mark.parametrize("total", [1, 7, 5000])
def test_points_find_their_span(spark, total):
    edges = sorted({0, total, *np.random.default_rng(total).integers(0, total, 40).tolist()})
    spans = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "nth int, low long, high long")
    out = mixing.located(spark.range(total).select(F.col("id").alias("u")), spans, total, cells=16).collect()
    assert sorted((r["u"], r["nth"]) for r in out) == [(u, int(np.searchsorted(edges, u, side="right")) - 1) for u in range(total)]


def test_the_number_of_slots_of_a_shard_matters(spark):
    d = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}", i % 5) for i in range(900)], "doc_id long, text string, source string, shard int")
    out = {n: sorted(map(tuple, mixing.mix_sources(d, block=16, slots=n, rows_each=100).collect()), key=str) for n in (50, 400)}
    assert out[50] != out[400] and {r[5] for r in out[50]} > {r[5] for r in out[400]}
    taken = {n: sum(r[4] for r in rows) for n, rows in out.items()}
    assert abs(taken[50] - taken[400]) < 0.02 * taken[50]
    assert all((r[5] is None) == (r[4] == 0) for r in out[50])
