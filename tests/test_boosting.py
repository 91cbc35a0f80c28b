"""Boosted trees from histograms against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.operators import boosting, metrics, model, trees


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(2000).select(
        (F.col("id") * 7919 % 2003 / 10).alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") % 6).cast("double").alias("b"), F.col("id"),
        ((F.col("id") * 7919 % 2003 > 1200).cast("int") + (F.col("id") % 6 > 3).cast("int") + (F.xxhash64("id") % 3 == 0).cast("int") > 1).cast("int").alias("y"),
    )
    return d.repartition(3, "id").persist()


def test_the_first_tree_has_the_best_splits(spark, rows):
    """sums of packed blocks stand for all rows; every row counts where none is left to the draw."""
    forest, curve, gains = boosting.boosted(rows, rows, ["a", "b"], 1, lambda c: False, 2, 0.1, 20, 1.0, 63, 1, sampled=1.0)
    r = rows.select(F.coalesce("a", F.lit(-1.0)), F.coalesce("b", F.lit(-1.0)), F.col("y") * 2 - 1).collect()
    x, sign = np.array([[q[0], q[1]] for q in r]), np.array([q[2] for q in r], float)

    def best(inside):
        gain, whole = {}, sign[inside].sum() ** 2 / inside.sum()
        for i in np.flatnonzero(forest.feature >= 0):
            left = inside & (x[:, forest.feature[i]] <= forest.threshold[i])
            right = inside & ~left
            gain[i] = sign[left].sum() ** 2 / max(left.sum(), 1) + sign[right].sum() ** 2 / max(right.sum(), 1) - whole
        return gain

    everything = np.ones(len(x), bool)
    cuts = boosting.cuts_of(rows.select("a", F.coalesce("b", F.lit(-1.0)).alias("b")), ["a", "b"], 63)
    assert cuts[1] == [-0.5, 0.5, 1.5, 2.5, 3.5, 4.5] and len(cuts[0]) == 62
    assert max(abs((x[:, 0] <= c).mean() - (i + 1) / 63) for i, c in enumerate(cuts[0])) < 1 / 300
    all_gains = [((left := x[:, f] <= c), sign[left].sum() ** 2 / left.sum() + sign[~left].sum() ** 2 / (~left).sum() - sign.sum() ** 2 / len(x))[1] for f in (0, 1) for c in cuts[f]]
    root = forest.roots[0]
    assert best(everything)[root] == pytest.approx(max(all_gains)) and sum(gains[0]) > max(all_gains)
    leaves = forest.leaves(x)[:, 0]
    for v in np.unique(leaves):
        assert sign[leaves == v].mean() == pytest.approx(v, abs=1e-6)
    assert len(curve) == 1


def test_every_round_is_validated_in_ranges_of_scores(spark, rows, monkeypatch):
    """rows times rounds were exploded, sorted and stored; ranges, ties and a row without a label are counted as the metrics do."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 300)
    real = boosting.average_precisions
    monkeypatch.setattr(boosting, "average_precisions", lambda blocks, since, width: real(blocks, since, width, range_rows=250))
    monkeypatch.setattr(boosting, "RANGE_PICKS", 50)
    checked = rows.where("id % 2 = 0").withColumn("y", F.when(F.col("id") != 8, F.col("y")))
    forest, curve, _ = boosting.boosted(rows.where("id % 2 = 1"), checked, ["a", "b"], 7, lambda c: False, 3, 0.1, 20, 1.0, 63, 1)
    want = {r["trees"]: r["ap"] for r in metrics.average_precision(trees.staged(checked, forest, ["y"]), by=["trees"]).collect()}
    assert curve == pytest.approx([want[i + 1] for i in range(7)]) and len(forest) == 7


def test_rounds_end_without_gain_and_blocks_go(spark, rows, monkeypatch):
    """all rounds were fitted, and those after the end thrown away."""
    seen = []
    real = boosting.boosted
    monkeypatch.setattr(model, "boosted", lambda *a: seen.append(real(*a)) or seen[0])
    none = rows.withColumn("y", F.lit(1))
    fitted = model.fit_trees(rows, none, ["a", "b"], rounds=30, patience=2, depth=2)
    assert fitted.trees == 1 and len(seen[0][0]) == 5
    folder, fs = boosting_folder(spark)
    assert not [f for f in fs.listStatus(folder) if "kept-" in f.getPath().getName() and spark.read.parquet(f.getPath().toString()).columns == ["id", "n", "bins", "y", "margin"]]


def boosting_folder(spark):
    from docketspark.sources.store import hadoop_path, shared_folder

    return hadoop_path(spark, shared_folder(spark))
