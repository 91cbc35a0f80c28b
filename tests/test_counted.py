"""Exact quantiles and prefix sums over counted blocks, and requester histories of one shuffle."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.operators import audit, history, metrics
from docketspark.plans.features import ORDER, TRAIN_DAYS
from docketspark.plans.serving import feature_table
from docketspark.sources.requests import request_log

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_log_is_shuffled_once_by_requester(spark):
    text = plan(feature_table(spark, DATA))
    assert len(re.findall(r"Exchange hashpartitioning\(requester#", text)) == 1
    log = request_log(spark, DATA)
    for out in (history.prior_counts(log, ORDER), history.matured_history(log, ["requester", "agency"], "p"), history.unlagged_history(log, ["requester"], ORDER)):
        assert len(re.findall(r"Exchange hashpartitioning\(requester#", plan(out))) == 1 and "_own" not in out.columns


def test_anonymous_rows_are_no_window(spark):
    log = request_log(spark, DATA).withColumn("requester", F.lit(0))
    dealt = history.apart(log).groupBy("requester", "_own").count()
    assert dealt.agg(F.max("count")).first()[0] < 10 and dealt.count() > 5000
    assert history.unlagged_history(log, ["requester"], ORDER).where("leaky_den <> -1 or leaky_sum <> -1").count() == 0


def test_all_histories_together_equal_them_one_by_one(spark):
    log = request_log(spark, DATA).withColumn("requester", F.when(F.col("line") < 6, F.col("requester")))
    one = history.matured_history(history.matured_history(history.prior_counts(log, ORDER), ["requester", "agency"], "prev_here"), ["requester"], "prev")
    both = history.histories(log, ORDER)
    assert sorted(both.columns) == sorted(one.columns) and one.select(both.columns).exceptAll(both).isEmpty() and both.count() == log.count()


def test_the_base_rate_comes_from_the_daily_sums(spark):
    log = request_log(spark, DATA)
    base = log.where(TRAIN_DAYS).agg(F.avg("y")).first()[0]
    a, b = history.rolling_rates(log, base), history.rolling_rates(log, train=TRAIN_DAYS)
    worst = a.join(b.select("agency", "reg", F.col("rate_90").alias("r")), ["agency", "reg"]).agg(F.max(F.abs(F.col("rate_90") - F.col("r"))), F.count("*")).first()
    assert worst[0] < 1e-12 and worst[1] == a.count()


@pytest.mark.parametrize("range_blocks", [1, 7, 50_000])
def test_sums_above_over_many_ranges(spark, range_blocks):
    rng = np.random.default_rng(2)
    rows = [(g, float(s), int(y)) for g in ("a", "b", None) for s, y in zip(rng.integers(-40, 40, 300) / 8, rng.integers(0, 2, 300), strict=True)]
    b = metrics.blocks(spark.createDataFrame(rows, "g string, score double, y int"), by=["g"])
    for r in metrics.with_above(b, ["g"], range_blocks).collect():
        own = [x for x in rows if x[0] == r["g"]]
        high = [x for x in own if x[1] > r["score"]]
        assert (r["n_above"], r["pos_above"], r["n_all"], r["pos_all"]) == (len(high), sum(x[2] for x in high), 300, sum(x[2] for x in own))


@pytest.mark.parametrize("range_blocks", [3, 50_000])
def test_quantiles_equal_linear_interpolation(spark, range_blocks):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=101), "b": np.repeat([1.0, 2.0], [3, 1]), "c": np.array([7.0]), None: rng.integers(0, 9, 50).astype(float)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("none", None)]
    at = [0, 0.05, 0.25, 0.5, 0.9, 1]
    out = metrics.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", at, ["g"], range_blocks).collect()
    assert {r["g"] for r in out} == set(values)
    for r in out:
        assert r["quantiles"] == pytest.approx(np.quantile(values[r["g"]], at).tolist()) and r["n"] == len(values[r["g"]])
    assert metrics.quantiles(spark.createDataFrame([], "v double"), "v", at).collect() == []


def test_quantiles_and_metrics_of_a_million_distinct_scores(spark):
    d = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_000 / 1_000_000).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = metrics.quantiles(d, "score", [0.9, 0.5])
    assert "percentile" not in plan(out) and out.first()["quantiles"] == pytest.approx([0.8999991, 0.4999995])
    assert metrics.with_above(metrics.blocks(d)).where(F.round((1 - F.col("score")) * 1_000_000) != F.col("n_above") + 1).isEmpty()
    assert metrics.queue_threshold(d).first()[0] == 0.899999
    assert metrics.roc_auc(d).first()["auc"] == pytest.approx(0.5, abs=0.01)


def test_metrics_read_the_rows_once(spark):
    d = spark.createDataFrame([(0.5, 1), (0.25, 0)], "score double, y int")
    text = plan(metrics.roc_auc(d))
    assert "ExistingRDD" not in text and text.count("FileScan") <= 2  # what follows reads the stored blocks


def test_spread_keeps_groups_of_nulls(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "g string, v double")
    out = {r["g"]: (r["n"], r["mean"], r["median"], r["p95"]) for r in audit.spread(d, F.col("v"), ["g"]).collect()}
    assert out == {"a": (2, 1.5, 1.5, pytest.approx(1.95)), "b": (1, None, None, None), None: (1, 4.0, 4.0, 4.0)}
