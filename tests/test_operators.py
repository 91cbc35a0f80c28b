"""Edges of the operators: nulls, ties, empty tables, causality, train and serve alike."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docketspark.functions import columns as C
from docketspark.operators import encode, history, joins, metrics, model, serving
from docketspark.sources import requests

DAY = dt.date(2020, 1, 1)


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, y int")


def test_precision_at_k_with_and_without_ties(spark):
    plain = [(1 - i / 10, 1 if i in (0, 2, 7) else 0) for i in range(10)]
    assert metrics.precision_at_k(scored(spark, plain), 0.3).first()["precision"] == pytest.approx(2 / 3)
    tied = [(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0)] + [(0.1, 0)] * 5
    row = metrics.precision_at_k(scored(spark, tied), 0.3).first()
    assert row["precision"] == pytest.approx((1 + 2 / 4) / 3) and row["n_tied"] == 4 and row["need"] == 2
    flat = [(0.5, int(i < 2)) for i in range(10)]
    assert metrics.precision_at_k(scored(spark, flat), 0.4).first()["precision"] == pytest.approx(0.2)
    for seed in range(3):
        random.Random(seed).shuffle(tied)
        assert metrics.precision_at_k(scored(spark, tied).repartition(3), 0.3).first()["precision"] == pytest.approx(0.5)


def test_metrics_of_empty_and_one_sided_input(spark):
    empty = scored(spark, [])
    assert metrics.precision_at_k(empty, 0.1).collect() == []
    assert metrics.roc_auc(scored(spark, [(0.2, 1), (0.4, 1)])).first()["auc"] is None
    assert metrics.average_precision(scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1)])).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.roc_auc(scored(spark, [(0.5, 1), (0.5, 0), (None, 1)])).first()["auc"] == 0.5


def log(spark, rows):
    return spark.createDataFrame(rows, "requester string, agency string, reg date, y int, id int")


def test_history_counts_same_day_and_absent_requesters(spark):
    rows = [("a", "x", DAY, 1, 1), ("a", "y", DAY, 0, 2), ("a", "x", DAY + dt.timedelta(5), 0, 3), ("0", "x", DAY, 1, 4), (None, "x", DAY, 1, 5)]
    out = {r["id"]: r for r in history.prior_counts(log(spark, rows), ["id"]).collect()}
    assert [out[i]["n_prior"] for i in (1, 2, 3, 4, 5)] == [0, 1, 2, -1, -1]
    assert [out[i]["n_agencies_prior"] for i in (1, 2, 3)] == [0, 1, 2]
    assert [out[i]["days_since_last"] for i in (1, 2, 3, 4)] == [-1, 0, 5, -1]
    assert out[3]["n_prior_pair"] == 1


def test_labels_mature_and_never_leak(spark):
    rows = [("a", "x", DAY, 1, 1), ("a", "x", DAY + dt.timedelta(59), 1, 2), ("a", "x", DAY + dt.timedelta(60), 0, 3), ("a", "x", DAY + dt.timedelta(119), 0, 4)]
    read = lambda rs: {r["id"]: (r["prev"], r["prev_den"]) for r in history.matured_history(log(spark, rs), ["requester"], "prev").collect()}
    assert read(rows) == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (2, 2)}
    later = [(*r[:3], 1 - r[3], r[4]) if r[4] in (3, 4) else r for r in rows]
    assert read(later) == read(rows)


def test_rolling_window_bounds(spark):
    rows = [("a", "x", DAY - dt.timedelta(d), 1, d) for d in (0, 59, 60, 61, 149, 150)]
    out = {r["reg"]: r for r in history.rolling(log(spark, rows)).collect()}
    assert out[DAY]["cnt_90"] == 3 and out[DAY]["cnt_365"] == 4


def test_asof_takes_the_last_row_and_never_a_later_one(spark):
    left = spark.createDataFrame([("k", DAY), ("z", DAY)], "k string, on date")
    right = spark.createDataFrame([("k", DAY - dt.timedelta(3), 1), ("k", DAY - dt.timedelta(2), 2), ("k", DAY + dt.timedelta(1), 3)], "k string, on date, v int")
    assert {r["k"]: r["asof_v"] for r in history.asof(left, right, ["k"], "on", ["v"]).collect()} == {"k": 2, "z": None}
    assert history.asof(left, right, ["k"], "on", ["v"], lag=3).where("k = 'k'").first()["asof_v"] == 1


def test_cleaning(spark):
    df = spark.createDataFrame([(" a\t", "5/9/2026"), ("  ", "31/02/2026"), (" ", "2026-01-01"), ("NA", None)], "`  Org ` string, day string")
    out = C.clean_strings(df)
    assert out.columns == ["Org", "day"] and [r["Org"] for r in out.collect()] == ["a", "", None, None]
    assert [r[0] for r in out.select(C.day(F.col("day"))).collect()] == [dt.date(2026, 9, 5), None, None, None]


def test_csv_of_two_bytes_and_missing_years(spark, tmp_path):
    (tmp_path / "20260101_Pedidos_csv_2024.csv").write_bytes('" IdPedido ";Org\n1;" x "\n2;"a\nb"\n'.encode("utf-16"))
    out = requests.read_years(spark, str(tmp_path), "Pedidos", [2024], ["IdPedido", "Org"])
    assert sorted((r["IdPedido"], r["Org"], r["ano"]) for r in out.collect()) == [("1", "x", 2024), ("2", "a\nb", 2024)]
    with pytest.raises(FileNotFoundError):
        requests.read_years(spark, str(tmp_path), "Pedidos", [2023], ["IdPedido"])
    assert requests.read_years(spark, str(tmp_path), "Pedidos", [2023], ["IdPedido"], allow_missing=True).count() == 0


def test_crossfit_never_sees_its_own_fold_and_falls_back(spark):
    rows = [("x", 0, 1), ("x", 1, 0), ("solo", 0, 1), ("y", 1, 1)]
    out = {(r["agency"], r["fold"]): r["rate_out"] for r in encode.crossfit_rates(spark.createDataFrame(rows, "agency string, fold int, y int")).collect()}
    assert out[("solo", 0)] == pytest.approx(0.5)  # the base rate of fold 1
    assert out[("x", 0)] == pytest.approx((0 + 50 * 0.5) / 51)


def test_joins_keep_null_keys_apart(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    right = spark.createDataFrame([(None, 9), ("a", 2), ("a", 1)], "k string, v int")
    assert {r["id"]: r["v"] for r in joins.with_profile(left, right, ["k"], ["v"]).collect()} == {1: None, 2: 1}


def test_serving_matches_its_table_and_refuses_leaks(spark):
    art = serving.Artifact(0.2, 0.3, {"x": 0.4}, births={"x": "2020-01-01"})
    assert serving.Artifact.from_json(art.to_json()) == art
    df = spark.createDataFrame([(" x ", DAY), ("new", DAY), (None, DAY)], "agency string, reg date")
    out = {r["agency"]: r for r in serving.score_batch(df, art, F.col("rate")).collect()}
    assert out["x"]["risk"] == "ALTO RISCO" and out["new"]["probability"] == 0.2 and not out["new"]["agency_known"] and out[None]["agency_age"] is None
    with pytest.raises(ValueError):
        serving.transform(df.withColumn("Situacao", F.lit("x")), art)


def test_calibration_is_monotone_and_clamped(spark):
    df = spark.createDataFrame([(i / 100, int(i % 10 < i / 10)) for i in range(100)], "score double, y int")
    curve = model.fit_calibration(df, points=50)
    assert all(a <= b + 1e-12 for a, b in zip(curve.image, curve.image[1:], strict=False))
    shown = [r[0] for r in spark.createDataFrame([(-1.0,), (9.0,)], "p double").select(curve.apply(F.col("p"))).collect()]
    assert shown == pytest.approx([curve.image[0], curve.image[-1]])


def test_stream_scores_like_the_batch(spark, tmp_path):
    from docketspark.streaming import scoring

    df = spark.createDataFrame([("x", DAY), ("new", DAY)], "agency string, reg date")
    df.write.parquet(str(tmp_path / "in"))
    art = serving.Artifact(0.2, 0.3, {"x": 0.4})
    stream = scoring.read_requests(spark, str(tmp_path / "in"), "agency string, reg date")
    scoring.write_scores(scoring.scored_stream(stream, art), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    want = sorted(tuple(r) for r in serving.score_baseline(df, art).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_daily_rates_as_a_stream(spark, tmp_path):
    from docketspark.streaming import scoring

    at = lambda d, h: dt.datetime(2020, 1, d, h)
    rows = [("x", at(1, 1), 1), ("x", at(1, 23), 0), ("y", at(1, 5), 1), ("x", at(2, 0), 1), ("x", at(9, 0), 0)]
    for i, part in enumerate((rows, [("x", at(20, 0), 1)])):
        spark.createDataFrame(part, "agency string, ts timestamp, y int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = scoring.daily_rates(scoring.read_requests(spark, str(tmp_path / "in"), "agency string, ts timestamp, y int", 1))
        query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["agency"], r["reg"].day): (r["n"], r["positives"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("x", 1): (2, 1), ("y", 1): (1, 1), ("x", 2): (1, 1), ("x", 9): (1, 0)}  # the last day is still open


def test_shares_flags_and_pruned_files(spark, tmp_path):
    d = spark.createDataFrame([(1, 4, "a"), (0, 0, None)], "p int, w int, s string")
    assert [r[0] for r in d.select(C.share_text(F.col("p"), F.col("w"))).collect()] == ["25.00%", "-"]
    out = C.missing_flags(d, ["s", "p"])
    assert [(r["s_missing"], r["p_missing"], r["complete"]) for r in out.collect()] == [(0, 0, 1), (1, 0, 0)]
    (tmp_path / "a.csv").write_bytes(b" id ;x;y\n 1 ;NA;3\n")
    pruned = requests.read_csv(spark, str(tmp_path / "a.csv"), ["id", "y"], "UTF-8")
    assert pruned.collect()[0].asDict() == {"id": "1", "y": "3"} and "x#" not in pruned._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
