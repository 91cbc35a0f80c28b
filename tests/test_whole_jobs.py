"""Jobs done whole, and logs read once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketspark.functions.columns import trimmed
from docketspark.operators import audit, history
from docketspark.plans import experiments, features, serving
from docketspark.plans.registry import QUERIES, SQL
from docketspark.sources.requests import request_log

DATA = "/root/testdata/sf0.001"
DAY = dt.date(1998, 1, 1)


@pytest.mark.parametrize("keys", [["requester"], ["requester", "agency"]])
def test_anonymous_rows_have_a_leaky_history(spark, keys):
    """rows of requester 0 and of none were -1, in the SQL, too."""
    rows = [(i, (0, None, 5)[i * 7 % 3], DAY + dt.timedelta(i * 13 % 4), i * 5 % 2, i % 2) for i in range(60)]
    log = spark.createDataFrame(rows, "id int, requester long, reg date, agency int, y int")
    place = {"requester": 1, "agency": 3}
    out = history.unlagged_history(log, keys, ["id"], anonymous=True)
    assert out.columns == [*log.columns, "leaky_sum", "leaky_den"] and out.count() == 60
    for r in out.collect():
        past = [x for x in rows if all(x[place[k]] == r[k] for k in keys) and (x[2], x[0]) < (r["reg"], r["id"])]
        assert (r["leaky_den"], r["leaky_sum"]) == (len(past), sum(x[4] for x in past))
    assert "requester <> 0" not in SQL["leaky_history"]


@pytest.mark.parametrize("name", ["training_windows", "corrections", "history_alignment", "prior_shift", "feature_table_rows", "agency_age"])
def test_the_log_is_read_once(spark, monkeypatch, name):
    """F2, F5, F6, F7, F8: the log was joined anew for every sum of every list of keys and every metric."""
    seen, log = spark.sparkContext.accumulator(0), request_log(spark, DATA)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for plans in (experiments, features, serving):
        monkeypatch.setattr(plans, "request_log", lambda *_: log.mapInArrow(counted, log.schema))
    assert QUERIES[name](spark, DATA).count() > 0
    assert seen.value == log.count()


def test_modal_values_need_no_window(spark):
    """one task sorted all values of a group; ties still go to the smallest value."""
    log = spark.createDataFrame([("a", 3), ("a", 2), ("a", 3), ("a", 2), ("a", 9), ("b", None), (None, 1), ("b", 7)], "g string, v int")
    out = audit.modal_purity(log, "g", "v")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("a", 5, 2, 0.4), ("b", 1, 7, 1.0)}


def test_requests_meet_their_profile_summed(spark, monkeypatch):
    """every request was sorted and joined; now a row per year and requester is."""
    met, join = [], features.joins.with_profile
    monkeypatch.setattr(features.joins, "with_profile", lambda requests, *more: met.append(requests) or join(requests, *more))
    QUERIES["profile_left_join"](spark, DATA)
    log = request_log(spark, DATA)
    assert met[0].count() == log.select("year", "requester").distinct().count() < log.count()


def test_a_text_model_reads_the_log_once(spark, monkeypatch):
    """six sums and the requests themselves each joined the log anew."""
    test_the_log_is_read_once(spark, monkeypatch, "text_model_score")


def test_trimming_needs_no_pattern(spark):
    """a pattern ran over every field of every request; the same white space goes from both ends, and no other."""
    odd = [chr(c) for c in [*range(1, 0x21), 0x85, 0xA0, 0x180E, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    d = spark.createDataFrame([(t,) for c in odd for t in (c, f"{c}a{c}b{c}", f"a{c}\n", f"\r\n{c} é")] + [("",), (None,), ("  a b  ",)], "t string")
    assert d.where(~trimmed(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in d.select(trimmed(F.col("t")))._jdf.queryExecution().toString().lower()


def test_agency_tables_are_those_of_each_agencys_last_day(spark):
    """rolling rates of all days were windowed to take the last one's."""
    log = request_log(spark, DATA).withColumn("agency", F.col("agency") % 3)
    out = serving.serving.agency_tables(log.where("year < 1999"), log)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    base = log.where("year < 1999").agg(F.avg("y")).first()[0]
    rolled = history.rolling_rates(log, base).groupBy("agency").agg(*[F.max_by(c, "reg").alias(c) for c in ("rate_90", "rate_365")], F.min("reg").alias("born"))
    want = {str(r["agency"]): r for r in rolled.collect()}
    got = {r["agency"]: r for r in out.collect()}
    assert set(got) == set(want) and all(got[a]["born"] == r["born"] and got[a]["rate_90"] == pytest.approx(r["rate_90"]) and got[a]["rate_365"] == pytest.approx(r["rate_365"]) for a, r in want.items())
