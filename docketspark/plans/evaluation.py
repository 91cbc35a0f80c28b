"""Ranking metrics of the lookup baseline on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.config import DEMO
from docketspark.operators import encode, history, metrics
from docketspark.plans.registry import query
from docketspark.sources.requests import request_log
from docketspark.sources.store import stored

#: The days of the training years, as a condition.
TRAIN_DAYS = f"year(reg) in ({', '.join(map(str, DEMO.train_years))})"


def tested(log: DataFrame, since: int = DEMO.test_year) -> DataFrame:
    """Requests from `since` on whose labels have matured on the log's last day."""
    last = log.agg(F.max("reg").alias("_last"))
    return history.matured(log.where(F.col("year") >= since).crossJoin(F.broadcast(last)), F.col("_last"), DEMO.maturity_days).drop("_last")


def baseline(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, score, n, pos): the matured test requests, counted, with the smoothed training rate of their agency as the score.

    The log is read once, into sums per agency and day; rates, the base rate, the last day and the test all come from these.
    """
    by = by or []
    days = stored(history.daily(log, ["agency", *by]))
    rates = encode.smoothed_counts(days.where(TRAIN_DAYS), ["agency"], "n_day", "y_day", DEMO.prior_agency)
    known = days.agg(F.max("reg").alias("_last"), (F.sum(F.when(F.expr(TRAIN_DAYS), F.col("y_day"))) / F.sum(F.when(F.expr(TRAIN_DAYS), F.col("n_day")))).alias("_base"))
    test = history.matured(days.where(F.year("reg") >= DEMO.test_year).crossJoin(F.broadcast(known)), F.col("_last"), DEMO.maturity_days)
    scored = test.join(rates.select("agency", "rate"), "agency", "left").withColumn("score", F.coalesce("rate", "_base"))
    return scored.groupBy(*by, "score").agg(F.sum("n_day").alias("n"), F.sum("y_day").alias("pos"))


BASE = """WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998), base AS (SELECT avg(y) AS base FROM t),
    rates AS (SELECT agency, (sum(y) + 50 * max(base)) / (count(*) + 50) AS rate FROM t, base GROUP BY agency),
    last AS (SELECT max(reg) - 60 AS last FROM req),
    s AS (SELECT req.*, coalesce(rate, base) AS score FROM req LEFT JOIN rates USING (agency), base, last WHERE year >= 2000 AND reg <= last),
    g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM s GROUP BY score),
    a AS (SELECT *, coalesce(sum(n) OVER w, 0) AS n_above, coalesce(sum(pos) OVER w, 0) AS pos_above, sum(n) OVER () AS n_all, sum(pos) OVER () AS pos_all
          FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_PREC = """round((pos_above + (k - n_above) * pos / n) / k, 9) AS precision, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n_tied, CAST(k - n_above AS BIGINT) AS need
    FROM (SELECT *, least(greatest(CAST(round_even({f} * n_all, 0) AS BIGINT), 1), n_all) AS k FROM a) WHERE n_above < k AND k <= n_above + n"""


@query(BASE + " SELECT " + _PREC.replace("{f}", "0.05"))
def lookup_baseline_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_at_k(baseline(request_log(spark, d)), 0.05, counted=True).withColumn("precision", F.round("precision", 9))


@query(BASE + " SELECT " + _PREC.replace("{f}", "0.1"))
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_at_k(baseline(request_log(spark, d)), 0.10, counted=True).withColumn("precision", F.round("precision", 9))


@query(BASE + """ SELECT round(sum(pos * ((n_all - pos_all) - (n_above - pos_above) - (n - pos) / 2)) / max(pos_all * (n_all - pos_all)), 9) AS auc FROM a""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(baseline(request_log(spark, d)), counted=True).select(F.round("auc", 9).alias("auc"))


@query(BASE + """ SELECT round(sum(pos * (pos_above + pos) / (n_above + n)) / max(pos_all), 9) AS ap FROM a""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(baseline(request_log(spark, d)), counted=True).select(F.round("ap", 9).alias("ap"))


@query(BASE + ", " + ", ".join(f"p{i} AS (SELECT {f} AS fraction, {_PREC.replace('{f}', str(f))})" for i, f in enumerate((0.01, 0.05, 0.1)))
       + """, u AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2), r AS (SELECT avg(y) AS base FROM s)
    SELECT CAST(fraction AS DOUBLE) AS fraction, precision, round(base, 9) AS base, round(precision / base, 6) AS lift FROM u, r""")  # fmt: skip
def lift_table(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.lift(baseline(request_log(spark, d)), [0.01, 0.05, 0.1], counted=True)
    return out.select("fraction", F.round("precision", 9).alias("precision"), F.round("base", 9).alias("base"), F.round("lift", 6).alias("lift"))


@query(BASE + " SELECT round(avg((score - y) * (score - y)), 9) AS brier, round(avg(score), 9) AS mean_score, round(avg(y), 9) AS rate, count(*) AS n FROM s")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return metrics.brier(baseline(request_log(spark, d)), counted=True).select(*[F.round(c, 9).alias(c) for c in ("brier", "mean_score", "rate")], "n")


@query(BASE + """, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM s),
    b AS (SELECT y, score, CAST(greatest(len(list_filter(e, lambda x: x < score)) - 1, 0) AS INTEGER) AS bin FROM s, e)
    SELECT bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(y), 9) AS rate FROM b GROUP BY bin""")
def reliability_deciles(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.reliability(baseline(request_log(spark, d)), counted=True)
    return out.select("bin", "n", F.round("mean_score", 9).alias("mean_score"), F.round("rate", 9).alias("rate"))


@query(BASE + " SELECT round(quantile_cont(score, 0.9), 6) AS threshold FROM s")
def queue_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.queue_threshold(baseline(request_log(spark, d)), counted=True)


@query(BASE + """, k AS (SELECT score, n, n_above, n_all, least(greatest(CAST(round_even(0.1 * n_all, 0) AS BIGINT), 1), n_all) AS k FROM a),
    w AS (SELECT score, greatest(0, least(1, (k - n_above) / n)) AS w, k, n_all FROM k)
    SELECT channel, count(*) AS n, round(count(*) / max(n_all), 9) AS share, round(sum(w) / max(k), 9) AS queue_share, round((sum(w) / max(k)) / (count(*) / max(n_all)), 6) AS ratio
    FROM s JOIN w USING (score) GROUP BY channel ORDER BY n DESC, channel LIMIT 8""")
def equity_audit(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.equity(baseline(request_log(spark, d), ["channel"]), "channel", 0.1, counted=True)
    return out.select("channel", "n", F.round("share", 9).alias("share"), F.round("queue_share", 9).alias("queue_share"), F.round("ratio", 6).alias("ratio"))


_DRIFT = """WITH {LOG}, o AS (SELECT agency, avg(y) AS rate FROM req WHERE year = 1997 GROUP BY agency), n AS (SELECT agency, avg(y) AS rate FROM req WHERE year = 1998 GROUP BY agency),
    c AS (SELECT agency, o.rate AS rate_old, n.rate AS rate_new, abs(n.rate - o.rate) AS change FROM o JOIN n USING (agency))"""


def _yearly(log: DataFrame, year: int) -> DataFrame:
    return log.where(F.col("year") == year).groupBy("agency").agg(F.avg("y").alias("rate"))


@query(_DRIFT + " SELECT count(*) AS n, round(quantile_cont(change, 0.5), 9) AS median, round(quantile_cont(change, 0.95), 9) AS p95, count(*) FILTER (change > 0.05) AS moved FROM c")
def rate_drift(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    out = metrics.rate_drift(_yearly(log, 1997), _yearly(log, 1998))[0]
    return out.select("n", F.round("median", 9).alias("median"), F.round("p95", 9).alias("p95"), "moved")


@query(_DRIFT + " SELECT agency, round(rate_old, 9) AS rate_old, round(rate_new, 9) AS rate_new, round(change, 9) AS change FROM c ORDER BY c.change DESC, agency LIMIT 5")
def rate_drift_worst(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    return metrics.rate_drift(_yearly(log, 1997), _yearly(log, 1998))[1].select("agency", *[F.round(c, 9).alias(c) for c in ("rate_old", "rate_new", "change")])


_LEAK = """WITH {LOG}, h AS (SELECT year, y, coalesce(sum(y) OVER m, 0) AS clean_s, count(*) OVER m AS clean_n, sum(y) OVER q - y AS leaky_s, count(*) OVER q - 1 AS leaky_n FROM req
    WINDOW m AS (PARTITION BY agency ORDER BY reg RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 60 DAY PRECEDING), q AS (PARTITION BY agency ORDER BY reg RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    v AS (SELECT 'matured' AS variant, y, round((clean_s + 10) / (clean_n + 20), 9) AS score FROM h WHERE year >= 2000 UNION ALL SELECT 'leaky', y, round((leaky_s + 10) / (leaky_n + 20), 9) FROM h WHERE year >= 2000),
    g AS (SELECT variant, score, count(*) AS n, sum(y) AS pos FROM v GROUP BY ALL), a AS (SELECT *, coalesce(sum(n) OVER w, 0) AS n_above, coalesce(sum(pos) OVER w, 0) AS pos_above,
    sum(n) OVER (PARTITION BY variant) AS n_all, sum(pos) OVER (PARTITION BY variant) AS pos_all FROM g WINDOW w AS (PARTITION BY variant ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT variant, round(sum(pos * ((n_all - pos_all) - (n_above - pos_above) - (n - pos) / 2)) / max(pos_all * (n_all - pos_all)), 9) AS auc FROM a GROUP BY variant"""


@query(_LEAK)
def leak_cost(spark: SparkSession, d: str) -> DataFrame:
    """AUC of an agency's matured history and of one that sees today's labels, side by side."""
    from pyspark.sql import Window as W

    from docketspark.functions.columns import day_number

    log = request_log(spark, d)
    own = W.partitionBy("agency").orderBy(day_number(F.col("reg")))
    m, q = own.rangeBetween(W.unboundedPreceding, -60), own.rangeBetween(W.unboundedPreceding, 0)
    h = log.select(
        "year", "y", F.round((F.coalesce(F.sum("y").over(m), F.lit(0)) + 10) / (F.count("*").over(m) + 20), 9).alias("matured"),
        F.round((F.sum("y").over(q) - F.col("y") + 10) / (F.count("*").over(q) - 1 + 20), 9).alias("leaky"),
    ).where("year >= 2000")
    v = h.select("y", F.explode(F.create_map(F.lit("matured"), "matured", F.lit("leaky"), "leaky")).alias("variant", "score"))
    return metrics.roc_auc(v, by=["variant"]).select("variant", F.round("auc", 9).alias("auc"))
