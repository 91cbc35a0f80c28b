"""Queries of the experiments: causality, alignment, priors, encodings, training years, corrections, random search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.config import DEMO
from docketspark.operators import experiments, history, metrics
from docketspark.operators.model import draws
from docketspark.plans.evaluation import tested
from docketspark.plans.features import ORDER, TRAIN_DAYS
from docketspark.plans.registry import query
from docketspark.sources.requests import request_log
from docketspark.sources.store import stored

CUTS = [dt.date(1996, 6, 30), dt.date(1998, 6, 30), dt.date(2000, 6, 30)]
_ROW = "PARTITION BY requester ORDER BY reg, request_id, line, part, quantity, agency"
_LEAKY = f"coalesce(sum({{y}}) OVER ({_ROW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("WITH {LOG}, c(cut) AS (VALUES " + ", ".join(f"(DATE '{c}')" for c in CUTS) + f"""), f AS (SELECT req.*, cut, CASE WHEN reg > cut - 60 THEN 1 - y ELSE y END AS z FROM req, c WHERE reg <= cut),
    l AS (SELECT requester, {_LEAKY.replace('{y}', 'y').replace('PARTITION BY ', 'PARTITION BY cut, ')} AS a, {_LEAKY.replace('{y}', 'z').replace('PARTITION BY ', 'PARTITION BY cut, ')} AS b FROM f)
    SELECT 'prev' AS feature, count(*) AS n, CAST(0 AS BIGINT) AS changed FROM l UNION ALL SELECT 'prev_here', count(*), 0 FROM l
    UNION ALL SELECT 'leaky_sum', count(*), count(*) FILTER (requester <> 0 AND a <> b) FROM l""")  # fmt: skip
def causality_audit(spark: SparkSession, d: str) -> DataFrame:
    """The matured histories are causal; a history of all earlier labels, planted beside them, is not."""

    def featurize(log: DataFrame) -> DataFrame:
        both = history.matured_history(history.apart(log), ["requester", "agency"], "prev_here")
        both = history.unlagged_history(both, ["requester"], ORDER)
        return history.matured_history(both, ["requester"], "prev")

    log = request_log(spark, d)
    return experiments.causality_audit(log, featurize, ORDER, ["prev", "prev_here", "leaky_sum"], CUTS)


_PAST = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 60 DAY PRECEDING"


@query(f"""WITH {{LOG}}, r AS (SELECT * FROM req WHERE requester <> 0), h AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY requester ORDER BY reg {_PAST}), 0) AS a,
        count(*) OVER (PARTITION BY requester ORDER BY reg {_PAST}) AS c FROM r), m AS (SELECT *, lag(a) OVER ({_ROW}) AS b FROM h)
    SELECT 'prev' AS "column", count(*) AS n, CAST(0 AS BIGINT) AS only_one, CAST(0 AS BIGINT) AS only_two, CAST(0 AS BIGINT) AS differ, CAST(sum(a) AS DOUBLE) AS sum_one, CAST(sum(a) AS DOUBLE) AS sum_two FROM m
    UNION ALL SELECT 'prev_den', count(*), 0, 0, 0, sum(c), sum(c) FROM m
    UNION ALL SELECT 'shifted', count(*), count(*) FILTER (b IS NULL), 0, count(*) FILTER (a <> b), sum(a), sum(b) FROM m""")
def history_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The matured history beside one made by running sums and an as-of join, row by row; and beside one whose values sit a row too late."""
    log = stored(request_log(spark, d).where(F.col("requester") != 0).select("requester", "reg", *ORDER, "y"))
    one = history.matured_history(log, ["requester"], "prev").select("requester", "reg", *ORDER, "prev", "prev_den")
    two = log.join(experiments.history_by_asof(log, ["requester"], "prev"), ["requester", "reg"])
    late = W.partitionBy("requester").orderBy("reg", *ORDER)
    two = two.select("requester", "reg", *ORDER, "prev", "prev_den", F.lag("prev").over(late).alias("shifted"))
    return experiments.alignment_audit(one.withColumn("shifted", F.col("prev")), two, ["requester", "reg", *ORDER], ["prev", "prev_den", "shifted"])


_DAILY = """day AS (SELECT agency, reg, count(*) AS n, sum(y) AS s FROM req GROUP BY ALL), b AS (SELECT avg(y) AS base_all, avg(y) FILTER (year BETWEEN 1995 AND 1998) AS base_train FROM req)"""
_FRAME = "OVER (PARTITION BY agency ORDER BY reg RANGE BETWEEN INTERVAL {a} DAY PRECEDING AND INTERVAL {b} DAY PRECEDING)"


def _rate(base: str, a: int, b: int) -> str:
    frame = _FRAME.replace("{a}", str(a)).replace("{b}", str(b))
    return f"(coalesce(sum(s) {frame}, 0) + 20 * {base}) / (coalesce(sum(n) {frame}, 0) + 20)"


@query(f"WITH {{LOG}}, {_DAILY}, w AS (" + " UNION ALL ".join(f"SELECT {w} AS days, n, abs({_rate('base_all', 59 + w, 60)} - {_rate('base_train', 59 + w, 60)}) AS m FROM day, b" for w in (90, 365)) + """)
    SELECT CAST(days AS INTEGER) AS days, CAST(coalesce(sum(n) FILTER (m > 0), 0) AS BIGINT) AS affected, round(sum(m * n) / sum(n), 9) AS mean, round(max(m), 9) AS most,
    CAST(coalesce(sum(n) FILTER (m > 0.001), 0) AS BIGINT) AS over_0001, CAST(coalesce(sum(n) FILTER (m > 0.01), 0) AS BIGINT) AS over_001 FROM w GROUP BY days""")  # fmt: skip
def prior_shift(spark: SparkSession, d: str) -> DataFrame:
    """What it changes if the rolling rates' prior sees the labels of validation and test."""
    out = experiments.prior_shift(stored(history.daily(request_log(spark, d), ["agency"])), TRAIN_DAYS)
    return out.select("days", "affected", F.round("mean", 9).alias("mean"), F.round("most", 9).alias("most"), "over_0001", "over_001")


@query("""WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998), c AS (SELECT agency, fold, count(*) AS n, sum(y) AS s FROM t GROUP BY ALL),
    a AS (SELECT agency, sum(n) AS n, sum(s) AS s FROM c GROUP BY agency), f AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM c GROUP BY fold), tot AS (SELECT sum(n) AS n, sum(s) AS s FROM c),
    d AS (SELECT c.fold, c.n, (a.s + 50 * tot.s / tot.n) / (a.n + 50) - (a.s - c.s + 50 * ((tot.s - f.s) / (tot.n - f.n))) / (a.n - c.n + 50) AS d FROM c JOIN a USING (agency) JOIN f ON c.fold = f.fold CROSS JOIN tot)
    SELECT fold, CAST(sum(n) AS BIGINT) AS n, round(sum(n * d) / sum(n), 9) AS mean, round(sqrt(greatest(sum(n * d * d) / sum(n) - (sum(n * d) / sum(n)) ** 2, 0)), 9) AS sd, round(sum(n * abs(d)) / sum(n), 9) AS mean_abs,
    round(max(abs(d)), 9) AS most, CAST(coalesce(sum(n) FILTER (abs(d) > 0.01), 0) AS BIGINT) AS over_001, CAST(coalesce(sum(n) FILTER (abs(d) > 0.05), 0) AS BIGINT) AS over_005 FROM d GROUP BY ROLLUP (fold)""")
def encoding_difference(spark: SparkSession, d: str) -> DataFrame:
    """How far the cross-fitted agency rate lies from the plain one, by fold and in all."""
    out = experiments.encoding_difference(request_log(spark, d).where(TRAIN_DAYS))
    return out.select("fold", "n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "mean_abs", "most")], "over_001", "over_005")


WINDOWS = {"1995": [1995], "1996": [1996], "1997": [1997], "1997-1998": [1997, 1998], "1995-1998": [1995, 1996, 1997, 1998]}
KEYS = {"agency": ["agency"], "agency, channel": ["agency", "channel"]}
#: Metrics of counted scores (v, score, n, pos): AP and the precision of the first twentieth, ties by lot.
_MEASURED = """g AS (SELECT v, score, sum(n) AS n, sum(pos) AS pos FROM counted GROUP BY ALL), q AS (SELECT *, coalesce(sum(n) OVER o, 0) AS n_above, coalesce(sum(pos) OVER o, 0) AS pos_above,
    sum(n) OVER (PARTITION BY v) AS n_all, sum(pos) OVER (PARTITION BY v) AS pos_all FROM g WINDOW o AS (PARTITION BY v ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ap AS (SELECT v, sum(pos * (pos_above + pos) / (n_above + n)) / max(pos_all) AS ap, max(n_all) AS n_all FROM q GROUP BY v),
    k AS (SELECT *, least(greatest(CAST(round_even(0.05 * n_all, 0) AS BIGINT), 1), n_all) AS k FROM q),
    p AS (SELECT v, (pos_above + (k - n_above) * pos / n) / k AS precision FROM k WHERE n_above < k AND k <= n_above + n)"""
_SETS = ", ".join(f"('{w}', {y})" for w, ys in WINDOWS.items() for y in ys)


def _window_sql(name: str, by: list[str]) -> str:
    keys = ", ".join(by)
    return f"""SELECT "window" || '|{name}' AS v, "window", '{name}' AS inputs, coalesce((c.s + 50 * base) / (c.n + 50), base) AS score, t.n, t.pos, n_train
        FROM (SELECT {keys}, count(*) AS n, sum(y) AS pos FROM test GROUP BY ALL) t CROSS JOIN (SELECT w AS "window", count(*) AS n_train, avg(y) AS base FROM trained GROUP BY w) b
        LEFT JOIN (SELECT w, {keys}, count(*) AS n, sum(y) AS s FROM trained GROUP BY ALL) c ON c.w = b."window" AND {' AND '.join(f't.{k} = c.{k}' for k in by)}"""


@query(f"""WITH {{LOG}}, sets(w, wy) AS (VALUES {_SETS}), trained AS (SELECT req.*, w FROM req JOIN sets ON year = wy), last AS (SELECT max(reg) - 60 AS last FROM req),
    test AS (SELECT req.* FROM req, last WHERE year >= 2000 AND reg <= last), counted AS ({' UNION ALL '.join(_window_sql(k, v) for k, v in KEYS.items())}), {_MEASURED}
    SELECT "window", inputs, n_train, round(ap, 9) AS ap, round(precision, 9) AS precision FROM ap JOIN p USING (v) JOIN (SELECT DISTINCT v, "window", inputs, n_train FROM counted) USING (v)""")
def training_windows(spark: SparkSession, d: str) -> DataFrame:
    """Five sets of training years, each with the agency alone and with the channel, on one matured test."""
    log = stored(request_log(spark, d).select("agency", "channel", "reg", "year", "y"))
    out = experiments.training_windows(log, tested(log), WINDOWS, KEYS)
    return out.select("window", "inputs", "n_train", F.round("ap", 9).alias("ap"), F.round("precision", 9).alias("precision"))


_MAKINGS = {"neither": ("base_all", 90, 1), "matured": ("base_all", 149, 60), "training prior": ("base_train", 90, 1), "both": ("base_train", 149, 60)}


@query(f"""WITH {{LOG}}, {_DAILY}, r AS (SELECT reg, n, s AS pos, {', '.join(f'round({_rate(*x)}, 9) AS m{i}' for i, x in enumerate(_MAKINGS.values()))} FROM day, b),
    last AS (SELECT max(reg) - 60 AS last FROM req), test AS (SELECT r.* FROM r, last WHERE year(reg) >= 2000 AND reg <= last),
    counted AS ({' UNION ALL '.join(f"SELECT '{v}' AS v, m{i} AS score, n, pos FROM test" for i, v in enumerate(_MAKINGS))}), {_MEASURED}
    SELECT v AS variant, CAST(n_all AS BIGINT) AS n, round(ap, 6) AS ap, round(precision, 6) AS precision FROM ap JOIN p USING (v)""")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    """The rolling rate with and without matured labels, and with and without a prior of the training years alone."""
    days = stored(history.daily(request_log(spark, d), ["agency"]))
    last = days.agg(F.date_sub(F.max("reg"), DEMO.maturity_days)).first()[0]
    out = experiments.corrections(days, TRAIN_DAYS, (F.year("reg") >= DEMO.test_year) & (F.col("reg") <= F.lit(last)))
    return out.select("variant", "n", F.round("ap", 6).alias("ap"), F.round("precision", 6).alias("precision"))


#: Lists of the search over encodings: a score is a mix of the agency's smoothed rate and of the agency and channel's.
LISTS = {"prior": (5, 20, 50, 100), "prior_channel": (2, 5, 10, 50), "share": (0.0, 0.25, 0.5, 1.0), "since": (1995, 1996, 1997), "fold": (0, 1, 2, 3, 4)}
_TRIALS = ", ".join("(" + ", ".join([str(i), *map(str, t.values())]) + ")" for i, t in enumerate(draws(LISTS)))


@query(f"""WITH {{LOG}}, d(trial, prior, prior_channel, share, since, out) AS (VALUES {_TRIALS}), t AS (SELECT trial, req.* FROM req, d WHERE year BETWEEN since AND 1998 AND fold <> d.out),
    b AS (SELECT trial, avg(y) AS base FROM t GROUP BY trial), a AS (SELECT trial, agency, count(*) AS n, sum(y) AS s FROM t GROUP BY ALL), c AS (SELECT trial, agency, channel, count(*) AS n, sum(y) AS s FROM t GROUP BY ALL),
    u AS (SELECT agency, channel, count(*) AS n, sum(y) AS pos FROM req WHERE year = 1999 GROUP BY ALL),
    counted AS (SELECT d.trial AS v, round((1 - share) * (coalesce(a.s, 0) + prior * base) / (coalesce(a.n, 0) + prior) + share * (coalesce(c.s, 0) + prior_channel * base) / (coalesce(c.n, 0) + prior_channel), 9) AS score, u.n, u.pos
        FROM u CROSS JOIN d JOIN b USING (trial) LEFT JOIN a ON a.trial = d.trial AND a.agency = u.agency LEFT JOIN c ON c.trial = d.trial AND c.agency = u.agency AND c.channel = u.channel), {_MEASURED}
    SELECT trial, prior, prior_channel, CAST(share AS DOUBLE) AS share, since, out, round(ap, 6) AS ap, CAST(rank() OVER (ORDER BY round(ap, 6) DESC) AS INTEGER) AS place FROM d JOIN ap ON v = trial""")
def random_search(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen drawn encodings, all measured on the validation year in one plan, and their places; no test row is looked at."""
    log = request_log(spark, d)
    fields = "trial int, prior int, prior_channel int, share double, since int, out int"
    trials = F.broadcast(spark.createDataFrame([(i, *t.values()) for i, t in enumerate(draws(LISTS))], fields))  # sixteen rows
    cells = log.where(TRAIN_DAYS).groupBy("year", "fold", "agency", "channel").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    cells = cells.crossJoin(trials.select("trial", "since", "out")).where("year >= since and fold <> out")
    fine = cells.groupBy("trial", "agency", "channel").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"))
    coarse = fine.groupBy("trial", "agency").agg(F.sum("cn").alias("an"), F.sum("cs").alias("as"))
    base = coarse.groupBy("trial").agg((F.sum("as") / F.sum("an")).alias("base"))
    asked = log.where(F.col("year") == DEMO.validation_year).groupBy("agency", "channel").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).crossJoin(trials)
    asked = asked.join(F.broadcast(base), "trial").join(coarse, ["trial", "agency"], "left").join(fine, ["trial", "agency", "channel"], "left").na.fill(0, ["an", "as", "cn", "cs"])
    rate = lambda s, n, prior: (F.col(s) + F.col(prior) * F.col("base")) / (F.col(n) + F.col(prior))
    score = F.round((1 - F.col("share")) * rate("as", "an", "prior") + F.col("share") * rate("cs", "cn", "prior_channel"), 9)
    ap = metrics.average_precision(asked.select("trial", score.alias("score"), "n", "pos"), by=["trial"], counted=True)
    out = trials.join(ap.select("trial", F.round("ap", 6).alias("ap")), "trial")
    return out.withColumn("place", F.rank().over(W.orderBy(F.desc("ap"))))  # sixteen rows


