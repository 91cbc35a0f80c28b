"""Audit queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.operators import audit
from docketspark.operators.metrics import quantiles
from docketspark.plans.registry import query
from docketspark.sources.requests import request_log, table
from docketspark.sources.store import stored


def _with_gaps(log: DataFrame) -> DataFrame:
    """The channel as a subject that is filled in late: null for open requests of some agencies."""
    return log.withColumn("subject", F.when((F.col("status") == "F") | (F.col("agency") % 3 != 0), F.col("channel")))


_GAPS = "WITH {LOG}, g AS (SELECT *, CASE WHEN status = 'F' OR agency % 3 <> 0 THEN channel END AS subject FROM req)"


@query(_GAPS + " SELECT status, count(*) AS n, round(count(*) FILTER (subject IS NULL) / count(*), 9) AS missing FROM g GROUP BY status")
def missing_by_status(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing_share(_with_gaps(request_log(spark, d)), "subject", "status").withColumn("missing", F.round("missing", 9))


@query(_GAPS + """ SELECT CAST(days AS INTEGER) AS days, count(*) FILTER (reg > last - CAST(days AS INTEGER)) AS n,
    round(count(*) FILTER (reg > last - CAST(days AS INTEGER) AND subject IS NULL) / count(*) FILTER (reg > last - CAST(days AS INTEGER)), 9) AS missing
    FROM g, (SELECT max(reg) AS last FROM req), (SELECT unnest([3, 30, 90, 365]) AS days) GROUP BY days""")
def missing_by_recency(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing_by_recency(_with_gaps(request_log(spark, d)), "subject", "reg", [3, 30, 90, 365]).withColumn("missing", F.round("missing", 9))


@query("""WITH {LOG} SELECT status, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1, count(*) AS n, round(100.0 * count(*) FILTER (y = 0) / count(*), 6) AS pct_0,
    round(100.0 * count(*) FILTER (y = 1) / count(*), 6) AS pct_1 FROM req GROUP BY status""")
def status_crosstab(spark: SparkSession, d: str) -> DataFrame:
    out = audit.crosstab(request_log(spark, d), "status", "y", [0, 1])
    return out.select("status", "n_0", "n_1", "n", F.round("pct_0", 6).alias("pct_0"), F.round("pct_1", 6).alias("pct_1"))


_PREFIX = """WITH {LOG}, c AS (SELECT substr(CAST(request_id AS VARCHAR), 1, 2) AS prefix, agency, count(*) AS c FROM req GROUP BY ALL),
    r AS (SELECT prefix, agency, c, sum(c) OVER (PARTITION BY prefix) AS n, row_number() OVER (PARTITION BY prefix ORDER BY c DESC, agency) AS rn FROM c)"""


def _prefixed(log: DataFrame) -> DataFrame:
    """(prefix, agency) of every request, stored: the join and the sums that follow don't share a task's memory."""
    return stored(log.select(F.substring(F.col("request_id").cast("string"), 1, 2).alias("prefix"), "agency"))


@query(_PREFIX + " SELECT prefix, CAST(n AS BIGINT) AS n, agency AS modal, round(c / n, 9) AS purity FROM r WHERE rn = 1")
def modal_purity(spark: SparkSession, d: str) -> DataFrame:
    log = _prefixed(request_log(spark, d))
    return audit.modal_purity(log, "prefix", "agency").withColumn("purity", F.round("purity", 9))


@query(_PREFIX + " SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round(sum(c) / sum(n), 9) AS purity FROM r WHERE rn = 1")
def weighted_purity(spark: SparkSession, d: str) -> DataFrame:
    log = _prefixed(request_log(spark, d))
    return audit.weighted_purity(log, "prefix", "agency").withColumn("purity", F.round("purity", 9))


@query("""WITH {LOG} SELECT CAST(quantity > 25 AS BOOLEAN) AS large, year, count(*) AS n, round(avg(reg - asked), 6) AS mean, quantile_cont(reg - asked, 0.5) AS median,
    round(quantile_cont(reg - asked, 0.05), 6) AS p05, round(quantile_cont(reg - asked, 0.95), 6) AS p95 FROM req GROUP BY ALL""")
def deadline_spread(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d).withColumn("large", F.col("quantity") > 25)
    out = audit.spread(log, F.datediff("reg", "asked"), ["large", "year"])
    return out.select("large", "year", "n", F.round("mean", 6).alias("mean"), "median", F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"))


@query("""WITH {LOG} SELECT year, quantile_cont(reg - asked, 0.5) FILTER (y = 0) AS y_0, quantile_cont(reg - asked, 0.5) FILTER (y = 1) AS y_1 FROM req GROUP BY year""")
def deadline_pivot(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d).withColumn("days", F.datediff("reg", "asked"))
    q = quantiles(log, "days", [0.5], ["year", "y"])
    return q.groupBy("year").pivot("y", [0, 1]).agg(F.max(F.get("quantiles", F.lit(0)))).select("year", F.col("0").alias("y_0"), F.col("1").alias("y_1"))


@query("""WITH {LOG}, c AS (SELECT year, quantity, count(*) AS c FROM req GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY year) AS n, row_number() OVER (PARTITION BY year ORDER BY c DESC, quantity) AS rn FROM c)
    SELECT year, CAST(n AS BIGINT) AS n, quantity AS modal, round(c / n, 9) AS share FROM r WHERE rn = 1""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    return audit.modal_share(request_log(spark, d), "quantity", "year").withColumn("share", F.round("share", 9))


@query("""WITH {LOG}, big AS (SELECT agency, year FROM req GROUP BY ALL HAVING count(*) >= 50),
    e AS (SELECT agency, year, quantile_cont(quantity, [0.25, 0.5, 0.75]) AS e FROM req JOIN big USING (agency, year) GROUP BY ALL)
    SELECT CAST(CASE WHEN quantity <= e[1] THEN 1 WHEN quantity <= e[2] THEN 2 WHEN quantity <= e[3] THEN 3 ELSE 4 END AS INTEGER) AS quartile, count(*) AS n, round(avg(y), 9) AS rate
    FROM req JOIN e USING (agency, year) GROUP BY 1""")
def within_group_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return audit.within_group_quartiles(request_log(spark, d), "quantity", ["agency", "year"], 50).withColumn("rate", F.round("rate", 9))


_PROTOCOL = "WITH {LOG}, p AS (SELECT *, lpad(CAST(request_id AS VARCHAR), 11, '0') || year(asked) || lpad(CAST(line AS VARCHAR), 2, '0') AS protocol FROM req)"


def _with_protocol(log: DataFrame) -> DataFrame:
    """A protocol of eleven digits, the year in which was asked, and two digits."""
    return log.withColumn("protocol", F.concat(F.lpad(F.col("request_id").cast("string"), 11, "0"), F.year("asked").cast("string"), F.lpad(F.col("line").cast("string"), 2, "0")))


@query(_PROTOCOL + " SELECT year, count(*) AS n, round(count(*) FILTER (CAST(substr(protocol, 12, 4) AS BIGINT) = year) / count(*), 9) AS agree FROM p GROUP BY year")
def protocol_year(spark: SparkSession, d: str) -> DataFrame:
    """Does the protocol's year tell the year of the request?"""
    log = _with_protocol(request_log(spark, d))
    return audit.agreement(log, F.substring("protocol", 12, 4).cast("long"), F.col("year"), "year").withColumn("agree", F.round("agree", 9))


@query(_PROTOCOL + """, v AS (SELECT y, CAST(substr(protocol, 6, 6) AS DOUBLE) AS v FROM p), e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM v),
    b AS (SELECT y, v, CAST(greatest(len(list_filter(e, lambda x: x < v)) - 1, 0) AS INTEGER) AS bin FROM v, e)
    SELECT bin, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(y), 9) AS rate FROM b GROUP BY bin""")
def protocol_deciles(spark: SparkSession, d: str) -> DataFrame:
    """The rate by decile of a slice of the protocol, which must not tell the outcome."""
    log = _with_protocol(request_log(spark, d)).withColumn("slice", F.substring("protocol", 6, 6).cast("double"))
    return audit.bin_rates(log, "slice").withColumn("rate", F.round("rate", 9))


@query("""WITH {LOG}, p AS (SELECT requester, count(DISTINCT channel) AS channel, count(DISTINCT status) AS status FROM req GROUP BY requester)
    SELECT 'channel' AS attribute, count(*) FILTER (channel > 1) AS changing, count(*) FILTER (channel > 0) AS known FROM p
    UNION ALL SELECT 'status', count(*) FILTER (status > 1), count(*) FILTER (status > 0) FROM p""")
def attribute_stability(spark: SparkSession, d: str) -> DataFrame:
    return audit.unstable_attributes(request_log(spark, d), "requester", ["channel", "status"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem) WHERE copies > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("WITH {LOG} SELECT round(corr(quantity, y), 6) AS quantity_y, round(corr(reg - asked, y), 6) AS days_y FROM req")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    return request_log(spark, d).agg(F.round(F.corr("quantity", "y"), 6).alias("quantity_y"), F.round(F.corr(F.datediff("reg", "asked"), "y"), 6).alias("days_y"))


@query(_GAPS + " SELECT subject, count(*) AS n, round(count(*) / max(t), 9) AS share FROM g, (SELECT count(*) AS t FROM req) GROUP BY subject")
def normalised_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.normalised_counts(_with_gaps(request_log(spark, d)), "subject").withColumn("share", F.round("share", 9))


@query("WITH {LOG} SELECT agency, count(*) AS n, round(avg(y), 9) AS rate, round(ln(1 + count(*)), 6) AS log_volume FROM req GROUP BY agency HAVING count(*) >= 500")
def minimum_volume(spark: SparkSession, d: str) -> DataFrame:
    out = request_log(spark, d).groupBy("agency").agg(F.count("*").alias("n"), F.avg("y").alias("rate")).where("n >= 500")
    return out.select("agency", "n", F.round("rate", 9).alias("rate"), F.round(F.log1p("n"), 6).alias("log_volume"))


@query("WITH {LOG} SELECT channel, count(*) AS n, count(*) FILTER (quantity < 2) AS abstained, round(avg(CASE WHEN quantity < 2 THEN 1.0 ELSE 0 END), 9) AS rate FROM req GROUP BY channel")
def abstention(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("quantity") < 2
    return request_log(spark, d).groupBy("channel").agg(F.count("*").alias("n"), F.count_if(low).alias("abstained"), F.round(F.avg(low.cast("double")), 9).alias("rate"))


@query("""SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def event_log_daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""WITH {LOG}, f AS (SELECT agency, y, reg, row_number() OVER (PARTITION BY requester ORDER BY reg, request_id, line, part, quantity, agency) AS k FROM req)
    SELECT agency, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM f WHERE k = 1 GROUP BY agency""")
def newcomers_per_agency(spark: SparkSession, d: str) -> DataFrame:
    from docketspark.operators.joins import first_per_key

    first = first_per_key(request_log(spark, d), ["requester"], ["reg", "request_id", "line", "part", "quantity", "agency"])
    return first.groupBy("agency").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
