"""Cleaning, joins, temporal features and encodings on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.config import DEMO
from docketspark.functions import columns as C
from docketspark.operators import encode, history, joins
from docketspark.plans.evaluation import TRAIN_DAYS
from docketspark.plans.registry import query
from docketspark.sources.requests import request_log, table
from docketspark.sources.store import stored

ORDER = ["request_id", "line", "part", "quantity", "agency"]


def _train(log: DataFrame) -> DataFrame:
    return log.where(F.col("year").isin(*DEMO.train_years))


@query("""SELECT c_custkey AS id, CASE WHEN raw IN (' ', '', 'NA') THEN NULL ELSE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') END AS segment
    FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || c_mktsegment || chr(9) WHEN 1 THEN ' ' WHEN 2 THEN '  ' WHEN 3 THEN 'NA' ELSE c_mktsegment END AS raw FROM customer)""")
def clean_trim_null(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 5
    raw = F.when(m == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit("\t"))).when(m == 1, " ").when(m == 2, "  ").when(m == 3, "NA").otherwise(F.col("c_mktsegment"))
    return C.clean_strings(table(spark, d, "customer").select(F.col("c_custkey").alias(" id "), raw.alias("segment")))


@query("""SELECT DISTINCT CAST(l_shipdate AS DATE) AS reg, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(day(l_shipdate) AS INTEGER) AS day,
    CAST(isodow(l_shipdate) - 1 AS INTEGER) AS weekday, CAST(week(l_shipdate) AS INTEGER) AS week, CAST(dayofyear(l_shipdate) AS INTEGER) AS yearday,
    CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("reg")).distinct()
    return reg.select("reg", *[c.alias(n) for n, c in C.calendar(F.col("reg")).items()])


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def date_coerce(spark: SparkSession, d: str) -> DataFrame:
    m, on = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(m == 0, F.date_format(on, "dd/MM/yyyy")).when(m == 1, F.date_format(on, "d/M/yyyy")).when(m == 2, F.date_format(on, "yyyy-MM-dd")).otherwise("31/02/2000")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.day(text).alias("day"))


@query("""SELECT request_id, asked, CASE WHEN age BETWEEN 10 AND 110 THEN age END AS age FROM (
    SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS asked,
           round((CAST(o_orderdate AS DATE) - (DATE '1880-01-01' + CAST(o_custkey * 37 % 45000 AS INTEGER))) / 365.25, 1) AS age FROM orders)""")
def age_clip(spark: SparkSession, d: str) -> DataFrame:
    born = F.date_add(F.lit("1880-01-01").cast("date"), (F.col("o_custkey") * 37 % 45000).cast("int"))
    asked = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), asked.alias("asked"), C.age(asked, born).alias("age"))


@query("""{W} SELECT status, count(*) AS n FROM (SELECT CASE WHEN line = 3 THEN NULL ELSE status END AS status FROM req) WHERE status IS DISTINCT FROM 'F' GROUP BY status""".replace("{W}", "WITH {LOG}"))
def null_safe_filter(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d).withColumn("status", F.when(F.col("line") != 3, F.col("status")))
    return log.where(~F.col("status").eqNullSafe(F.lit("F"))).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH {LOG} SELECT c_nationkey = s_nationkey AS match, count(*) AS n, sum(y) AS positives FROM req
    JOIN customer ON requester = c_custkey JOIN supplier ON agency = s_suppkey GROUP BY ALL""")
def state_match(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    log = request_log(spark, d).join(c, F.col("requester") == c["c_custkey"]).join(s, F.col("agency") == s["s_suppkey"])
    match = C.same(F.col("c_nationkey"), F.col("s_nationkey")) == 1
    return log.groupBy(match.alias("match")).agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("""WITH n AS (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'SP' WHEN 1 THEN 'SE' WHEN 2 THEN 'PR' WHEN 3 THEN 'AM' ELSE 'XX' END AS uf FROM nation),
    r(uf, region) AS (VALUES ('SP', 'SE'), ('SE', 'NE'), ('PR', 'S'), ('AM', 'N'))
    SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(coalesce(x.region = y.region, false) AS INTEGER) AS same_region
    FROM n a CROSS JOIN n b LEFT JOIN r x ON a.uf = x.uf LEFT JOIN r y ON b.uf = y.uf WHERE a.n_nationkey < b.n_nationkey""")
def region_match(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_regionkey")
    n = table(spark, d, "nation").select("n_nationkey", F.when(k == 0, "SP").when(k == 1, "SE").when(k == 2, "PR").when(k == 3, "AM").otherwise("XX").alias("uf"))
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("uf").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("uf").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", C.same_region(F.col("x"), F.col("y")).alias("same_region"))


@query("""SELECT l_returnflag AS flag, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, count(*) AS n FROM lineitem GROUP BY 1""")
def label_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.max(C.flag(F.col("l_returnflag"), "R")).alias("y"), F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, substr(p_type, 1, 5) AS head, length(p_name) AS size, CAST(regexp_matches(p_type, 'BRASS|STEEL') AS INTEGER) AS metal,
    regexp_extract(p_brand, '[0-9]+') AS digits, round(ln(1 + p_retailprice), 6) AS log_price FROM part""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.substring("p_type", 1, 5).alias("head"), F.length("p_name").cast("long").alias("size"),
        F.col("p_type").rlike("BRASS|STEEL").cast("int").alias("metal"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("digits"), F.round(F.log1p("p_retailprice"), 6).alias("log_price"),
    )


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'middle'
    WHEN l_quantity > 30 AND l_quantity <= 50 THEN 'high' END AS band FROM lineitem) GROUP BY band""")
def right_closed_bins(spark: SparkSession, d: str) -> DataFrame:
    band = C.binned(F.col("l_quantity"), [0, 10, 30, 50], ["low", "middle", "high"])
    return table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT k, json_extract_string(props, '$.' || k) AS v, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """Rows per key and value of the payload."""
    pairs = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return pairs.groupBy("k", "v").agg(F.count("*").alias("n"))


@query("""WITH {LOG}, y AS (SELECT unnest([1995, 1996, 1997, 1998, 1999, 2000, 2001]) AS year), p AS (SELECT year, c_custkey, arg_min(c_mktsegment, c_name) AS segment, arg_min(c_nationkey, c_name) AS nation
        FROM customer, y WHERE (c_nationkey + year) % 5 <> 0 GROUP BY ALL)
    SELECT req.year, segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, count(nation) AS known FROM req LEFT JOIN p ON requester = c_custkey AND req.year = p.year GROUP BY ALL""")
def profile_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the request's own year; each year lacks a fifth of them."""
    years = F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long")))
    profiles = table(spark, d, "customer").withColumnRenamed("c_custkey", "requester").withColumn("year", years).where("(c_nationkey + year) % 5 <> 0")
    log = stored(request_log(spark, d).select("year", "requester", "y"))
    counts = log.groupBy("year", "requester").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))  # requests meet their profile summed
    out = joins.with_profile(counts, profiles, ["year", "requester"], ["c_name"])
    known = F.coalesce(F.sum(F.when(F.col("c_nationkey").isNotNull(), F.col("n"))), F.lit(0))
    return out.groupBy("year", F.col("c_mktsegment").alias("segment")).agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), known.alias("known"))


@query("""WITH {LOG}, m AS (SELECT *, CAST(CASE WHEN line = 3 THEN 1 ELSE 0 END AS INTEGER) AS channel_missing, CAST(CASE WHEN quantity > 40 THEN 1 ELSE 0 END AS INTEGER) AS quantity_missing FROM req)
    SELECT channel_missing, quantity_missing, CAST(1 - greatest(channel_missing, quantity_missing) AS INTEGER) AS complete, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM m GROUP BY ALL""")
def missing_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which of two fields a request lacks, and whether it is complete."""
    log = request_log(spark, d).withColumns({"channel": F.when(F.col("line") != 3, F.col("channel")), "quantity": F.when(F.col("quantity") <= 40, F.col("quantity"))})
    return C.missing_flags(log, ["channel", "quantity"]).groupBy("channel_missing", "quantity_missing", "complete").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("""WITH {LOG} SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT agency) AS agencies FROM req JOIN orders ON request_id = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def appeals_inner_join(spark: SparkSession, d: str) -> DataFrame:
    appeals = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("request_id"), "o_orderstatus")
    return request_log(spark, d).join(appeals, "request_id").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("agency").alias("agencies"))


@query("""WITH {LOG} SELECT agency, count(*) AS n FROM req WHERE requester IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY agency""")
def receivers_semi(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("requester"))
    return request_log(spark, d).join(rich, "requester", "left_semi").groupBy("agency").agg(F.count("*").alias("n"))


@query("""WITH {LOG} SELECT DISTINCT requester, agency FROM req r WHERE year >= 1997 AND NOT EXISTS (SELECT 1 FROM req s WHERE s.requester = r.requester AND s.agency = r.agency AND s.year < 1997)""")
def new_agencies_anti(spark: SparkSession, d: str) -> DataFrame:
    """Agencies that are new to a requester from 1997 on."""
    log, pair = request_log(spark, d), ["requester", "agency"]
    return log.where("year >= 1997").select(*pair).distinct().join(log.where("year < 1997").select(*pair), pair, "left_anti")


@query("""WITH o AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer), n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0)
    SELECT 'c_mktsegment' AS "column", count(*) AS n, count(*) FILTER (o.c_mktsegment IS DISTINCT FROM n.c_mktsegment) AS changed FROM o JOIN n USING (c_custkey)
    UNION ALL SELECT 'c_nationkey', count(*), count(*) FILTER (o.c_nationkey IS DISTINCT FROM n.c_nationkey) FROM o JOIN n USING (c_custkey)""")
def snapshot_compare(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer")
    new = old.where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return joins.compare_snapshots(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""WITH {LOG}, t AS (SELECT agency, channel, count(*) AS n FROM req WHERE year BETWEEN 1995 AND 1998 GROUP BY ALL HAVING count(*) >= 5)
    SELECT coalesce(t.n, -1) AS n, count(*) AS rows FROM req LEFT JOIN t USING (agency, channel) GROUP BY 1""")
def composite_lookup(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    t = _train(log).groupBy("agency", "channel").agg(F.count("*").alias("n")).where("n >= 5")
    return joins.composite_lookup(log, t, ["agency", "channel"], "n", -1).groupBy("n").agg(F.count("*").alias("rows"))


@query("""WITH {LOG}, r AS (SELECT agency, reg, max(part) AS part FROM req GROUP BY ALL), l AS (SELECT DISTINCT agency, reg FROM req)
    SELECT l.agency, l.reg, r.part AS asof_part FROM l ASOF LEFT JOIN r ON l.agency = r.agency AND l.reg >= r.reg + 60""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    return history.asof(log.select("agency", "reg").distinct(), log.select("agency", "reg", "part"), ["agency"], "reg", ["part"], lag=60)


_KEYS = "request_id, line, part, quantity, agency"
_OWN = f"(PARTITION BY requester ORDER BY reg, {_KEYS})"


@query("WITH {LOG} SELECT requester, reg, " + _KEYS + f", CASE WHEN requester <> 0 THEN row_number() OVER {_OWN} - 1 ELSE -1 END AS n_prior FROM req")
def prior_count(spark: SparkSession, d: str) -> DataFrame:
    return history.prior_counts(request_log(spark, d), ORDER).select("requester", "reg", *ORDER, "n_prior")


@query("WITH {LOG} SELECT requester, reg, " + _KEYS + f", CASE WHEN requester <> 0 THEN row_number() OVER (PARTITION BY requester, agency ORDER BY reg, {_KEYS}) - 1 ELSE -1 END AS n_prior_pair FROM req")
def prior_count_pair(spark: SparkSession, d: str) -> DataFrame:
    return history.prior_counts(request_log(spark, d), ORDER).select("requester", "reg", *ORDER, "n_prior_pair")


@query("WITH {LOG}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY requester, agency ORDER BY reg, " + _KEYS + ") = 1 THEN 1 ELSE 0 END AS first FROM req)"
       " SELECT requester, reg, " + _KEYS + f", CAST(CASE WHEN requester <> 0 THEN sum(first) OVER (PARTITION BY requester ORDER BY reg, {_KEYS} ROWS UNBOUNDED PRECEDING) - first ELSE -1 END AS BIGINT) AS n_agencies_prior FROM f")  # fmt: skip
def prior_distinct_agencies(spark: SparkSession, d: str) -> DataFrame:
    return history.prior_counts(request_log(spark, d), ORDER).select("requester", "reg", *ORDER, "n_agencies_prior")


@query("WITH {LOG} SELECT requester, reg, " + _KEYS + f", CAST(CASE WHEN requester <> 0 THEN coalesce(reg - lag(reg) OVER {_OWN}, -1) ELSE -1 END AS BIGINT) AS days_since_last FROM req")
def days_since_last(spark: SparkSession, d: str) -> DataFrame:
    return history.prior_counts(request_log(spark, d), ORDER).select("requester", "reg", *ORDER, "days_since_last")


_PAST = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 60 DAY PRECEDING"


@query(f"""WITH {{LOG}} SELECT requester, reg, request_id, line, part, CAST(CASE WHEN requester <> 0 THEN coalesce(sum(y) OVER (PARTITION BY requester ORDER BY reg {_PAST}), 0) ELSE -1 END AS BIGINT) AS prev,
    CASE WHEN requester <> 0 THEN count(*) OVER (PARTITION BY requester ORDER BY reg {_PAST}) END AS prev_den FROM req""")
def matured_history(spark: SparkSession, d: str) -> DataFrame:
    return history.matured_history(request_log(spark, d), ["requester"], "prev").select("requester", "reg", "request_id", "line", "part", "prev", "prev_den")


@query(f"""WITH {{LOG}}, h AS (SELECT *, sum(y) OVER w AS s, count(*) OVER w AS c FROM req WINDOW w AS (PARTITION BY requester, agency ORDER BY reg {_PAST}))
    SELECT requester, agency, reg, request_id, line, part, round(CASE WHEN c > 0 AND requester <> 0 THEN s / c ELSE -1 END, 6) AS rate FROM h""")
def matured_rate(spark: SparkSession, d: str) -> DataFrame:
    out = history.matured_history(request_log(spark, d), ["requester", "agency"], "prev")
    return out.select("requester", "agency", "reg", "request_id", "line", "part", F.round("prev_rate", 6).alias("rate"))


_ROLL = """WITH {LOG}, b AS (SELECT avg(y) AS base FROM req WHERE year BETWEEN 1995 AND 1998),
    day AS (SELECT agency, reg, count(*) AS n, sum(y) AS s FROM req GROUP BY ALL), r AS (SELECT agency, reg,
    coalesce(sum(n) OVER (PARTITION BY agency ORDER BY reg RANGE BETWEEN INTERVAL 149 DAY PRECEDING AND INTERVAL 60 DAY PRECEDING), 0) AS cnt_90,
    coalesce(sum(s) OVER (PARTITION BY agency ORDER BY reg RANGE BETWEEN INTERVAL 149 DAY PRECEDING AND INTERVAL 60 DAY PRECEDING), 0) AS sum_90,
    coalesce(sum(n) OVER (PARTITION BY agency ORDER BY reg RANGE BETWEEN INTERVAL 424 DAY PRECEDING AND INTERVAL 60 DAY PRECEDING), 0) AS cnt_365,
    coalesce(sum(s) OVER (PARTITION BY agency ORDER BY reg RANGE BETWEEN INTERVAL 424 DAY PRECEDING AND INTERVAL 60 DAY PRECEDING), 0) AS sum_365 FROM day)"""


@query(_ROLL + """ SELECT agency, reg, round((sum_90 + 20 * base) / (cnt_90 + 20), 6) AS rate_90, round((sum_365 + 20 * base) / (cnt_365 + 20), 6) AS rate_365,
    round((sum_90 + 20 * base) / (cnt_90 + 20) - (sum_365 + 20 * base) / (cnt_365 + 20), 6) AS trend, CAST(cnt_90 AS BIGINT) AS volume FROM r, b""")
def rolling_rate_90_365(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    out = history.rolling_rates(log, None, DEMO.windows, DEMO.maturity_days, DEMO.prior_rolling, train=TRAIN_DAYS)
    return out.select("agency", "reg", *[F.round(c, 6).alias(c) for c in ("rate_90", "rate_365", "trend")], F.col("cnt_90").alias("volume"))


@query("""WITH {LOG}, b AS (SELECT agency, min(reg) AS born FROM req WHERE year < 1997 AND agency % 10 <> 0 GROUP BY agency)
    SELECT agency, reg, CAST(reg - born AS INTEGER) AS agency_age, count(*) AS n FROM req LEFT JOIN b USING (agency) GROUP BY ALL""")
def agency_age(spark: SparkSession, d: str) -> DataFrame:
    """Requests are summed per agency and day, from columns that are joined once, before they meet the births."""
    log = stored(request_log(spark, d).select("agency", "reg", "year"))
    born = history.births(log.where("year < 1997 and agency % 10 <> 0"))
    days = log.groupBy("agency", "reg").agg(F.count("*").alias("n"))
    return history.agency_age(days, born).select("agency", "reg", "agency_age", "n")


@query(_ROLL + " SELECT agency, round(arg_max((sum_90 + 20 * base) / (cnt_90 + 20), reg), 6) AS rate FROM r, b GROUP BY agency")
def latest_per_agency(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    rates = history.rolling_rates(log, None, DEMO.windows, DEMO.maturity_days, DEMO.prior_rolling, train=TRAIN_DAYS)
    return history.latest(rates, "agency", "rate_90").select("agency", F.round("rate_90", 6).alias("rate"))


@query("WITH {LOG} SELECT requester, reg, " + _KEYS + f""", CAST(coalesce(sum(y) OVER (PARTITION BY requester ORDER BY reg, {_KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS leaky_sum,
    count(*) OVER (PARTITION BY requester ORDER BY reg, {_KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS leaky_den FROM req""")
def leaky_history(spark: SparkSession, d: str) -> DataFrame:
    """All earlier rows of every requester, the anonymous one too."""
    return history.unlagged_history(request_log(spark, d), ["requester"], ORDER, anonymous=True).select("requester", "reg", *ORDER, "leaky_sum", "leaky_den")


@query("""WITH {LOG}, day AS (SELECT agency, reg, count(*) AS n, sum(y) AS s FROM req GROUP BY ALL) SELECT agency, reg,
    CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS cnt_prior, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS sum_prior FROM day
    WINDOW w AS (PARTITION BY agency ORDER BY reg RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def strictly_prior_rolling(spark: SparkSession, d: str) -> DataFrame:
    return history.strictly_prior(request_log(spark, d), 90).select("agency", "reg", "cnt_prior", "sum_prior")


@query("""WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998), b AS (SELECT avg(y) AS base FROM t)
    SELECT agency, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round((sum(y) + 50 * max(base)) / (count(*) + 50), 6) AS rate FROM t, b GROUP BY agency""")
def agency_smoothed_rate(spark: SparkSession, d: str) -> DataFrame:
    return encode.smoothed_rate(_train(request_log(spark, d)), ["agency"]).withColumn("rate", F.round("rate", 6))


@query("""WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998), b AS (SELECT avg(y) AS base FROM t)
    SELECT agency, channel, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round((sum(y) + 5 * max(base)) / (count(*) + 5), 6) AS rate FROM t, b GROUP BY agency, channel""")
def pair_target_encoding(spark: SparkSession, d: str) -> DataFrame:
    return encode.smoothed_rate(_train(request_log(spark, d)), ["agency", "channel"], prior=5).withColumn("rate", F.round("rate", 6))


@query("""WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998), c AS (SELECT agency, fold, count(*) AS n, sum(y) AS s FROM t GROUP BY ALL),
    a AS (SELECT agency, sum(n) AS n, sum(s) AS s FROM c GROUP BY agency), f AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM c GROUP BY fold), tot AS (SELECT sum(n) AS n, sum(s) AS s FROM c)
    SELECT c.agency, c.fold, round((a.s - c.s + 50 * ((tot.s - f.s) / (tot.n - f.n))) / (a.n - c.n + 50), 6) AS rate_out
    FROM c JOIN a USING (agency) JOIN f ON c.fold = f.fold CROSS JOIN tot""")
def crossfit_rate(spark: SparkSession, d: str) -> DataFrame:
    return encode.crossfit_rates(_train(request_log(spark, d))).withColumn("rate_out", F.round("rate_out", 6))


@query("""WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998), l AS (SELECT 'channel' AS "column", channel AS level FROM t UNION SELECT 'status', status FROM t)
    SELECT "column", level, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY level) - 1 AS INTEGER) AS code FROM l""")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return encode.category_codes(_train(request_log(spark, d)), ["channel", "status"])


@query("""WITH {LOG}, l AS (SELECT channel, dense_rank() OVER (ORDER BY channel) - 1 AS code FROM (SELECT DISTINCT channel FROM req WHERE year BETWEEN 1995 AND 1998 AND channel <> '3-MEDIUM'))
    SELECT CAST(coalesce(code, -1) AS INTEGER) AS channel, count(*) AS n FROM req LEFT JOIN l USING (channel) GROUP BY 1""")
def encode_unseen(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    codes = encode.category_codes(_train(log).where("channel <> '3-MEDIUM'"), ["channel"])
    return encode.encode(log, codes, ["channel"]).groupBy("channel").agg(F.count("*").alias("n"))
