"""Scoring, refresh and model queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.config import DEMO, MODEL_INPUTS
from docketspark.operators import encode, history, metrics, model, serving, trees
from docketspark.plans.features import TRAIN_DAYS
from docketspark.plans.registry import query
from docketspark.sources.requests import request_log
from docketspark.sources.store import stored

_REFRESH = """WITH {LOG}, b AS (SELECT avg(y) AS base FROM req WHERE year BETWEEN 1995 AND 1998), e AS (SELECT max(reg) - {lag} AS e FROM req)
    SELECT agency, min(reg) AS born, round((count(*) FILTER (y = 1 AND reg > e - 90 AND reg <= e) + 20 * max(base)) / (count(*) FILTER (reg > e - 90 AND reg <= e) + 20), 6) AS rate_90,
    round((count(*) FILTER (y = 1 AND reg > e - 365 AND reg <= e) + 20 * max(base)) / (count(*) FILTER (reg > e - 365 AND reg <= e) + 20), 6) AS rate_365 FROM req, b, e GROUP BY agency"""


def _refresh(spark: SparkSession, d: str, lag: int) -> DataFrame:
    log = request_log(spark, d)
    base = encode.base_rate(log.where(F.col("year").isin(*DEMO.train_years)))
    out = serving.refresh_tables(log, base, lag_days=lag)
    return out.select("agency", "born", F.round("rate_90", 6).alias("rate_90"), F.round("rate_365", 6).alias("rate_365"))


@query(_REFRESH.replace("{lag}", "60"))
def refresh_tables(spark: SparkSession, d: str) -> DataFrame:
    return _refresh(spark, d, 60)


@query(_REFRESH.replace("{lag}", "0"))
def refresh_tables_unlagged(spark: SparkSession, d: str) -> DataFrame:
    return _refresh(spark, d, 0)


def _tables(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows, and the tables by agency, of a log that never saw every ninth agency."""
    seen = log.where(F.col("agency") % 9 != 0)
    train = seen.where(F.col("year").isin(*DEMO.train_years))
    return train, serving.agency_tables(train, seen)


@query("""WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998 AND agency % 9 <> 0), b AS (SELECT avg(y) AS base FROM t),
    r AS (SELECT agency, (sum(y) + 50 * max(base)) / (count(*) + 50) AS rate FROM t, b GROUP BY agency),
    s AS (SELECT CAST(agency AS VARCHAR) AS agency, r.rate IS NOT NULL AS agency_known, coalesce(r.rate, base) AS raw, round(coalesce(r.rate, base), 6) AS probability FROM req LEFT JOIN r USING (agency), b)
    SELECT agency, agency_known, probability, CASE WHEN raw >= 0.335 THEN 'ALTO RISCO' ELSE 'BAIXO RISCO' END AS risk, count(*) AS n FROM s GROUP BY ALL""")
def score_baseline(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d)
    new = log.select("agency", "reg")
    train, tables = _tables(log)
    out = serving.score_baseline(new, serving.build_artifact(train, 0.335), tables)
    return out.groupBy("agency", "agency_known", "probability", "risk").agg(F.count("*").alias("n"))


@query("""WITH {LOG}, s AS (SELECT CAST(agency AS VARCHAR) AS agency, request_id % 3 = 0 AS history_given, request_id % 3 = 1 AS partial_history_ignored,
    CASE WHEN request_id % 3 = 0 THEN CAST(line AS DOUBLE) ELSE -1 END AS n, CASE WHEN request_id % 3 = 0 AND line > 1 THEN 1.0 / (line - 1) ELSE -1 END AS rate FROM req)
    SELECT agency, history_given, partial_history_ignored, n, round(rate, 6) AS rate, count(*) AS rows FROM s GROUP BY ALL""")
def serving_history(spark: SparkSession, d: str) -> DataFrame:
    """All eight history inputs for a third of the requests, seven for another third, none for the rest."""
    log = request_log(spark, d)
    third, line = F.col("request_id") % 3, F.col("line").cast("double")
    values = {c: line for c in serving.HISTORY} | {serving.HISTORY[4]: F.lit(1.0), serving.HISTORY[5]: line - 1}
    given = {c: F.when((third == 0) | ((third == 1) & (F.lit(i) < 7)), v) for i, (c, v) in enumerate(values.items())}
    out = serving.with_history(log.select(F.col("agency").cast("string").alias("agency"), *[v.alias(c) for c, v in given.items()]))
    return out.groupBy(
        "agency", "history_given", "partial_history_ignored", F.col(serving.HISTORY[0]).alias("n"), F.round("prev_reenc_rate_solicitante", 6).alias("rate")
    ).agg(F.count("*").alias("rows"))


@query("""WITH {LOG}, t AS (SELECT * FROM req WHERE year BETWEEN 1995 AND 1998 AND agency % 9 <> 0), b AS (SELECT avg(y) AS base FROM t),
    r AS (SELECT agency, (sum(y) + 50 * max(base)) / (count(*) + 50) AS rate FROM t, b GROUP BY agency),
    s AS (SELECT r.rate IS NOT NULL AS known, coalesce(r.rate, base) AS rate, base, coalesce(r.rate, base) + 0.01 * (CASE WHEN month(reg) = 6 THEN 1 ELSE 0 END) + 0.02 * (CASE WHEN request_id % 2 = 0 THEN 1 ELSE 0 END) AS p,
        request_id % 3 = 0 AS given, request_id % 3 = 1 AS partial FROM req LEFT JOIN r USING (agency), b)
    SELECT round(p, 6) AS probabilidade_reencaminhamento, CASE WHEN p >= 0.345 THEN 'ALTO RISCO' ELSE 'BAIXO RISCO' END AS alerta, CAST(0.345 AS DOUBLE) AS threshold,
        round(CASE WHEN p < 0.5 THEN 0.8 * p ELSE 0.4 + 1.2 * (p - 0.5) END, 6) AS probabilidade_calibrada, true AS calibrada_apenas_para_leitura, known AS orgao_conhecido,
        round(rate, 6) AS orgao_rate_historica, round(base, 6) AS orgao_rate_movel_90d, round(base, 6) AS base_rate_coorte, given AS historico_informado, partial AS historico_parcial_ignorado, count(*) AS n
    FROM s GROUP BY ALL""")
def score_responses(spark: SparkSession, d: str) -> DataFrame:
    """The eleven fields of a scored request, for every request; a model in plain sight stands for the trees."""
    log = request_log(spark, d)
    train, tables = _tables(log)
    artifact = serving.build_artifact(train, 0.345, grid=[0.0, 0.5, 1.0], image=[0.0, 0.4, 1.0])
    none = F.lit(None).cast("double")  # rolling rates are left to the base rate
    tables = tables.select("agency", "rate", none.alias("rate_90"), none.alias("rate_365"), "born")
    third, uf = F.col("request_id") % 3, F.when(F.col("request_id") % 2 == 0, "DF").otherwise("SP")
    given = [F.when((third == 0) | ((third == 1) & (F.lit(i) < 7)), F.lit(1.0)).alias(c) for i, c in enumerate(serving.HISTORY)]
    asked = log.select(F.concat(F.lit(" "), F.col("agency").cast("string"), F.lit(" ")).alias("OrgaoDestinatario"), F.date_format("reg", "dd/MM/yyyy").alias("DataRegistro"), F.lit("DF").alias("UF"), uf.alias("UF_sol"), *given)
    model = F.col("orgao_rate") + 0.01 * (F.col("reg_month") == 6).cast("int") + 0.02 * F.col("uf_match")
    out = serving.responses(asked, artifact, model, tables)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


#: A model of four trees over the shipped model's inputs, made up to have all kinds of splits: a category set of two words, an unknown that
#: goes left, one that goes right, a zero that counts as unknown, a category that is never given, and a tree of one leaf.
MODEL = "tree\nversion=v4\nobjective=binary sigmoid:1\nfeature_names=" + " ".join(MODEL_INPUTS) + """

Tree=0
num_leaves=4
num_cat=1
split_feature=0 18 17
threshold=0 0.25 40.5
decision_type=1 0 10
left_child=1 -1 -3
right_child=2 -2 -4
leaf_value=-0.5 0.25 0.75 -0.125
cat_boundaries=0 2
cat_threshold=1 4

Tree=1
num_leaves=3
num_cat=0
split_feature=20 30
threshold=2.5 700.5
decision_type=4 8
left_child=1 -1
right_child=-3 -2
leaf_value=0.375 -0.25 0.125

Tree=2
num_leaves=4
num_cat=1
split_feature=19 15 9
threshold=0.5 3.5 0
decision_type=0 0 1
left_child=1 -1 -3
right_child=2 -2 -4
leaf_value=-0.0625 0.5 2 0.3125
cat_boundaries=0 1
cat_threshold=4294967295

Tree=3
num_leaves=1
num_cat=0
leaf_value=0.05

end of trees
"""
CODES = {"Esfera": {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 34}, "FormaResposta": {"F": 0}, "Profissao": {}}


@query("""WITH {LOG}, seen AS (SELECT * FROM req WHERE agency % 9 <> 0), t AS (SELECT * FROM seen WHERE year BETWEEN 1995 AND 1998), b AS (SELECT avg(y) AS base FROM t),
    r AS (SELECT agency, (sum(y) + 50 * max(base)) / (count(*) + 50) AS rate FROM t, b GROUP BY agency), o AS (SELECT agency, min(reg) AS born FROM seen GROUP BY agency),
    x AS (SELECT channel, r.rate IS NOT NULL AS known, coalesce(r.rate, base) AS rate, reg - o.born AS days, CASE WHEN request_id % 2 = 0 THEN 1 ELSE 0 END AS uf_match, isodow(reg) - 1 AS dow,
            CASE WHEN line % 4 = 1 THEN NULL ELSE round((reg - (DATE '1930-01-01' + CAST(requester * 37 % 30000 AS INTEGER))) / 365.25, 1) END AS a,
            CASE WHEN request_id % 3 = 0 THEN line - 1 ELSE -1 END AS previous, request_id % 3 = 0 AS given FROM req LEFT JOIN r USING (agency) LEFT JOIN o USING (agency), b),
    y AS (SELECT *, CASE WHEN a BETWEEN 10 AND 110 THEN a END AS age FROM x),
    s AS (SELECT known, given, 1 / (1 + exp(-(
        CASE WHEN channel IN ('1-URGENT', '3-MEDIUM') THEN CASE WHEN rate <= 0.25 THEN -0.5 ELSE 0.25 END ELSE CASE WHEN age IS NULL OR age <= 40.5 THEN 0.75 ELSE -0.125 END END
        + CASE WHEN previous <> 0 AND previous <= 2.5 THEN CASE WHEN days <= 700.5 THEN 0.375 ELSE -0.25 END ELSE 0.125 END
        + CASE WHEN uf_match <= 0.5 THEN CASE WHEN dow <= 3.5 THEN -0.0625 ELSE 0.5 END ELSE 0.3125 END + 0.05))) AS p FROM y)
    SELECT round(p, 6) AS probabilidade_reencaminhamento, CASE WHEN p >= 0.6 THEN 'ALTO RISCO' ELSE 'BAIXO RISCO' END AS alerta, known AS orgao_conhecido, given AS historico_informado, count(*) AS n FROM s GROUP BY ALL""")
def text_model_score(spark: SparkSession, d: str) -> DataFrame:
    """Every request through a text model, end to end: the request's own fields, tables by agency, codes, all 31 inputs, trees, answer."""
    log = stored(request_log(spark, d).select("request_id", "line", "reg", "requester", "agency", "y", "status", "channel", "year"))
    train, tables = _tables(log)
    artifact = serving.build_artifact(train, 0.6, list(MODEL_INPUTS), codes=CODES)
    forest = trees.parse_text_model(MODEL)
    artifact.check(forest.names)
    given, born = F.col("request_id") % 3 == 0, F.date_add(F.lit("1930-01-01").cast("date"), (F.col("requester") * 37 % 30000).cast("int"))
    asked = log.select(
        F.col("agency").cast("string").alias("OrgaoDestinatario"), F.date_format("reg", "dd/MM/yyyy").alias("DataRegistro"), F.col("channel").alias("Esfera"), F.col("status").alias("FormaResposta"),
        F.when(F.col("line") % 4 != 1, F.date_format(born, "dd/MM/yyyy")).alias("DataNascimento"), F.lit("DF").alias("UF"), F.when(F.col("request_id") % 2 == 0, "DF").otherwise("SP").alias("UF_sol"),
        *[F.when(given, F.col("line").cast("double") - 1).alias(c) for c in serving.HISTORY],
    )
    out = serving.responses(asked, artifact, forest, tables)
    return out.groupBy("probabilidade_reencaminhamento", "alerta", "orgao_conhecido", "historico_informado").agg(F.count("*").alias("n"))


@query("""WITH {LOG}, m AS (SELECT max(reg) AS m FROM req) SELECT year, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM req, m WHERE reg <= m - 60 AND status <> 'F' GROUP BY year""")
def matured_settled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Requests that aren't in transit (status F stands for that) and whose labels have matured."""
    log = request_log(spark, d)
    last = log.agg(F.max("reg").alias("last"))
    out = history.matured(history.settled(log, "status", "F").crossJoin(F.broadcast(last)), F.col("last"))
    return out.groupBy("year").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("""WITH {LOG}, o AS (SELECT DISTINCT part FROM req WHERE year = 1995), n AS (SELECT DISTINCT part FROM req WHERE year = 1998)
    SELECT 'common' AS change, count(*) AS n FROM (SELECT * FROM o INTERSECT SELECT * FROM n) UNION ALL SELECT 'gone', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)
    UNION ALL SELECT 'new', count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def refreshed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that two years' tables share, lose and gain."""
    log = request_log(spark, d)
    year = lambda y: log.where(F.col("year") == y).select("part").distinct()
    found = serving.key_changes(year(1995), year(1998), "part").groupBy("change").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([("common",), ("gone",), ("new",)], "change string")
    return kinds.join(found, "change", "left").select("change", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH {LOG}, a AS (SELECT * REPLACE (CASE WHEN request_id % 5 = 0 THEN 0 ELSE requester END AS requester) FROM req),
    c AS (SELECT requester, row_number() OVER (PARTITION BY requester ORDER BY reg) - 1 AS n, row_number() OVER (PARTITION BY requester, agency ORDER BY reg) - 1 AS p,
        coalesce(reg - lag(reg) OVER (PARTITION BY requester ORDER BY reg), -1) AS d FROM a)
    SELECT requester, count(*) AS rows, CAST(sum(CASE WHEN requester = 0 THEN -1 ELSE n END) AS BIGINT) AS n_prior, CAST(sum(CASE WHEN requester = 0 THEN -1 ELSE p END) AS BIGINT) AS n_prior_pair,
        CAST(sum(CASE WHEN requester = 0 THEN -1 ELSE d END) AS BIGINT) AS days FROM c GROUP BY requester""")
def prior_counts_with_anonymous(spark: SparkSession, d: str) -> DataFrame:
    """Histories where a fifth of the rows is anonymous."""
    log = request_log(spark, d).withColumn("requester", F.when(F.col("request_id") % 5 == 0, F.lit(0)).otherwise(F.col("requester")))
    out = history.prior_counts(log, ["request_id", "line", "part", "quantity", "agency"])
    return out.groupBy("requester").agg(F.count("*").alias("rows"), F.sum("n_prior").alias("n_prior"), F.sum("n_prior_pair").alias("n_prior_pair"), F.sum("days_since_last").alias("days"))


FEATURES = ["quantity", "n_prior", "n_prior_pair", "days_since_last", "prev", "prev_rate", "rate_90", "rate_365", "trend", "channel"]


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """All features of every request; the log is joined once and stored, the plan shuffles it once by requester and once by (agency, day)."""
    log = stored(request_log(spark, d))
    out = history.histories(log, ["request_id", "line", "part", "quantity", "agency"])
    rates = history.rolling_rates(stored(history.daily(log, ["agency"])), train=TRAIN_DAYS).select("agency", "reg", "rate_90", "rate_365", "trend")
    out = out.join(rates, ["agency", "reg"])
    codes = encode.category_codes(log.where(F.col("year").isin(*DEMO.train_years)), ["channel"])
    return encode.encode(out, codes, ["channel"])


@query("""WITH {LOG} SELECT year, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM req WHERE requester <> 0 GROUP BY year""")
def feature_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """The feature table has each request once (anonymous requesters have no history and are left out here)."""
    return feature_table(spark, d).where("rate_90 is not null and n_prior >= 0").groupBy("year").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query()
def trained_model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees with validation-chosen size and isotonic calibration, measured on the test years. All with the operator's defaults."""
    t = stored(feature_table(spark, d).select(*FEATURES, "y", "year"))
    train, validation = t.where(F.col("year").isin(*DEMO.train_years)), t.where(F.col("year") == DEMO.validation_year)
    fitted = model.fit_trees(train, validation, FEATURES)
    curve = model.fit_calibration(fitted.score(validation))
    test = stored(metrics.blocks(fitted.score(t.where(F.col("year") >= DEMO.test_year))))  # rows per score, which tells the shown value
    ap, auc = metrics.average_precision(test, counted=True), metrics.roc_auc(test, counted=True)
    brier = metrics.brier(test.withColumn("shown", curve.apply(F.col("score"))), "shown", counted=True)
    return ap.crossJoin(auc).crossJoin(brier.select("brier", "n")).withColumn("trees", F.lit(fitted.trees))  # a row each
