"""Encodings learnt from training rows: smoothed rates, cross-fitted rates, category codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.columns import ratio, smoothed


def base_rate(df: DataFrame) -> float:
    value = df.agg(F.avg("y")).first()[0]
    return 0.0 if value is None else float(value)


def smoothed_rate(train: DataFrame, keys: list[str], prior: float = 50.0) -> DataFrame:
    """keys, n, positives, rate; rows with a null key are left out, as they have no category."""
    known = train.dropna(subset=keys)
    base = known.sparkSession.range(1).select(F.lit(base_rate(train)).alias("base"))
    out = known.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    return out.crossJoin(F.broadcast(base)).withColumn("rate", smoothed(F.col("positives"), F.col("n"), F.col("base"), prior)).drop("base")


def smoothed_counts(cells: DataFrame, keys: list[str], n: str, positives: str, prior: float = 50.0) -> DataFrame:
    """smoothed_rate of rows that are counted already (keys, n, positives), with the base rate in `base`."""
    base = cells.agg(F.coalesce(ratio(F.sum(positives), F.sum(n)), F.lit(0.0)).alias("base"))
    out = cells.dropna(subset=keys).groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(positives).alias("positives"))
    return out.crossJoin(F.broadcast(base)).withColumn("rate", smoothed(F.col("positives"), F.col("n"), F.col("base"), prior))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: float, out: str) -> DataFrame:
    """A table's value by key, or the default for unknown and null keys. Spark broadcasts the table if it is small."""
    t = table.select(*keys, F.col(value).alias(out))
    return df.join(t, keys, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def crossfit_rates(train: DataFrame, prior: float = 50.0, fold: str = "fold") -> DataFrame:
    """Per (agency, fold): the rate from the other folds, smoothed to the other folds' base rate.

    One aggregation by (agency, fold); totals less the fold's own give the rest. An agency
    of one fold only gets that base rate.
    """
    cell = train.groupBy("agency", fold).agg(F.count("*").alias("n_in"), F.sum("y").alias("y_in"))
    agency = cell.groupBy("agency").agg(F.sum("n_in").alias("n_all"), F.sum("y_in").alias("y_all"))
    folds = cell.groupBy(fold).agg(F.sum("n_in").alias("n_fold"), F.sum("y_in").alias("y_fold"))
    total = folds.agg(F.sum("n_fold").alias("n_total"), F.sum("y_fold").alias("y_total"))
    base = folds.crossJoin(total).select(fold, ((F.col("y_total") - F.col("y_fold")) / F.nullif(F.col("n_total") - F.col("n_fold"), F.lit(0))).alias("base_out"))
    out = cell.join(agency, "agency").join(F.broadcast(base), fold)
    rate = smoothed(F.col("y_all") - F.col("y_in"), F.col("n_all") - F.col("n_in"), F.coalesce("base_out", F.lit(0.0)), prior)
    return out.select("agency", fold, rate.alias("rate_out"))


def category_codes(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, code): levels in binary order from 0, of training rows only; null has no level."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]))
    levels = train.select(pairs.alias("p")).select("p.*").where("level is not null").distinct()
    return levels.withColumn("code", F.dense_rank().over(W.partitionBy("column").orderBy("level")) - 1)


def encode(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by its code; -1 for null and unseen levels."""
    for c in columns:
        own = codes.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        df = df.join(own, F.col(c).cast("string") == F.col("_level"), "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_level", "_code")
    return df
