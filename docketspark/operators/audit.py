"""Audits: is a field really known when a request arrives?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.columns import ratio
from docketspark.operators.metrics import edges, quantile_bin, quantiles
from docketspark.sources.store import stored


def missing_share(df: DataFrame, column: str, by: str) -> DataFrame:
    """Rows and share of nulls per group; a null group is a group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), (F.count_if(F.col(column).isNull()) / F.count("*")).alias("missing"))


def missing_by_recency(df: DataFrame, column: str, on: str, days: list[int]) -> DataFrame:
    """Share of nulls among rows later than the last day less d, per d. One pass: the tails are conditional sums."""
    last = df.agg(F.max(on).alias("_last"))
    d = df.crossJoin(F.broadcast(last))
    later = {n: F.col(on) > F.date_sub("_last", n) for n in days}
    sums = d.agg(
        *[F.count_if(later[n]).alias(f"n_{n}") for n in days], *[F.count_if(later[n] & F.col(column).isNull()).alias(f"m_{n}") for n in days]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("days"), F.col(f"n_{n}").alias("n"), F.col(f"m_{n}").alias("m")) for n in days]))
    return sums.select(rows.alias("r")).select("r.days", "r.n", ratio(F.col("r.m"), F.col("r.n")).alias("missing"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts per row value and column value, and each row's shares in percent."""
    t = df.groupBy(row).pivot(column, values).count()
    names = [str(v) for v in values]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names])
    out = t.select(row, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(f"n_{n}") for n in names], total.alias("n"))
    return out.select("*", *[ratio(100.0 * F.col(f"n_{n}"), F.col("n")).alias(f"pct_{n}") for n in names])


def modal_purity(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: rows, most frequent value (the smallest of ties) and its share."""
    c = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    modal = F.min_by(value, F.struct(-F.col("c"), F.col(value)))
    return c.groupBy(group).agg(F.sum("c").alias("n"), modal.alias("modal"), (F.max("c") / F.sum("c")).alias("purity"))


def weighted_purity(df: DataFrame, group: str, value: str) -> DataFrame:
    p = modal_purity(df, group, value)
    return p.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("purity")) / F.sum("n")).alias("purity"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once, with the number of their rows."""
    return df.withColumn("copies", F.count("*").over(W.partitionBy(*keys))).where("copies > 1")


def spread(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """n, mean, median, 5th and 95th percentile per group, all from one stored table of (group, value, rows)."""
    counted = stored(df.groupBy(*by, value.cast("double").alias("_v")).agg(F.count("*").alias("n")))
    known = F.sum(F.when(F.col("_v").isNotNull(), F.col("n")))
    means = counted.groupBy(*by).agg(F.sum("n").alias("n"), ratio(F.sum(F.col("_v") * F.col("n")), known).alias("mean"))
    q = quantiles(counted, "_v", [0.5, 0.05, 0.95], by, counted=True).withColumnRenamed("n", "_known").alias("q")
    same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by])
    pick = [F.get("q.quantiles", F.lit(i)).alias(n) for i, n in enumerate(("median", "p05", "p95"))]
    return means.alias("m").join(q, same, "left").select("m.*", *pick)


def modal_share(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: the most frequent value (lowest of ties) and its share of the group's known values."""
    out = modal_purity(df, by, value)
    return out.withColumnRenamed("purity", "share")


def unstable_attributes(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Per attribute: keys with more than one known value, and keys with at least one."""
    per = df.groupBy(key).agg(*[F.count_distinct(a).alias(a) for a in attributes])
    sums = per.agg(*[F.count_if(F.col(a) > 1).alias(f"c_{a}") for a in attributes], *[F.count_if(F.col(a) > 0).alias(f"k_{a}") for a in attributes])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"c_{a}").alias("changing"), F.col(f"k_{a}").alias("known")) for a in attributes]))
    return sums.select(rows.alias("r")).select("r.*")


def within_group_quartiles(df: DataFrame, value: str, groups: list[str], least: int) -> DataFrame:
    """Rate per quartile of the value within each group of at least `least` rows; edges are the group's exact quartiles.

    Rows are summed per (group, value) once; that stored table gives the group sizes, the edges and the sums.
    """
    counted = stored(df.groupBy(*groups, value).agg(F.count("*").alias("n"), F.sum("y").alias("_y"), F.count("y").alias("_k")))
    large = counted.groupBy(*groups).agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).drop("_n")
    e = quantiles(counted, value, [0.25, 0.5, 0.75], groups, counted=True).drop("n").join(large, groups)
    edge = [F.get("quantiles", F.lit(i)) for i in range(3)]
    quartile = F.when(F.col(value) <= edge[0], 1).when(F.col(value) <= edge[1], 2).when(F.col(value) <= edge[2], 3).otherwise(4)
    return counted.join(e, groups).groupBy(quartile.alias("quartile")).agg(F.sum("n").alias("n"), ratio(F.sum("_y"), F.sum("_k")).alias("rate"))


def bin_rates(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Per bin of equal counts of a value: rows, lowest and highest value, rate; rows without a value are a bin of their own (null)."""
    counted = stored(df.groupBy(value).agg(F.count("*").alias("n"), F.sum("y").alias("_y"), F.count("y").alias("_k")))
    at = quantile_bin(F.col(value), edges(counted, value, bins, counted=True))
    return counted.groupBy(at.alias("bin")).agg(F.sum("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), ratio(F.sum("_y"), F.sum("_k")).alias("rate"))


def agreement(df: DataFrame, one: Column, two: Column, by: str) -> DataFrame:
    """Per group: rows, and the share in which both values are known and equal."""
    return df.groupBy(by).agg(F.count("*").alias("n"), (F.count_if(one == two) / F.count("*")).alias("agree"))


def normalised_counts(df: DataFrame, column: str) -> DataFrame:
    """n and share per value; null is a value."""
    total = df.agg(F.count("*").alias("_t"))
    return df.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))
