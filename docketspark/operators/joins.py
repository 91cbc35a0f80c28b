"""Joins of requests with profiles, appeals and tables, with the rules for duplicates and nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order: Spark has no file order to fall back on."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_profile(requests: DataFrame, profiles: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left join with the first profile per key. A null key has no profile; it doesn't match another null."""
    return requests.join(first_per_key(profiles, keys, order), keys, "left")


def composite_lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def compare_snapshots(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: keys in both snapshots, and how many have another value (null equals null)."""
    both = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]).join(new.select(key, *columns), key)
    changed = [F.count_if(~F.col(f"_o_{c}").eqNullSafe(F.col(c))).alias(c) for c in columns]
    wide = both.agg(F.count("*").alias("_n"), *changed)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns]))
    return wide.select(F.col("_n").alias("n"), pairs.alias("p")).select("p.column", "n", "p.changed")
