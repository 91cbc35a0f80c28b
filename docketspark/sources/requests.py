"""Request logs: yearly CSV files, and the driver's tables in the same roles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketspark.config import FORBIDDEN_INPUTS
from docketspark.functions.columns import clean_strings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_file(names: list[str], kind: str, year: int) -> str | None:
    """The last of the snapshots `*_{kind}_csv_{year}.csv`, by name; None if there is none."""
    return max((n for n in names if re.search(rf"_{re.escape(kind)}_csv_{year}\.csv$", n)), default=None)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """File paths in a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [x.getPath().toString() for x in found]


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-16") -> DataFrame:
    """A `;`-separated file, every column a string, cleaned; `columns` prunes the scan, before anything is cleaned."""
    raw = spark.read.options(header=True, sep=";", encoding=encoding, multiLine=True).csv(path)
    if columns is None:
        return clean_strings(raw)
    own = {n.strip(): n for n in raw.columns}
    return clean_strings(raw.select(*[F.col(f"`{own[c]}`") for c in columns]))


def read_years(spark: SparkSession, folder: str, kind: str, years: list[int], columns: list[str], allow_missing: bool = False, encoding: str = "UTF-16") -> DataFrame:
    """The latest snapshot of each year, with the year in `ano`. A missing year is an error unless allowed."""
    names, out = listed(spark, folder), None
    for year in years:
        path = latest_file(names, kind, year)
        if path is None:
            if not allow_missing:
                raise FileNotFoundError(f"no {kind} snapshot of {year} in {folder}")
            continue
        part = read_csv(spark, path, columns, encoding).withColumn("ano", F.lit(year))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("ano", T.IntegerType())]))
    return out


def check_inputs(df: DataFrame) -> DataFrame:
    """Raises if a column is only known after the decision."""
    found = sorted(set(df.columns) & set(FORBIDDEN_INPUTS))
    if found:
        raise ValueError(f"inputs known only after the decision: {', '.join(found)}")
    return df


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as a request log: request_id, line, part, reg, requester, agency, y, status, channel, asked, quantity, year, fold."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("reg"),
        F.col("l_suppkey").alias("agency"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("requester"), F.col("o_orderpriority").alias("channel"), F.to_date("o_orderdate").alias("asked")
    )
    out = items.join(orders, "request_id")
    return out.withColumn("year", F.year("reg").cast("long")).withColumn("fold", F.col("request_id") % 5)
