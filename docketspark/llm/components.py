"""Connected components of a link table, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import durable


def _settled(links: DataFrame) -> bool:
    """Whether the distinct links (a, b), a > b, are stars already: each a has one b, and no b is an a."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").count() == 0


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the links (a, b): the least id that links reach.

    Alternates large-star and small-star steps until all links are stars: in a star, each
    neighbour of a node is linked to the node's least neighbour, so chains halve and the
    number of links never grows. Links whose ends are null or equal count for nothing.
    """
    now = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b")))
        now = durable(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
