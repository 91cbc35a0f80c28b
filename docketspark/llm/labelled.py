"""Labelled rows: which are held out, and a bounded, repeatable sample of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, per_class: bool) -> DataFrame:
    """doc_id, y, text of at most `most` labelled rows (of each class) that aren't held out.

    Rows go by a hash of the id, so the sample is the same at every run and, where
    there are fewer, holds them all. Null labels and ids are left out; of several labels of
    an id the larger counts. The ids are at most 2 * `most` rows, so they are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(11), "id")
    if per_class:
        chosen = known.where("y = 1").orderBy(order, "id").limit(most).unionByName(known.where("y = 0").orderBy(order, "id").limit(most))
    else:
        chosen = known.orderBy(order, "id").limit(most)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "y", "text")
