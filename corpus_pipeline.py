"""Documents made ready for training: reject toxic ones, then poor ones, keep one of each group of
near copies, mix the sources to their weights, and pack the mix into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.llm import jaccard, mixing, packing, quality, toxicity
from docketspark.llm.common import stored, table

#: SQL can express neither the trained models nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't mark as toxic. Null and empty texts and repeated rows are judged like others;
    an empty table stays empty."""
    carried, names = _carried(docs)
    return _kept(toxicity.toxicity(carried, table(spark, sf_dir, "labels"), extra=names).where("predicted = 0"), docs)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null texts count as empty. An empty table stays empty."""
    carried, names = _carried(docs)
    return _kept(quality.quality(carried, table(spark, sf_dir, "labels"), extra=names).where("predicted = 1"), docs)


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id and text, and all columns under names that no result has."""
    names = [f"\u0001kept{i}" for i in range(len(docs.columns))]
    return docs.select("doc_id", "text", *[F.col(c).alias(k) for c, k in zip(docs.columns, names, strict=True)]), names


def _kept(scored: DataFrame, docs: DataFrame) -> DataFrame:
    return scored.select(*[F.col(f"\u0001kept{i}").alias(c) for i, c in enumerate(docs.columns)])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group that the n-gram join links, once.

    Documents without doc_id are in no group and stay.
    """
    groups = jaccard.jaccard_join(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    stay = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, or as far, as the mix of sources takes them; those without words are never taken. A null source
    is a source of its own, equal rows count each, and an empty table stays empty."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the tokenised documents and their places in sequences. A null text is the end id alone, equal rows
    are packed each, and an empty table gives none."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("jaccard_join", one_of_each_group),
    ("mix_sources", mixed),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared folder and read again. The files go when the driver ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
