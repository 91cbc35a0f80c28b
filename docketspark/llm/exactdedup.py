"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

1. Rows. One pass over the texts gives each row its key (64 bits of its normalised text) and the text's
   SHA-256; these short rows are stored in the shared folder.
2. Index. The rows are summed per key (before they are shuffled, so a key that a third of all rows
   share is one entry) and the entries are put into buckets by their keys' leading bits. A directory of 2 ** g
   slots maps the leading g bits to buckets; a bucket of more than `capacity` entries is split by one bit more, and
   the directory doubles when a bucket of its own depth splits. Owner tasks hold ranges of buckets
   and store their entries, sorted, in one file each.
3. Chains. Equal keys are no proof. Texts of keys that occur more than once are gathered by bucket and key and
   compared byte by byte (again summed before the shuffle); a key with several texts is a chain, whose links
   are classes of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import SPACE_CLASS, parts_for, partitions, stored

#: At most so many repeated keys are broadcast to filter the texts (16 bytes each); beyond, all texts are summed by key and bytes.
BROADCAST_KEYS = 1_000_000
#: Bits of a key.
BITS = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{SPACE_CLASS}]+", " ")


def prefix(key: Column, depth: int) -> Column:
    """The leading `depth` bits of a key."""
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def buckets_of(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The buckets (bits, depth, n) of an index over `entries` (key), and the directory's depth g.

    The first directory has as many slots as buckets of `capacity` entries are needed. While a bucket is overfull
    it is split by its next bit, all overfull ones in one job; each round doubles the directory. Keys are distinct, so this ends.
    """
    g = max(0, math.ceil(math.log2(max(1, entries.count()) / capacity)))
    made = stored(entries.groupBy(prefix(F.col("key"), g).alias("bits")).agg(F.count("*").alias("n")).withColumn("depth", F.lit(g)))
    while g < BITS and not (over := made.where((F.col("n") > capacity) & (F.col("depth") == g)).select("bits")).isEmpty():
        inside = entries.withColumn("bits", prefix(F.col("key"), g)).join(over, "bits", "left_semi")
        halves = inside.groupBy(prefix(F.col("key"), g + 1).alias("bits")).agg(F.count("*").alias("n")).withColumn("depth", F.lit(g + 1))
        made = stored(made.where((F.col("n") <= capacity) | (F.col("depth") < g)).unionByName(halves))
        g += 1
    return made, g


def directory_of(buckets: DataFrame, g: int) -> DataFrame:
    """(slot, bucket): each of the 2 ** g slots that a bucket holds; a bucket's number is its first slot."""
    span = F.lit(1).cast("long") * F.pow(F.lit(2.0), F.lit(g) - F.col("depth")).cast("long")
    first = F.col("bits") * span
    return buckets.select(first.alias("bucket"), F.explode(F.sequence(first, first + span - 1)).alias("slot"))


def build_index(entries: DataFrame, capacity: int = 50_000, owners: int | None = None) -> DataFrame:
    """The entries with their bucket, stored by owner: each file holds a range of buckets, sorted by bucket and key."""
    made, g = buckets_of(entries, capacity)
    placed = entries.withColumn("slot", prefix(F.col("key"), g)).join(directory_of(made, g), "slot").drop("slot")
    owners = owners or max(partitions(entries.sparkSession), parts_for(made.count(), 4))
    return stored(placed.repartitionByRange(owners, "bucket", "key").sortWithinPartitions("bucket", "key"))


def chained_keys(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Keys whose rows (key, norm) hold more than one text. Only keys that the index has more than once are looked at."""
    repeated = index.where("n > 1").select("key", "bucket")
    if repeated.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(repeated), "key")
        by = ["bucket", "key", "norm"]
    else:
        by = ["key", "norm"]
    links = texts.groupBy(*by).agg(F.count("*").alias("n"))
    return links.groupBy("key").agg(F.count("*").alias("links")).where("links > 1").select("key")


def exact_dedup(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = 50_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are equal if their texts are, white space normalised (null counts as empty). Of
    equal ones the row of the least doc_id stays, null ids last; of rows with that id too one stays. Other columns
    play no part. `key` gives 64 bits of a text; whatever it is, bytes decide. An empty table gives no rows.
    """
    norm = normalised(F.col("text"))
    texts = docs.select("doc_id", norm.alias("norm")).withColumn("key", key(F.col("norm")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid"))
    rows = stored(texts.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("rid")))
    index = build_index(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")), capacity)

    chained = stored(chained_keys(texts.select("key", "norm"), index))
    out = rows.join(index.select("key", "n", "first"), "key")
    if not chained.isEmpty():
        several = texts.join(chained, "key", "left_semi")
        several = stored(several.select("doc_id", "key", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("rid")))
        links = several.groupBy("key", "norm").agg(F.count("*").alias("n"), F.min(order).alias("first"))
        out = out.join(chained, "key", "left_anti").unionByName(several.join(links, ["key", "norm"]).drop("norm"))
    return out.select(
        "doc_id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
