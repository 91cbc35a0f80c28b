"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form streams that are packed into blocks of `block` words. The mix is a row of output shards
of `slots` slots each. Every slot draws its source by the target weights, so a shard's counts are a multinomial draw.
Then the sums over all shards are set right: a source that got more than it is due gives slots back, shard
by shard in a hashed order, and these go to sources that got less. A shard's counts number its slots in each
source's sequence, a pseudorandom permutation per source and pass maps the numbers to block indexes, and the slots are
joined with the blocks by index. A document's share of the mix is what its stretches of drawn blocks hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import durable, partitions

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
MICRO = 1_000_000
#: A table of sources of at most so many rows is broadcast; a larger one is joined over salts.
BROADCAST_ROWS, SALTS = 100_000, 64
#: Rounds of the permutation.
ROUNDS = 16
#: Output shards at most; beyond, a shard has more slots. Windows over shards hold so many rows.
MOST_SHARDS = 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets by source from (source, source_size): adds target and weight.

    Sources by code point, null last, weigh as `weights` repeats, and share the sum of all
    sizes. No target passes `most` times its source's size; what is over is shared again
    by weight. This is one level: target = min(weight * level, most * size), and the
    level follows from running sums over the sources in the order in which they reach
    their bound. One row per source, so the two windows over all rows stay small.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    options = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.get(options, F.pmod(rank, F.lit(len(weights))).cast("int")))
    t = t.withColumn("bound", F.col("source_size") * float(most))
    order = W.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    t = t.withColumn("level", level)
    reached = F.when(F.col("level") <= F.col("bound") / F.col("weight"), F.col("level"))
    t = t.withColumn("level", F.max(reached).over(everything))  # the level falls from there on
    return t.select("source", "source_size", "weight", F.least("bound", F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))).alias("target"))


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom bijection of 0 .. n - 1, keyed by the seed: in each round an index swaps, or not, with its partner, by one
    hashed bit that both share."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - x, n)
        return F.when(F.xxhash64(*seed, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def with_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` joined with a table of one row per source, null sources too: by broadcast if it is small, else over
    salts, for one source may hold a third of all rows."""
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table.withColumnRenamed("source", "s"))
        return rows.join(table, F.col("source").eqNullSafe(F.col("s")), how).drop("s")
    table = table.withColumnRenamed("source", "s").withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    return rows.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("z")), how).drop("s", "z", "salt")


def mix_plan(docs: DataFrame, block: int = 128, slots: int = 4096, seed: int = 20240229, most: int = 3, rows_each: int = 2000) -> DataFrame:
    """Per document: doc_id, source, key, size, source_size, target, taken, whole, extra, shard.

    `taken` counts the words that the mix takes of the document, repeats included; the
    mix holds the document `whole` times in full and, once more, the stretches `extra`
    (place of the first word, number of words); `shard` is the first output shard that holds some of it, null if none does. A null text has
    size 0, takes part with nothing and is returned; a null source is a source of its own; equal rows are told
    apart by a row number that is kept in a checkpoint. A source's slots in all are what it is due, within one; a shard's
    counts are multinomial, but for the slots that make the sums right. Hashes of `seed` decide everything, so reruns agree. A
    source is never due more than `most` passes over its blocks, so a document never gives more than `most` times its words.
    """
    sized = durable(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            n_words(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "source", "text").alias("key"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )
    totals = durable(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most=most))

    # streams: a source's documents dealt over buckets, so that no window holds a whole source
    buckets = max(1, sized.count() // rows_each)
    held = sized.where("size > 0").withColumn("bucket", F.pmod("key", F.lit(buckets)))
    in_bucket = W.partitionBy("source", "bucket").orderBy("doc_id", "key", "rid")
    held = held.withColumn("start", F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    lots = sized.where("size > 0").groupBy("source", F.pmod("key", F.lit(buckets)).alias("bucket")).agg(
        F.ceil(F.sum("size") / block).cast("long").alias("lot")
    )
    lots = durable(
        lots.withColumn("first", F.sum("lot").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("lot"))
    )
    n_blocks = lots.groupBy("source").agg(F.sum("lot").alias("blocks"))

    # how many slots each source is due, and where its part of the unit interval lies
    due = totals.join(n_blocks.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    due = due.withColumn("due", F.coalesce(F.col("target") * F.col("blocks") / F.col("source_size"), F.lit(0.0)))
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    # counted in millionths of a slot, so that sums are exact
    due = due.withColumn("due", F.least(F.round(F.col("due") * MICRO).cast("long"), F.coalesce("blocks", F.lit(0)) * F.lit(most * MICRO)))
    due = durable(
        due.withColumn("upto", F.sum("due").over(by_source.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("all", F.sum("due").over(by_source.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("nth", F.row_number().over(by_source))
    )

    slot = drawn_slots(due, slots, seed)
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("nth"), F.floor(F.col("k") / F.col("blocks")))
    draws = slot.select("nth", index.alias("index"), "shard").groupBy("nth", "index").agg(F.count("*").alias("draws"), F.min("shard").alias("shard"))

    # the documents' stretches of blocks, joined with the draws by block index
    firsts = lots.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "first")
    placed = held.join(firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    placed = with_source(placed, due.select("source", "nth"))
    span = F.sequence((F.col("start") / block).cast("long"), ((F.col("start") + F.col("size") - 1) / block).cast("long"))
    cut = placed.withColumn("lot", F.explode(span))
    left, right = F.greatest(F.col("lot") * block, "start"), F.least((F.col("lot") + 1) * block, F.col("start") + F.col("size"))
    cut = cut.select("rid", "nth", (F.col("first") + F.col("lot")).alias("index"), (left - F.col("start")).alias("at"), (right - left).alias("words"))
    cut = cut.join(draws, ["nth", "index"], "left").withColumn("draws", F.coalesce("draws", F.lit(0)))
    given = cut.groupBy("rid").agg(
        F.sum(F.col("words") * F.col("draws")).alias("taken"),
        F.min("draws").alias("whole"),
        F.min("shard").alias("shard"),
        F.collect_list(F.struct("at", "words", "draws")).alias("stretches"),
    )
    extra = F.array_sort(F.filter("stretches", lambda x: x["draws"] > F.col("whole")))
    out = sized.join(given.select("rid", "taken", "whole", "shard", extra.alias("extra")), "rid", "left")
    out = with_source(out, totals.select("source", "source_size", "target"), "left")
    return out.select(
        "doc_id", "source", "key", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("whole", F.lit(0)).alias("whole"), "extra", "shard",
    )


def located(points: DataFrame, spans: DataFrame, total: int, cells: int = 1024) -> DataFrame:
    """`points` (u, ...) joined with the one span (low <= u < high) that holds u; spans part 0 .. total - 1.

    An equality join on cells of the line: a span lies in as many cells as it touches, so the table has a row per span and `cells` more.
    """
    width = max(1, -(-total // cells))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    return points.withColumn("cell", F.floor(F.col("u") / width)).join(spans, "cell").where("low <= u and u < high").drop("cell", "low", "high")


def shard_counts(due: DataFrame, slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): slots by (nth, shard), and the slots in all by nth, of sources (nth, blocks, due, upto, all) with due in millionths of a slot.

    Totals are one systematic draw: the whole numbers in a source's part of all slots. Each of the slots draws its
    source with the weights `due`, which makes a shard's counts multinomial; then surplus slots are drawn again for sources that lack some.
    Shards have `slots` slots, more where there would be over MOST_SHARDS.
    """
    spark = due.sparkSession
    point = F.pmod(F.xxhash64(F.lit(seed)), F.lit(MICRO))
    edge = lambda c: ((c + point) - F.pmod(c + point, F.lit(MICRO))) / MICRO
    totals = durable(due.where("due > 0").select("nth", "blocks", "upto", "due", (edge(F.col("upto")) - edge(F.col("upto") - F.col("due"))).cast("long").alias("total")))
    n, whole = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("due"), F.lit(0))).first()
    each = max(slots, -(-n // MOST_SHARDS))
    drawn = spark.range(n).select(F.floor(F.col("id") / each).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "id"), F.lit(max(1, whole))).alias("u"))
    spans = totals.select("nth", (F.col("upto") - F.col("due")).alias("low"), F.col("upto").alias("high"))
    counts = durable(located(drawn, spans, whole).groupBy("nth", "shard").agg(F.count("*").alias("n")))

    # keep, in a hashed order of shards, what a source is due; what is over is free
    hashed = W.partitionBy("nth").orderBy(F.xxhash64(F.lit(seed), F.lit(2), "nth", "shard"), "shard").rowsBetween(W.unboundedPreceding, -1)
    held = counts.join(totals.select("nth", "total"), "nth").withColumn("left", F.col("total") - F.coalesce(F.sum("n").over(hashed), F.lit(0)))
    held = durable(held.select("nth", "shard", F.greatest(F.least("n", "left"), F.lit(0)).cast("long").alias("kept"), "n"))
    lack = totals.join(held.groupBy("nth").agg(F.sum("kept").alias("kept")), "nth", "left").select("nth", (F.col("total") - F.coalesce("kept", F.lit(0))).alias("lack")).where("lack > 0")
    upto = F.sum("lack").over(W.orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    lack = durable(lack.select("nth", (upto - F.col("lack")).alias("low"), upto.alias("high")))
    free = held.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("f")).where("f > 0")
    last = F.sum("f").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))  # at most MOST_SHARDS rows
    free = free.withColumn("last", last).withColumn("r", F.explode(F.sequence(F.col("last") - F.col("f"), F.col("last") - 1)))
    missing = lack.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]
    again = located(free.select("shard", permuted(F.col("r"), F.lit(max(1, missing)), F.lit(seed), F.lit(3)).alias("u")), lack, missing)
    both = held.select("nth", "shard", F.col("kept").alias("n")).where("n > 0").unionByName(again.select("nth", "shard", F.lit(1).cast("long").alias("n")))
    return durable(both.groupBy("nth", "shard").agg(F.sum("n").alias("n"))), totals


def drawn_slots(due: DataFrame, slots: int, seed: int) -> DataFrame:
    """The slots (nth, blocks, k, shard): a source's slots are numbered through its shards, each shard's as many as its count."""
    counts, totals = shard_counts(due, slots, seed)
    before = F.coalesce(F.sum("n").over(W.partitionBy("nth").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = counts.withColumn("first", before).join(totals.select("nth", "blocks"), "nth").repartition(partitions(due.sparkSession), "nth", "shard")
    return runs.select("nth", "blocks", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("k"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard of every document; see mix_plan."""
    return mix_plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "shard")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: each document as often as the mix holds it whole, with its
    text as it is, and one row more for the stretches taken once more, their words joined by one space.

    Documents of which the mix takes nothing have no row. n_chars, where it is a column, is set anew.
    """
    plan = mix_plan(docs, **options)
    again = lambda by: F.row_number().over(W.partitionBy(by).orderBy(by))
    plan = plan.where("taken > 0").select(F.col("key").alias("\u0001key"), F.col("whole").alias("\u0001whole"), F.col("extra").alias("\u0001extra"))
    plan = plan.withColumn("\u0001dup", again("\u0001key"))
    texts = docs.withColumn("\u0001key", F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"))).withColumn("\u0001dup", again("\u0001key"))
    both = texts.join(plan, ["\u0001key", "\u0001dup"])
    words = F.split(F.regexp_replace("text", f"^{GAP}", ""), GAP)
    part = F.array_join(F.flatten(F.transform("\u0001extra", lambda x: F.slice(words, (x["at"] + 1).cast("int"), x["words"].cast("int")))), " ")
    copies = F.array_repeat(F.col("text"), F.col("\u0001whole").cast("int"))
    rows = F.when(F.size("\u0001extra") > 0, F.concat(copies, F.array(part))).otherwise(copies)
    out = both.withColumn("text", F.explode(rows))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
