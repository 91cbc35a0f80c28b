"""Ranking metrics that know ties, and exact quantiles, from distinct values.

Rows are first summed per distinct value; these blocks are stored once, and all that follows reads only
them. Sums over all higher values are two-level prefix sums: sums per range of values, of which there are as
many as the number of blocks asks for, and a window within each range. So no window and no task holds all values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.columns import ratio
from docketspark.sources.store import stored

#: Blocks in a range, about.
RANGE_BLOCKS = 50_000


def blocks(df: DataFrame, score: str = "score", by: list[str] | None = None, counted: bool = False) -> DataFrame:
    """(by, score, n, pos): rows and positives per distinct score. Null scores or labels are left out. `counted` frames have n and pos."""
    if counted:
        return df.where(F.col(score).isNotNull()).groupBy(*(by or []), F.col(score).alias("score")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return df.where(F.col(score).isNotNull() & F.col("y").isNotNull()).groupBy(*(by or []), F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("pos")
    )


def range_of(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most x, by bisection."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(float(c)) for c in cuts])
    return F.aggregate(F.array(*[F.lit(i) for i in steps]), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= x, at + step).otherwise(at))


def with_above(b: DataFrame, by: list[str] | None = None, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """Adds n_above and pos_above, sums over strictly higher scores (of the same `by`), and n_all and pos_all, sums over all."""
    by, b = by or [], stored(b)
    ranges = math.ceil(b.count() / range_blocks)
    cuts = sorted(set(b.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    b = b.withColumn("_range", range_of(F.col("score").cast("double"), cuts))
    all_of, high = W.partitionBy(*by), W.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    sums = b.groupBy(*by, "_range").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    sums = sums.select(
        *by, "_range", *[F.coalesce(F.sum(c).over(high), F.lit(0)).alias(c) for c in ("_n", "_p")],
        F.sum("_n").over(all_of).alias("n_all"), F.sum("_p").over(all_of).alias("pos_all"),
    )
    near = W.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    key = F.lit(True)
    for c in [*by, "_range"]:
        key = key & F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}"))  # a null group is a group
    b = b.alias("b").join(sums.alias("s"), key).select("b.*", *[F.col(f"s.{c}") for c in ("_n", "_p", "n_all", "pos_all")])
    out = b.withColumn("n_above", F.col("_n") + F.coalesce(F.sum("n").over(near), F.lit(0))).withColumn(
        "pos_above", F.col("_p") + F.coalesce(F.sum("pos").over(near), F.lit(0))
    )
    return out.drop("_range", "_n", "_p")


def quantiles(df: DataFrame, value: Column | str, at: list[float], by: list[str] | None = None, range_blocks: int = RANGE_BLOCKS, counted: bool = False) -> DataFrame:
    """(by, n, quantiles): the exact quantiles `at`, linear between neighbours, of a value's known rows per group; a row per group.

    The order statistics are picked from counted blocks, of which prefix sums tell how many rows lie before; nothing sorts
    a group's rows. Groups without a known value have no row. `counted` frames have the number of rows in n.
    """
    by = by or []
    value = F.col(value) if isinstance(value, str) else value
    rows = F.col("n") if counted else F.lit(1)
    b = df.select(*by, value.cast("double").alias("score"), rows.cast("long").alias("n")).where("score is not null").groupBy(*by, "score").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("pos"))
    b = with_above(b, by, range_blocks).withColumn("_before", F.col("n_all") - F.col("n_above") - F.col("n"))
    holds = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("n")), F.col("score")))
    place = [F.lit(float(p)) * (F.col("n_all") - 1) for p in at]
    ends = [x for i, h in enumerate(place) for x in (holds(F.floor(h)).alias(f"_l{i}"), holds(F.ceil(h)).alias(f"_h{i}"))]
    out = b.groupBy(*by).agg(F.max("n_all").alias("n"), *ends)
    part = lambda p: (h := F.lit(float(p)) * (F.col("n") - 1)) - F.floor(h)
    q = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part(p) for i, p in enumerate(at)]
    return out.where("n is not null").select(*by, "n", F.array(*q).alias("quantiles"))


def precision_at_k(df: DataFrame, fraction: float, score: str = "score", by: list[str] | None = None, counted: bool = False) -> DataFrame:
    """precision, k, n_tied, need: the expected precision of the k highest scores when ties fall by lot.

    k is the fraction of the rows, rounded half to even, at least 1. All positives strictly
    above the cut count, and of the tied ones the share that the queue still takes. No rows, no result row.
    """
    by = by or []
    b = with_above(blocks(df, score, by, counted), by)
    k = F.least(F.greatest(F.bround(F.lit(float(fraction)) * F.col("n_all")).cast("long"), F.lit(1)), F.col("n_all"))
    cut = b.withColumn("k", k).where((F.col("n_above") < F.col("k")) & (F.col("k") <= F.col("n_above") + F.col("n")))
    need = F.col("k") - F.col("n_above")
    return cut.select(*by, ((F.col("pos_above") + need * F.col("pos") / F.col("n")) / F.col("k")).alias("precision"), "k", F.col("n").alias("n_tied"), need.alias("need"))


def lift(df: DataFrame, fractions: list[float], score: str = "score", counted: bool = False) -> DataFrame:
    """A row per fraction: precision and its ratio to the base rate of these rows. The rows are read once."""
    b = stored(blocks(df, score, None, counted))
    base = b.agg((F.sum("pos") / F.sum("n")).alias("base"))
    out = None
    for f in fractions:
        row = precision_at_k(b, f, counted=True).crossJoin(base)  # a row each
        row = row.select(F.lit(f).alias("fraction"), "precision", "base", ratio(F.col("precision"), F.col("base")).alias("lift"))
        out = row if out is None else out.unionByName(row)
    return out


def roc_auc(df: DataFrame, score: str = "score", by: list[str] | None = None, counted: bool = False) -> DataFrame:
    """auc: the chance that a positive outranks a negative, ties one half; null without either."""
    by = by or []
    b = with_above(blocks(df, score, by, counted), by)
    neg, neg_above = F.col("n") - F.col("pos"), F.col("n_above") - F.col("pos_above")
    won = F.sum(F.col("pos") * ((F.col("n_all") - F.col("pos_all")) - neg_above - neg / 2))
    pairs = F.max(F.col("pos_all").cast("double") * (F.col("n_all") - F.col("pos_all")))
    return b.groupBy(*by).agg(ratio(won, pairs).alias("auc"))


def average_precision(df: DataFrame, score: str = "score", by: list[str] | None = None, counted: bool = False) -> DataFrame:
    """ap: the sum over distinct scores of recall gained times precision."""
    by = by or []
    b = with_above(blocks(df, score, by, counted), by)
    step = F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))
    return b.groupBy(*by).agg(ratio(F.sum(step), F.max("pos_all")).alias("ap"))


def brier(df: DataFrame, score: str = "score", counted: bool = False) -> DataFrame:
    """brier, mean_score, rate, n, from the sums per distinct score."""
    b, p, n, pos = blocks(df, score, None, counted), F.col("score"), F.col("n"), F.col("pos")
    miss = F.sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p)
    return b.agg(*[(x / F.sum(n)).alias(k) for k, x in (("brier", miss), ("mean_score", F.sum(p * n)), ("rate", F.sum(pos)))], F.coalesce(F.sum(n), F.lit(0)).alias("n"))


def edges(df: DataFrame, column: str, bins: int, counted: bool = False) -> list[float]:
    """Exact, linear quantile edges; equal ones once."""
    row = quantiles(df, column, [i / bins for i in range(bins + 1)], counted=counted).first()
    return sorted(set(row["quantiles"])) if row else []


def quantile_bin(x: Column, cuts: list[float]) -> Column:
    """The number of the bin (low, high]; the lowest edge belongs to bin 0."""
    out = F.lit(None).cast("int")
    for i in range(len(cuts) - 1, 0, -1):
        out = F.when((x <= cuts[i]) & ((x > cuts[i - 1]) | (F.lit(i == 1) & (x >= cuts[0]))), i - 1).otherwise(out)
    return out


def reliability(df: DataFrame, score: str = "score", bins: int = 10, counted: bool = False) -> DataFrame:
    """Per score bin of equal counts: rows, mean score, observed rate, of rows whose score and label are known."""
    b = stored(blocks(df, score, None, counted))
    n = F.sum("n")
    return b.withColumn("bin", quantile_bin(F.col("score"), edges(b, "score", bins, counted=True))).groupBy("bin").agg(
        n.alias("n"), (F.sum(F.col("score") * F.col("n")) / n).alias("mean_score"), (F.sum("pos") / n).alias("rate")
    )


def queue_threshold(df: DataFrame, fraction: float = 0.10, score: str = "score", counted: bool = False) -> DataFrame:
    """The raw score from which the queue's fraction of the rows lies, with six decimals; no rows, no result row."""
    return quantiles(df, score, [1 - fraction], counted=counted).select(F.round(F.get("quantiles", F.lit(0)), 6).alias("threshold"))


def equity(df: DataFrame, group: str, fraction: float, score: str = "score", top: int = 8, counted: bool = False) -> DataFrame:
    """The largest groups' shares of the queue and of all rows, and their ratio.

    Rows tied at the cut are in the queue with the weight that precision_at_k gives them.
    """
    rows = F.sum("n") if counted else F.count("*")
    per = stored(df.groupBy(group, F.col(score).alias("score")).agg(rows.alias("n"), F.lit(0).cast("long").alias("pos")))
    b = with_above(blocks(per, counted=True))
    k = F.least(F.greatest(F.bround(F.lit(float(fraction)) * F.col("n_all")).cast("long"), F.lit(1)), F.col("n_all"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - F.col("n_above")) / F.col("n")))
    w = b.select("score", weight.alias("w"), k.alias("k"), "n_all")
    out = per.join(w, "score").groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("queued"), F.max("k").alias("k"), F.max("n_all").alias("n_all"))
    share, queue = F.col("n") / F.col("n_all"), F.col("queued") / F.col("k")
    return out.select(group, "n", share.alias("share"), queue.alias("queue_share"), (queue / share).alias("ratio")).orderBy(F.desc("n"), group).limit(top)


def rate_drift(old: DataFrame, new: DataFrame, moved: float = 0.05, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary, the agencies that moved most) of two tables (agency, rate)."""
    both = old.select("agency", F.col("rate").alias("rate_old")).join(new.select("agency", F.col("rate").alias("rate_new")), "agency")
    both = stored(both.withColumn("change", F.abs(F.col("rate_new") - F.col("rate_old"))))
    spread = quantiles(both, "change", [0.5, 0.95]).select(F.get("quantiles", F.lit(0)).alias("median"), F.get("quantiles", F.lit(1)).alias("p95"))
    counts = both.agg(F.count("*").alias("n"), F.count_if(F.col("change") > moved).alias("moved"))
    summary = counts.join(spread, F.lit(True), "left").select("n", "median", "p95", "moved")  # one row each
    return summary, both.orderBy(F.desc("change"), "agency").limit(worst)
