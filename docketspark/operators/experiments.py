"""Experiments that decide how features are made: is a feature causal, aligned, honest, and which years and corrections help."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.columns import ratio, smoothed
from docketspark.operators import encode, history, metrics
from docketspark.sources.store import stored


def _changes(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., and a struct of both values per column) of two frames with the same unique keys."""
    a = one.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = two.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.join(b, keys)


def causality_audit(
    log: DataFrame, featurize: Callable[[DataFrame], DataFrame], keys: list[str], features: list[str], cuts: list[dt.date], lag: int = 60
) -> DataFrame:
    """(feature, n, changed): does a feature of a day see labels that weren't known on that day?

    For each cut, every label of a request later than `lag` days before the cut is turned over, the features are
    made anew, and all rows up to the cut are compared with what they were, one by one. A causal feature has 0 changed.
    `keys` must tell rows apart; the features are made once for the true labels and once per cut.
    """
    true, found = featurize(log), []
    for cut in cuts:
        later = F.col("reg") > F.date_sub(F.lit(cut), lag)
        other = featurize(log.withColumn("y", F.when(later, 1 - F.col("y")).otherwise(F.col("y"))))
        both = _changes(true.where(F.col("reg") <= F.lit(cut)), other.where(F.col("reg") <= F.lit(cut)), keys, features)
        found.append(both.agg(F.count("*").alias("_n"), *[F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in features]))
    sums = reduce(lambda a, b: a.unionByName(b), found).agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in features])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col("_n").alias("n"), F.col(c).alias("changed")) for c in features]))
    return sums.select(rows.alias("r")).select("r.*")


def history_by_asof(df: DataFrame, keys: list[str], name: str, lag: int = 60) -> DataFrame:
    """matured_history's sums by another way: running sums per day, then the last day up to `lag` days before. To check it, not to use it.

    Rows are dealt by the keys once for their sums, days and windows."""
    dealt = df.where(history.eligible(F.col("requester"))).repartition(*keys)
    days = history.daily(dealt, keys)
    upto = W.partitionBy(*keys).orderBy("reg").rowsBetween(W.unboundedPreceding, 0)
    days = days.select(*keys, "reg", F.sum("y_day").over(upto).alias(name), F.sum("n_day").over(upto).alias(f"{name}_den"))
    asked = dealt.select(*keys, "reg").distinct()
    out = history.asof(asked, days, keys, "reg", [name, f"{name}_den"], lag)
    return out.select(*keys, "reg", *[F.coalesce(f"asof_{c}", F.lit(0)).alias(c) for c in (name, f"{name}_den")])


def alignment_audit(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, n, only_one, only_two, differ, sum_one, sum_two): are two makings of a feature the same row by row?

    Values that sit on other rows than they belong to show as `differ` while the sums agree.
    """
    both = _changes(one, two, keys, columns)
    parts = []
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        parts.append(F.struct(
            F.count("*").alias("n"), F.count_if(a.isNotNull() & b.isNull()).alias("only_one"), F.count_if(a.isNull() & b.isNotNull()).alias("only_two"),
            F.count_if(a != b).alias("differ"), F.sum(a).cast("double").alias("sum_one"), F.sum(b).cast("double").alias("sum_two"),
        ).alias(c))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]))
    return both.agg(*parts).select(rows.alias("r")).select("r.column", "r.v.*")


def prior_shift(log: DataFrame, train: str, windows: tuple[int, ...] = (90, 365), lag: int = 60, prior: float = 20.0) -> DataFrame:
    """(days, affected, mean, most, over_0001, over_001): how far rolling rates move, in requests, if their prior is the base rate of
    all labels in place of that of the training days (a SQL condition on reg)."""
    daily = history.daily(log, ["agency"])
    rate = lambda c: ratio(F.sum(F.when(c, F.col("y_day"))), F.sum(F.when(c, F.col("n_day"))))
    bases = daily.agg(rate(F.lit(True)).alias("_all"), rate(F.expr(train)).alias("_train"))
    d = history.rolling(log, windows, lag).crossJoin(F.broadcast(bases))
    one = lambda w, b: smoothed(F.col(f"sum_{w}"), F.col(f"cnt_{w}"), F.col(b), prior)
    moved = F.explode(F.array(*[F.struct(F.lit(w).alias("days"), F.abs(one(w, "_all") - one(w, "_train")).alias("by")) for w in windows]))
    d = d.select("n_day", moved.alias("m")).select("n_day", "m.*")
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_day"))), F.lit(0))
    return d.groupBy("days").agg(
        rows(F.col("by") > 0).alias("affected"), (F.sum(F.col("by") * F.col("n_day")) / F.sum("n_day")).alias("mean"), F.max("by").alias("most"),
        rows(F.col("by") > 0.001).alias("over_0001"), rows(F.col("by") > 0.01).alias("over_001"),
    )


def encoding_difference(train: DataFrame, prior: float = 50.0, fold: str = "fold") -> DataFrame:
    """Paired differences, in training rows, of the agency's rate from all folds and from the other folds: a row per fold and one
    (fold null) for all: n, mean, sd, mean_abs, most, over_001, over_005. Rows are counted per (agency, fold)."""
    cells = train.groupBy("agency", fold).agg(F.count("*").alias("n"))
    both = cells.join(encode.crossfit_rates(train, prior, fold), ["agency", fold]).join(encode.smoothed_rate(train, ["agency"], prior).select("agency", "rate"), "agency")
    both = both.withColumn("d", F.col("rate") - F.col("rate_out"))
    n, d = F.col("n"), F.col("d")
    mean = F.sum(n * d) / F.sum(n)
    rows = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return both.rollup(fold).agg(
        F.sum(n).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(n * d * d) / F.sum(n) - mean * mean, F.lit(0.0))).alias("sd"), (F.sum(n * F.abs(d)) / F.sum(n)).alias("mean_abs"),
        F.max(F.abs(d)).alias("most"), rows(F.abs(d) > 0.01).alias("over_001"), rows(F.abs(d) > 0.05).alias("over_005"),
    )


def _measured(counted: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """ap and precision of counted scores (by, score, n, pos), which are summed per score once."""
    counted = stored(metrics.blocks(counted, by=by, counted=True))
    ap = metrics.average_precision(counted, by=by, counted=True)
    return ap.join(metrics.precision_at_k(counted, fraction, by=by, counted=True).select(*by, "precision"), by)


def training_windows(train: DataFrame, test: DataFrame, windows: dict[str, list[int]], keys: dict[str, list[str]], prior: float = 50.0, fraction: float = 0.05) -> DataFrame:
    """(window, inputs, n_train, ap, precision): the smoothed-rate score fitted on several sets of years, with and without further keys,
    on one fixed test.

    Training rows are summed per year and all keys, test rows per all keys, and stored; every window and list of keys comes from these two.
    """
    finest = list(dict.fromkeys(k for by in keys.values() for k in by))
    sums = (F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    years = stored(train.groupBy("year", *finest).agg(F.count("*").alias("n"), F.sum("y").alias("pos")))
    asked = stored(test.groupBy(*finest).agg(F.count("*").alias("n"), F.sum("y").alias("pos")))
    listed = F.array(*[F.struct(F.lit(w).alias("window"), F.array(*map(F.lit, of)).alias("years")) for w, of in windows.items()])
    of_window = F.explode(F.filter(listed, lambda w: F.array_contains(w["years"], F.col("year"))))
    base = years.groupBy("year").agg(*sums).withColumn("w", of_window).groupBy("w.window").agg(F.sum("n").alias("n_train"), (F.sum("pos") / F.sum("n")).alias("base"))
    base = F.broadcast(stored(base))  # a row per window
    scored = []
    for inputs, by in keys.items():
        rates = years.groupBy("year", *by).agg(*sums).withColumn("w", of_window).groupBy("w.window", *by).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
        both = asked.groupBy(*by).agg(*sums).crossJoin(base).join(rates, ["window", *by], "left")
        score = F.coalesce(smoothed(F.col("_p"), F.col("_n"), F.col("base"), prior), F.col("base"))
        scored.append(both.select("window", F.lit(inputs).alias("inputs"), score.alias("score"), "n", "pos"))
    measured = _measured(reduce(lambda a, b: a.unionByName(b), scored), ["window", "inputs"], fraction)
    return measured.join(base, "window").select("window", "inputs", "n_train", "ap", "precision")


def corrections(log: DataFrame, train: str, is_test: Column, window: int = 90, lag: int = 60, prior: float = 20.0, fraction: float = 0.05) -> DataFrame:
    """(variant, n, ap, precision): the agency's rolling rate as a score in four makings: neither correction, labels
    matured, prior from the training days only, and both. All come from daily sums (or a log, which is summed); both lags share the windows' one shuffle."""
    days = history.daily(log, ["agency"])
    bases = days.agg(
        (F.sum("y_day") / F.sum("n_day")).alias("_all"), ratio(F.sum(F.when(F.expr(train), F.col("y_day"))), F.sum(F.when(F.expr(train), F.col("n_day")))).alias("_train")
    )
    early = history.rolled(days, (window,), 1).withColumnsRenamed({f"cnt_{window}": "_c", f"sum_{window}": "_s"})
    d = history.rolled(early, (window,), lag).where(is_test).crossJoin(F.broadcast(bases))
    made = {"neither": ("_s", "_c", "_all"), "matured": (f"sum_{window}", f"cnt_{window}", "_all"), "training prior": ("_s", "_c", "_train"), "both": (f"sum_{window}", f"cnt_{window}", "_train")}
    scores = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.round(smoothed(F.col(s), F.col(c), F.col(b), prior), 9).alias("score")) for v, (s, c, b) in made.items()]))
    counted = d.select("n_day", "y_day", scores.alias("s")).groupBy("s.variant", "s.score").agg(F.sum("n_day").alias("n"), F.sum("y_day").alias("pos"))
    n = counted.groupBy("variant").agg(F.sum("n").alias("n"))
    return _measured(counted, ["variant"], fraction).join(n, "variant").select("variant", "n", "ap", "precision")
