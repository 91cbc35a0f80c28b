"""Temporal features without leaks: what was known of a requester and an agency on the day of a request.

Rows need reg (date), requester, agency, y (0 or 1). A label counts only `lag` days after
its request. Requester histories are windows keyed by the requester; agency rates are
summed per day first, so that an agency's window has a row per day and not per request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.columns import day_number, ratio, smoothed

ABSENT = -1


def eligible(requester: Column) -> Column:
    """Anonymous ('0') and unknown requesters have no history."""
    return requester.isNotNull() & (requester.cast("string") != "0")


#: A second window key, see `apart`.
OWN = "_own"


def apart(df: DataFrame) -> DataFrame:
    """Adds the column `_own`: 0 for rows with a history, and any of many numbers for the others, whose windows count for nothing;
    so anonymous rows, a sixth of all and more, aren't one window. Dealt once by (requester, _own), which all
    windows of requesters then share. A frame that has the column already is taken as dealt."""
    if OWN in df.columns:
        return df
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    return df.withColumn(OWN, F.when(eligible(F.col("requester")), F.lit(0).cast("long")).otherwise(spread)).repartition("requester", OWN)


def prior_counts(df: DataFrame, order: list[str]) -> DataFrame:
    """n_prior, n_prior_pair, n_agencies_prior, days_since_last; -1 for rows without a history.

    `order` breaks ties of a day; earlier requests of the same day count.
    """
    ok = eligible(F.col("requester"))
    own, pair = (W.partitionBy("requester", OWN, *more).orderBy("reg", *order) for more in ([], ["agency"]))
    d = apart(df).withColumn("_pair", F.row_number().over(pair) - 1)
    seen = F.count_if(F.col("_pair") == 0).over(own.rowsBetween(W.unboundedPreceding, 0)) - (F.col("_pair") == 0).cast("int")
    counts = {
        "n_prior": F.row_number().over(own) - 1, "n_prior_pair": F.col("_pair"), "n_agencies_prior": seen,
        "days_since_last": F.coalesce(F.datediff("reg", F.lag("reg").over(own)), F.lit(ABSENT)),
    }
    kept = [*df.columns, *([OWN] if OWN in df.columns else [])]
    return d.select(*dict.fromkeys(kept), *[F.when(ok, c).otherwise(F.lit(ABSENT)).cast("long").alias(n) for n, c in counts.items()])


def matured_history(df: DataFrame, keys: list[str], name: str, lag: int = 60) -> DataFrame:
    """Adds {name} (sum of labels), {name}_den (requests) and {name}_rate of the same keys up to `lag` days before."""
    d = apart(df) if "requester" in keys else df
    by = ", ".join([*(f"`{k}`" for k in keys), *([OWN] if "requester" in keys else [])])
    past = f"OVER (PARTITION BY {by} ORDER BY reg RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '{int(lag)}' DAY PRECEDING)"
    ok = eligible(F.col("requester"))
    out = d.withColumn("_n", F.expr(f"count(*) {past}")).withColumn("_y", F.expr(f"sum(y) {past}"))
    out = out.withColumn(f"{name}_den", F.when(ok, F.col("_n"))).withColumn(name, F.when(ok, F.coalesce("_y", F.lit(0))).otherwise(F.lit(ABSENT)).cast("long"))
    out = out.withColumn(f"{name}_rate", F.coalesce(ratio(F.col(name), F.col(f"{name}_den")), F.lit(float(ABSENT)))).drop("_n", "_y")
    return out if OWN in df.columns else out.drop(OWN)


def histories(df: DataFrame, order: list[str], lag: int = 60) -> DataFrame:
    """All features of a requester's past: prior_counts, and matured_history of the requester (`prev`) and of the requester at
    the agency (`prev_here`). One shuffle; windows of a pair come first, so that each sort order is made once."""
    d = matured_history(apart(df), ["requester", "agency"], "prev_here", lag)
    return matured_history(prior_counts(d, order), ["requester"], "prev", lag).drop(OWN)


def daily(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reg, n_day, y_day): requests and labels per day. A frame that has these sums already, by these keys, is taken as it is."""
    if {"n_day", "y_day"} <= set(df.columns):
        return df
    return df.groupBy(*keys, "reg").agg(F.count("*").alias("n_day"), F.sum("y").alias("y_day"))


def rolling(df: DataFrame, windows: tuple[int, ...] = (90, 365), lag: int = 60, key: str = "agency") -> DataFrame:
    """Per (agency, day): cnt_w and sum_w of the requests with reg in (day - lag - w, day - lag]."""
    return rolled(daily(df, [key]), windows, lag, key)


def rolled(d: DataFrame, windows: tuple[int, ...] = (90, 365), lag: int = 60, key: str = "agency") -> DataFrame:
    """Daily sums with cnt_w and sum_w, as in `rolling`."""
    order = W.partitionBy(key).orderBy(day_number(F.col("reg")))
    for w in windows:
        frame = order.rangeBetween(-(lag + w - 1), -lag)
        d = d.withColumn(f"cnt_{w}", F.coalesce(F.sum("n_day").over(frame), F.lit(0))).withColumn(
            f"sum_{w}", F.coalesce(F.sum("y_day").over(frame), F.lit(0))
        )
    return d


def rolling_rates(
    df: DataFrame, base: float | None = None, windows: tuple[int, ...] = (90, 365), lag: int = 60, prior: float = 20.0, train: str | None = None
) -> DataFrame:
    """Per (agency, day): rate_w, smoothed towards the training base rate, and their trend.

    The base rate is given, or is that of the days where `train`, a SQL condition on reg, holds: a sum of the same
    daily sums, so the log isn't read again.
    """
    d = rolling(df, windows, lag)
    if base is None:
        sums = daily(df, ["agency"]).agg(F.sum(F.when(F.expr(train), F.col("y_day"))).alias("_y"), F.sum(F.when(F.expr(train), F.col("n_day"))).alias("_n"))
        d = d.crossJoin(F.broadcast(sums.select(F.coalesce(ratio(F.col("_y"), F.col("_n")), F.lit(0.0)).alias("_base"))))
    for w in windows:
        d = d.withColumn(f"rate_{w}", smoothed(F.col(f"sum_{w}"), F.col(f"cnt_{w}"), F.lit(base) if base is not None else F.col("_base"), prior))
    return d.withColumn("trend", F.col(f"rate_{windows[0]}") - F.col(f"rate_{windows[-1]}")).drop("_base")


def births(df: DataFrame) -> DataFrame:
    return df.where("agency is not null").groupBy("agency").agg(F.min("reg").alias("born"))


def agency_age(df: DataFrame, born: DataFrame) -> DataFrame:
    """Days since the agency's first request; null for an agency that isn't known."""
    return df.join(born, "agency", "left").withColumn("agency_age", F.datediff("reg", "born")).drop("born")


def latest(df: DataFrame, key: str, value: str, order: str = "reg") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], lag: int = 0) -> DataFrame:
    """Backward as-of join: for each left row the values of the last right row with the same keys and
    right.on <= left.on - lag days. Both sides' rows share one window, so nothing is multiplied; of
    several right rows of a day the largest values count.
    """
    r = right.groupBy(*keys, on).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_at", day_number(F.col(on)) + lag)
    left_rows = left.withColumn("_at", day_number(F.col(on))).withColumn("_left", F.lit(1))
    both = left_rows.unionByName(r.select(*keys, "_at", "_v", F.lit(0).alias("_left")), allowMissingColumns=True)
    # on one day the right row comes first, so one running "last" finds it; rows frames run in one pass
    w = W.partitionBy(*keys).orderBy("_at", "_left").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left = 1")
    return both.select(*left.columns, *[F.col(f"_v.{v}").alias(f"asof_{v}") for v in values])


def matured(df: DataFrame, snapshot: Column, lag: int = 60) -> DataFrame:
    """Rows whose label has matured: registered `lag` days before the snapshot or earlier. Metrics of a test set count only these."""
    return df.where(F.col("reg") <= F.date_sub(snapshot, lag))


def settled(df: DataFrame, status: str, in_transit: str) -> DataFrame:
    """Without rows in transit, whose agency is the receiver; a null status is none in transit."""
    return df.where(~F.col(status).eqNullSafe(F.lit(in_transit)))


def unlagged_history(df: DataFrame, keys: list[str], order: list[str], anonymous: bool = False) -> DataFrame:
    """The history as it leaks: all earlier rows, labels not matured; -1 for requesters without a history. Only to measure the leak.

    With `anonymous`, rows of anonymous and unknown requesters are counted like all others. Their windows are those of a day, to
    which the sums of the days before are added, so that no task holds all of them.
    """
    of_requester, ok, names = "requester" in keys, eligible(F.col("requester")), ("leaky_sum", "leaky_den")
    whole = of_requester and anonymous
    if whole:
        own = F.when(ok, F.lit(0)).otherwise(day_number(F.col("reg"))).cast("long")
        d = df.drop(OWN).withColumn(OWN, own).repartition("requester", OWN)
    else:
        d = apart(df) if of_requester else df
    w = W.partitionBy(*keys, *([OWN] if of_requester else [])).orderBy("reg", *order).rowsBetween(W.unboundedPreceding, -1)
    out = d.withColumn("leaky_sum", F.coalesce(F.sum("y").over(w), F.lit(0))).withColumn("leaky_den", F.count("*").over(w))
    if whole:
        before = W.partitionBy(*keys).orderBy("reg").rowsBetween(W.unboundedPreceding, -1)
        days = daily(df.where(~ok), keys).select(*keys, "reg", F.sum("y_day").over(before).alias("leaky_sum"), F.sum("n_day").over(before).alias("leaky_den"))
        same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [*keys, "reg"]])
        days = F.broadcast(days) if keys == ["requester"] else days  # two requesters, a row a day
        both = out.alias("r").join(days.alias("d"), same, "left")
        out = both.select(*[F.col(f"r.{c}") for c in d.columns if c != OWN], *[(F.col(f"r.{c}") + F.coalesce(f"d.{c}", F.lit(0))).alias(c) for c in names])
        return out if OWN not in df.columns else apart(out)
    if of_requester:
        out = out.withColumns({c: F.when(ok, F.col(c)).otherwise(F.lit(ABSENT)).cast("long") for c in names})
    return out if OWN in df.columns else out.drop(OWN)


def strictly_prior(df: DataFrame, window: int, key: str = "agency") -> DataFrame:
    """Per (agency, day): requests and labels of the `window` days before, today excluded, unlagged. Diagnostic."""
    d = daily(df, [key])
    frame = W.partitionBy(key).orderBy(day_number(F.col("reg"))).rangeBetween(-window, -1)
    return d.withColumn("cnt_prior", F.coalesce(F.sum("n_day").over(frame), F.lit(0))).withColumn("sum_prior", F.coalesce(F.sum("y_day").over(frame), F.lit(0)))
