"""Benchmark forecasts that need nothing but windows and regressions of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal

MIN_PAIRS = 4  # fixed value: lagged pairs an AR(1) needs
AR1_START = 12  # fixed value: rows before the expanding fit begins


def naive_persistence(target: DataFrame, keys: list[str], order: str = "quarter") -> DataFrame:
    """Last known value strictly before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return target.withColumn("pred", F.last("value", ignorenulls=True).over(w))


def expanding_mean(target: DataFrame, keys: list[str], order: str = "quarter") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return target.withColumn("pred", F.avg("value").over(w))


def expanding_ar1(target: DataFrame, keys: list[str], order: str = "quarter", start: int = AR1_START) -> DataFrame:
    """AR(1) refitted before every row on all rows before it."""
    by_time = Window.partitionBy(*keys).orderBy(order)
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    lagged = target.withColumn("lag_value", F.lag("value").over(by_time))
    pair = F.when(F.col("value").isNotNull() & F.col("lag_value").isNotNull(), 1)
    slope = F.regr_slope("value", "lag_value").over(before)
    intercept = F.regr_intercept("value", "lag_value").over(before)
    ready = (F.count(pair).over(before) >= MIN_PAIRS) & (F.row_number().over(by_time) > start)
    return lagged.withColumn(
        "pred", F.when(ready, intercept + slope * F.col("lag_value"))
    ).drop("lag_value")


def ar1_forecast(target: DataFrame, keys: list[str], order: str = "quarter") -> DataFrame:
    """One step after the last observation of each key; needs four lagged pairs."""
    known = target.filter(F.col("value").isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    lagged = known.withColumn("lag_value", F.lag("value").over(w))
    fit = lagged.groupBy(*keys).agg(
        F.regr_slope("value", "lag_value").alias("slope"),
        F.regr_intercept("value", "lag_value").alias("intercept"),
        F.count("lag_value").alias("n_pairs"),
        F.max_by("value", order).alias("last_value"),
    )
    return fit.filter(F.col("n_pairs") >= MIN_PAIRS).withColumn(
        "pred", F.col("intercept") + F.col("slope") * F.col("last_value")
    )


def steps_ahead(known: DataFrame, keys: list[str], models: list[str], steps: int = 2, order: str = "quarter") -> DataFrame:
    """``(keys, last_quarter, model, step, pred)``: the last observation as step 0 and the simple forecasts behind it.

    ``known`` has (keys, quarter, value). ``naive`` repeats the last value, ``mean`` the mean, and ``ar1`` goes on from
    its own forecasts. A key without observations has no rows, one with too few pairs no ``ar1`` beyond step 0.
    """
    seen = known.filter(F.col("value").isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    fit = seen.withColumn("_lag", F.lag("value").over(w)).groupBy(*keys).agg(
        F.max(order).alias("last_quarter"), F.max_by("value", order).alias("last"), F.avg("value").alias("mean"),
        F.regr_slope("value", "_lag").alias("b"), F.regr_intercept("value", "_lag").alias("a"), F.count("_lag").alias("n"),
    )
    start, path = F.col("last"), []
    for step in range(1, steps + 1):
        start = F.when(F.col("n") >= MIN_PAIRS, F.col("a") + F.col("b") * start)
        path.append(start)
    made = {"naive": [F.col("last")] * steps, "mean": [F.col("mean")] * steps, "ar1": path}
    rows = [
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("step"), p.alias("pred"))
        for m in models for i, p in enumerate([F.col("last"), *made[m]])
    ]
    return fit.select(*keys, "last_quarter", F.inline(F.array(*rows))).filter("pred is not null")


def last_known_before(values: DataFrame, asked: DataFrame, keys: list[str], when: str) -> DataFrame:
    """As-of join: the last value strictly before each asked date.

    A value holds from the day after it until the next one. Its interval is
    laid out by month, and a question meets it by key and month, so each
    question is compared with the few values around it. The questions are not
    sorted or gathered by key: a key with very many of them is split.
    """
    horizon = asked.select(F.max(when)).scalar()
    by_time = Window.partitionBy(*keys).orderBy("_from")
    known = (
        values.filter(F.col("value").isNotNull())
        .groupBy(*keys, F.col(when).alias("_from"))
        .agg(F.max("value").alias("last_value"))
        .withColumn("_to", F.coalesce(F.lead("_from").over(by_time), F.greatest(horizon, F.col("_from"))))
    )
    months = cal.months_between_inclusive(cal.month_start(F.col("_from")), cal.month_start(F.col("_to")))
    laid = known.withColumn("_month", F.explode(months))
    by_month = asked.withColumn("_month", cal.month_start(F.col(when)))
    inside = (F.col(f"q.{when}") > F.col("v._from")) & (F.col(f"q.{when}") <= F.col("v._to"))
    same = [F.col(f"q.{k}") == F.col(f"v.{k}") for k in (*keys, "_month")]
    on = inside
    for c in same:
        on = on & c
    return by_month.alias("q").join(laid.alias("v"), on, "left").select(
        *[F.col(f"q.{c}") for c in asked.columns], "v.last_value"
    )
