"""Stationarity transforms, growth rates and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.numeric import floored_log
from tidecast.operators.grid import SERIES, series_window

# fixed values: transform codes
LEVEL, MOM, DIFF, QOQ_ANN, YOY = 0, 1, 2, 3, 4
MIN_STD = 1e-12  # fixed value: a smaller deviation counts as 1


def _log_change(lag: int, w: Window) -> Column:
    return floored_log(F.col("value")) - floored_log(F.lag("value", lag).over(w))


def transform_expr(code: Column, freq: str = "monthly", keys: list[str] = SERIES, scale: int | None = None) -> Column:
    """Value of a dense series under its transform code."""
    w = series_window(keys)
    quarterly = freq == "quarterly"
    factor = scale if scale is not None else (1 if quarterly else 3)
    return (
        F.when(code == MOM, _log_change(1, w))
        .when(code == DIFF, F.col("value") - F.lag("value").over(w))
        .when(code == QOQ_ANN, _log_change(1, w) * factor)
        .when(code == YOY, _log_change(4 if quarterly else 12, w))
        .otherwise(F.col("value"))
    )


def transform_series(grid: DataFrame, code: int, freq: str = "monthly", keys: list[str] = SERIES, scale: int | None = None) -> DataFrame:
    """One code for all series. ``grid`` is dense, so a gap gives a missing value."""
    return grid.withColumn("value", transform_expr(F.lit(code), freq, keys, scale))


def transform_panel(grid: DataFrame, meta: DataFrame, freq: str = "monthly", scaled: bool = False, keys: list[str] = SERIES) -> DataFrame:
    """Each series under the code of its registry row."""
    coded = grid.join(meta.select("series_id", "transform"), "series_id", "left")
    out = coded.withColumn(
        "value", transform_expr(F.coalesce("transform", F.lit(LEVEL)), freq, keys)
    ).select(*grid.columns)
    return standardize(out, keys).drop("mu", "sigma") if scaled else out


def series_stats(panel: DataFrame, keys: list[str] = SERIES, eps: float = MIN_STD) -> DataFrame:
    """Mean and population deviation; flat series get 1, empty ones 0 and 1."""
    sd = F.stddev_pop("value")
    return panel.groupBy(*keys).agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mu"),
        F.when(sd >= eps, sd).otherwise(F.lit(1.0)).alias("sigma"),
    )


def standardize(panel: DataFrame, keys: list[str] = SERIES, eps: float = MIN_STD) -> DataFrame:
    """Z-scores with ``mu`` and ``sigma`` kept beside them for the way back."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop("value").over(w)
    return (
        panel.withColumn("mu", F.coalesce(F.avg("value").over(w), F.lit(0.0)))
        .withColumn("sigma", F.when(sd >= eps, sd).otherwise(F.lit(1.0)))
        .withColumn("value", (F.col("value") - F.col("mu")) / F.col("sigma"))
    )


def destandardize(panel: DataFrame, factor: float = 1.0) -> DataFrame:
    return panel.withColumn("value", (F.col("value") * F.col("sigma") + F.col("mu")) * factor)


def scale_percent(panel: DataFrame, series: list[str]) -> DataFrame:
    """Listed series are percentages and become fractions."""
    return panel.withColumn(
        "value",
        F.when(F.col("series_id").isin(series), F.col("value") / 100).otherwise(F.col("value")),
    )


def growth_simple(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Relative change between existing rows, only from a positive base."""
    w = series_window(keys)
    prev = F.lag("value").over(w)
    return (
        panel.filter(F.col("value").isNotNull())
        .withColumn("prev", prev)
        .filter(F.col("prev") > 0)
        .withColumn("value", (F.col("value") - F.col("prev")) / F.col("prev"))
        .drop("prev")
    )


def growth_dlog_rows(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Log change between existing rows, only from a positive base."""
    return (
        panel.filter(F.col("value").isNotNull())
        .withColumn("prev", F.lag("value").over(series_window(keys)))
        .filter((F.col("prev") > 0) & (F.col("value") > 0))
        .withColumn("value", F.ln("value") - F.ln("prev"))
        .drop("prev")
    )


def lag_features(panel: DataFrame, lags: tuple[int, ...] = (3, 6), keys: list[str] = SERIES) -> DataFrame:
    w = series_window(keys)
    return panel.select("*", *[F.lag("value", k).over(w).alias(f"lag{k}") for k in lags])


def growth_to_level(growth: DataFrame, base: Column, keys: list[str], order: str = "period", annualized: bool = True) -> DataFrame:
    """Levels compounded from ``base``; annualised growth contributes a quarter of itself."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("value") / 4 if annualized else F.col("value")
    # a product with sign: zero and negative factors have no logarithm
    factor = 1 + step
    log_sum = F.sum(F.when(factor != 0, F.ln(F.abs(factor)))).over(w)
    negatives = F.sum(F.when(factor < 0, 1).otherwise(0)).over(w)
    zeros = F.sum(F.when(factor == 0, 1).otherwise(0)).over(w)
    sign = F.when(negatives % 2 == 1, -1.0).otherwise(1.0)
    product = F.when(zeros > 0, 0.0).otherwise(sign * F.exp(F.coalesce(log_sum, F.lit(0.0))))
    return growth.withColumn("level", base * product)


def level_path(quarters: DataFrame, keys: list[str]) -> DataFrame:
    """Published levels, then compounding of ``growth`` from the last of them.

    ``quarters`` has ``quarter``, ``actual`` (NULL once unpublished) and
    ``growth`` (a fraction). The first unpublished quarter is the nowcast.
    """
    w = Window.partitionBy(*keys).orderBy("quarter")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    open_q = F.col("actual").isNull()
    base = F.last("actual", ignorenulls=True).over(run)
    step = F.sum(F.when(open_q, F.ln(1 + F.col("growth"))).otherwise(0.0)).over(run)
    # published quarters may reappear after a gap: count open ones since the last published
    base_step = F.last(F.when(~open_q, F.col("cum")), ignorenulls=True).over(run)
    position = F.sum(open_q.cast("int")).over(run)
    return (
        quarters.withColumn("cum", step)
        .withColumn("base", base)
        .withColumn("base_cum", base_step)
        .withColumn("n_open", position)
        .withColumn("level", F.when(open_q, F.col("base") * F.exp(F.col("cum") - F.col("base_cum"))).otherwise(F.col("actual")))
        .withColumn(
            "status",
            F.when(~open_q, "actual").when(F.col("n_open") == 1, "nowcast").otherwise("forecast"),
        )
        .drop("cum", "base", "base_cum", "n_open")
    )
