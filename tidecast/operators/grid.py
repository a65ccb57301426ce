"""The monthly grid: building it, aligning to it, moving between frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.schemas import SERIES


def series_window(keys: list[str] = SERIES) -> Window:
    return Window.partitionBy(*keys).orderBy("period")


def date_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def period_grid(bounds: DataFrame, step: int = 1) -> DataFrame:
    """Every month (or ``step`` months) from ``lo`` to ``hi`` of each row of ``bounds``."""
    keys = [c for c in bounds.columns if c not in ("lo", "hi")]
    return bounds.select(
        *keys, F.explode(cal.months_between_inclusive(F.col("lo"), F.col("hi"), step)).alias("period")
    )


def vintages_between(bounds: DataFrame, step: int = 1, day: int = 1) -> DataFrame:
    """Vintage dates of every row of ``bounds`` (keys, lo, hi), every ``step`` months; the day is capped at 28."""
    keys = [c for c in bounds.columns if c not in ("lo", "hi")]
    return period_grid(bounds, step).select(
        *keys, F.make_date(F.year("period"), F.month("period"), F.lit(min(day, 28))).alias("vintage_date")
    )


def vintage_grid(spark: SparkSession, start: str, end: str, step: int = 1, day: int = 1) -> DataFrame:
    """Vintage dates from month ``start`` to month ``end``; the day is capped at 28."""
    bounds = spark.range(1).select(cal.month_start(F.lit(start)).alias("lo"), cal.month_start(F.lit(end)).alias("hi"))
    return vintages_between(bounds, step, day)


def panel_bounds(panel: DataFrame, start: str | None = None, keys: list[str] = ()) -> DataFrame:
    """First and last month of the panel, not before ``start``."""
    lo = F.min("period")
    if start is not None:
        lo = F.greatest(lo, F.lit(start).cast("date"))
    return panel.groupBy(*keys).agg(lo.alias("lo"), F.max("period").alias("hi"))


def last_per_cell(panel: DataFrame, order: str, keys: list[str] = SERIES) -> DataFrame:
    """One value per cell; the row with the greatest ``order`` wins.

    An aggregate, not a window: duplicates of one hot cell are reduced on the
    map side before anything is shuffled.
    """
    return panel.groupBy(*keys, "period").agg(F.max_by("value", order).alias("value"))


def span_of(df: DataFrame, column: str) -> Column:
    """First and last month of a column as one scalar (fields ``lo`` and ``hi``), read once."""
    month = cal.month_start(F.col(column))
    return df.select(F.struct(F.min(month).alias("lo"), F.max(month).alias("hi"))).scalar()


def align_to_grid(
    panel: DataFrame, start=None, end=None, keys: list[str] = SERIES, horizon: int = 0, order: str = "value"
) -> DataFrame:
    """Put every series on every month of one shared grid; absent cells are NULL.

    Of several rows for one cell the one with the greatest ``order`` wins. Each series becomes one row (its length
    is bounded by the calendar) and is unfolded again on the grid, so a series
    costs one shuffle and windows over ``keys`` reuse that partitioning. Pass
    the bounds when they are known: otherwise the panel is read once more.
    """
    if start is None or end is None:
        span = span_of(panel, "period")
    lo = date_column(start) if start is not None else span["lo"]
    hi = date_column(end) if end is not None else span["hi"]
    if horizon:
        hi = F.add_months(hi, horizon)
    rows = F.array_sort(F.collect_list(F.struct("period", F.col(order).alias("order"), F.col("value").alias("value"))))
    series = panel.filter(F.col("value").isNotNull()).groupBy(*keys).agg(rows.alias("rows"))
    last = F.filter("rows", lambda r, i: ~r["period"].eqNullSafe(F.get("rows", i + 1)["period"]))
    cells = F.map_from_entries(F.transform(last, lambda r: F.struct(r["period"], r["value"])))
    series = series.select(*keys, cells.alias("cells"))
    dense = F.transform(
        cal.months_between_inclusive(F.col("_lo"), F.col("_hi")),
        lambda p: F.struct(p.alias("period"), F.col("cells")[p].alias("value")),
    )
    return series.withColumns({"_lo": lo, "_hi": hi}).select(*keys, F.inline(dense))


def grid_index(grid: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Position of each month in the grid, counted from its first month."""
    first = grid.select(F.min("period")).scalar()
    return grid.withColumn("idx", cal.months_apart(F.col("period"), first).cast("int"))


def date_lookup(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    """Grid position of each wanted month, -1 when the grid does not hold it."""
    return wanted.join(grid.select("period", "idx"), "period", "left").withColumn(
        "idx", F.coalesce("idx", F.lit(-1))
    )


def shift_to_quarter_end(panel: DataFrame) -> DataFrame:
    """Quarterly observations move to the last month of their quarter."""
    return panel.withColumn("period", cal.quarter_end_month(F.col("period")))


def agg_quarter(panel: DataFrame, method: str, keys: list[str] = SERIES, require_full: bool = True) -> DataFrame:
    """Monthly to quarterly: ``last`` month, ``mean`` or ``sum`` of present months.

    ``panel`` is on the grid. A quarter that the grid covers only in part gives
    a missing mean and a zero sum unless ``require_full`` is off.
    """
    if method == "last":
        return panel.filter(cal.is_quarter_end(F.col("period"))).select(
            *keys, cal.quarter_start(F.col("period")).alias("quarter"), "value"
        )
    full = (F.count(F.lit(1)) == 3) | F.lit(not require_full)
    value = (
        F.when(full, F.avg("value"))
        if method == "mean"
        else F.when(full, F.coalesce(F.sum("value"), F.lit(0.0))).otherwise(F.lit(0.0))
    )
    quarter = cal.quarter_start(F.col("period")).alias("quarter")
    # a quarter exists once its closing month is on the grid
    return (
        panel.groupBy(*keys, quarter)
        .agg(value.alias("value"), F.max("period").alias("last_month"))
        .filter(cal.is_quarter_end(F.col("last_month")))
        .drop("last_month")
    )


def agg_mariano_murasawa(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Five-month weighted sum that turns monthly into quarterly growth."""
    weights = [1.0, 2.0, 3.0, 2.0, 1.0]  # fixed values
    w = series_window(keys)
    total = sum(
        (F.coalesce(F.lag("value", k).over(w) if k else F.col("value"), F.lit(0.0)) * wt
         for k, wt in enumerate(weights)),
        F.lit(0.0),
    )
    return panel.withColumn("value", F.when(F.row_number().over(w) > 4, total))


def daily_to_monthly_last(raw: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Last non-missing value of each month."""
    return (
        raw.filter(F.col("value").isNotNull())
        .groupBy(*keys, cal.month_start(F.col(ts)).alias("period"))
        .agg(F.max_by("value", ts).alias("value"))
    )


def quarter_blocks(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One row per quarter with the three months side by side; a cut quarter is padded."""
    month = cal.month_of_quarter(F.col("period"))
    return panel.groupBy(*keys, cal.quarter_start(F.col("period")).alias("quarter")).agg(
        *[F.max(F.when(month == m, F.col("value"))).alias(f"m{m}") for m in (1, 2, 3)]
    )


def unblock_quarters(blocks: DataFrame, lo, hi, keys: list[str] = SERIES) -> DataFrame:
    """Quarter blocks back to months, cut to the original span."""
    months = F.array(*[
        F.struct(F.add_months("quarter", m - 1).alias("period"), F.col(f"m{m}").alias("value"))
        for m in (1, 2, 3)
    ])
    return blocks.select(*keys, F.inline(months)).filter(F.col("period").between(lo, hi))


def long_to_wide(panel: DataFrame, series: list[str], keys: list[str]) -> DataFrame:
    """One column per listed series; the list is part of the schema, not read from data."""
    return panel.groupBy(*keys).agg(
        *[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in series]
    )


def wide_to_long(wide: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    return wide.unpivot(keys, series, "series_id", "value")


def group_one_hot(meta: DataFrame) -> DataFrame:
    """Series x group membership as 0/1 rows, one per (series, known group)."""
    groups = meta.agg(F.array_sort(F.collect_set("grp"))).scalar()
    return meta.select("series_id", "grp", F.explode(groups).alias("block")).select(
        "series_id", "block", (F.col("grp") == F.col("block")).cast("int").alias("member")
    )
