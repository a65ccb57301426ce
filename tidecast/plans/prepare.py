"""From landed series to a panel ready for a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import grid, stats, transforms
from tidecast.sources import payloads

TARGET = "target"


def load_panel(
    records: DataFrame, specs: list[dict], target: dict, keys: list[str], *, date: str = "date", order: str | None = None,
    start: str | None = None, percent: list[str] = (), log_growth: list[str] = (),
) -> DataFrame:
    """Landed records to one panel: (keys, series_id, period, value), the target in it as ``TARGET``.

    ``specs`` and ``target`` say which records make which series (see ``payloads.load_series``); of repeated dates the
    first by ``order`` stays, and of several dates in a month the last. The target is the relative change from quarter to
    quarter, from positive levels only, at the last month of its quarter. Series of ``percent`` become fractions, those of
    ``log_growth`` the change of their logarithms between observed dates. A key begins with the quarter of its first known
    change of the target, or at ``start`` if that is later; a key without a target has no rows.
    """
    series = [*keys, "series_id"]
    cells = payloads.load_series(records, [*specs, {**target, "series_id": TARGET}], date, order, keys)
    cells = cells.withColumnRenamed("date", "period")
    is_target, grows = F.col("series_id") == TARGET, F.col("series_id").isin(list(log_growth))
    change = transforms.growth_simple(cells.filter(is_target), series)
    quarters = change.select(*series, cal.quarter_start(F.col("period")).alias("quarter"), "value")
    first = F.min("quarter")
    begins = quarters.groupBy(*keys).agg((F.greatest(first, F.lit(start).cast("date")) if start else first).alias("begin"))
    monthly = cells.filter(~is_target & ~grows)
    if log_growth:
        monthly = monthly.unionByName(transforms.growth_dlog_rows(cells.filter(grows), series))
    monthly = transforms.scale_percent(monthly, list(percent)).groupBy(*series, cal.month_start(F.col("period")).alias("month")).agg(
        F.max_by("value", "period").alias("value")
    ).withColumnRenamed("month", "period")
    placed = quarters.select(*series, cal.quarter_end_month(F.col("quarter")).alias("period"), "value")
    both = monthly.unionByName(placed).join(begins, keys)
    return both.filter(F.col("period") >= F.col("begin")).drop("begin")


def prepare_records(records: DataFrame, specs: list[dict], target: dict, meta: DataFrame, keys: list[str], scaled: bool = True, **load) -> DataFrame:
    """The whole way from landed records to a panel ready for a fit: ``load_panel``, then ``prepare_panel``."""
    return prepare_panel(load_panel(records, specs, target, keys, **load), meta, keys, scaled=scaled)


def prepare_panel(
    raw: DataFrame, meta: DataFrame, keys: list[str], start=None, end=None, percent: list[str] = (), scaled: bool = True
) -> DataFrame:
    """Scale, align to the monthly grid, transform by registry code, trim and standardise."""
    series = [*keys, "series_id"]
    cells = transforms.scale_percent(raw, list(percent)) if percent else raw
    dense = grid.align_to_grid(cells, start, end, series)
    stationary = transforms.transform_panel(dense, meta, keys=series)
    trimmed = stats.trim_empty_edges(stationary, keys=keys)
    return transforms.standardize(trimmed, series) if scaled else trimmed


def with_target(panel: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Add the quarterly target on the panel's months, observed at quarter ends only.

    ``target`` has (keys, quarter, value).
    """
    months = panel.select(*keys, "period").distinct()
    placed = target.select(*keys, cal.quarter_end_month(F.col("quarter")).alias("period"), "value")
    rows = months.join(placed, [*keys, "period"], "left").select(
        *keys, F.lit(TARGET).alias("series_id"), "period", "value"
    )
    return panel.select(*keys, "series_id", "period", "value").unionByName(rows)
