"""Filling and blanking cells of a dense panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators.grid import SERIES, series_window
from tidecast.session import spread


def _windows(keys: list[str]):
    w = series_window(keys)
    return (
        w,
        w.rowsBetween(Window.unboundedPreceding, 0),
        w.rowsBetween(0, Window.unboundedFollowing),
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )


def forward_fill(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Last valid value; leading cells stay missing. Uses no later value."""
    _, back, _, _ = _windows(keys)
    return panel.withColumn("value", F.last("value", ignorenulls=True).over(back))


def backfill_leading(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Leading missing cells take the first valid value; others are untouched."""
    _, back, _, whole = _windows(keys)
    first = F.first("value", ignorenulls=True).over(whole)
    seen = F.last("value", ignorenulls=True).over(back)
    return panel.withColumn("value", F.when(seen.isNull(), first).otherwise(F.col("value")))


def _neighbours(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Previous and next valid cell of every row, and the first two and last of the series."""
    w, back, ahead, whole = _windows(keys)
    at = F.when(F.col("value").isNotNull(), F.col("t"))
    return (
        panel.withColumn("t", F.row_number().over(w))
        .withColumn("n_valid", F.count("value").over(whole))
        .withColumn("v0", F.last("value", ignorenulls=True).over(back))
        .withColumn("t0", F.last(at, ignorenulls=True).over(back))
        .withColumn("v1", F.first("value", ignorenulls=True).over(ahead))
        .withColumn("t1", F.first(at, ignorenulls=True).over(ahead))
    )


def _between() -> Column:
    share = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return F.when(F.col("t0") == F.col("t1"), F.col("value")).otherwise(
        F.col("v0") + share * (F.col("v1") - F.col("v0"))
    )


def impute_linear(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Straight line between neighbours, nearest value at the edges; two valid cells needed."""
    filled = F.coalesce(_between(), "v0", "v1")
    return (
        _neighbours(panel, keys)
        .withColumn("value", F.when(F.col("n_valid") >= 2, filled).otherwise(F.col("value")))
        .select(*panel.columns)
    )


def impute_linear_no_leak(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Interior gaps only: nothing before the first or after the last valid cell."""
    return (
        _neighbours(panel, keys)
        .withColumn("value", F.when(F.col("n_valid") >= 2, _between()).otherwise(F.col("value")))
        .select(*panel.columns)
    )


def impute_block(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Interior line, leading cells on the line through the first two valid ones, trailing forward fill."""
    w, _, _, whole = _windows(keys)
    near = _neighbours(panel, keys)
    valid_t = F.when(F.col("value").isNotNull(), F.col("t"))
    ft = F.min(valid_t).over(whole)
    near = near.withColumn("ft", ft)
    second = F.when(F.col("value").isNotNull() & (F.col("t") > F.col("ft")), F.struct("t", "value"))
    near = near.withColumn("fv", F.first("value", ignorenulls=True).over(whole)).withColumn(
        "s", F.min(second).over(whole)
    )
    slope = (F.col("s.value") - F.col("fv")) / (F.col("s.t") - F.col("ft"))
    leading = F.col("fv") + (F.col("t") - F.col("ft")) * slope
    filled = (
        F.when(F.col("n_valid") < 2, F.col("v0"))
        .when(F.col("t0").isNull(), leading)
        .otherwise(F.coalesce(_between(), "v0"))
    )
    return near.withColumn("value", filled).select(*panel.columns)


def _not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) with the third derivative continuous at the outer inner knots."""
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    a, rhs = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (slope[i] - slope[i - 1])
    m = np.linalg.solve(a, rhs)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, right = at - x[i], x[i + 1] - at
    return (
        (m[i] * right**3 + m[i + 1] * left**3) / (6 * h[i])
        + (y[i] / h[i] - m[i] * h[i] / 6) * right
        + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * left
    )


def impute_spline(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Cubic spline per series; below four valid cells a line, below two nothing.

    A group is one series on the grid, so its length is bounded by the calendar. A series with an infinite cell, or whose
    spline cannot be solved, stays as it is.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        v = pdf["value"].to_numpy(dtype=float)
        ok = ~np.isnan(v)
        x, t = np.flatnonzero(ok).astype(float), np.arange(len(v), dtype=float)
        if not np.isfinite(v[ok]).all():
            return pdf
        if ok.sum() >= 4:
            try:
                v = np.where(ok, v, _not_a_knot(x, v[ok], t))
            except np.linalg.LinAlgError:
                return pdf
        elif ok.sum() >= 2:
            v = np.interp(t, x, v[ok])
        return pdf.assign(value=v)

    return spread(panel, keys).groupBy(*keys).applyInPandas(fill, panel.schema)


def outlier_mad(panel: DataFrame, threshold: float = 5.0, replace: bool = True, keys: list[str] = SERIES) -> DataFrame:
    """Cells further than ``threshold`` scaled median deviations from the median.

    They become missing, or with ``replace`` off are flagged in ``is_outlier``.
    Series with fewer than five valid cells or no spread are left alone.
    """
    w = Window.partitionBy(*keys)
    scored = (
        panel.withColumn("med", F.median("value").over(w))
        .withColumn("mad", F.median(F.abs(F.col("value") - F.col("med"))).over(w) * 1.4826)
        .withColumn("n_valid", F.count("value").over(w))
    )
    hit = (
        (F.col("n_valid") >= 5)
        & (F.col("mad") >= 1e-12)
        & (F.abs(F.col("value") - F.col("med")) > threshold * F.col("mad"))
    )
    scored = scored.withColumn("is_outlier", F.coalesce(hit, F.lit(False)))
    if replace:
        return scored.withColumn("value", F.when(~F.col("is_outlier"), F.col("value"))).select(*panel.columns)
    return scored.select(*panel.columns, "is_outlier")


SHOCK_START, SHOCK_END = "2020-02-01", "2020-09-01"  # fixed values
SHOCK_QUARTERS = {1: ("2020-06-01", "2020-09-01"), 4: ("2020-03-01", "2020-06-01")}  # fixed values


def mask_period(panel: DataFrame, start: str = SHOCK_START, end: str = SHOCK_END) -> DataFrame:
    """Blank all series between two months; nothing happens when the grid lacks the first."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    has_start = panel.select(F.max(F.col("period") == lo)).scalar()
    return panel.withColumn(
        "value", F.when(~(F.col("period").between(lo, hi) & has_start), F.col("value"))
    )


def correct_shock(panel: DataFrame, mode: int = 0, threshold: float = 5.0, start: str = SHOCK_START, end: str = SHOCK_END) -> DataFrame:
    """0, 1 and 4 leave the data as it is, 2 blanks the block, 3 blanks outliers."""
    if mode in (0, 1, 4):
        return panel
    if mode == 2:
        return mask_period(panel, start, end)
    if mode == 3:
        return outlier_mad(panel, threshold)
    raise ValueError(f"unknown shock mode {mode}")


def event_dummies(grid: DataFrame, months: tuple[str, ...]) -> DataFrame:
    """0/1 columns on the quarter-end months, one per listed month."""
    flags = [
        (F.col("period") == F.lit(m).cast("date")).cast("int").alias(f"d{i + 1}")
        for i, m in enumerate(months)
    ]
    return grid.filter(cal.is_quarter_end(F.col("period"))).select("period", *flags)
