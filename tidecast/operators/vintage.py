"""What was known when: release dates, vintages, revisions and frozen first values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.functions.numeric import close
from tidecast.operators.grid import SERIES
from tidecast.session import spread

DEFAULT_LAG_DAYS = 30  # fixed value: days when neither calendar nor registry knows
DEFAULT_MEDIAN_LAG = 45.0  # fixed value


def earliest_release(calendar: DataFrame) -> DataFrame:
    return calendar.filter(F.col("ref_period").isNotNull()).groupBy("series_id", "ref_period").agg(
        F.min("release_date").alias("release_date")
    )


def median_release_lag(calendar: DataFrame, meta: DataFrame) -> DataFrame:
    """Median days from the end of the period to its release; a default without releases.

    Lags are whole days, so the exact median holds one counter per distinct lag.
    """
    lags = calendar.groupBy("series_id").agg(
        F.median(F.date_diff("release_date", F.last_day("ref_period"))).alias("lag_days")
    )
    return meta.select("series_id").join(lags, "series_id", "left").withColumn(
        "lag_days", F.coalesce("lag_days", F.lit(DEFAULT_MEDIAN_LAG))
    )


def calendar_coverage(calendar: DataFrame) -> DataFrame:
    return calendar.agg(
        F.count(F.lit(1)).alias("n_releases"),
        F.countDistinct("series_id").alias("n_series"),
        F.min("release_date").alias("first_release"),
        F.max("release_date").alias("last_release"),
    )


def release_dates(panel: DataFrame, calendar: DataFrame, meta: DataFrame) -> DataFrame:
    """Exact earliest release of every cell, else period end plus the series' lag."""
    exact = earliest_release(calendar).withColumnRenamed("ref_period", "period")
    lags = meta.select("series_id", "pub_lag_days")
    fallback = F.date_add(F.last_day("period"), F.coalesce("pub_lag_days", F.lit(DEFAULT_LAG_DAYS)))
    return (
        panel.join(exact, ["series_id", "period"], "left")
        .join(lags, "series_id", "left")
        .withColumn("release_date", F.coalesce("release_date", fallback))
        .select(*panel.columns, "release_date")
    )


def vintage_dates(start: str, end: str, step: int, day: int) -> Column:
    """The vintage dates as one array, for use inside a row."""
    months = cal.months_between_inclusive(
        F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"), step
    )
    return F.transform(months, lambda m: F.date_add(m, min(day, 28) - 1))


def build_vintages_strict(dated: DataFrame, vintages: Column) -> DataFrame:
    """Each released cell in every vintage at or after its release, and in no other.

    The theta join on the release date is an unfolding of the row itself:
    nothing is broadcast, shuffled or compared that does not match.
    """
    seen = F.filter(vintages, lambda v: v >= F.col("release_date"))
    return dated.select(*[c for c in dated.columns if c != "release_date"], F.explode(seen).alias("vintage_date"))


def _mask_edge(rows: DataFrame, keys: list[str]) -> DataFrame:
    published = F.when(
        F.col("value").isNotNull() & (F.col("release_date") <= F.col("vintage_date")), F.col("period")
    )
    last = F.max(published).over(Window.partitionBy(*keys, "vintage_date"))
    return (
        rows.withColumn("last_published", last)
        .withColumn("value", F.when(F.col("period") <= F.col("last_published"), F.col("value")))
        .drop("release_date", "last_published")
    )


def build_vintages(dated: DataFrame, vintages: Column, keys: list[str] = SERIES) -> DataFrame:
    """The panel as it looked at each vintage, all vintages in one plan.

    A cell is blank when it lies after the last published period of its
    series: the mask works back from the edge and stops at the first
    published cell. Rows are placed by series before they are unfolded, so the
    shuffle carries the panel once and not once per vintage.
    """
    rows = spread(dated, keys).withColumn("vintage_date", F.explode(vintages))
    return _mask_edge(rows, keys)


def ragged_edge(dated: DataFrame, vintages: Column, keys: list[str] = SERIES) -> DataFrame:
    """Vintages cut at their own month, as a pseudo-real-time loop would see them."""
    own = F.filter(vintages, lambda v: F.trunc(v, "month") >= F.col("period"))
    return _mask_edge(spread(dated, keys).withColumn("vintage_date", F.explode(own)), keys)


def vintage_diff(old: DataFrame, new: DataFrame, keys: list[str] = (*SERIES, "period")) -> DataFrame:
    """Cells added, revised, removed or unchanged between two vintages."""
    keys = list(keys)
    a = old.select(*keys, F.col("value").alias("old_value"))
    b = new.select(*keys, F.col("value").alias("new_value"))
    both = a.join(b, keys, "full_outer")
    status = (
        F.when(close(F.col("old_value"), F.col("new_value")), "same")
        .when(F.col("old_value").isNull(), "added")
        .when(F.col("new_value").isNull(), "removed")
        .otherwise("revised")
    )
    return both.withColumn("status", status)


def freeze_first_release(feed: DataFrame, keys: list[str] = ("quarter", "metric")) -> DataFrame:
    """First value ever seen, latest value, and when. ``feed`` rows carry ``seen_date``.

    A later base year is reported beside the frozen one, never applied.
    """
    seen = feed.filter(F.col("value").isNotNull()).withColumn("value", F.round("value", 3))
    return seen.groupBy(*keys).agg(
        F.min("seen_date").alias("first_release_date"),
        F.min_by("value", "seen_date").alias("first_value"),
        F.max_by("value", "seen_date").alias("latest_value"),
        F.max("seen_date").alias("last_update_date"),
        F.min_by("base_year", "seen_date").alias("base_year"),
        (F.max_by("base_year", "seen_date") != F.min_by("base_year", "seen_date")).alias("base_changed"),
    )


def merge_actuals(state: DataFrame, feed: DataFrame) -> DataFrame:
    """One incremental step: known keys keep their first value, new keys are inserted.

    The latest value is the one seen last, whichever side it comes from.
    """
    keys = ["quarter", "metric"]
    fresh = freeze_first_release(feed).drop("base_changed")
    s, f = state.alias("s"), fresh.alias("f")
    joined = s.join(f, [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "full_outer")
    newer = F.col("s.last_update_date").isNull() | (F.col("f.last_update_date") >= F.col("s.last_update_date"))
    return joined.select(
        *[F.coalesce(f"s.{k}", f"f.{k}").alias(k) for k in keys],
        F.coalesce("s.first_release_date", "f.first_release_date").alias("first_release_date"),
        F.coalesce("s.first_value", "f.first_value").alias("first_value"),
        F.when(newer, F.col("f.latest_value")).otherwise(F.col("s.latest_value")).alias("latest_value"),
        F.greatest("f.last_update_date", "s.last_update_date").alias("last_update_date"),
        F.coalesce("s.base_year", "f.base_year").alias("base_year"),
    )


def revision_stats(actuals: DataFrame) -> DataFrame:
    gap = F.col("latest_value") - F.col("first_value")
    return actuals.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(gap).alias("mean_revision"),
        F.avg(F.abs(gap)).alias("mean_abs_revision"),
    )


def latest_published_quarter(actuals: DataFrame) -> DataFrame:
    known = actuals.filter(F.col("first_value").isNotNull())
    return known.groupBy("metric").agg(F.max("quarter").alias("quarter"))
