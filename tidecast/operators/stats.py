"""Panel diagnostics and selections of series and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.schemas import ENTITY, SERIES


def valid_span(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """First and last observed period of each key."""
    seen = F.when(F.col("value").isNotNull(), F.col("period"))
    return panel.groupBy(*keys).agg(F.min(seen).alias("first_period"), F.max(seen).alias("last_period"))


def last_observed(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return valid_span(panel, keys).select(*keys, "last_period")


def publication_lag(grid: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Trailing missing months; a series without any observation lags the whole grid."""
    seen = F.when(F.col("value").isNotNull(), F.col("period"))
    lag = cal.months_apart(F.max("period"), F.max(seen))
    return grid.groupBy(*keys).agg(F.coalesce(lag, F.count(F.lit(1))).cast("long").alias("lag_months"))


def trim_empty_edges(panel: DataFrame, trailing: bool = True, keys: list[str] = ENTITY) -> DataFrame:
    """Drop leading (and trailing) periods in which every series is missing."""
    span = valid_span(panel, keys)
    keep = F.col("period") >= F.col("first_period")
    if trailing:
        keep = keep & (F.col("period") <= F.col("last_period"))
    return panel.join(span, keys).filter(keep).select(*panel.columns)


def drop_short_series(panel: DataFrame, lags: int, freq: str = "monthly", target: str | None = None) -> DataFrame:
    """Keep a series whose first observation lies early enough before the last non-empty period."""
    needed = 2 * lags + 1 if freq == "quarterly" else 3 * 2 * lags + 1
    return panel.join(long_enough(panel, needed, target), SERIES, "left_semi")


def long_enough(panel: DataFrame, needed: int, target: str | None = None) -> DataFrame:
    spans = valid_span(panel)
    ends = spans.groupBy("entity_id").agg(F.max("last_period").alias("end"))
    ok = cal.months_apart(F.col("end"), F.col("first_period")) + 1 >= needed
    if target is not None:
        ok = ok | (F.col("series_id") == target)
    return spans.join(ends, "entity_id").filter(ok).select(*SERIES)


def near_constant(panel: DataFrame, limit: float = 1e-6, keys: list[str] = SERIES) -> DataFrame:
    sd = F.stddev_pop("value")
    return panel.groupBy(*keys).agg(sd.alias("sd")).filter(F.col("sd").isNull() | (F.col("sd") < limit))


def target_usable(target: DataFrame, needed: int = 3, keys: list[str] = ENTITY) -> DataFrame:
    return target.groupBy(*keys).agg(F.count("value").alias("n_obs")).filter(F.col("n_obs") >= needed)


def vintage_profile(vintages: DataFrame, target: str) -> DataFrame:
    """What each vintage of each entity holds."""
    rows = vintages.groupBy("entity_id", "vintage_date", "period").agg(
        F.count("value").alias("n_seen"),
        F.count(F.lit(1)).alias("n_series"),
        F.count(F.when(F.col("series_id") == target, F.col("value"))).alias("n_target"),
    )
    some = F.when(F.col("n_seen") > 0, F.col("period"))
    return rows.groupBy("entity_id", "vintage_date").agg(
        F.min(some).alias("first_month"),
        F.max(some).alias("last_month"),
        F.count(some).alias("n_rows"),
        F.sum("n_target").alias("n_target"),
        F.count(F.when(F.col("n_seen") == F.col("n_series"), 1)).alias("n_complete"),
    )


def availability(grid: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells and observed cells by group and period, with all margins."""
    return (
        grid.join(meta.select("series_id", "grp"), "series_id")
        .cube("grp", "period")
        .agg(F.count(F.lit(1)).alias("n_cells"), F.count("value").alias("n_seen"))
        .withColumn("share", F.col("n_seen") / F.col("n_cells"))
    )


def component_share(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of the total of its quarter. Totals are aggregates joined back, so a hot key is not gathered."""
    by = [*keys, "quarter"]
    total = levels.groupBy(*by).agg(F.sum("value").alias("_total"))
    return levels.join(total, by).withColumn("share", F.try_divide(F.col("value"), F.col("_total")) * 100).drop("_total")


def select_group_subset(meta: DataFrame, target_groups: DataFrame, minimum: int = 3) -> DataFrame:
    """Indicators of each target's groups; a target with fewer than ``minimum`` gets all.

    ``target_groups`` is (target, groups ARRAY<STRING>). Groups meet series by
    equality; only a target that falls short unfolds the registry's id list.
    """
    wanted = target_groups.select("target", F.explode(F.array_distinct("groups")).alias("grp"))
    hits = wanted.join(meta.select("series_id", "grp"), "grp").select("target", "series_id")
    n_hit = hits.groupBy("target").agg(F.count(F.lit(1)).alias("n_hit"))
    counted = target_groups.select("target").join(n_hit, "target", "left")
    short = counted.filter(F.coalesce("n_hit", F.lit(0)) < minimum).select("target")
    everything = meta.agg(F.array_sort(F.collect_set("series_id"))).scalar()
    return hits.join(short, "target", "left_anti").unionByName(
        short.select("target", F.explode(everything).alias("series_id"))
    )


def filter_series_spec(records: DataFrame, filters: dict[str, str]) -> DataFrame:
    """All column = value conditions, skipping columns the dataset does not have."""
    for column, wanted in filters.items():
        if column in records.columns:
            records = records.filter(F.col(column) == wanted)
    return records


def level_yoy(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Percent change against the same quarter a year earlier, from a positive base only."""
    ago = levels.select(
        *keys, F.add_months("quarter", 12).alias("quarter"), F.col("value").alias("base")
    )
    return (
        levels.join(ago, [*keys, "quarter"])
        .filter(F.col("base") > 0)
        .withColumn("yoy", (F.col("value") / F.col("base") - 1) * 100)
    )


def identity_residual(parts: DataFrame) -> DataFrame:
    """Growth of imports implied by the expenditure identity.

    ``parts`` has levels ``c, i, g, x, m`` and growth in percent ``c_g, i_g,
    g_g, x_g, total_g``; any missing growth gives a missing result.
    """
    m = F.when(F.abs("m") > 0, F.abs("m")).otherwise(1.0)
    spent = sum((F.col(k) * F.col(f"{k}_g") for k in ("c", "i", "g", "x")), F.lit(0.0))
    total = (F.col("c") + F.col("i") + F.col("g") + F.col("x") - m) * F.col("total_g")
    return parts.withColumn("imports_identity", (spent - total) / m)
