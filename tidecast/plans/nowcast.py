"""The three models on one panel, combined; news between two vintages; indicator choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import bridge, bvar, dfm, ensemble, forecasts, news, selection, transforms
from tidecast.operators.systems import Order, indicators, place, target_rows
from tidecast.session import cut, together

FITTED = ("dfm", "bvar", "beq")
SIMPLE = ("ar1", "naive", "mean")


def model_paths(system: DataFrame, order: Order, keys: list[str], r: int = 2, p: int = 2, max_iter: int = 100,
                draws: int = 100, beq_types: tuple[int, ...] = (bridge.ALL_TYPES,), models: tuple[str, ...] = FITTED,
                specs: DataFrame | None = None) -> DataFrame:
    """Path of the target under every model: (keys, model, period, value).

    ``system`` is dense and stationary. ``order`` names its variables with the target last: one list for all keys, or a
    table of systems by key (see ``systems``). ``specs`` may give the factor model's (n_factors, n_lags) by key. The
    simple models have the last observed quarter and the two behind it. A model that cannot be fitted for a key has no
    path there; the others have theirs.
    """
    # every model reads it, and several times
    system = cut(place(system, order).select(*keys, "series_id", "period", "value"), "system")
    known = target_rows(system, order).filter(cal.is_quarter_end(F.col("period"))).select(
        *keys, cal.quarter_start(F.col("period")).alias("quarter"), F.col("value").alias("y")
    )
    def factor_path() -> DataFrame:
        fit = dfm.dfm_fit(system, keys, r, p, max_iter, specs=specs)
        return target_rows(fit.project(None if isinstance(order, DataFrame) else [order[-1]]), order)

    def bridge_path() -> DataFrame:
        return bridge.bridge_median(bridge.beq_fit(system, known, indicators(order), keys, types=beq_types), keys)

    fits = {
        "dfm": factor_path, "beq": bridge_path,
        "bvar": lambda: target_rows(bvar.bvar_fit(system, order, keys, draws=draws), order),
    }
    paths = together({m: fits[m] for m in models if m in fits})
    parts = [df.select(*keys, F.lit(model).alias("model"), "period", "value") for model, df in paths.items()]
    simple = [m for m in models if m in SIMPLE]
    if simple:
        steps = forecasts.steps_ahead(known.withColumnRenamed("y", "value"), keys, simple)
        at = F.add_months(cal.quarter_end_month(F.col("last_quarter")), 3 * F.col("step"))
        parts.append(steps.select(*keys, "model", at.alias("period"), F.col("pred").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(cal.is_quarter_end(F.col("period")))


def extended(system: DataFrame, keys: list[str], months: int) -> DataFrame:
    """``system`` with so many empty months behind its last one."""
    last = system.groupBy(*keys).agg(F.max("period").alias("end"))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda i: F.add_months("end", i))
    rows = system.select(*keys, "series_id").distinct().join(last, keys)
    rows = rows.select(*keys, "series_id", F.explode(ahead).alias("period"), F.lit(None).cast("double").alias("value"))
    return system.select(*keys, "series_id", "period", "value").unionByName(rows)


def run_nowcast(system: DataFrame, order: Order, keys: list[str], **options) -> DataFrame:
    """Last observed quarter, the next one and the one after, per model and for the median of the models.

    The quarter after the target's last observation is the nowcast; a quarter
    of empty months is added behind the system, so that the one after exists.
    """
    system = cut(extended(system, keys, 3), "system")
    last = target_rows(system, order).filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.max("period").alias("last_period"), F.max_by("value", "period").alias("last_actual")
    )
    rows = model_paths(system, order, keys, **options).join(last, keys)
    ahead = cal.months_apart(F.col("period"), F.col("last_period")) / 3
    stage = F.when(ahead == 0, "backcast").when(ahead == 1, "nowcast").when(ahead == 2, "forecast")
    staged = rows.withColumn("stage", stage).filter("stage is not null").withColumnRenamed("value", "pred")
    staged = cut(staged.withColumn("quarter", cal.quarter_label(F.col("period"))), "nowcast")
    both = staged.groupBy(*keys, "quarter", "stage", "last_actual").agg(ensemble.median().alias("pred"))
    return staged.select(*keys, "quarter", "stage", "model", "pred", "last_actual").unionByName(
        both.withColumn("model", F.lit("ensemble")), allowMissingColumns=True
    )


def run_news(old: DataFrame, new: DataFrame, target: str, keys: list[str], meta: DataFrame, r: int = 2, p: int = 1,
             max_iter: int = 100) -> DataFrame:
    """Fit on the old vintage, then attribute the move of the latest target period to series and groups.

    Both vintages are dense on the same months and scaled with the old moments.
    """
    series = [*keys, "series_id"]
    old, new = cut(old, "old"), cut(new, "new")
    moments = transforms.series_stats(old, series)
    z = lambda df: df.join(moments, series).withColumn("value", (F.col("value") - F.col("mu")) / F.col("sigma")).select(*series, "period", "value")
    fit = dfm.dfm_fit(old, keys, r, p, max_iter)
    at = new.filter(F.col("series_id") == target).groupBy(*keys).agg(F.max("period").alias("period"))
    params = fit.state.select(*keys, "a", "q").join(at, keys)
    table = cut(news.news_decompose(z(old), z(new), fit.loadings(), params, target, keys, r * p), "news")
    groups = news.news_by_group(table, meta, keys).select(
        *keys, F.col("grp"), F.col("contribution").alias("group_contribution")
    )
    tagged = table.join(meta.select("series_id", "grp"), "series_id", "left")
    tagged = tagged.withColumn("grp", F.coalesce("grp", F.lit("other")))
    return news.news_order(tagged.join(groups, [*keys, "grp"]), keys)


def run_selection(panel: DataFrame, target: DataFrame, meta: DataFrame, keys: list[str], method: str = "correlation",
                  n: int = 20) -> DataFrame:
    """Rank indicators against the target and show their registry entry.

    ``target`` has (keys, period, y).
    """
    xy = cut(selection.align_quarterly_xy(panel, target, keys), "xy")
    if method == "lars":
        scores = selection.rank_lars(xy, n, keys)
    elif method == "tstat":
        scores = selection.rank_tstat(xy, keys)
    elif method == "correlation":
        scores = selection.rank_correlation(xy, keys)
    else:
        raise ValueError(f"unknown method {method}")
    return selection.top_variables(scores, n, keys).join(
        meta.select("series_id", "name", "grp", "freq", "pub_lag_days"), "series_id", "left"
    )
