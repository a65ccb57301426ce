"""Job grids and pseudo-real-time evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.functions.numeric import uniform
from tidecast.operators import bridge, bvar, dfm, forecasts, vintage
from tidecast.session import cut, together

MODELS = ("dfm", "bvar", "beq", "ar1", "naive", "mean")


def model_grid(entities: DataFrame, vintages: Column, rs: tuple[int, ...], ps: tuple[int, ...]) -> DataFrame:
    """Every entity under every vintage and hyper-parameter pair; the lists unfold in the row."""
    return (
        entities.withColumn("vintage_date", F.explode(vintages))
        .withColumn("r", F.explode(F.lit(list(rs))))
        .withColumn("p", F.explode(F.lit(list(ps))))
    )


def random_grid(entities: DataFrame, n: int, r: tuple[int, int], p: tuple[int, int], seed: int = 0) -> DataFrame:
    """``n`` random specifications per entity within inclusive ranges, fixed by the seed."""
    keys = entities.columns

    def pick(tag: str, lo: int, hi: int) -> Column:
        u = uniform(F.lit(seed), F.lit(tag), *keys, "draw")
        return (lo + F.floor(u * (hi - lo + 1))).cast("int")

    return entities.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns(
        {"r": pick("r", *r), "p": pick("p", *p)}
    )


def vintage_systems(dated: DataFrame, vintages: Column, keys: list[str]) -> DataFrame:
    """Every series as known at each vintage, on the months up to the end of the vintage's quarter.

    ``dated`` is dense with ``release_date``; the target is one of its series.
    """
    series = [*keys, "series_id"]
    seen = vintage.build_vintages(dated, vintages, series)
    return seen.filter(F.col("period") <= cal.quarter_end_month(F.col("vintage_date")))


def run_backtest(
    systems: DataFrame, target: DataFrame, order: list[str], keys: list[str], models: tuple[str, ...] = MODELS,
    r: int = 2, p: int = 1, max_iter: int = 100, draws: int = 100,
    beq_types: tuple[int, ...] = (bridge.ALL_TYPES,),
) -> DataFrame:
    """Nowcast of the vintage's own quarter by every model at every vintage, beside the actual.

    ``systems`` come from ``vintage_systems`` with the target last in
    ``order``; ``target`` has (keys, quarter, value). All vintages are keys of
    one fit per model. A fit that fails leaves a missing prediction.
    """
    fit_keys, name = [*keys, "vintage_date"], order[-1]
    systems = cut(systems, "systems")
    asked = systems.select(*fit_keys).distinct().withColumn(
        "quarter", cal.quarter_start(F.col("vintage_date"))
    )
    at = cal.quarter_end_month(F.col("vintage_date"))
    known = systems.filter((F.col("series_id") == name) & cal.is_quarter_end(F.col("period")))
    known = known.select(*fit_keys, cal.quarter_start(F.col("period")).alias("quarter"), "value")

    def at_quarter(paths: DataFrame) -> DataFrame:
        hit = paths.filter((F.col("series_id") == name) & (F.col("period") == at))
        return hit.select(*fit_keys, F.col("value").alias("pred"))

    def bridge_path() -> DataFrame:
        fcst = bridge.beq_fit(systems, known.withColumnRenamed("value", "y"), order[:-1], fit_keys, types=beq_types)
        median = bridge.bridge_median(fcst, fit_keys)
        return median.filter(F.col("period") == at).select(*fit_keys, F.col("value").alias("pred"))

    fits = {
        "dfm": lambda: at_quarter(dfm.dfm_fit(systems, fit_keys, r, p, max_iter).project([name])),
        "bvar": lambda: at_quarter(bvar.bvar_fit(systems, order, fit_keys, draws=draws)),
        "beq": bridge_path,
    }
    made = together({m: fits[m] for m in models if m in fits})
    if "ar1" in models:
        made["ar1"] = forecasts.ar1_forecast(known, fit_keys).select(*fit_keys, "pred")
    observed = known.filter("value is not null").groupBy(*fit_keys)
    if "naive" in models:
        made["naive"] = observed.agg(F.max_by("value", "quarter").alias("pred"))
    if "mean" in models:
        made["mean"] = observed.agg(F.avg("value").alias("pred"))
    grid = asked.withColumn("model", F.explode(F.lit(list(made))))
    preds = None
    for model, df in made.items():
        part = df.withColumn("model", F.lit(model))
        preds = part if preds is None else preds.unionByName(part)
    actual = target.select(*keys, "quarter", F.col("value").alias("actual"))
    return grid.join(preds, [*fit_keys, "model"], "left").join(actual, [*keys, "quarter"], "left")
