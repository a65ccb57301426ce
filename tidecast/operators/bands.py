"""Uncertainty bands from draws and from state variances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.numeric import dot, normal_quantile, uniform

FAN = (10, 25, 50, 75, 90)  # fixed values: percentiles of a fan chart
BAND_FLOOR = 1e-10  # fixed value


def quadratic_form(c, v):
    """c' V c for an array ``c`` and a row-major flat array ``v``."""
    k = F.size(c)
    rows = F.transform(
        F.sequence(F.lit(0), k - 1), lambda i: dot(F.slice(v, i * k + 1, k), c)
    )
    return dot(c, rows)


def confidence_bands(states: DataFrame, alpha: float = 0.32) -> DataFrame:
    """Central path and band from ``c``, ``z`` and the flat state variance ``v``."""
    z = normal_quantile(1 - alpha / 2)
    sd = F.sqrt(quadratic_form(F.col("c"), F.col("v")) + BAND_FLOOR)
    central = dot(F.col("c"), F.col("z"))
    return states.withColumn("central", central).withColumn("lower", central - z * sd).withColumn(
        "upper", central + z * sd
    )


def dfm_fan(states: DataFrame, percentiles: tuple[int, ...] = FAN) -> DataFrame:
    """Normal percentiles of the target, with observation noise ``r``, in its own units."""
    mean = dot(F.col("c"), F.col("z")) * F.col("sigma") + F.col("mu")
    sd = F.sqrt(quadratic_form(F.col("c"), F.col("v")) + F.col("r")) * F.abs("sigma")
    return states.withColumn("mean", mean).withColumn("std", sd).withColumns(
        {f"p{p}": mean + normal_quantile(p / 100) * sd for p in percentiles}
    )


def draw_fan(draws: DataFrame, keys: list[str], percentiles: tuple[int, ...] = FAN) -> DataFrame:
    """Percentiles, mean and deviation over forecast draws; the draws per key are a parameter."""
    q = F.percentile("forecast", F.array(*[F.lit(p / 100) for p in percentiles]))
    out = draws.groupBy(*keys).agg(
        q.alias("q"), F.avg("forecast").alias("mean"), F.stddev_pop("forecast").alias("std")
    )
    return out.select(*keys, *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(percentiles)], "mean", "std")


def bootstrap_bands(path: DataFrame, keys: list[str], n_boot: int = 200, seed: int = 42) -> DataFrame:
    """16th and 84th percentile of paths rebuilt from resampled, centred changes.

    ``path`` has (keys, period, value). The resampled position of every draw
    and step is a hash of (seed, key, draw, step), so a rerun of a lost task
    gives the same paths. The changes of a key form one array as long as its
    path, and the draws unfold from the row that carries it.
    """
    w = Window.partitionBy(*keys).orderBy("period")
    change = F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))
    steps = path.withColumn("d", change).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("period", "d", "value"))).alias("s"), F.avg("d").alias("m")
    )
    position = lambda t: F.floor(uniform(F.lit(seed), *keys, "b", t) * F.size("s")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda t: F.struct(
        t.alias("t"), F.col("s")[t]["period"].alias("period"), F.col("s")[0]["value"].alias("start"),
        (F.col("s")[position(t)]["d"] - F.col("m")).alias("d"),
    ))
    drawn = steps.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).select(*keys, "b", F.inline(cells))
    run = Window.partitionBy(*keys, "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    paths = drawn.withColumn("value", F.col("start") + F.sum("d").over(run))
    return paths.groupBy(*keys, "period").agg(
        F.percentile("value", F.lit(0.16)).alias("lower"), F.percentile("value", F.lit(0.84)).alias("upper")
    )
