"""Scores of nowcasts against frozen first releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import segments

BENCHMARK_MASE_FLOOR = 1e-10  # fixed value

# A pair table has (keys..., order, actual, pred); only complete pairs count.


def complete(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("actual").isNotNull() & F.col("pred").isNotNull())


def mae() -> Column:
    return F.avg(F.abs(F.col("actual") - F.col("pred")))


def rmse() -> Column:
    err = F.col("actual") - F.col("pred")
    return F.sqrt(F.avg(err * err))


def bias() -> Column:
    return F.avg(F.col("pred") - F.col("actual"))


def sign_accuracy() -> Column:
    """Share of pairs on the same side of zero."""
    return F.avg((F.signum("actual") == F.signum("pred")).cast("double"))


def coverage() -> Column:
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    return F.avg(inside.cast("double"))


def with_turns(pairs: DataFrame, keys: list[str], order: list[str], segment: Column | None = None) -> DataFrame:
    """Direction hit of each pair with its predecessor: NULL where the actual did not move.

    A key may hold most pairs: it is cut along the order (see ``segments``), by default at the first of its columns.
    """
    whole = complete(pairs)
    moved = segments.with_lag(whole, keys, order, ["actual", "pred"], 1, segment)
    da = F.signum(F.col("actual") - F.col("_before.actual"))
    dp = F.signum(F.col("pred") - F.col("_before.pred"))
    return moved.withColumn("hit", F.when(da != 0, (da == dp).cast("double"))).drop("_before")


def fda() -> Column:
    """Direction-of-change accuracy over ``with_turns`` rows."""
    return F.avg("hit")


def mase(pairs: DataFrame, keys: list[str], order: list[str], season: int = 1, segment: Column | None = None) -> DataFrame:
    """MAE relative to the MAE of repeating the value ``season`` rows back; keys are cut along the order by ``segment``."""
    moved = segments.with_lag(complete(pairs), keys, order, ["actual"], season, segment)
    rows = moved.withColumn("naive_err", F.abs(F.col("actual") - F.col("_before.actual")))
    scale = F.avg("naive_err")
    return rows.groupBy(*keys).agg(
        F.when((F.count(F.lit(1)) > season) & (scale >= BENCHMARK_MASE_FLOOR), mae() / scale).alias("mase")
    )


def crps_ensemble(draws: DataFrame, keys: list[str]) -> DataFrame:
    """CRPS from draws: mean distance to the actual less half the mean distance between draws.

    The pair term comes from the ranks, so the draws are sorted once instead
    of being paired; the draws of a key are sorted range by range.
    """
    n = F.count(F.lit(1))
    ranked = segments.with_rank(draws, keys, "draw")
    spread = 2 * (2 * F.sum(F.col("_rank") * F.col("draw")) - (n + 1) * F.sum("draw")) / (n * n)
    return ranked.groupBy(*keys).agg(
        (F.avg(F.abs(F.col("draw") - F.col("actual"))) - 0.5 * spread).alias("crps")
    )


def join_actuals(nowcasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Nowcasts with the frozen first value of their quarter; pending quarters drop out."""
    first = actuals.select(F.col("quarter").alias("target_quarter"), "metric", F.col("first_value").alias("actual"))
    return nowcasts.join(first, ["target_quarter", "metric"]).withColumnRenamed("value", "pred")


def score_nowcasts(pairs: DataFrame, keys: list[str], order: list[str], minimum: int = 3) -> DataFrame:
    return (
        with_turns(pairs, keys, order)
        .groupBy(*keys)
        .agg(mae().alias("mae"), rmse().alias("rmse"), fda().alias("fda"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= minimum)
    )


def score_by_horizon(pairs: DataFrame, keys: list[str], minimum: int = 2) -> DataFrame:
    horizon = cal.horizon_bucket(F.col("run_date"), F.col("target_quarter"))
    return (
        complete(pairs)
        .groupBy(*keys, horizon.alias("horizon"))
        .agg(mae().alias("mae"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= minimum)
    )


def leaderboard_rollup(pairs: DataFrame) -> DataFrame:
    """MAE, RMSE and count by model, model x horizon, target x model and overall in one pass."""
    rows = complete(pairs).withColumn(
        "horizon", cal.horizon_bucket(F.col("run_date"), F.col("target_quarter"))
    )
    sets = [
        [F.col("model")],
        [F.col("model"), F.col("horizon")],
        [F.col("metric"), F.col("model")],
        [],
    ]
    return rows.groupingSets(sets, "metric", "model", "horizon").agg(
        mae().alias("mae"), rmse().alias("rmse"), F.count(F.lit(1)).alias("n")
    )


def rank_models(scores: DataFrame, target: list[str]) -> DataFrame:
    """Rank by MAE, with flags for the best MAE and the best FDA of each target."""
    by_mae = Window.partitionBy(*target).orderBy("mae")
    best_fda = F.max("fda").over(Window.partitionBy(*target))
    return (
        scores.withColumn("mae_rank", F.rank().over(by_mae))
        .withColumn("best_mae", F.col("mae_rank") == 1)
        .withColumn("best_fda", F.coalesce(F.col("fda") == best_fda, F.lit(False)))
    )
