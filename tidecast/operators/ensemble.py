"""Combining the nowcasts of several models.

A prediction table has (keys..., model, pred); a missing pred is left out.
Rows of one key are the models of one target quarter, so groups stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT_FLOOR = 0.01  # fixed value: keeps weights finite for a perfect model
MIN_HISTORY = 3  # fixed value


def median() -> Column:
    return F.median("pred")


def mean() -> Column:
    return F.avg("pred")


def trimmed() -> Column:
    """Mean without one smallest and one largest prediction; below three the plain mean."""
    n = F.count("pred")
    inner = (F.sum("pred") - F.min("pred") - F.max("pred")) / (n - 2)
    return F.when(n >= 3, inner).otherwise(F.avg("pred"))


def direction_vote() -> Column:
    """Mean of the predictions with the majority sign (ties count as positive)."""
    up, down = F.col("pred") > 0, F.col("pred") < 0
    n_up, n_down = F.count(F.when(up, 1)), F.count(F.when(down, 1))
    voted = F.when(n_up >= n_down, F.avg(F.when(up, F.col("pred")))).otherwise(
        F.avg(F.when(down, F.col("pred")))
    )
    return F.when(F.count("pred") >= 2, F.coalesce(voted, median())).otherwise(median())


def combine(preds: DataFrame, keys: list[str], method: str) -> DataFrame:
    value = {"median": median, "mean": mean, "trimmed": trimmed, "direction_vote": direction_vote}[method]()
    return preds.groupBy(*keys).agg(value.alias("pred"), F.count("pred").alias("n_models"))


def history_weights(history: DataFrame, keys: list[str], order: str, power: str = "mae") -> DataFrame:
    """Weight of each model from its errors in earlier quarters only.

    ``history`` has (keys..., order, model, pred, actual). A model weighs in
    once it has three scored quarters behind it.
    """
    w = (
        Window.partitionBy(*keys, "model").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    err = F.col("actual") - F.col("pred")
    if power == "mae":
        score = F.pow(F.avg(F.abs(err)).over(w), 2)
    else:
        score = F.avg(err * err).over(w)
    return history.withColumn("n_scored", F.count(err).over(w)).withColumn(
        "weight", F.when(F.col("n_scored") >= MIN_HISTORY, 1.0 / (score + WEIGHT_FLOOR))
    )


def weighted() -> Column:
    """Weighted mean over the models that carry a weight, else the median."""
    use = F.col("pred").isNotNull() & F.col("weight").isNotNull()
    total = F.sum(F.when(use, F.col("weight")))
    value = F.sum(F.when(use, F.col("weight") * F.col("pred"))) / total
    return F.coalesce(value, median())


def combine_weighted(history: DataFrame, keys: list[str], order: str, power: str = "mae") -> DataFrame:
    """Inverse squared MAE or inverse MSE weights, one combination per quarter."""
    rows = history_weights(history, keys, order, power)
    return rows.groupBy(*keys, order).agg(weighted().alias("pred"))


def combine_hybrid(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Weighted mean when the weighted models agree in sign, else the direction vote among them."""
    rows = history_weights(history, keys, order, "mae")
    use = F.col("pred").isNotNull() & F.col("weight").isNotNull()
    up = F.count(F.when(use & (F.col("pred") > 0), 1))
    n = F.count(F.when(use, 1))
    p_up = F.avg(F.when(use & (F.col("pred") > 0), F.col("pred")))
    p_down = F.avg(F.when(use & (F.col("pred") < 0), F.col("pred")))
    value = (
        F.when(n == 0, median())
        .when((up == n) | (up == 0), weighted())
        .when(up >= n - up, p_up)
        .otherwise(p_down)
    )
    return rows.groupBy(*keys, order).agg(value.alias("pred"))


def weights_map(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Normalised weights of each quarter as a map model -> weight."""
    rows = history_weights(history, keys, order).filter("weight is not null and pred is not null")
    total = F.sum("weight").over(Window.partitionBy(*keys, order))
    entry = F.struct(F.col("model"), (F.col("weight") / total).alias("w"))
    return rows.withColumn("entry", entry).groupBy(*keys, order).agg(
        F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("weights")
    )
