"""Tables of model quality: leaderboards, comparisons with an official estimate, hyper-parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.numeric import safe_corr
from tidecast.operators import metrics, stats

MIN_MODELS = 2  # fixed value: predictions that make an ensemble
ADVANCE = "advance"


def with_ensemble(preds: DataFrame, by: list[str], name: str = "ensemble") -> DataFrame:
    """Predictions beside the mean of the models of each ``by`` that has at least two of them."""
    mean = preds.groupBy(*by).agg(
        F.avg("pred").alias("pred"), F.first("actual").alias("actual"), F.count("pred").alias("n")
    ).filter(F.col("n") >= MIN_MODELS).drop("n").withColumn("model", F.lit(name))
    return preds.filter("pred is not null").unionByName(mean)


def leaderboard(pairs: DataFrame, target: list[str], order: list[str], counted: Column | None = None, segment: Column | None = None) -> DataFrame:
    """MAE, direction accuracy, count and MAE rank of every model of each target.

    ``mae_ex`` leaves out the rows for which ``counted`` does not hold. ``segment`` cuts a crowded (target, model) along
    ``order``, see ``segments``. The rank is worked out on the board, not on the pairs.
    """
    turns = metrics.with_turns(pairs, [*target, "model"], order, segment)
    error = F.abs(F.col("actual") - F.col("pred"))
    board = turns.groupBy(*target, "model").agg(
        metrics.mae().alias("mae"), metrics.fda().alias("fda"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(counted if counted is not None else F.lit(True), error)).alias("mae_ex"),
    )
    return board.withColumn("mae_rank", F.rank().over(Window.partitionBy(*target).orderBy(F.round("mae", 9))))


def component_leaderboard(pairs: DataFrame, component: str = "component") -> DataFrame:
    """MAE and count of every model on every component, models by their upper-case names."""
    named = metrics.complete(pairs).withColumn("model", F.upper("model"))
    return named.groupBy(component, "model").agg(metrics.mae().alias("mae"), F.count(F.lit(1)).alias("n"))


def model_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of predictions and actuals, largest and mean absolute error."""
    err = F.abs(F.col("actual") - F.col("pred"))
    return metrics.complete(pairs).groupBy(*keys).agg(
        safe_corr("actual", "pred").alias("corr"), F.max(err).alias("max_error"), F.avg(err).alias("mean_error")
    )


def advance_errors(feed: DataFrame, actuals: DataFrame) -> DataFrame:
    """The first release of every quarter against its latest value."""
    latest = actuals.select("quarter", "metric", F.col("first_release_date").alias("seen_date"), F.col("latest_value").alias("actual"))
    return feed.join(latest, ["quarter", "metric", "seen_date"]).select(
        "quarter", "metric", F.col("value").alias("advance"), "actual", (F.col("value") - F.col("actual")).alias("error")
    )


def benchmark_compare(preds: DataFrame, advance: DataFrame, target: str) -> DataFrame:
    """Best of the models and the official advance estimate for every target, by MAE to six digits.

    ``preds`` has (target, model, pred, actual), ``advance`` comes from ``advance_errors``.
    """
    scores = preds.groupBy(target, "model").agg(F.round(metrics.mae(), 6).alias("mae"))
    official = advance.groupBy(F.col("metric").alias(target), F.lit(ADVANCE).alias("model")).agg(F.round(F.avg(F.abs("error")), 6).alias("mae"))
    return scores.unionByName(official).groupBy(target).agg(
        F.min_by("model", "mae").alias("winner"), F.min("mae").alias("mae"),
        F.max(F.when(F.col("model") == ADVANCE, F.col("mae"))).alias("advance_mae"),
    )


def grid_search_score(forecasts: DataFrame, actuals: DataFrame, on: list[str], spec: list[str] = ("n_factors", "n_lags")) -> DataFrame:
    """MAE, sign accuracy and count of every specification, with the best MAE marked.

    ``forecasts`` has (on..., spec..., value), ``actuals`` (on..., actual).
    """
    spec = list(spec)
    pairs = metrics.complete(forecasts.withColumnRenamed("value", "pred").join(actuals, on))
    scores = pairs.groupBy(*spec).agg(
        metrics.mae().alias("mae"), metrics.sign_accuracy().alias("sign_accuracy"), F.count(F.lit(1)).alias("n")
    )
    # one row per specification of the grid
    best = F.row_number().over(Window.orderBy("mae", *spec)) == 1
    return scores.withColumn("best", best)


def consensus_yoy(levels: DataFrame, keys: list[str], unit: str, comparable: list[str]) -> DataFrame:
    """Growth over the year that forecast levels imply; levels in a unit that the history is not in are left out."""
    return stats.level_yoy(levels.filter(F.col(unit).isin(comparable)), keys).select(*keys, "quarter", "yoy")
