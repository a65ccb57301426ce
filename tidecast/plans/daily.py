"""The daily job: log, frozen actuals, scores and the tables behind a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import metrics, vintage
from tidecast.plans import nowcast
from tidecast.session import cut
from tidecast.sources import versioned


def upsert_log(log: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Append rows and keep one per key: the row loaded last wins, columns may differ."""
    both = log.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    last = F.max_by(F.struct(*rest), order).alias("row")
    return both.groupBy(*keys).agg(last).select(*keys, "row.*")


def backfill_log(log: DataFrame, targets: list[str]) -> DataFrame:
    """Fill missing target quarters; old ``x_yoy`` becomes ``x`` and old ``x`` becomes ``x_qoq``."""
    out = log.withColumn(
        "target_quarter", cal.resolve_target_quarter(F.col("target_quarter"), F.col("run_date"))
    )
    for x in targets:
        if f"{x}_yoy" in log.columns:
            out = out.withColumnRenamed(x, f"{x}_qoq").withColumnRenamed(f"{x}_yoy", x)
    return out


def extract(log: DataFrame, keys: list[str]) -> DataFrame:
    """Backcast, nowcast and forecast of every run: the previous, current and next quarter."""
    def of(months: int, name: str):
        label = cal.quarter_label(F.add_months("run_date", months))
        return F.max(F.when(F.col("target_quarter") == label, F.col("value"))).alias(name)

    return log.groupBy(*keys, "run_date").agg(of(0, "nowcast"), of(3, "forecast"), of(-3, "backcast"))


def backcast_error(log: DataFrame, actuals: DataFrame) -> DataFrame:
    """Last estimate of the latest published quarter against its actual."""
    last = actuals.filter("first_value is not null").groupBy("metric").agg(
        F.max("quarter").alias("target_quarter"), F.max_by("first_value", "quarter").alias("actual")
    )
    estimate = log.filter("value is not null").groupBy("metric", "model", "target_quarter").agg(
        F.max_by("value", "run_date").alias("estimate")
    )
    return estimate.join(last, ["metric", "target_quarter"]).withColumn(
        "error", F.abs(F.col("estimate") - F.col("actual"))
    )


def dashboard_feed(log: DataFrame, actuals: DataFrame, n: int = 30) -> DataFrame:
    """Gold rows by section: latest actuals, current nowcasts, backcast errors, recent nowcasts."""
    cols = ["section", "metric", "model", "quarter", "run_date", "value", "actual"]
    none_date, none = F.lit(None).cast("date"), F.lit(None).cast("double")
    latest = vintage.latest_published_quarter(actuals).join(actuals, ["metric", "quarter"]).select(
        F.lit("latest_actual").alias("section"), "metric", F.lit(None).cast("string").alias("model"), "quarter",
        none_date.alias("run_date"), none.alias("value"), F.col("first_value").alias("actual"),
    )
    known = log.filter("value is not null")
    current = known.groupBy("metric", "model").agg(
        F.max_by(F.struct("target_quarter", "run_date", "value"), F.struct("run_date", "target_quarter")).alias("r")
    ).select(
        F.lit("current_nowcast").alias("section"), "metric", "model", F.col("r.target_quarter").alias("quarter"),
        F.col("r.run_date").alias("run_date"), F.col("r.value").alias("value"), none.alias("actual"),
    )
    backcast = backcast_error(log, actuals).select(
        F.lit("backcast").alias("section"), "metric", "model", F.col("target_quarter").alias("quarter"),
        none_date.alias("run_date"), F.col("estimate").alias("value"), "actual",
    )
    first = actuals.select(F.col("quarter").alias("target_quarter"), "metric", F.col("first_value").alias("actual"))
    w = Window.partitionBy("metric").orderBy(F.desc("run_date"), "model", "target_quarter")
    recent = (
        known.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
        .join(first, ["target_quarter", "metric"], "left")
        .select(F.lit("recent").alias("section"), "metric", "model", F.col("target_quarter").alias("quarter"), "run_date", "value", "actual")
    )
    out = latest
    for part in (current, backcast, recent):
        out = out.unionByName(part)
    return out.select(*cols)


LOG = "run_date date, target_quarter string, metric string, model string, value double"
ACTUALS = (
    "quarter string, metric string, first_release_date date, first_value double, latest_value double, "
    "last_update_date date, base_year int"
)


def day_tables(log: DataFrame, fresh: DataFrame, state: DataFrame, feed: DataFrame) -> dict[str, DataFrame]:
    """New log, new frozen actuals, scores and the dashboard's rows, from the old ones and what came in.

    A row of ``fresh`` replaces the row of the log for the same run, quarter, metric and model.
    """
    keys = ["run_date", "entity_id", "target_quarter", "metric", "model"]
    keys = [k for k in keys if k in log.columns]
    stamped = log.withColumn("loaded", F.lit(0)).unionByName(fresh.withColumn("loaded", F.lit(1)))
    new_log = stamped.groupBy(*keys).agg(F.max_by("value", "loaded").alias("value"))
    actuals = vintage.merge_actuals(state, feed)
    return {"log": new_log, "actuals": actuals, **derived_tables(new_log, actuals)}


def derived_tables(log: DataFrame, actuals: DataFrame) -> dict[str, DataFrame]:
    """What follows from the log and the actuals alone."""
    return {
        "scores": metrics.leaderboard_rollup(metrics.join_actuals(log, actuals)),
        "dashboard": dashboard_feed(log, actuals),
    }


def log_rows(nowcasts: DataFrame, run_date: Column, metric: Column) -> DataFrame:
    """Rows of ``nowcast.run_nowcast`` as rows of the log; a model without a value has none."""
    return nowcasts.filter("pred is not null").select(
        run_date.alias("run_date"), F.col("quarter").alias("target_quarter"), metric.alias("metric"), "model",
        F.col("pred").alias("value"),
    )


def run_daily(
    spark: SparkSession, root: str, systems: DataFrame, order: list[str], keys: list[str], feed: DataFrame, *,
    run_date: Column, metric: Column, keep: int = 2, **options,
) -> int:
    """One run of the whole job on a store: nowcast, frozen actuals, log, scores and dashboard, published together.

    ``systems`` has one dense system per key as known at the run (``run_date`` may be one of the keys, so that missed days
    are caught up in one run); ``feed`` has the releases seen since the last run; ``options`` go to ``run_nowcast``. The
    log and the actuals of the store's last version are carried on, and a run that is repeated replaces its own rows. The
    new log and actuals are written once and the tables that follow from them are computed from the written rows. Returns
    the version; readers see all four tables of it or all four of the one before.
    """
    before = versioned.manifest(spark, root)
    was = max((r.version for r in before.values()), default=0)

    def old(name: str, columns: str) -> DataFrame:
        return versioned.open_table(spark, root, before[name]) if name in before else spark.createDataFrame([], columns)

    fresh = log_rows(nowcast.run_nowcast(systems, order, keys, **options), run_date, metric)
    tables = day_tables(old("log", LOG), fresh, old("actuals", ACTUALS), feed)
    log, actuals = cut(tables["log"], "log"), cut(tables["actuals"], "actuals")
    return versioned.publish(
        spark, root, {"log": log, "actuals": actuals, **derived_tables(log, actuals)}, based_on=was, keep=keep
    )
