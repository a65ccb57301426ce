"""Transforms, imputation, outliers, growth and simple forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.catalog import recursions
from tidecast.catalog.registry import query
from tidecast.catalog.scores import HORIZON
from tidecast.functions import calendar as cal
from tidecast.operators import forecasts, impute, metrics, transforms

W = "WINDOW w AS (PARTITION BY entity_id, series_id ORDER BY period)"
LOGS = "(SELECT *, CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-12)) END AS lv FROM dense)"


def logs(t):
    """Log levels on the grid: where interpolation between amounts makes sense."""
    return t.dense.withColumn("value", F.ln("value"))


def _transform(key: str, code: int, expr: str, digits: str = "value") -> None:
    @query(key, f"SELECT entity_id, series_id, period, {expr} AS value FROM {LOGS} {W}", digits)
    def _(t):
        return transforms.transform_series(t.dense, code)


_transform("transform_level", transforms.LEVEL, "value", "value:2")
_transform("transform_mom", transforms.MOM, "lv - lag(lv) OVER w")
_transform("transform_diff", transforms.DIFF, "value - lag(value) OVER w", "value:4")
_transform("transform_qoq_ann", transforms.QOQ_ANN, "3 * (lv - lag(lv) OVER w)")
_transform("transform_yoy", transforms.YOY, "lv - lag(lv, 12) OVER w")


@query("transform_panel", "SELECT entity_id, series_id, period, value FROM trans", "value:4")
def _(t):
    return t.trans


@query("standardize", "SELECT entity_id, series_id, period, value FROM scaled", "value")
def _(t):
    return t.scaled


# standardising undone gives the transformed panel back, in percent
@query("destandardize", "SELECT entity_id, series_id, period, 100 * value AS value FROM trans", "value:2")
def _(t):
    return transforms.destandardize(transforms.standardize(t.trans), 100.0).drop("mu", "sigma")


@query("growth_simple", f"""
    SELECT entity_id, series_id, period, (value - prev) / prev AS value FROM (SELECT *, lag(value) OVER w AS prev FROM panel {W}) WHERE prev > 0""", "value")
def _(t):
    return transforms.growth_simple(t.panel)


@query("growth_dlog_rows", f"""
    SELECT entity_id, series_id, period, ln(value) - ln(prev) AS value FROM (SELECT *, lag(value) OVER w AS prev FROM panel {W}) WHERE prev > 0 AND value > 0""", "value")
def _(t):
    return transforms.growth_dlog_rows(t.panel)


@query("lag_features", f"SELECT entity_id, series_id, period, value, lag(value, 3) OVER w AS lag3, lag(value, 6) OVER w AS lag6 FROM panel {W}")
def _(t):
    return transforms.lag_features(t.panel)


@query("forward_fill", f"SELECT entity_id, series_id, period, last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM dense {W}")
def _(t):
    return impute.forward_fill(t.dense)


@query("backfill_leading", f"""
    SELECT entity_id, series_id, period, CASE WHEN last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NULL
      THEN first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE value END AS value FROM dense {W}""")
def _(t):
    return impute.backfill_leading(t.dense)


NEAR = f"""
    WITH a AS (SELECT *, row_number() OVER w AS t FROM logdense {W}),
    b AS (SELECT *, CASE WHEN value IS NOT NULL THEN t END AS vt FROM a),
    n AS (SELECT entity_id, series_id, period, value, t,
      count(value) OVER (PARTITION BY entity_id, series_id) AS nv,
      last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
      last_value(vt IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
      first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
      first_value(vt IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM b {W})"""
BETWEEN = "CASE WHEN value IS NOT NULL THEN value ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END"


@query("impute_linear", f"{NEAR} SELECT entity_id, series_id, period, CASE WHEN nv >= 2 THEN coalesce({BETWEEN}, v0, v1) ELSE value END AS value FROM n", "value")
def _(t):
    return impute.impute_linear(logs(t))


@query("impute_linear_no_leak", f"{NEAR} SELECT entity_id, series_id, period, CASE WHEN nv >= 2 THEN {BETWEEN} ELSE value END AS value FROM n", "value")
def _(t):
    return impute.impute_linear_no_leak(logs(t))


@query("impute_block", f"""{NEAR},
    k AS (SELECT entity_id, series_id, t, value, row_number() OVER (PARTITION BY entity_id, series_id ORDER BY t) AS i FROM n WHERE value IS NOT NULL),
    f AS (SELECT a.entity_id, a.series_id, a.t AS ft, a.value AS fv, b.t AS st, b.value AS sv FROM k a JOIN k b ON a.entity_id = b.entity_id AND a.series_id = b.series_id AND a.i = 1 AND b.i = 2)
    SELECT n.entity_id, n.series_id, n.period, CASE WHEN nv < 2 THEN v0 WHEN t0 IS NULL THEN fv + (t - ft) * (sv - fv) / (st - ft) ELSE coalesce({BETWEEN}, v0) END AS value
    FROM n LEFT JOIN f ON n.entity_id = f.entity_id AND n.series_id = f.series_id""", "value")
def _(t):
    return impute.impute_block(logs(t))


@query("impute_spline", f"WITH RECURSIVE {recursions.spline('logdense')} SELECT entity_id, series_id, period, value FROM filled", "value")
def _(t):
    return impute.impute_spline(logs(t))


MAD = """
    SELECT entity_id, series_id, period, {out} FROM (SELECT *, 1.4826 * median(abs(value - med)) OVER s AS mad, count(value) OVER s AS nv
      FROM (SELECT *, median(value) OVER s AS med FROM trans WINDOW s AS (PARTITION BY entity_id, series_id)) WINDOW s AS (PARTITION BY entity_id, series_id))"""
HIT = "coalesce(nv >= 5 AND mad >= 1e-12 AND abs(value - med) > 1.5 * mad, FALSE)"


@query("outlier_mad", MAD.format(out=f"value, {HIT} AS is_outlier"), "value:4")
def _(t):
    return impute.outlier_mad(t.trans, 1.5, replace=False)


@query("mask_period", "SELECT entity_id, series_id, period, CASE WHEN period NOT BETWEEN DATE '1998-02-01' AND DATE '1998-09-01' THEN value END AS value FROM dense")
def _(t):
    return impute.mask_period(t.dense, "1998-02-01", "1998-09-01")


@query("correct_shock", MAD.format(out=f"CASE WHEN NOT {HIT} THEN value END AS value"), "value:4")
def _(t):
    return impute.correct_shock(t.trans, 3, 1.5)


@query("event_dummies", """
    SELECT entity_id, CAST(quarter + INTERVAL 2 MONTH AS DATE) AS period, CAST(quarter = DATE '1998-04-01' AS INTEGER) AS d1, CAST(quarter = DATE '1998-07-01' AS INTEGER) AS d2 FROM target""")
def _(t):
    months = t.target.select("entity_id", cal.quarter_end_month(F.col("quarter")).alias("period"))
    ends = impute.event_dummies(months.select("period").distinct(), ("1998-06-01", "1998-09-01"))
    return months.join(ends, "period")


@query("expanding_ar1", "SELECT entity_id, quarter, pred FROM preds WHERE model = 'ar1'", "pred")
def _(t):
    return forecasts.expanding_ar1(t.growth, ["entity_id"], start=6).select("entity_id", "quarter", "pred")


@query("naive_persistence", """
    SELECT entity_id, series_id, period, last_value(value IGNORE NULLS) OVER (PARTITION BY entity_id, series_id ORDER BY period
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pred FROM dense""")
def _(t):
    return forecasts.naive_persistence(t.dense, ["entity_id", "series_id"], "period").drop("value")


@query("ar1_forecast", """
    SELECT entity_id, regr_slope(value, lv) AS slope, regr_intercept(value, lv) AS intercept, count(lv) AS n_pairs, arg_max(value, quarter) AS last_value,
           regr_intercept(value, lv) + regr_slope(value, lv) * arg_max(value, quarter) AS pred
    FROM (SELECT *, lag(value) OVER (PARTITION BY entity_id ORDER BY quarter) AS lv FROM growth) GROUP BY 1 HAVING count(lv) >= 4""", "slope intercept last_value pred")
def _(t):
    return forecasts.ar1_forecast(t.growth, ["entity_id"])


@query("rank_models", f"""
    WITH h AS (SELECT *, {HORIZON} AS horizon FROM pairs WHERE pred IS NOT NULL AND actual IS NOT NULL),
    d AS (SELECT *, sign(actual - lag(actual) OVER w) AS da, sign(pred - lag(pred) OVER w) AS dp FROM h WINDOW w AS (PARTITION BY metric, horizon, model ORDER BY target_quarter, run_date)),
    s AS (SELECT metric, horizon, model, round(avg(abs(actual - pred)), 6) AS mae, avg(CASE WHEN da <> 0 THEN CAST(da = dp AS INTEGER) END) AS fda FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 3)
    SELECT metric, horizon, model, mae, fda, CAST(rank() OVER (PARTITION BY metric, horizon ORDER BY mae) AS INTEGER) AS mae_rank,
           rank() OVER (PARTITION BY metric, horizon ORDER BY mae) = 1 AS best_mae, coalesce(fda = max(fda) OVER (PARTITION BY metric, horizon), FALSE) AS best_fda FROM s""", "mae fda")
def _(t):
    target = ["metric", "horizon"]
    pairs = t.pairs.withColumn("horizon", cal.horizon_bucket(F.col("run_date"), F.col("target_quarter")))
    scores = metrics.score_nowcasts(pairs, [*target, "model"], ["target_quarter", "run_date"]).withColumn("mae", F.round("mae", 6))
    return metrics.rank_models(scores.drop("rmse", "n"), target)


@query("growth_to_level", """
    SELECT entity_id, quarter, 100 * exp(sum(ln(1 + value / 100 / 4)) OVER (PARTITION BY entity_id ORDER BY quarter)) AS level FROM growth""", "level")
def _(t):
    fraction = t.growth.withColumn("value", F.col("value") / 100)
    return transforms.growth_to_level(fraction, F.lit(100.0), ["entity_id"], "quarter").drop("value")


@query("level_path", """
    WITH b AS (SELECT p.entity_id, p.model, p.quarter, p.pred / 100 AS g, CASE WHEN p.quarter < DATE '2000-07-01' THEN t.value END AS actual
               FROM preds p JOIN target t ON t.entity_id = p.entity_id AND t.quarter = p.quarter WHERE pred IS NOT NULL),
    l AS (SELECT entity_id, model, arg_max(actual, quarter) AS base FROM b WHERE actual IS NOT NULL GROUP BY 1, 2)
    SELECT b.entity_id, b.model, b.quarter, coalesce(b.actual, base * exp(sum(CASE WHEN actual IS NULL THEN ln(1 + g) ELSE 0 END) OVER (PARTITION BY b.entity_id, b.model ORDER BY b.quarter))) AS level,
           CASE WHEN actual IS NOT NULL THEN 'actual' WHEN b.quarter = DATE '2000-07-01' THEN 'nowcast' ELSE 'forecast' END AS status
    FROM b JOIN l ON l.entity_id = b.entity_id AND l.model = b.model""", "level:4")
def _(t):
    rows = t.preds.filter("pred is not null").join(t.target, ["entity_id", "quarter"])
    known = F.when(F.col("quarter") < F.lit("2000-07-01").cast("date"), F.col("value"))
    path = rows.select("entity_id", "model", "quarter", known.alias("actual"), (F.col("pred") / 100).alias("growth"))
    return transforms.level_path(path, ["entity_id", "model"]).select("entity_id", "model", "quarter", "level", "status")
