"""Ensembles, metrics, leaderboards, bands and variable selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast.catalog.registry import query
from tidecast.functions import calendar as cal
from tidecast.functions import numeric as num
from tidecast.operators import bands, boards, ensemble, forecasts, metrics, selection, transforms
from tidecast.plans import daily

EQ = ["entity_id", "quarter"]


# --- ensembles ------------------------------------------------------------------------------


def _combine(key: str, method: str, expr: str) -> None:
    @query(key, f"SELECT entity_id, quarter, {expr} AS pred, count(pred) AS n_models FROM preds GROUP BY 1, 2", "pred")
    def _(t):
        return ensemble.combine(t.preds, EQ, method)


VOTE = """CASE WHEN count(pred) < 2 THEN median(pred) WHEN count(CASE WHEN pred > 0 THEN 1 END) >= count(CASE WHEN pred < 0 THEN 1 END)
    THEN coalesce(avg(CASE WHEN pred > 0 THEN pred END), median(pred)) ELSE coalesce(avg(CASE WHEN pred < 0 THEN pred END), median(pred)) END"""
_combine("ensemble_median", "median", "median(pred)")
_combine("ensemble_mean", "mean", "avg(pred)")
_combine("ensemble_trimmed", "trimmed", "CASE WHEN count(pred) >= 3 THEN (sum(pred) - min(pred) - max(pred)) / (count(pred) - 2) ELSE avg(pred) END")
_combine("ensemble_direction_vote", "direction_vote", VOTE)

HIST = """
    WITH h AS (SELECT *, count(actual - pred) OVER w AS ns, avg(abs(actual - pred)) OVER w AS m, avg((actual - pred) ** 2) OVER w AS m2 FROM preds
               WINDOW w AS (PARTITION BY entity_id, model ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT entity_id, quarter, model, pred, actual, ns AS n_scored, CASE WHEN ns >= 3 THEN 1.0 / ({score} + 0.01) END AS weight FROM h)"""
WMEAN = "sum(CASE WHEN pred IS NOT NULL THEN weight * pred END) / sum(CASE WHEN pred IS NOT NULL THEN weight END)"
BY_MAE, BY_MSE = HIST.format(score="m * m"), HIST.format(score="m2")


@query("ensemble_inverse_mae", f"{BY_MAE} SELECT entity_id, quarter, coalesce({WMEAN}, median(pred)) AS pred FROM k GROUP BY 1, 2", "pred")
def _(t):
    return ensemble.combine_weighted(t.preds, ["entity_id"], "quarter", "mae")


@query("ensemble_inverse_mse", f"{BY_MSE} SELECT entity_id, quarter, coalesce({WMEAN}, median(pred)) AS pred FROM k GROUP BY 1, 2", "pred")
def _(t):
    return ensemble.combine_weighted(t.preds, ["entity_id"], "quarter", "mse")


@query("ensemble_hybrid", f"""{BY_MAE},
    c AS (SELECT entity_id, quarter, median(pred) AS med, {WMEAN} AS wm, count(CASE WHEN pred > 0 AND weight > 0 THEN 1 END) AS up, count(CASE WHEN pred IS NOT NULL AND weight > 0 THEN 1 END) AS n,
          avg(CASE WHEN pred > 0 AND weight > 0 THEN pred END) AS pu, avg(CASE WHEN pred < 0 AND weight > 0 THEN pred END) AS pd FROM k GROUP BY 1, 2)
    SELECT entity_id, quarter, CASE WHEN n = 0 THEN med WHEN up = n OR up = 0 THEN wm WHEN up >= n - up THEN pu ELSE pd END AS pred FROM c""", "pred")
def _(t):
    return ensemble.combine_hybrid(t.preds, ["entity_id"], "quarter")


@query("ensemble_history", f"{BY_MAE} SELECT entity_id, quarter, model, pred, actual, n_scored, weight FROM k", "pred actual weight")
def _(t):
    return ensemble.history_weights(t.preds, ["entity_id"], "quarter")


@query("ensemble_weights", f"""{BY_MAE}
    SELECT entity_id, quarter, model, weight / sum(weight) OVER (PARTITION BY entity_id, quarter) AS weight FROM k WHERE weight IS NOT NULL AND pred IS NOT NULL""", "weight")
def _(t):
    maps = ensemble.weights_map(t.preds, ["entity_id"], "quarter")
    return maps.select("entity_id", "quarter", F.explode("weights").alias("model", "weight"))


# --- metrics --------------------------------------------------------------------------------

OK = "(SELECT * FROM pairs WHERE pred IS NOT NULL AND actual IS NOT NULL)"


def _metric(key: str, column, expr: str) -> None:
    @query(key, f"SELECT metric, model, {expr} AS score, count(*) AS n FROM {OK} GROUP BY 1, 2", "score")
    def _(t):
        return metrics.complete(t.pairs).groupBy("metric", "model").agg(column().alias("score"), F.count(F.lit(1)).alias("n"))


_metric("metric_mae", metrics.mae, "avg(abs(actual - pred))")
_metric("metric_rmse", metrics.rmse, "sqrt(avg((actual - pred) ** 2))")
_metric("metric_bias", metrics.bias, "avg(pred - actual)")
_metric("sign_accuracy", metrics.sign_accuracy, "avg(CAST(sign(actual) = sign(pred) AS INTEGER))")


@query("metric_corr", f"SELECT metric, model, corr(actual, pred) AS corr, max(abs(actual - pred)) AS max_error, avg(abs(actual - pred)) AS mean_error FROM {OK} GROUP BY 1, 2", "corr max_error mean_error")
def _(t):
    return boards.model_fit(t.pairs, ["metric", "model"])


TURNS = f"""(SELECT *, CASE WHEN sign(actual - lag(actual) OVER w) <> 0 THEN CAST(sign(actual - lag(actual) OVER w) = sign(pred - lag(pred) OVER w) AS INTEGER) END AS hit
    FROM {OK} WINDOW w AS (PARTITION BY metric, model ORDER BY target_quarter, run_date))"""
ORDER = ["target_quarter", "run_date"]


@query("metric_fda", f"SELECT metric, model, avg(hit) AS score FROM {TURNS} GROUP BY 1, 2", "score")
def _(t):
    turns = metrics.with_turns(t.pairs, ["metric", "model"], ORDER)
    return turns.groupBy("metric", "model").agg(metrics.fda().alias("score"))


@query("metric_mase", f"""
    SELECT entity_id, model, avg(abs(actual - pred)) / avg(ne) AS mase FROM (SELECT *, abs(actual - lag(actual, 4) OVER (PARTITION BY entity_id, model ORDER BY quarter)) AS ne
      FROM preds WHERE pred IS NOT NULL) GROUP BY 1, 2""", "mase")
def _(t):
    return metrics.mase(t.preds, ["entity_id", "model"], ["quarter"], 4, segment=F.year("quarter"))


@query("metric_coverage", f"SELECT metric, model, avg(CAST(actual BETWEEN pred - 10 AND pred + 10 AS INTEGER)) AS coverage FROM {OK} GROUP BY 1, 2", "coverage")
def _(t):
    band = metrics.complete(t.pairs).withColumn("lower", F.col("pred") - 10).withColumn("upper", F.col("pred") + 10)
    return band.groupBy("metric", "model").agg(metrics.coverage().alias("coverage"))


@query("metric_crps_ensemble", f"""
    WITH d AS (SELECT metric, target_quarter, actual, pred AS draw FROM {OK})
    SELECT a.metric, a.target_quarter, a.e - 0.5 * b.s AS crps FROM (SELECT metric, target_quarter, avg(abs(draw - actual)) AS e FROM d GROUP BY 1, 2) a
    JOIN (SELECT x.metric, x.target_quarter, avg(abs(x.draw - y.draw)) AS s FROM d x JOIN d y ON x.metric = y.metric AND x.target_quarter = y.target_quarter GROUP BY 1, 2) b
    ON a.metric = b.metric AND a.target_quarter = b.target_quarter""", "crps")
def _(t):
    draws = metrics.complete(t.pairs).withColumnRenamed("pred", "draw")
    return metrics.crps_ensemble(draws, ["metric", "target_quarter"])


# the normal distribution function by its power series, the double factorials from lgamma
SERIES_TERMS = "list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-12)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
BELOW = f"CASE WHEN abs(z) > 9 THEN CAST(z > 0 AS INTEGER) ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * {SERIES_TERMS} END"


@query("metric_crps_normal", f"""
    WITH s AS (SELECT metric, model, actual, pred, greatest(stddev_pop(pred - actual) OVER (PARTITION BY metric, model), 1e-6) AS sd FROM {OK}),
    z AS (SELECT *, (actual - pred) / sd AS z FROM s), c AS (SELECT *, {BELOW} AS below FROM z)
    SELECT metric, model, avg(sd * (z * (2 * below - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps
    FROM c GROUP BY 1, 2""", "crps")
def _(t):
    pairs, keys = metrics.complete(t.pairs), ["metric", "model"]
    gap = F.stddev_pop(F.col("pred") - F.col("actual"))
    sd = pairs.groupBy(*keys).agg(F.greatest(gap, F.lit(1e-6)).alias("sd"))
    scored = pairs.join(sd, keys).withColumn("crps", num.crps_normal("actual", "pred", "sd"))
    return scored.groupBy(*keys).agg(F.avg("crps").alias("crps"))


@query("score_nowcasts", f"SELECT metric, model, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) ** 2)) AS rmse, avg(hit) AS fda, count(*) AS n FROM {TURNS} GROUP BY 1, 2 HAVING count(*) >= 3", "mae rmse fda")
def _(t):
    return metrics.score_nowcasts(t.pairs, ["metric", "model"], ORDER)


GAP = "(year(run_date) * 12 + month(run_date)) - (CAST(substr(target_quarter, 1, 4) AS INTEGER) * 12 + CAST(right(target_quarter, 1) AS INTEGER) * 3 - 2)"
HORIZON = f"CASE WHEN {GAP} < 0 THEN 'forecast' WHEN {GAP} <= 2 THEN 'm' || ({GAP} + 1) ELSE 'backcast' END"


@query("score_by_horizon", f"SELECT metric, model, {HORIZON} AS horizon, avg(abs(actual - pred)) AS mae, count(*) AS n FROM {OK} GROUP BY 1, 2, 3 HAVING count(*) >= 2", "mae")
def _(t):
    return metrics.score_by_horizon(t.pairs, ["metric", "model"])


LB = """SELECT entity_id, quarter, model, pred, actual FROM preds WHERE pred IS NOT NULL
    UNION ALL SELECT entity_id, quarter, 'ensemble', avg(pred), any_value(actual) FROM preds GROUP BY 1, 2 HAVING count(pred) >= 2"""


@query("leaderboard", f"""
    WITH l AS ({LB}), s AS (SELECT entity_id, model, quarter < DATE '1999-01-01' AS early, actual, pred, CASE WHEN sign(actual - lag(actual) OVER w) <> 0 THEN CAST(sign(actual - lag(actual) OVER w) = sign(pred - lag(pred) OVER w) AS INTEGER) END AS hit
      FROM l WINDOW w AS (PARTITION BY entity_id, model ORDER BY quarter)),
    f AS (SELECT entity_id, model, avg(abs(actual - pred)) AS mae, avg(hit) AS fda, count(*) AS n, avg(CASE WHEN NOT early THEN abs(actual - pred) END) AS mae_ex FROM s GROUP BY 1, 2)
    SELECT *, CAST(rank() OVER (PARTITION BY entity_id ORDER BY round(mae, 9)) AS INTEGER) AS mae_rank FROM f""", "mae fda mae_ex")
def _(t):
    late = F.col("quarter") >= F.lit("1999-01-01").cast("date")
    return boards.leaderboard(boards.with_ensemble(t.preds, EQ), ["entity_id"], ["quarter"], late, F.year("quarter"))


CG = """
    WITH v AS (SELECT entity_id, component, quarter, value AS now, lag(value) OVER (PARTITION BY entity_id, component ORDER BY quarter) AS was FROM components WHERE value IS NOT NULL),
    g AS (SELECT entity_id, component, quarter, 100 * (ln(now) - ln(was)) AS value FROM v WHERE now > 0 AND was > 0),
    l AS (SELECT *, lag(value) OVER w AS lv, avg(value) OVER (PARTITION BY entity_id, component ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean, row_number() OVER w AS rn FROM g WINDOW w AS (PARTITION BY entity_id, component ORDER BY quarter)),
    r AS (SELECT *, regr_slope(value, lv) OVER w AS b, regr_intercept(value, lv) OVER w AS a, count(lv) OVER w AS n FROM l WINDOW w AS (PARTITION BY entity_id, component ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT entity_id, component, quarter, value, unnest(['NAIVE', 'MEAN', 'AR1']) AS model, unnest([lv, mean, CASE WHEN rn > 6 AND n >= 4 THEN a + b * lv END]) AS pred FROM r)"""


@query("component_leaderboard", f"{CG} SELECT component, model, avg(abs(value - pred)) AS mae, count(*) AS n FROM p WHERE pred IS NOT NULL GROUP BY 1, 2", "mae")
def _(t):
    keys = ["entity_id", "component"]
    change = transforms.growth_dlog_rows(t.components.withColumnRenamed("quarter", "period"), keys)
    growth = change.withColumnRenamed("period", "quarter").withColumn("value", 100 * F.col("value"))
    made = {
        "naive": forecasts.naive_persistence(growth, keys), "mean": forecasts.expanding_mean(growth, keys),
        "ar1": forecasts.expanding_ar1(growth, keys, start=6),
    }
    parts = [df.select(*keys, "quarter", F.lit(m).alias("model"), "pred", F.col("value").alias("actual")) for m, df in made.items()]
    return boards.component_leaderboard(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("benchmark_compare", f"""
    WITH l AS ({LB}), m AS (SELECT entity_id, model, round(avg(abs(actual - pred)), 6) AS mae FROM l GROUP BY 1, 2
      UNION ALL SELECT f.metric, 'advance', round(avg(abs(f.value - a.latest_value)), 6) FROM feed f JOIN actuals a ON a.quarter = f.quarter AND a.metric = f.metric AND a.first_release_date = f.seen_date GROUP BY 1)
    SELECT entity_id, arg_min(model, mae) AS winner, min(mae) AS mae, max(CASE WHEN model = 'advance' THEN mae END) AS advance_mae FROM m GROUP BY 1""", "mae advance_mae")
def _(t):
    return boards.benchmark_compare(boards.with_ensemble(t.preds, EQ), boards.advance_errors(t.feed, t.actuals), "entity_id")


@query("backcast_error", """
    SELECT e.metric, e.target_quarter, e.model, e.estimate, a.first_value AS actual, abs(e.estimate - a.first_value) AS error
    FROM (SELECT metric, model, target_quarter, arg_max(value, run_date) AS estimate FROM nowcasts WHERE value IS NOT NULL GROUP BY 1, 2, 3) e
    JOIN (SELECT metric, max(quarter) AS quarter, arg_max(first_value, quarter) AS first_value FROM actuals GROUP BY 1) a ON a.metric = e.metric AND a.quarter = e.target_quarter""", "estimate error")
def _(t):
    return daily.backcast_error(t.nowcasts, t.actuals)


@query("consensus_yoy", """
    SELECT a.entity_id, a.component, a.quarter, (a.value / b.value - 1) * 100 AS yoy FROM components a JOIN components b ON a.entity_id = b.entity_id AND a.component = b.component
    AND a.quarter = CAST(b.quarter + INTERVAL 12 MONTH AS DATE) WHERE b.value > 0 AND a.component <> 'R'""", "yoy")
def _(t):
    unit = F.when(F.col("component") == "R", "USD").otherwise("MYR")
    return boards.consensus_yoy(t.components.withColumn("unit", unit), ["entity_id", "component"], "unit", ["MYR"])


@query("dashboard_feed", """
    SELECT 'latest_actual' AS section, metric, NULL AS model, max(quarter) AS quarter, CAST(NULL AS DATE) AS run_date, CAST(NULL AS DOUBLE) AS value, arg_max(first_value, quarter) AS actual FROM actuals GROUP BY 2
    UNION ALL SELECT 'current_nowcast', metric, model, arg_max(target_quarter, k), max(run_date), arg_max(value, k), NULL FROM (SELECT *, CAST(run_date AS VARCHAR) || target_quarter AS k FROM nowcasts WHERE value IS NOT NULL) GROUP BY 2, 3
    UNION ALL SELECT 'backcast', e.metric, e.model, e.target_quarter, NULL, e.estimate, a.first_value
    FROM (SELECT metric, model, target_quarter, arg_max(value, run_date) AS estimate FROM nowcasts WHERE value IS NOT NULL GROUP BY 1, 2, 3) e
    JOIN (SELECT metric, max(quarter) AS quarter, arg_max(first_value, quarter) AS first_value FROM actuals GROUP BY 1) a ON a.metric = e.metric AND a.quarter = e.target_quarter
    UNION ALL SELECT 'recent', n.metric, n.model, n.target_quarter, n.run_date, n.value, a.first_value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run_date DESC, model, target_quarter) AS rn FROM nowcasts WHERE value IS NOT NULL) n
    LEFT JOIN actuals a ON a.quarter = n.target_quarter AND a.metric = n.metric WHERE n.rn <= 30""", "value")
def _(t):
    return daily.dashboard_feed(t.nowcasts, t.actuals)


# --- selection and bands --------------------------------------------------------------------

XY = """
    WITH x AS (SELECT s.entity_id, s.series_id, s.period, s.value, g.value AS y FROM (SELECT entity_id, series_id, period, CASE WHEN series_id IN ('n1', 'n2') THEN value ELSE coalesce(value, 0) END AS value FROM scaled) s
      JOIN growth g ON g.entity_id = s.entity_id AND CAST(g.quarter + INTERVAL 2 MONTH AS DATE) = s.period),
    full_rows AS (SELECT entity_id, period FROM x GROUP BY 1, 2 HAVING count(value) = count(*)),
    xy AS (SELECT x.* FROM x JOIN full_rows f ON f.entity_id = x.entity_id AND f.period = x.period)"""


def xy(t):
    """Indicators and the quarterly target; all but two series are filled with their mean."""
    filled = F.when(F.col("series_id").isin("n1", "n2"), F.col("value")).otherwise(F.coalesce("value", F.lit(0.0)))
    target = t.growth.select("entity_id", cal.quarter_end_month(F.col("quarter")).alias("period"), F.col("value").alias("y"))
    return selection.align_quarterly_xy(t.scaled.withColumn("value", filled), target)


@query("align_quarterly_xy", f"{XY} SELECT entity_id, series_id, period, value, y FROM xy", "value y")
def _(t):
    return xy(t)


@query("rank_correlation", f"{XY} SELECT entity_id, series_id, CASE WHEN stddev_pop(value) * stddev_pop(y) > 0 THEN corr(value, y) ELSE 0 END AS score FROM xy GROUP BY 1, 2", "score")
def _(t):
    return selection.rank_correlation(xy(t))


T = "CASE WHEN stddev_pop(value) * stddev_pop(y) > 0 THEN abs(corr(value, y)) * sqrt((count(*) - 2) / (1 - corr(value, y) ** 2)) ELSE 0 END"


@query("rank_tstat", f"{XY} SELECT entity_id, series_id, {T} AS score FROM xy GROUP BY 1, 2", "score")
def _(t):
    return selection.rank_tstat(xy(t))


@query("top_variables", f"""{XY}, s AS (SELECT entity_id, series_id, {T} AS score FROM xy GROUP BY 1, 2)
    SELECT entity_id, series_id, score, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY abs(score) DESC, series_id) AS INTEGER) AS rank FROM s
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs(score) DESC, series_id) <= 10""", "score")
def _(t):
    return selection.top_variables(selection.rank_tstat(xy(t)), 10)


@query("rank_lars")
def _(t):
    return selection.rank_lars(xy(t), 25)


@query("bootstrap_bands", """
    WITH s AS (SELECT entity_id, quarter, value, value - coalesce(lag(value) OVER w, value) AS d, row_number() OVER w - 1 AS t, first_value(value) OVER w AS start FROM growth WINDOW w AS (PARTITION BY entity_id ORDER BY quarter)),
    m AS (SELECT entity_id, avg(d) AS m, count(*) AS n FROM s GROUP BY 1),
    b AS (SELECT s.entity_id, s.quarter, s.t, s.start, m.m, u.b, floor(('0x' || substr(md5('42|' || s.entity_id || '|' || u.b || '|' || s.t), 1, 8))::BIGINT / 4294967296.0 * m.n) AS pick
          FROM s JOIN m ON m.entity_id = s.entity_id CROSS JOIN (SELECT unnest(range(200)) AS b) u),
    p AS (SELECT b.entity_id, b.quarter, b.start + sum(k.d - b.m) OVER (PARTITION BY b.entity_id, b.b ORDER BY b.t) AS v FROM b JOIN s k ON k.entity_id = b.entity_id AND k.t = b.pick)
    SELECT entity_id, quarter AS period, quantile_cont(v, 0.16) AS lower, quantile_cont(v, 0.84) AS upper FROM p GROUP BY 1, 2""", "lower upper")
def _(t):
    return bands.bootstrap_bands(t.growth.withColumnRenamed("quarter", "period"), ["entity_id"])
