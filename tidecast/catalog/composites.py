"""Whole jobs: preparation, nowcast, evaluation, news, selection and the daily run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.catalog import models, sources
from tidecast.catalog.registry import query
from tidecast.catalog.scores import OK, XY, HORIZON, xy
from tidecast.operators import metrics, vintage
from tidecast.plans import backtest, daily, nowcast, prepare
from tidecast.session import cut, scratch_path
from tidecast.sources import landed, versioned

E = ["entity_id"]


@query("prepare_panel", """
    WITH span AS (SELECT entity_id, min(period) AS lo, max(period) AS hi FROM trans WHERE value IS NOT NULL GROUP BY 1)
    SELECT s.entity_id, s.series_id, s.period, s.value FROM scaled s JOIN span ON span.entity_id = s.entity_id WHERE s.period BETWEEN lo AND hi""", "value")
def _(t):
    return prepare.prepare_panel(t.panel, t.meta, E).drop("mu", "sigma")


CODES = {"AFRICA": 1, "AMERICA": 2, "ASIA": 3, "EUROPE": 0, "MIDDLE EAST": 4}


def landed_records(t):
    """Regional totals and target levels as records in JSON files, some of them twice."""
    region = t.region_panel.select("entity_id", F.lit("region").alias("kind"), F.col("series_id").alias("name"), F.col("period").alias("date"), F.col("value").alias("total"))
    level = t.target.select("entity_id", F.lit("target").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("quarter").alias("date"), F.col("value").alias("total"))
    again = F.explode(F.when(F.month("date") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = region.unionByName(level).withColumn("seq", again).withColumn("total", F.when(F.col("seq") == 2, F.col("total") + 1).otherwise(F.col("total")))
    packed = rows.groupBy("kind", F.col("entity_id").alias("segment")).agg(
        F.concat(F.lit('{"value":['), F.array_join(F.collect_list(F.to_json(F.struct("entity_id", "name", "date", "total", "seq"))), ","), F.lit("]}")).alias("value")
    )
    path = sources.land(packed, "landed")
    fields = {"entity_id": "string", "name": "string", "date": "date", "total": "double", "seq": "int"}
    return landed.json_objects(t.spark, path, fields, ["date", "total"]).rows


@query("prepare_panel_from_files", """
    WITH v AS (SELECT entity_id, quarter, value, lag(value) OVER (PARTITION BY entity_id ORDER BY quarter) AS was FROM target),
    q AS (SELECT entity_id, quarter, (value - was) / was AS value FROM v WHERE was > 0),
    b AS (SELECT entity_id, min(quarter) AS begin FROM q GROUP BY 1),
    r AS (SELECT entity_id, series_id, period, CASE series_id WHEN 'ASIA' THEN value / 100 WHEN 'EUROPE' THEN ln(value) - ln(lag(value) OVER (PARTITION BY entity_id, series_id ORDER BY period)) ELSE value END AS value FROM region_panel
      UNION ALL SELECT entity_id, 'target', CAST(quarter + INTERVAL 2 MONTH AS DATE), value FROM q),
    p AS (SELECT r.* FROM r JOIN b ON b.entity_id = r.entity_id AND r.period >= b.begin WHERE value IS NOT NULL),
    m AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM p),
    dn AS (SELECT s.entity_id, s.series_id, m.period, p.value FROM (SELECT DISTINCT entity_id, series_id FROM p) s CROSS JOIN m LEFT JOIN p ON p.entity_id = s.entity_id AND p.series_id = s.series_id AND p.period = m.period),
    lg AS (SELECT *, CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-12)) END AS lv FROM dn),
    tr AS (SELECT entity_id, series_id, period, CASE series_id WHEN 'AFRICA' THEN lv - lag(lv) OVER w WHEN 'AMERICA' THEN value - lag(value) OVER w WHEN 'ASIA' THEN 3 * (lv - lag(lv) OVER w)
      WHEN 'MIDDLE EAST' THEN lv - lag(lv, 12) OVER w ELSE value END AS value FROM lg WINDOW w AS (PARTITION BY entity_id, series_id ORDER BY period)),
    sp AS (SELECT entity_id, min(period) AS lo, max(period) AS hi FROM tr WHERE value IS NOT NULL GROUP BY 1),
    st AS (SELECT entity_id, series_id, coalesce(avg(value), 0) AS mu, CASE WHEN stddev_pop(value) >= 1e-12 THEN stddev_pop(value) ELSE 1 END AS sigma FROM tr GROUP BY 1, 2)
    SELECT tr.entity_id, tr.series_id, tr.period, (tr.value - mu) / sigma AS value FROM tr JOIN sp ON sp.entity_id = tr.entity_id AND period BETWEEN lo AND hi JOIN st ON st.entity_id = tr.entity_id AND st.series_id = tr.series_id""", "value")
def _(t):
    specs = [{"series_id": r, "value_col": "total", "filters": {"kind": "region", "name": r}} for r in CODES]
    meta = t.spark.createDataFrame(list(CODES.items()), "series_id string, transform int")
    out = prepare.prepare_records(
        landed_records(t), specs, {"value_col": "total", "filters": {"kind": "target"}}, meta, E, order="seq", percent=["ASIA"], log_growth=["EUROPE"],
    )
    return out.drop("mu", "sigma")


@query("run_nowcast")
def _(t):
    return nowcast.run_nowcast(models.at_vintage(t), models.SYSTEM, E)


@query("run_evaluation")
def _(t):
    systems = backtest.vintage_systems(models.dated_system(t), t.vintages, E)
    runs = cut(backtest.run_backtest(systems, t.growth, models.SYSTEM, E), "runs")
    keys = [*E, "vintage_date", "quarter"]
    mean = runs.filter("pred is not null").groupBy(*keys).agg(
        F.avg("pred").alias("pred"), F.first("actual").alias("actual"), F.count(F.lit(1)).alias("n")
    ).filter("n >= 2").drop("n").withColumn("model", F.lit("ensemble"))
    board = metrics.score_nowcasts(runs.unionByName(mean), ["model", *E], ["vintage_date"])
    return metrics.rank_models(board, E)


@query("run_news")
def _(t):
    return models.news_table(t)


@query("run_selection", f"""{XY}, s AS (SELECT entity_id, series_id, CASE WHEN stddev_pop(value) * stddev_pop(y) > 0 THEN corr(value, y) ELSE 0 END AS score FROM xy GROUP BY 1, 2),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY abs(score) DESC, series_id) AS INTEGER) AS rank FROM s)
    SELECT k.series_id, k.entity_id, k.score, k.rank, m.name, m.grp, m.freq, m.pub_lag_days FROM k LEFT JOIN meta m ON m.series_id = k.series_id WHERE rank <= 5""", "score")
def _(t):
    rows = xy(t).withColumn("at", F.col("period"))
    target = rows.groupBy(*E, "period").agg(F.first("y").alias("y"))
    return nowcast.run_selection(rows.select(*E, "series_id", "period", "value"), target, t.meta, E, "correlation", 5)


@query("merge_actuals", "SELECT * FROM actuals")
def _(t):
    early = F.col("seen_date") <= F.lit("1999-06-30").cast("date")
    feed = cut(t.feed, "feed")
    state = vintage.freeze_first_release(feed.filter(early)).drop("base_changed")
    return vintage.merge_actuals(state, feed.filter(~early))


@query("day_tables", f"""
    WITH h AS (SELECT *, {HORIZON} AS horizon FROM {OK})
    SELECT metric, model, horizon, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) ** 2)) AS rmse, count(*) AS n FROM h
    GROUP BY GROUPING SETS ((model), (model, horizon), (metric, model), ())""", "mae rmse")
def _(t):
    log = cut(t.nowcasts, "log")
    feed = cut(t.feed, "feed")
    day = F.lit("2000-06-30").cast("date")
    state = vintage.freeze_first_release(feed.filter(F.col("seen_date") <= day)).drop("base_changed")
    # half of the log is rerun: the rerun rows replace the ones they repeat
    rerun = log.filter(F.col("run_date") > day)
    stale = log.withColumn("value", F.when(F.col("run_date") > day, F.col("value") + 1).otherwise(F.col("value")))
    return daily.day_tables(stale, rerun, state, feed.filter(F.col("seen_date") > day))["scores"]


# --- the daily job on a store ---------------------------------------------------------------

#: What the simple models say at every vintage: the target known by then, three quarters of each model and their median.
DAILY = """
    WITH k AS (SELECT g.entity_id, v.vintage_date, g.quarter, g.value FROM growth g, vintages v, (SELECT min(period) AS lo, max(period) AS hi FROM months) s
      WHERE g.value IS NOT NULL AND CAST(g.quarter + INTERVAL 2 MONTH AS DATE) BETWEEN lo AND hi AND last_day(CAST(g.quarter + INTERVAL 2 MONTH AS DATE)) + 45 <= v.vintage_date),
    l AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, vintage_date ORDER BY quarter) AS lv FROM k),
    f AS (SELECT entity_id, vintage_date, max(quarter) AS q, arg_max(value, quarter) AS last, avg(value) AS mean, regr_slope(value, lv) AS b, regr_intercept(value, lv) AS a, count(lv) AS n FROM l GROUP BY 1, 2),
    p AS (SELECT entity_id, vintage_date, q, unnest([0, 1, 2]) AS step, last, mean, CASE WHEN n >= 4 THEN a + b * last END AS one, CASE WHEN n >= 4 THEN a + b * (a + b * last) END AS two FROM f),
    e AS (SELECT *, unnest(['naive', 'mean', 'ar1']) AS model FROM p),
    m AS (SELECT entity_id, vintage_date AS run_date, CAST(q + 3 * step * INTERVAL 1 MONTH AS DATE) AS quarter, model,
            CASE WHEN step = 0 OR model = 'naive' THEN last WHEN model = 'mean' THEN mean WHEN step = 1 THEN one ELSE two END AS value FROM e),
    r AS (SELECT * FROM m WHERE value IS NOT NULL UNION ALL SELECT entity_id, run_date, quarter, 'ensemble', median(value) FROM m WHERE value IS NOT NULL GROUP BY 1, 2, 3),
    dlog AS (SELECT run_date, year(quarter) || '-Q' || quarter(quarter) AS target_quarter, entity_id AS metric, model, value FROM r)"""


def daily_store(t):
    """A store after two runs: one that catches up on all vintages, and one for the last of them, again.

    The releases of the first half come with the first run, the rest with the second.
    """
    root, keys, feed = scratch_path(t.spark, "store"), [*E, "vintage_date"], cut(t.feed, "feed")
    systems = cut(backtest.vintage_systems(models.dated_system(t), t.vintages, E), "systems")
    day = F.lit("2000-06-30").cast("date")
    last = systems.agg(F.max("vintage_date")).scalar()
    options = {"run_date": F.col("vintage_date"), "metric": F.col("entity_id"), "models": nowcast.SIMPLE}
    # the first run sees the last vintage with a wrong system; the second one replaces its rows
    early = systems.withColumn("value", F.when(F.col("vintage_date") == last, F.col("value") + 1).otherwise(F.col("value")))
    daily.run_daily(t.spark, root, early, models.SYSTEM, keys, feed.filter(F.col("seen_date") <= day), **options)
    daily.run_daily(t.spark, root, systems.filter(F.col("vintage_date") == last), models.SYSTEM, keys, feed.filter(F.col("seen_date") > day), **options)
    return root


@query("run_daily", f"""{DAILY},
    j AS (SELECT d.run_date, d.target_quarter, d.metric, d.model, d.value AS pred, a.first_value AS actual FROM dlog d JOIN actuals a ON a.quarter = d.target_quarter AND a.metric = d.metric WHERE a.first_value IS NOT NULL),
    h AS (SELECT *, {HORIZON} AS horizon FROM j)
    SELECT metric, model, horizon, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) ** 2)) AS rmse, count(*) AS n FROM h
    GROUP BY GROUPING SETS ((model), (model, horizon), (metric, model), ())""", "mae rmse")
def _(t):
    return versioned.read_table(t.spark, daily_store(t), "scores")


@query("run_daily_log", f"{DAILY} SELECT * FROM dlog", "value")
def _(t):
    return versioned.read_table(t.spark, daily_store(t), "log")


@query("run_daily_actuals", "SELECT * FROM actuals", "first_value:3 latest_value:3")
def _(t):
    return versioned.read_table(t.spark, daily_store(t), "actuals")


@query("run_daily_dashboard", f"""{DAILY},
    k2 AS (SELECT *, CAST(run_date AS VARCHAR) || target_quarter AS k FROM dlog),
    w AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run_date DESC, model, target_quarter) AS rn FROM dlog)
    SELECT 'latest_actual' AS section, metric, NULL AS model, max(quarter) AS quarter, CAST(NULL AS DATE) AS run_date, CAST(NULL AS DOUBLE) AS value, arg_max(first_value, quarter) AS actual FROM actuals GROUP BY 2
    UNION ALL SELECT 'current_nowcast', metric, model, arg_max(target_quarter, k), max(run_date), arg_max(value, k), NULL FROM k2 GROUP BY 2, 3
    UNION ALL SELECT 'backcast', x.metric, x.model, x.target_quarter, NULL, x.estimate, a.first_value
    FROM (SELECT metric, model, target_quarter, arg_max(value, run_date) AS estimate FROM dlog GROUP BY 1, 2, 3) x
    JOIN (SELECT metric, max(quarter) AS quarter, arg_max(first_value, quarter) AS first_value FROM actuals GROUP BY 1) a ON a.metric = x.metric AND a.quarter = x.target_quarter
    UNION ALL SELECT 'recent', w.metric, w.model, w.target_quarter, w.run_date, w.value, a.first_value FROM w LEFT JOIN actuals a ON a.quarter = w.target_quarter AND a.metric = w.metric WHERE w.rn <= 30""", "value actual")
def _(t):
    return versioned.read_table(t.spark, daily_store(t), "dashboard")


@query("run_daily_models")
def _(t):
    root, keys = scratch_path(t.spark, "store"), [*E, "vintage_date"]
    day = F.array(F.lit("2001-02-15").cast("date"))
    systems = backtest.vintage_systems(models.dated_system(t), day, E)
    daily.run_daily(
        t.spark, root, systems, models.SYSTEM, keys, t.feed, run_date=F.col("vintage_date"), metric=F.col("entity_id"),
        models=(*nowcast.FITTED, *nowcast.SIMPLE),
    )
    return versioned.read_table(t.spark, root, "log")
