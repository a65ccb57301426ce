"""Release dates, vintages, revisions, frozen values and the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.catalog.registry import query
from tidecast.functions import calendar as cal
from tidecast.operators import forecasts, metrics, stats, transforms, vintage
from tidecast.plans import daily

KEYS = ["entity_id", "series_id"]


@query("release_dates", "SELECT entity_id, series_id, period, value, release_date FROM dated")
def _(t):
    return t.dated


@query("build_vintages", "SELECT entity_id, series_id, period, vintage_date, value FROM vpanel")
def _(t):
    return t.vpanel


@query("build_vintages_strict", "SELECT entity_id, series_id, period, vintage_date FROM dated JOIN vintages ON release_date <= vintage_date WHERE value IS NOT NULL")
def _(t):
    return vintage.build_vintages_strict(t.dated.filter("value is not null"), t.vintages).drop("value")


@query("ragged_edge", """
    SELECT entity_id, series_id, period, vintage_date,
           CASE WHEN period <= max(CASE WHEN value IS NOT NULL AND release_date <= vintage_date THEN period END) OVER (PARTITION BY entity_id, series_id, vintage_date) THEN value END AS value
    FROM dated JOIN vintages ON period <= date_trunc('month', vintage_date)""")
def _(t):
    return vintage.ragged_edge(t.dated, t.vintages)


@query("vintage_standardize", """
    SELECT entity_id, series_id, period, vintage_date, (value - coalesce(avg(value) OVER s, 0)) / CASE WHEN stddev_pop(value) OVER s >= 1e-12 THEN stddev_pop(value) OVER s ELSE 1 END AS value
    FROM vpanel WINDOW s AS (PARTITION BY entity_id, series_id, vintage_date)""", "value")
def _(t):
    return transforms.standardize(t.vpanel, [*KEYS, "vintage_date"]).drop("mu", "sigma")


@query("freeze_first_release", """
    SELECT a.*, coalesce((SELECT arg_max(base_year, seen_date) FROM feed f WHERE f.quarter = a.quarter AND f.metric = a.metric AND f.value IS NOT NULL) <> a.base_year, FALSE) AS base_changed
    FROM actuals a""")
def _(t):
    return vintage.freeze_first_release(t.feed)


@query("revision_stats", """
    SELECT metric, count(*) AS n, avg(latest_value - first_value) AS mean_revision, avg(abs(latest_value - first_value)) AS mean_abs_revision
    FROM actuals GROUP BY 1""", "mean_revision mean_abs_revision")
def _(t):
    return vintage.revision_stats(t.actuals)


@query("first_release_map", "SELECT quarter, first_value FROM actuals WHERE metric = 'BUILDING'")
def _(t):
    return t.actuals.filter("metric = 'BUILDING'").select("quarter", "first_value")


@query("model_grid", """
    SELECT vintage_date, entity_id, r, p FROM vintages, (SELECT DISTINCT entity_id FROM panel), (VALUES (2), (3), (4), (5)) AS r(r), (VALUES (1), (2), (3), (4)) AS p(p)""")
def _(t):
    from tidecast.plans import backtest

    return backtest.model_grid(t.panel.select("entity_id").distinct(), t.vintages, (2, 3, 4, 5), (1, 2, 3, 4))


@query("model_grid_random", """
    SELECT entity_id, CAST(draw AS INTEGER) AS draw,
           CAST(2 + floor(('0x' || substr(md5('7|r|' || entity_id || '|' || draw), 1, 8))::BIGINT / 4294967296.0 * 4) AS INTEGER) AS r,
           CAST(1 + floor(('0x' || substr(md5('7|p|' || entity_id || '|' || draw), 1, 8))::BIGINT / 4294967296.0 * 4) AS INTEGER) AS p
    FROM (SELECT DISTINCT entity_id FROM panel), (SELECT unnest(range(20)) AS draw)""")
def _(t):
    from tidecast.plans import backtest

    return backtest.random_grid(t.panel.select("entity_id").distinct(), 20, (2, 5), (1, 4), seed=7)


@query("upsert_log", """
    SELECT entity_id AS run_entity, day AS run_date, value FROM (
      SELECT c_mktsegment AS entity_id, CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS value
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""")
def _(t):
    log = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("run_entity"), F.to_date("o_orderdate").alias("run_date"),
        F.col("o_orderkey").alias("loaded"), F.col("o_totalprice").alias("value"),
    )
    half = F.col("loaded") % 2 == 0
    return daily.upsert_log(log.filter(half), log.filter(~half), ["run_entity", "run_date"], "loaded").drop("loaded")


@query("log_backfill", """
    SELECT o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS target_quarter,
           CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS gdp, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS gdp_qoq FROM orders""")
def _(t):
    even = F.col("o_orderkey") % 2 == 0
    log = t.raw("orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("run_date"),
        F.when(even, cal.quarter_label(F.col("o_orderdate"))).alias("target_quarter"),
        F.when(even, F.col("o_totalprice")).alias("gdp_yoy"),
        F.when(~even, F.col("o_totalprice")).alias("gdp"),
    )
    return daily.backfill_log(log, ["gdp"]).drop("run_date")


@query("target_by_vintage", """
    SELECT entity_id, vintage_date, arg_max(value, quarter) AS value, max(quarter) AS quarter FROM growth JOIN vintages
    ON last_day(CAST(quarter + INTERVAL 2 MONTH AS DATE)) + 45 <= vintage_date GROUP BY 1, 2""", "value")
def _(t):
    due = F.date_add(F.last_day(F.add_months("quarter", 2)), 45)
    seen = vintage.build_vintages_strict(t.growth.withColumn("release_date", due), t.vintages)
    return seen.groupBy("entity_id", "vintage_date").agg(
        F.max_by("value", "quarter").alias("value"), F.max("quarter").alias("quarter")
    )


@query("nowcast_extract", """
    SELECT metric, model, run_date, max(CASE WHEN target_quarter = cq THEN value END) AS nowcast, max(CASE WHEN target_quarter = nq THEN value END) AS forecast,
           max(CASE WHEN target_quarter = bq THEN value END) AS backcast
    FROM (SELECT *, year(run_date) || '-Q' || quarter(run_date) AS cq, year(run_date + INTERVAL 3 MONTH) || '-Q' || quarter(run_date + INTERVAL 3 MONTH) AS nq,
            year(run_date - INTERVAL 3 MONTH) || '-Q' || quarter(run_date - INTERVAL 3 MONTH) AS bq FROM nowcasts WHERE value IS NOT NULL) GROUP BY 1, 2, 3""",
    "nowcast forecast backcast")
def _(t):
    return daily.extract(t.nowcasts.filter("value is not null"), ["metric", "model"])


@query("identity_residual", """
    WITH g AS (SELECT a.entity_id, a.component, a.quarter, a.value, (a.value / b.value - 1) * 100 AS yoy FROM components a JOIN components b
               ON a.entity_id = b.entity_id AND a.component = b.component AND a.quarter = CAST(b.quarter + INTERVAL 12 MONTH AS DATE)),
    w AS (SELECT entity_id, quarter, max(CASE WHEN component = 'A' THEN value END) AS c, max(CASE WHEN component = 'A' THEN yoy END) AS cg,
          max(CASE WHEN component = 'N' THEN value END) AS i, max(CASE WHEN component = 'N' THEN yoy END) AS ig,
          max(CASE WHEN component = 'R' THEN value END) AS m, max(CASE WHEN component = 'R' THEN yoy END) AS mg FROM g GROUP BY 1, 2)
    SELECT entity_id, quarter, (c * cg + i * ig + c * ig + i * cg - (2 * c + 2 * i - m) * mg) / m AS imports_identity FROM w""", "imports_identity:4")
def _(t):
    yoy = stats.level_yoy(t.components, ["entity_id", "component"])
    wide = yoy.groupBy("entity_id", "quarter").agg(*[
        F.max(F.when(F.col("component") == c, F.col(v))).alias(f"{c}_{v}") for c in "ANR" for v in ("value", "yoy")
    ])
    parts = wide.select(
        "entity_id", "quarter",
        F.col("A_value").alias("c"), F.col("A_yoy").alias("c_g"), F.col("N_value").alias("i"), F.col("N_yoy").alias("i_g"),
        F.col("A_value").alias("g"), F.col("N_yoy").alias("g_g"), F.col("N_value").alias("x"), F.col("A_yoy").alias("x_g"),
        F.col("R_value").alias("m"), F.col("R_yoy").alias("total_g"),
    )
    return stats.identity_residual(parts).select("entity_id", "quarter", "imports_identity")


FLAGSHIP = """
    WITH known AS (SELECT entity_id, vintage_date, quarter, value, lag(value) OVER (PARTITION BY entity_id, vintage_date ORDER BY quarter) AS lv
      FROM growth JOIN vintages ON last_day(CAST(quarter + INTERVAL 2 MONTH AS DATE)) + 45 <= vintage_date),
    fits AS (SELECT entity_id, vintage_date, max(quarter) AS last_quarter, arg_max(value, quarter) AS naive, avg(value) AS mean,
      CASE WHEN count(lv) >= 4 THEN regr_intercept(value, lv) + regr_slope(value, lv) * arg_max(value, quarter) END AS ar1 FROM known GROUP BY 1, 2),
    moves AS (SELECT entity_id, vintage_date, period, lv - lag(lv) OVER (PARTITION BY entity_id, series_id, vintage_date ORDER BY period) AS d
      FROM (SELECT *, CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-12)) END AS lv FROM vpanel)),
    breadth AS (SELECT entity_id, vintage_date, 300 * avg(d) AS breadth FROM moves WHERE period <= vintage_date AND period >= vintage_date - INTERVAL 6 MONTH GROUP BY 1, 2),
    preds4 AS (SELECT entity_id, vintage_date, last_quarter, unnest(['naive', 'mean', 'ar1', 'breadth']) AS model, unnest([naive, mean, ar1, breadth]) AS pred
      FROM fits JOIN breadth USING (entity_id, vintage_date))
    SELECT p.model, CAST((year(g.quarter) * 4 + quarter(g.quarter)) - (year(last_quarter) * 4 + quarter(last_quarter)) AS INTEGER) AS quarters_ahead, avg(abs(g.value - p.pred)) AS mae, count(*) AS n
    FROM preds4 p JOIN growth g ON g.entity_id = p.entity_id AND g.quarter = date_trunc('quarter', p.vintage_date) WHERE p.pred IS NOT NULL GROUP BY 1, 2"""


@query("flagship", FLAGSHIP, "mae")
def _(t):
    """Panel and target as known at each vintage, four forecasts from them, scored by distance."""
    keys = ["entity_id", "vintage_date"]
    due = F.date_add(F.last_day(F.add_months("quarter", 2)), 45)
    known = vintage.build_vintages_strict(t.growth.withColumn("release_date", due), t.vintages)
    fits = forecasts.ar1_forecast(known, keys).select(*keys, F.col("pred").alias("ar1"))
    last = known.groupBy(*keys).agg(
        F.max("quarter").alias("last_quarter"), F.max_by("value", "quarter").alias("naive"), F.avg("value").alias("mean")
    )
    moves = transforms.transform_series(t.vpanel, transforms.MOM, keys=[*KEYS, "vintage_date"])
    recent = F.col("period").between(F.add_months("vintage_date", -6), F.col("vintage_date"))
    breadth = moves.filter(recent).groupBy(*keys).agg((300 * F.avg("value")).alias("breadth"))
    wide = last.join(fits, keys, "left").join(breadth, keys)
    preds = wide.unpivot([*keys, "last_quarter"], ["naive", "mean", "ar1", "breadth"], "model", "pred")
    actual = t.growth.select("entity_id", "quarter", F.col("value").alias("actual"))
    pairs = preds.withColumn("quarter", cal.quarter_start(F.col("vintage_date"))).join(actual, ["entity_id", "quarter"])
    ahead = (cal.months_apart(F.col("quarter"), F.col("last_quarter")) / 3).cast("int")
    return metrics.complete(pairs).groupBy("model", ahead.alias("quarters_ahead")).agg(
        metrics.mae().alias("mae"), F.count(F.lit(1)).alias("n")
    )
