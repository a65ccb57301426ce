"""Projections, calendar and reshaping, joins, aggregations, top-k, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast.catalog.registry import query
from tidecast.functions import calendar as cal
from tidecast.functions import numeric as num
from tidecast.operators import boards, forecasts, grid, selection, stats, transforms, vintage
from tidecast.session import scratch_path
from tidecast.sources import readers

KEYS = ["entity_id", "series_id"]

# --- projections, filters, predicates -------------------------------------------------------


@query("filter_series_spec", """
    SELECT event_id, series_id, value FROM (SELECT event_id, event_type AS series_id, value FROM events)
    WHERE series_id = 'click'""")
def _(t):
    records = t.raw("events").select("event_id", F.col("event_type").alias("series_id"), "value")
    return stats.filter_series_spec(records, {"series_id": "click", "division": "overall"})


@query("project_value", "SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS revenue FROM orders")
def _(t):
    return t.raw("orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("revenue"))


@query("scale_percent", """
    SELECT entity_id, series_id, period, CASE WHEN series_id IN ('n1', 'n2', 'n3') THEN value / 100 ELSE value END AS value
    FROM panel""", "value:4")
def _(t):
    return transforms.scale_percent(t.panel, ["n1", "n2", "n3"])


@query("select_group_subset", """
    WITH tg AS (SELECT r_name AS target, CASE WHEN r_regionkey = 0 THEN 'none' ELSE r_name END AS grp FROM region),
    hits AS (SELECT target, series_id FROM tg JOIN meta ON tg.grp = meta.grp),
    n AS (SELECT tg.target, count(series_id) AS n FROM tg LEFT JOIN hits ON hits.target = tg.target GROUP BY 1)
    SELECT n.target, m.series_id FROM n JOIN tg ON tg.target = n.target JOIN meta m ON m.grp = tg.grp OR n.n < 3""")
def _(t):
    groups = t.raw("region").select(
        F.col("r_name").alias("target"),
        F.array(F.when(F.col("r_regionkey") == 0, "none").otherwise(F.col("r_name"))).alias("groups"),
    )
    return stats.select_group_subset(t.meta, groups)


@query("filter_registry", "SELECT series_id, name, grp FROM meta WHERE grp = 'ASIA' AND freq = 'monthly' AND pub_lag_days < 40")
def _(t):
    m = t.meta
    return m.filter((m.grp == "ASIA") & (m.freq == "monthly") & (m.pub_lag_days < 40)).select("series_id", "name", "grp")


@query("drop_short_series", """
    WITH span AS (SELECT entity_id, series_id, min(period) AS f, max(period) AS l FROM trans WHERE value IS NOT NULL GROUP BY 1, 2),
    ends AS (SELECT entity_id, max(l) AS e FROM span GROUP BY 1)
    SELECT p.entity_id, p.series_id, p.period, p.value FROM trans p JOIN span s ON s.entity_id = p.entity_id AND s.series_id = p.series_id
    JOIN ends ON ends.entity_id = p.entity_id
    WHERE (year(e) * 12 + month(e)) - (year(f) * 12 + month(f)) + 1 >= 3 * 2 * 12 + 1 OR p.series_id = 'n0'""", "value:4")
def _(t):
    return stats.drop_short_series(t.trans, 12, target="n0")


@query("trim_empty_edges", """
    WITH late AS (SELECT entity_id, series_id, period, CASE WHEN period >= DATE '1995-04-01' AND period < DATE '2001-05-01' THEN value END AS value FROM dense)
    SELECT l.* FROM late l JOIN (SELECT entity_id, min(period) AS f, max(period) AS e FROM late WHERE value IS NOT NULL GROUP BY 1) s
    ON s.entity_id = l.entity_id WHERE l.period BETWEEN f AND e""")
def _(t):
    inside = F.col("period").between(F.lit("1995-04-01").cast("date"), F.lit("2001-04-30").cast("date"))
    return stats.trim_empty_edges(t.dense.withColumn("value", F.when(inside, F.col("value"))))


@query("estimation_sample", "SELECT entity_id, series_id, period, value FROM panel WHERE period >= DATE '1997-07-01'")
def _(t):
    return t.panel.filter(F.col("period") >= F.lit("1997-07-01").cast("date"))


@query("target_usable", """
    SELECT entity_id, series_id, count(value) AS n_obs FROM dense GROUP BY 1, 2 HAVING count(value) >= 12""")
def _(t):
    return stats.target_usable(t.dense, 12, KEYS)


@query("ex_period_filter", "SELECT run_date, target_quarter, metric, model FROM nowcasts WHERE CAST(substr(target_quarter, 1, 4) AS INTEGER) >= 1999")
def _(t):
    year = F.year(cal.parse_quarter(F.col("target_quarter")))
    return t.nowcasts.filter(year >= 1999).select("run_date", "target_quarter", "metric", "model")


# --- calendar and reshaping -----------------------------------------------------------------


@query("month_grid", "SELECT period FROM months")
def _(t):
    return grid.period_grid(grid.panel_bounds(t.panel))


@query("quarter_grid", """
    SELECT entity_id, CAST(unnest(generate_series(lo, hi, INTERVAL 3 MONTH)) AS DATE) AS period
    FROM (SELECT entity_id, min(quarter) AS lo, max(quarter) AS hi FROM target GROUP BY 1)""")
def _(t):
    bounds = t.target.groupBy("entity_id").agg(F.min("quarter").alias("lo"), F.max("quarter").alias("hi"))
    return grid.period_grid(bounds, 3)


@query("vintage_grid", """
    SELECT entity_id, CAST(unnest(generate_series(lo, hi, INTERVAL 3 MONTH)) + INTERVAL 27 DAY AS DATE) AS vintage_date
    FROM (SELECT entity_id, min(period) AS lo, max(period) AS hi FROM panel GROUP BY 1)""")
def _(t):
    return grid.vintages_between(grid.panel_bounds(t.panel, keys=["entity_id"]), 3, 31)


@query("panel_date_range", """
    SELECT entity_id, greatest(min(period), DATE '1996-01-01') AS lo, max(period) AS hi FROM panel GROUP BY 1""")
def _(t):
    return grid.panel_bounds(t.panel, "1996-01-01", ["entity_id"])


@query("align_to_grid", "SELECT entity_id, series_id, period, value FROM dense")
def _(t):
    return t.dense


@query("quarter_end_shift", """
    SELECT entity_id, CAST(quarter + INTERVAL 2 MONTH AS DATE) AS period, value FROM target""")
def _(t):
    return grid.shift_to_quarter_end(t.target.withColumnRenamed("quarter", "period")).select("entity_id", "period", "value")


@query("month_of_quarter", """
    SELECT o_orderkey, CAST((month(o_orderdate) - 1) % 3 + 1 AS INTEGER) AS moq, month(o_orderdate) % 3 = 0 AS is_end FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.raw("orders").select("o_orderkey", cal.month_of_quarter(d).alias("moq"), cal.is_quarter_end(d).alias("is_end"))


@query("date_lookup", """
    SELECT o.o_orderkey, CAST(coalesce(g.idx, -1) AS INTEGER) AS idx
    FROM (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 18 MONTH AS DATE) AS period FROM orders) o
    LEFT JOIN (SELECT period, row_number() OVER (ORDER BY period) - 1 AS idx FROM months) g ON g.period = o.period""")
def _(t):
    months = grid.grid_index(grid.period_grid(grid.panel_bounds(t.panel)))
    wanted = t.raw("orders").select("o_orderkey", F.add_months(cal.month_start(F.col("o_orderdate")), 18).alias("period"))
    return grid.date_lookup(months, wanted).select("o_orderkey", "idx")


@query("add_months", """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 40 - 20 AS INTEGER)) AS DATE) AS period FROM orders""")
def _(t):
    shift = (F.col("o_orderkey") % 40 - 20).cast("int")
    return t.raw("orders").select("o_orderkey", F.add_months(cal.month_start(F.col("o_orderdate")), shift).alias("period"))


@query("quarter_label", """
    SELECT o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label,
           'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS display FROM orders""")
def _(t):
    label = cal.quarter_label(F.col("o_orderdate"))
    return t.raw("orders").select("o_orderkey", label.alias("label"), cal.quarter_display(label).alias("display"))


@query("parse_quarter", """
    SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
           year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label FROM orders""")
def _(t):
    display = cal.quarter_display(cal.quarter_label(F.col("o_orderdate")))
    label = cal.quarter_from_display(display)
    return t.raw("orders").select("o_orderkey", cal.parse_quarter(label).alias("quarter"), label.alias("label"))


@query("agg_quarter_last", """
    SELECT entity_id, series_id, CAST(date_trunc('quarter', period) AS DATE) AS quarter, value FROM dense WHERE month(period) % 3 = 0""")
def _(t):
    return grid.agg_quarter(t.dense, "last")


_FULL = """
    SELECT entity_id, series_id, CAST(date_trunc('quarter', period) AS DATE) AS quarter, {agg} AS value
    FROM dense GROUP BY 1, 2, 3 HAVING month(max(period)) % 3 = 0"""


@query("agg_quarter_mean", _FULL.format(agg="CASE WHEN count(*) = 3 THEN avg(value) END"), "value:4")
def _(t):
    return grid.agg_quarter(t.dense, "mean")


@query("agg_quarter_sum", _FULL.format(agg="CASE WHEN count(*) = 3 THEN coalesce(sum(value), 0) ELSE 0 END"), "value:2")
def _(t):
    return grid.agg_quarter(t.dense, "sum")


@query("agg_mariano_murasawa", """
    SELECT entity_id, series_id, period, CASE WHEN row_number() OVER w > 4 THEN v + 2 * lag(v) OVER w + 3 * lag(v, 2) OVER w
           + 2 * lag(v, 3) OVER w + lag(v, 4) OVER w END AS value
    FROM (SELECT *, coalesce(value, 0) AS v FROM dense)
    WINDOW w AS (PARTITION BY entity_id, series_id ORDER BY period)""", "value:2")
def _(t):
    return grid.agg_mariano_murasawa(t.dense)


@query("daily_to_monthly_last", """
    SELECT event_type, user_id, CAST(date_trunc('month', ts) AS DATE) AS period, arg_max(value, ts) AS value
    FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return grid.daily_to_monthly_last(t.raw("events"), ["event_type", "user_id"])


@query("pivot_quarter_blocks", """
    SELECT entity_id, series_id, CAST(date_trunc('quarter', period) AS DATE) AS quarter,
           max(CASE WHEN month(period) % 3 = 1 THEN value END) AS m1, max(CASE WHEN month(period) % 3 = 2 THEN value END) AS m2,
           max(CASE WHEN month(period) % 3 = 0 THEN value END) AS m3
    FROM dense GROUP BY 1, 2, 3""")
def _(t):
    return grid.quarter_blocks(t.dense)


@query("unpivot_quarter_blocks", "SELECT entity_id, series_id, period, value FROM dense")
def _(t):
    lo, hi = (t.panel.select(f("period")).scalar() for f in (F.min, F.max))
    return grid.unblock_quarters(grid.quarter_blocks(t.dense), lo, hi)


@query("long_to_wide", """
    SELECT entity_id, period, max(CASE WHEN series_id = 'AFRICA' THEN value END) AS "AFRICA", max(CASE WHEN series_id = 'AMERICA' THEN value END) AS "AMERICA",
           max(CASE WHEN series_id = 'ASIA' THEN value END) AS "ASIA", max(CASE WHEN series_id = 'EUROPE' THEN value END) AS "EUROPE",
           max(CASE WHEN series_id = 'MIDDLE EAST' THEN value END) AS "MIDDLE EAST"
    FROM region_panel GROUP BY 1, 2""")
def _(t):
    return grid.long_to_wide(t.region_panel, REGIONS, ["entity_id", "period"])


@query("wide_to_long", """
    SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount']) AS series_id, unnest([l_quantity, l_discount]) AS value FROM lineitem""")
def _(t):
    line = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return grid.wide_to_long(line, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@query("group_one_hot", """
    SELECT m.series_id, g.block, CAST(m.grp = g.block AS INTEGER) AS member FROM meta m CROSS JOIN (SELECT DISTINCT grp AS block FROM meta) g""")
def _(t):
    return grid.group_one_hot(t.meta)


# --- joins ----------------------------------------------------------------------------------


@query("join_meta", """
    SELECT p.entity_id, p.series_id, p.period, p.value, m.grp, m.pub_lag_days FROM panel p LEFT JOIN meta m ON m.series_id = p.series_id""")
def _(t):
    return t.panel.join(t.meta.select("series_id", "grp", "pub_lag_days"), "series_id", "left")


@query("join_calendar_exact", """
    SELECT p.entity_id, p.series_id, p.period, e.release_date FROM panel p
    LEFT JOIN earliest e ON e.series_id = p.series_id AND e.ref_period = p.period""")
def _(t):
    first = vintage.earliest_release(t.calendar).withColumnRenamed("ref_period", "period")
    return t.panel.join(first, ["series_id", "period"], "left").select(*KEYS, "period", "release_date")


@query("join_vintage_range", """
    SELECT entity_id, series_id, period, value, vintage_date FROM dated JOIN vintages ON release_date <= vintage_date""")
def _(t):
    return vintage.build_vintages_strict(t.dated, t.vintages)


@query("join_asof_last_known", """
    SELECT o.o_orderkey, o.entity_id, (SELECT arg_max(g.value, g.quarter) FROM growth g
           WHERE g.entity_id = o.entity_id AND g.quarter < o.day) AS last_value
    FROM (SELECT o_orderkey, c_mktsegment AS entity_id, CAST(o_orderdate AS DATE) AS day
          FROM orders JOIN customer ON o_custkey = c_custkey) o""", "last_value")
def _(t):
    asked = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("entity_id"), F.to_date("o_orderdate").alias("day"), "o_orderkey"
    )
    values = t.growth.withColumnRenamed("quarter", "day")
    return forecasts.last_known_before(values, asked, ["entity_id"], "day").select("o_orderkey", "entity_id", "last_value")


@query("join_actual_on_quarter", "SELECT run_date, target_quarter, metric, model, pred, actual FROM pairs", "pred actual")
def _(t):
    return t.pairs.select("run_date", "target_quarter", "metric", "model", "pred", "actual")


_PUBLISHED = "(SELECT * FROM actuals WHERE CAST(substr(quarter, 1, 4) AS INTEGER) < 2001)"


def _published(t):
    return t.actuals.filter(F.substring("quarter", 1, 4).cast("int") < 2001).select(
        F.col("quarter").alias("target_quarter"), "metric"
    )


@query("join_anti_pending", f"""
    SELECT DISTINCT n.target_quarter, n.metric FROM nowcasts n WHERE NOT EXISTS
    (SELECT 1 FROM {_PUBLISHED} a WHERE a.quarter = n.target_quarter AND a.metric = n.metric)""")
def _(t):
    return t.nowcasts.select("target_quarter", "metric").distinct().join(
        _published(t), ["target_quarter", "metric"], "left_anti"
    )


@query("join_semi_published", f"""
    SELECT n.run_date, n.target_quarter, n.metric, n.model, n.value FROM nowcasts n WHERE EXISTS
    (SELECT 1 FROM {_PUBLISHED} a WHERE a.quarter = n.target_quarter AND a.metric = n.metric)""", "value")
def _(t):
    return t.nowcasts.join(_published(t), ["target_quarter", "metric"], "left_semi").select(
        "run_date", "target_quarter", "metric", "model", "value"
    )


_DIFF = """
    WITH a AS (SELECT entity_id, series_id, period, value FROM vpanel WHERE vintage_date = DATE '2000-02-15'),
    b AS (SELECT entity_id, series_id, period, CASE WHEN period = DATE '1999-06-01' THEN value * 1.01 ELSE value END AS value
          FROM vpanel WHERE vintage_date = DATE '2000-05-15')
    SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.series_id, b.series_id) AS series_id,
           coalesce(a.period, b.period) AS period, a.value AS old_value, b.value AS new_value,
           CASE WHEN a.value IS NULL AND b.value IS NULL THEN 'same' WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed'
                WHEN abs(a.value - b.value) <= 1e-8 + 1e-8 * abs(b.value) THEN 'same' ELSE 'revised' END AS status
    FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.series_id = b.series_id AND a.period = b.period"""


def two_vintages(t):
    old = t.vpanel.filter(F.col("vintage_date") == F.lit("2000-02-15").cast("date"))
    new = t.vpanel.filter(F.col("vintage_date") == F.lit("2000-05-15").cast("date"))
    revised = F.when(F.col("period") == F.lit("1999-06-01").cast("date"), F.col("value") * 1.01).otherwise(F.col("value"))
    return old, new.withColumn("value", revised)


@query("join_full_vintage_diff", _DIFF, "old_value:2 new_value:2")
def _(t):
    return vintage.vintage_diff(*two_vintages(t))


@query("vintage_diff", f"SELECT * FROM ({_DIFF}) WHERE status IN ('added', 'revised')", "old_value:2 new_value:2")
def _(t):
    return vintage.vintage_diff(*two_vintages(t)).filter(F.col("status").isin("added", "revised"))


_YOY = """
    SELECT a.entity_id, a.quarter, a.value, b.value AS base, (a.value / b.value - 1) * 100 AS yoy FROM target a
    JOIN target b ON b.entity_id = a.entity_id AND CAST(b.quarter + INTERVAL 12 MONTH AS DATE) = a.quarter WHERE b.value > 0"""


@query("join_year_ago", _YOY, "value:4 base:4 yoy")
def _(t):
    return stats.level_yoy(t.target, ["entity_id"])


@query("join_benchmark_advance", """
    SELECT f.quarter, f.metric, f.value AS advance, a.latest_value AS actual, f.value - a.latest_value AS error
    FROM feed f JOIN actuals a ON a.quarter = f.quarter AND a.metric = f.metric AND a.first_release_date = f.seen_date""", "advance error")
def _(t):
    return boards.advance_errors(t.feed, t.actuals)


# --- aggregations ---------------------------------------------------------------------------


@query("series_stats", "SELECT entity_id, series_id, mu, sigma FROM stat", "mu:4 sigma:4")
def _(t):
    return transforms.series_stats(t.trans)


@query("last_observed", """
    SELECT entity_id, series_id, vintage_date, max(CASE WHEN value IS NOT NULL THEN period END) AS last_period FROM vpanel GROUP BY 1, 2, 3""")
def _(t):
    return stats.last_observed(t.vpanel, [*KEYS, "vintage_date"])


@query("publication_lag", """
    SELECT entity_id, series_id, vintage_date, CAST(coalesce((year(max(period)) * 12 + month(max(period))) -
        (year(max(CASE WHEN value IS NOT NULL THEN period END)) * 12 + month(max(CASE WHEN value IS NOT NULL THEN period END))), count(*)) AS BIGINT) AS lag_months
    FROM vpanel GROUP BY 1, 2, 3""")
def _(t):
    return stats.publication_lag(t.vpanel, [*KEYS, "vintage_date"])


@query("median_release_lag", """
    SELECT m.series_id, coalesce(median(date_diff('day', last_day(c.ref_period), c.release_date)), 45) AS lag_days
    FROM meta m LEFT JOIN calendar c ON c.series_id = m.series_id GROUP BY 1""", "lag_days")
def _(t):
    return vintage.median_release_lag(t.calendar, t.meta)


@query("earliest_release", "SELECT series_id, ref_period, release_date FROM earliest")
def _(t):
    return vintage.earliest_release(t.calendar)


@query("calendar_coverage", """
    SELECT count(*) AS n_releases, count(DISTINCT series_id) AS n_series, min(release_date) AS first_release, max(release_date) AS last_release
    FROM calendar""")
def _(t):
    return vintage.calendar_coverage(t.calendar)


@query("vintage_profile", """
    SELECT entity_id, vintage_date, min(CASE WHEN s > 0 THEN period END) AS first_month, max(CASE WHEN s > 0 THEN period END) AS last_month,
           count(CASE WHEN s > 0 THEN 1 END) AS n_rows, CAST(sum(tg) AS BIGINT) AS n_target, count(CASE WHEN s = n THEN 1 END) AS n_complete
    FROM (SELECT entity_id, vintage_date, period, count(value) AS s, count(*) AS n, count(CASE WHEN series_id = 'n1' THEN value END) AS tg
          FROM vpanel GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    return stats.vintage_profile(t.vpanel, "n1")


@query("availability_grid", """
    SELECT grp, period, count(*) AS n_cells, count(value) AS n_seen, count(value) / count(*) AS share
    FROM dense JOIN meta ON dense.series_id = meta.series_id GROUP BY CUBE (grp, period)""", "share")
def _(t):
    return stats.availability(t.dense, t.meta)


@query("latest_value", """
    SELECT entity_id, component, max(quarter) AS quarter, arg_max(value, quarter) AS value FROM components GROUP BY 1, 2""", "value:4")
def _(t):
    return t.components.groupBy("entity_id", "component").agg(
        F.max("quarter").alias("quarter"), F.max_by("value", "quarter").alias("value")
    )


@query("component_share", """
    SELECT entity_id, component, quarter, value / sum(value) OVER (PARTITION BY entity_id, quarter) * 100 AS share FROM components""", "share")
def _(t):
    return stats.component_share(t.components, ["entity_id"]).drop("value")


@query("near_constant_columns", """
    SELECT entity_id, series_id FROM (SELECT entity_id, series_id, CASE WHEN series_id IN ('n3', 'n8') THEN 1.0 ELSE value END AS value FROM dense)
    GROUP BY 1, 2 HAVING stddev_pop(value) IS NULL OR stddev_pop(value) < 1e-6""")
def _(t):
    flat = F.when(F.col("series_id").isin("n3", "n8"), 1.0).otherwise(F.col("value"))
    return stats.near_constant(t.dense.withColumn("value", flat)).drop("sd")


@query("collinear_pairs", """
    WITH twins AS (SELECT entity_id, series_id, period, value FROM dense
                   UNION ALL SELECT entity_id, series_id || 'b', period, -2 * value + 1000 * (month(period) % 2) FROM dense),
    c AS (SELECT entity_id, series_id, period, coalesce(value - avg(value) OVER (PARTITION BY entity_id, series_id), 0) AS v FROM twins)
    SELECT a.entity_id, a.series_id AS series_a, b.series_id AS series_b, abs(corr(a.v, b.v)) AS corr
    FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.period = b.period AND a.series_id < b.series_id
    GROUP BY 1, 2, 3 HAVING abs(corr(a.v, b.v)) >= 0.95""", "corr")
def _(t):
    mirrored = -2 * F.col("value") + 1000 * (F.month("period") % 2)
    twins = t.dense.unionByName(
        t.dense.withColumn("series_id", F.concat("series_id", F.lit("b"))).withColumn("value", mirrored)
    )
    return selection.collinear_pairs(twins, 0.95)


TWINS = """
    WITH twins AS (SELECT entity_id, series_id, period, value FROM dense
                   UNION ALL SELECT entity_id, series_id || 'b', period, -2 * value + 1000 * (month(period) % 2) FROM dense
                   UNION ALL SELECT entity_id, series_id || 'c', period, value FROM dense
                   UNION ALL SELECT entity_id, series_id || 'm', period, -value FROM dense),
    c AS (SELECT entity_id, series_id, period, coalesce(value - avg(value) OVER (PARTITION BY entity_id, series_id), 0) AS v FROM twins),
    s AS (SELECT entity_id, series_id FROM c GROUP BY 1, 2 HAVING sum(v * v) > 1e-24),
    l AS (SELECT a.entity_id, a.series_id, b.series_id AS other, corr(a.v, b.v) AS r FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.period = b.period AND a.series_id <> b.series_id
      GROUP BY 1, 2, 3 HAVING abs(corr(a.v, b.v)) >= 0.95)"""


def twins(t):
    """Every series beside a noisy mirrored copy, an exact copy and an exact mirrored one."""
    copies = {
        "": F.col("value"), "b": -2 * F.col("value") + 1000 * (F.month("period") % 2), "c": F.col("value"), "m": -F.col("value"),
    }
    each = F.array(*[F.struct(F.concat("series_id", F.lit(tail)).alias("series_id"), v.cast("double").alias("value")) for tail, v in copies.items()])
    return t.dense.select("entity_id", "period", F.inline(each))


@query("collinear_members", f"""{TWINS}
    SELECT s.entity_id, s.series_id, least(s.series_id, min(CASE WHEN r > 1 - 1e-10 THEN other END)) AS representative, count(l.other) AS n_links
    FROM s LEFT JOIN l ON l.entity_id = s.entity_id AND l.series_id = s.series_id GROUP BY 1, 2""")
def _(t):
    return selection.collinear_members(twins(t), 0.95)


@query("collinear_max", """
    WITH c AS (SELECT entity_id, series_id, period, value - avg(value) OVER (PARTITION BY entity_id, series_id) AS v FROM scaled_region),
    p AS (SELECT a.entity_id, a.series_id AS series_a, b.series_id AS series_b, abs(corr(a.v, b.v)) AS max_corr FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.period = b.period AND a.series_id < b.series_id GROUP BY 1, 2, 3)
    SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY max_corr DESC) = 1""", "max_corr")
def _(t):
    return selection.max_correlation(region_scaled(t), REGIONS)


@query("moment_matrix", """
    WITH v AS (SELECT period, series_id, entity_id, value, lag(value) OVER (PARTITION BY entity_id, series_id ORDER BY period) AS prev FROM scaled_region),
    z AS (SELECT entity_id, period, CASE series_id WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS k, value, prev FROM v),
    f AS (SELECT entity_id, period FROM z GROUP BY 1, 2 HAVING count(value) = 5 AND count(prev) = 5),
    l AS (SELECT z.entity_id, z.period, k AS pos, value AS v FROM z JOIN f ON f.entity_id = z.entity_id AND f.period = z.period
          UNION ALL SELECT z.entity_id, z.period, k + 5, prev FROM z JOIN f ON f.entity_id = z.entity_id AND f.period = z.period)
    SELECT a.entity_id, a.pos AS i, b.pos AS j, sum(a.v * b.v) AS s FROM l a JOIN l b ON a.entity_id = b.entity_id AND a.period = b.period AND a.pos <= b.pos
    GROUP BY 1, 2, 3""", "s")
def _(t):
    rows = selection.design_rows(region_scaled(t), REGIONS, 1)
    return selection.moment_matrix(rows.withColumn("v", F.concat("y", "x")))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def region_scaled(t):
    """Standardised log changes of the five regions of every segment, gaps set to 0."""
    change = transforms.transform_series(t.region_dense, transforms.MOM)
    z = transforms.standardize(change).drop("mu", "sigma")
    first = t.region_panel.select(F.min("period")).scalar()
    return z.filter(F.col("period") > first).withColumn("value", F.coalesce("value", F.lit(0.0)))


@query("leaderboard_rollup", """
    WITH h AS (SELECT *, (year(run_date) * 12 + month(run_date)) - (CAST(substr(target_quarter, 1, 4) AS INTEGER) * 12 + CAST(right(target_quarter, 1) AS INTEGER) * 3 - 2) AS g
               FROM pairs WHERE pred IS NOT NULL AND actual IS NOT NULL)
    SELECT metric, model, horizon, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) ** 2)) AS rmse, count(*) AS n
    FROM (SELECT *, CASE WHEN g < 0 THEN 'forecast' WHEN g <= 2 THEN 'm' || (g + 1) ELSE 'backcast' END AS horizon FROM h)
    GROUP BY GROUPING SETS ((model), (model, horizon), (metric, model), ())""", "mae rmse")
def _(t):
    from tidecast.operators import metrics

    return metrics.leaderboard_rollup(t.pairs)


@query("distinct_targets", "SELECT metric, count(DISTINCT target_quarter) AS n_targets FROM nowcasts GROUP BY 1")
def _(t):
    return t.nowcasts.groupBy("metric").agg(F.countDistinct("target_quarter").alias("n_targets"))


# --- sorts, limits, top-k -------------------------------------------------------------------


@query("recent_nowcasts", """
    SELECT run_date, target_quarter, metric, model, value FROM nowcasts WHERE value IS NOT NULL
    ORDER BY run_date DESC, metric, model, target_quarter LIMIT 30""", "value")
def _(t):
    order = [F.desc("run_date"), F.asc("metric"), F.asc("model"), F.asc("target_quarter")]
    return t.nowcasts.filter("value is not null").orderBy(*order).limit(30)


@query("latest_published_quarter", "SELECT metric, max(quarter) AS quarter FROM actuals WHERE first_value IS NOT NULL GROUP BY 1")
def _(t):
    return vintage.latest_published_quarter(t.actuals)


@query("nowcast_for_quarter", """
    SELECT target_quarter, metric, model, arg_max(value, run_date) AS value FROM nowcasts WHERE value IS NOT NULL GROUP BY 1, 2, 3""", "value")
def _(t):
    return t.nowcasts.filter("value is not null").groupBy("target_quarter", "metric", "model").agg(
        F.max_by("value", "run_date").alias("value")
    )


# --- set operations -------------------------------------------------------------------------


@query("union_pages", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def _(t):
    pages = [t.raw("orders").filter(F.col("o_orderkey") % 2 == i).select("o_orderkey", "o_totalprice") for i in (0, 1)]
    return pages[0].unionByName(pages[1])


@query("union_years", "SELECT series_id, ref_period, release_date FROM calendar")
def _(t):
    # a folder per year, as releases are landed; all of them are one scan
    path = scratch_path(t.spark, "calendar")
    t.calendar.withColumn("year", F.year("ref_period")).write.partitionBy("year").parquet(path)
    return readers.read_years(t.spark, path)


@query("union_log", """
    SELECT run_date, metric, model, value, NULL AS note FROM nowcasts WHERE model <> 'mean'
    UNION ALL SELECT run_date, metric, model, value, 'rerun' FROM nowcasts WHERE model = 'mean'""", "value")
def _(t):
    log = t.nowcasts.select("run_date", "metric", "model", "value")
    fresh = log.filter("model = 'mean'").withColumn("note", F.lit("rerun"))
    return log.filter("model <> 'mean'").unionByName(fresh, allowMissingColumns=True)


@query("intersect_series", "SELECT series_id FROM meta WHERE grp = 'ASIA' INTERSECT SELECT series_id FROM panel WHERE period >= DATE '2001-01-01'")
def _(t):
    return t.meta.filter("grp = 'ASIA'").select("series_id").intersect(
        t.panel.filter(F.col("period") >= F.lit("2001-01-01").cast("date")).select("series_id")
    )


@query("except_dropped", """
    SELECT entity_id, series_id FROM panel EXCEPT
    SELECT entity_id, series_id FROM trans WHERE value IS NOT NULL GROUP BY 1, 2 HAVING min(period) <= DATE '1995-03-01'""")
def _(t):
    span = stats.valid_span(t.trans).filter(F.col("first_period") <= F.lit("1995-03-01").cast("date"))
    return t.panel.select(*KEYS).distinct().join(span, KEYS, "left_anti")


# --- scalar functions -----------------------------------------------------------------------


@query("horizon_bucket", """
    SELECT run_date, target_quarter, metric, model, CASE WHEN g < 0 THEN 'forecast' WHEN g <= 2 THEN 'm' || (g + 1) ELSE 'backcast' END AS horizon
    FROM (SELECT *, (year(run_date) * 12 + month(run_date)) - (CAST(substr(target_quarter, 1, 4) AS INTEGER) * 12 + CAST(right(target_quarter, 1) AS INTEGER) * 3 - 2) AS g FROM nowcasts)""")
def _(t):
    return t.nowcasts.select(
        "run_date", "target_quarter", "metric", "model",
        cal.horizon_bucket(F.col("run_date"), F.col("target_quarter")).alias("horizon"),
    )


@query("resolve_target_quarter", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2002-Q1' ELSE year(o_orderdate) || '-Q' || quarter(o_orderdate) END AS target_quarter FROM orders""")
def _(t):
    stamped = F.when(F.col("o_orderkey") % 3 == 0, "2002-Q1").when(F.col("o_orderkey") % 3 == 1, "")
    return t.raw("orders").select("o_orderkey", cal.resolve_target_quarter(stamped, F.col("o_orderdate")).alias("target_quarter"))


@query("error_badge", """
    SELECT run_date, target_quarter, metric, model, CASE WHEN abs(pred - actual) < 1 THEN 'excellent' WHEN abs(pred - actual) < 2 THEN 'good' ELSE 'fair' END AS badge,
           CASE WHEN pred > 1e-6 THEN 'up' WHEN pred < -1e-6 THEN 'down' ELSE 'flat' END AS direction FROM pairs""")
def _(t):
    return t.pairs.select(
        "run_date", "target_quarter", "metric", "model",
        num.error_badge(F.abs(F.col("pred") - F.col("actual"))).alias("badge"), num.direction(F.col("pred")).alias("direction"),
    )


@query("normalise_leaderboard_row", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value + 1 END AS mae,
           CASE WHEN value <= 1 THEN value * 100 ELSE value END AS fda
    FROM events WHERE event_type <> 'error'""", "mae fda")
def _(t):
    e, k = t.raw("events"), F.col("event_id") % 3
    rows = e.select(
        "event_id", F.col("event_type").alias("model"),
        F.when(k == 0, F.concat(F.col("value").cast("string"), F.lit("%"))).otherwise("n/a").alias("MAE (pp)"),
        F.when(k == 1, (F.col("value") + 1).cast("string")).alias("MAE"),
        F.col("value").cast("string").alias("FDA (%)"),
    )
    fda = num.to_number(F.col("FDA (%)"))
    return rows.filter(F.col("model") != "error").select(
        "event_id", num.first_number(F.col("MAE (pp)"), F.col("MAE")).alias("mae"),
        F.when(fda <= 1, fda * 100).otherwise(fda).alias("fda"),
    )


@query("safe_log_floor", "SELECT c_custkey, ln(greatest(c_acctbal, 1e-12)) AS v FROM customer", "v")
def _(t):
    return t.raw("customer").select("c_custkey", num.floored_log(F.col("c_acctbal")).alias("v"))


@query("clip_state", """
    SELECT o_orderkey, greatest(least(o_totalprice * 10 - 500000, 1e6), -1e6) AS z, greatest(least(o_totalprice * 100000 - 1e9, 1e10), 0) AS v FROM orders""", "z:2 v:2")
def _(t):
    p = F.col("o_totalprice")
    return t.raw("orders").select(
        "o_orderkey", num.clip_state(p * 10 - 500000).alias("z"), num.clip_variance(p * 100000 - 1e9).alias("v")
    )


@query("json_attributes", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type AS back FROM events""")
def _(t):
    packed = F.to_json(F.map_from_entries(F.array(F.struct(F.lit("type"), F.col("event_type")))))
    back = F.from_json("packed", "map<string,string>")["type"]
    return t.raw("events").withColumn("packed", packed).select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), back.alias("back")
    )
