"""The test tables in the shapes the operators take, on Spark and as SQL.

``Tables`` derives the panel, registry, release calendar, targets, nowcast log
and actuals from the TPC-H-like tables. ``CTES`` states the same derivations
for the checking engine. Amounts are summed as decimals so that both sides
start from identical doubles.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import forecasts, grid, transforms, vintage

EXACT_FROM = "1998-01-01"
VINTAGES = ("1999-02-01", "2001-05-01", 3, 15)  # start, end, months apart, day
RUN_OFFSETS = (-20, 14, 45, 75, 110)  # days from the quarter start to a run
MODELS = ("ar1", "mean", "naive")

CTES = {
    "panel": """
        SELECT c_mktsegment AS entity_id, 'n' || c_nationkey AS series_id,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "region_panel": """
        SELECT c_mktsegment AS entity_id, r_name AS series_id,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "months": """
        SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period
        FROM (SELECT min(period) AS lo, max(period) AS hi FROM panel)""",
    "dense": """
        SELECT s.entity_id, s.series_id, m.period, p.value
        FROM (SELECT DISTINCT entity_id, series_id FROM panel) s CROSS JOIN months m
        LEFT JOIN panel p ON p.entity_id = s.entity_id AND p.series_id = s.series_id AND p.period = m.period""",
    "logdense": """
        SELECT entity_id, series_id, period, ln(value) AS value FROM dense""",
    "meta": """
        SELECT 'n' || n_nationkey AS series_id, n_name AS name, r_name AS grp, 'monthly' AS freq,
               CAST(n_nationkey % 5 AS INTEGER) AS transform,
               CAST(8 + (n_nationkey * 7) % 50 AS INTEGER) AS pub_lag_days
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "calendar": """
        SELECT 'n' || c_nationkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ref_period,
               last_day(o_orderdate) + CAST(8 + (c_nationkey * 7) % 50 + 3 + o_orderkey % 5 AS INTEGER) AS release_date
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "earliest": """
        SELECT series_id, ref_period, min(release_date) AS release_date FROM calendar GROUP BY 1, 2""",
    "dated": """
        SELECT d.entity_id, d.series_id, d.period, d.value,
               coalesce(e.release_date, last_day(d.period) + m.pub_lag_days) AS release_date
        FROM dense d LEFT JOIN earliest e ON e.ref_period >= DATE '1998-01-01' AND e.series_id = d.series_id AND e.ref_period = d.period
        LEFT JOIN meta m ON m.series_id = d.series_id""",
    "vintages": """
        SELECT CAST(unnest(generate_series(DATE '1999-02-15', DATE '2001-05-15', INTERVAL 3 MONTH)) AS DATE)
               AS vintage_date""",
    "vpanel": """
        SELECT entity_id, series_id, period, vintage_date,
               CASE WHEN period <= max(CASE WHEN value IS NOT NULL AND release_date <= vintage_date THEN period END)
                    OVER (PARTITION BY entity_id, series_id, vintage_date) THEN value END AS value
        FROM dated CROSS JOIN vintages""",
    "quarterly": """
        SELECT c_mktsegment AS entity_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter,
               l_returnflag AS flag,
               sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2, 3""",
    "target": """
        SELECT entity_id, quarter, CAST(sum(revenue) AS DOUBLE) AS value FROM quarterly GROUP BY 1, 2""",
    "components": """
        SELECT entity_id, flag AS component, quarter, CAST(revenue AS DOUBLE) AS value FROM quarterly""",
    "growth": """
        SELECT entity_id, quarter, 100 * (ln(value) - ln(prev)) AS value FROM (
          SELECT *, lag(value) OVER (PARTITION BY entity_id ORDER BY quarter) AS prev FROM target)
        WHERE prev > 0""",
    "preds": """
        SELECT entity_id, quarter, 'naive' AS model, lag(value) OVER w AS pred, value AS actual FROM growth
          WINDOW w AS (PARTITION BY entity_id ORDER BY quarter)
        UNION ALL
        SELECT entity_id, quarter, 'mean', avg(value) OVER (PARTITION BY entity_id ORDER BY quarter
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value FROM growth
        UNION ALL
        SELECT entity_id, quarter, 'ar1', CASE WHEN rn > 6 AND n >= 4 THEN a + b * lv END, value FROM (
          SELECT *, regr_slope(value, lv) OVER w AS b, regr_intercept(value, lv) OVER w AS a, count(lv) OVER w AS n
          FROM (SELECT *, lag(value) OVER (PARTITION BY entity_id ORDER BY quarter) AS lv,
                       row_number() OVER (PARTITION BY entity_id ORDER BY quarter) AS rn FROM growth)
          WINDOW w AS (PARTITION BY entity_id ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "nowcasts": """
        SELECT CAST(quarter + off AS DATE) AS run_date, year(quarter) || '-Q' || quarter(quarter) AS target_quarter,
               entity_id AS metric, model, pred * (1 + 0.02 * i) AS value
        FROM preds, (VALUES (0, -20), (1, 14), (2, 45), (3, 75), (4, 110)) AS o(i, off)""",
    "feed": """
        SELECT year(quarter) || '-Q' || quarter(quarter) AS quarter, entity_id AS metric,
               CAST(last_day(quarter + INTERVAL 2 MONTH) + 30 * k AS DATE) AS seen_date,
               100 * (ln(v) - ln(lag(v) OVER (PARTITION BY entity_id, k ORDER BY quarter))) AS value,
               CASE WHEN quarter < DATE '1998-01-01' OR k < 3 THEN 1995 ELSE 2000 END AS base_year
        FROM (SELECT entity_id, quarter, k,
                     CAST(sum(CASE WHEN flag <= substr('ANZ', k, 1) THEN revenue END) AS DOUBLE) AS v
              FROM quarterly, (VALUES (1), (2), (3)) AS r(k) GROUP BY 1, 2, 3)""",
    "actuals": """
        SELECT quarter, metric, min(seen_date) AS first_release_date, arg_min(round(value, 3), seen_date) AS first_value,
               arg_max(round(value, 3), seen_date) AS latest_value, max(seen_date) AS last_update_date,
               CAST(arg_min(base_year, seen_date) AS INTEGER) AS base_year
        FROM feed WHERE value IS NOT NULL GROUP BY 1, 2""",
    "pairs": """
        SELECT n.run_date, n.target_quarter, n.metric, n.model, n.value AS pred, a.first_value AS actual
        FROM nowcasts n JOIN actuals a ON a.quarter = n.target_quarter AND a.metric = n.metric""",
    "trans": """
        SELECT entity_id, series_id, period,
          CASE transform WHEN 1 THEN lv - lag(lv) OVER w WHEN 2 THEN value - lag(value) OVER w
            WHEN 3 THEN 3 * (lv - lag(lv) OVER w) WHEN 4 THEN lv - lag(lv, 12) OVER w ELSE value END AS value
        FROM (SELECT dense.*, CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-12)) END AS lv, transform FROM dense JOIN meta USING (series_id))
        WINDOW w AS (PARTITION BY entity_id, series_id ORDER BY period)""",
    "stat": """
        SELECT entity_id, series_id, coalesce(avg(value), 0) AS mu,
               CASE WHEN stddev_pop(value) >= 1e-12 THEN stddev_pop(value) ELSE 1 END AS sigma
        FROM trans GROUP BY 1, 2""",
    "scaled": """
        SELECT t.entity_id, t.series_id, t.period, (t.value - s.mu) / s.sigma AS value
        FROM trans t JOIN stat s ON s.entity_id = t.entity_id AND s.series_id = t.series_id""",
    "region_bounds": """
        SELECT min(period) AS lo, max(period) AS hi FROM region_panel""",
    "region_dense": """
        SELECT s.entity_id, s.series_id, m.period, p.value
        FROM (SELECT DISTINCT entity_id, series_id FROM region_panel) s
        CROSS JOIN (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM region_bounds) m
        LEFT JOIN region_panel p ON p.entity_id = s.entity_id AND p.series_id = s.series_id AND p.period = m.period""",
    "scaled_region": """
        SELECT entity_id, series_id, period, coalesce((d - avg(d) OVER s) / CASE WHEN stddev_pop(d) OVER s >= 1e-12 THEN stddev_pop(d) OVER s ELSE 1 END, 0) AS value
        FROM (SELECT *, lv - lag(lv) OVER o AS d, lag(period) OVER o AS before
              FROM (SELECT *, CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-12)) END AS lv FROM region_dense)
              WINDOW o AS (PARTITION BY entity_id, series_id ORDER BY period))
        WINDOW s AS (PARTITION BY entity_id, series_id) QUALIFY before IS NOT NULL""",
    "daily": """
        SELECT event_type AS series_id, CAST(ts AS DATE) AS day, arg_max(value, ts) AS value
        FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
}


def with_ctes(body: str) -> str:
    """Put the common table expressions ``body`` needs, and those they need, in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in CTES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text, re.IGNORECASE):
                needed.add(name)
                visit(sql)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts},\n{body[len('WITH RECURSIVE'):]}"
    return f"WITH {parts},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {parts}\n{body}"


class Tables:
    """The derived tables of one scale, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        # event days are cut in UTC, as the checking engine does
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sales(self) -> DataFrame:
        orders = self.raw("orders").select("o_custkey", "o_totalprice", "o_orderdate")
        customer = self.raw("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
        return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            "c_mktsegment", "c_nationkey", cal.month_start(F.col("o_orderdate")).alias("period"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        return self._sales().groupBy(
            F.col("c_mktsegment").alias("entity_id"),
            F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("series_id"),
            "period",
        ).agg(F.sum("amount").cast("double").alias("value"))

    @cached_property
    def region_panel(self) -> DataFrame:
        where = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self._sales().join(where, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
            F.col("c_mktsegment").alias("entity_id"), F.col("r_name").alias("series_id"), "period"
        ).agg(F.sum("amount").cast("double").alias("value"))

    @cached_property
    def span(self):
        """First and last month, from the date column alone."""
        return grid.span_of(self.raw("orders"), "o_orderdate")

    @cached_property
    def dense(self) -> DataFrame:
        return grid.align_to_grid(self.panel, self.span["lo"], self.span["hi"])

    @cached_property
    def region_dense(self) -> DataFrame:
        return grid.align_to_grid(self.region_panel, self.span["lo"], self.span["hi"])

    @cached_property
    def meta(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("series_id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("grp"),
            F.lit("monthly").alias("freq"),
            (F.col("n_nationkey") % 5).alias("transform"),
            (8 + (F.col("n_nationkey") * 7) % 50).alias("pub_lag_days"),
        )

    @cached_property
    def region_meta(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_name").alias("series_id"), F.col("r_name").alias("grp"), F.lit(1).alias("transform"),
            (10 + 7 * F.col("r_regionkey")).alias("pub_lag_days"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customer = self.raw("customer").select("c_custkey", "c_nationkey")
        days = 8 + (F.col("c_nationkey") * 7) % 50 + 3 + F.col("o_orderkey") % 5
        return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("series_id"),
            cal.month_start(F.col("o_orderdate")).alias("ref_period"),
            F.date_add(F.last_day("o_orderdate"), days.cast("int")).alias("release_date"),
        )

    @cached_property
    def dated(self) -> DataFrame:
        # older months have no entry here, so that the publication lag stands in for it
        recent = self.calendar.filter(F.col("ref_period") >= F.lit(EXACT_FROM).cast("date"))
        return vintage.release_dates(self.dense, recent, self.meta)

    @property
    def vintages(self):
        return vintage.vintage_dates(*VINTAGES)

    @cached_property
    def vpanel(self) -> DataFrame:
        return vintage.build_vintages(self.dated, self.vintages)

    @cached_property
    def quarterly(self) -> DataFrame:
        line = self.raw("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag")
        amount = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        customer = self.raw("customer").select("c_custkey", "c_mktsegment")
        return (
            line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(
                F.col("c_mktsegment").alias("entity_id"),
                cal.quarter_start(F.col("l_shipdate")).alias("quarter"),
                F.col("l_returnflag").alias("flag"),
            )
            .agg(F.sum(amount).alias("revenue"))
        )

    @cached_property
    def target(self) -> DataFrame:
        return self.quarterly.groupBy("entity_id", "quarter").agg(F.sum("revenue").cast("double").alias("value"))

    @cached_property
    def components(self) -> DataFrame:
        return self.quarterly.select(
            "entity_id", F.col("flag").alias("component"), "quarter", F.col("revenue").cast("double").alias("value")
        )

    @cached_property
    def growth(self) -> DataFrame:
        rows = self.target.withColumnRenamed("quarter", "period")
        change = transforms.growth_dlog_rows(rows, ["entity_id"])
        return change.select("entity_id", F.col("period").alias("quarter"), (100 * F.col("value")).alias("value"))

    @cached_property
    def preds(self) -> DataFrame:
        g, keys = self.growth, ["entity_id"]
        made = {
            "naive": forecasts.naive_persistence(g, keys),
            "mean": forecasts.expanding_mean(g, keys),
            "ar1": forecasts.expanding_ar1(g, keys, start=6),
        }
        parts = [
            df.select("entity_id", "quarter", F.lit(m).alias("model"), "pred", F.col("value").alias("actual"))
            for m, df in made.items()
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @cached_property
    def nowcasts(self) -> DataFrame:
        runs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).alias("off")) for i, o in enumerate(RUN_OFFSETS)])
        return self.preds.select("*", F.inline(runs)).select(
            F.date_add("quarter", F.col("off")).alias("run_date"),
            cal.quarter_label(F.col("quarter")).alias("target_quarter"),
            F.col("entity_id").alias("metric"),
            "model",
            (F.col("pred") * (1 + 0.02 * F.col("i"))).alias("value"),
        )

    @cached_property
    def feed(self) -> DataFrame:
        """Three releases per quarter, each from more of the line items."""
        upto = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("upto")) for k, f in enumerate("ANZ", 1)])
        sums = (
            self.quarterly.select("*", F.inline(upto))
            .groupBy("entity_id", "quarter", "k")
            .agg(F.sum(F.when(F.col("flag") <= F.col("upto"), F.col("revenue"))).cast("double").alias("v"))
        )
        w = Window.partitionBy("entity_id", "k").orderBy("quarter")
        base = F.when((F.col("quarter") < F.lit("1998-01-01").cast("date")) | (F.col("k") < 3), 1995).otherwise(2000)
        return sums.select(
            cal.quarter_label(F.col("quarter")).alias("quarter"),
            F.col("entity_id").alias("metric"),
            F.date_add(F.last_day(F.add_months("quarter", 2)), 30 * F.col("k")).alias("seen_date"),
            (100 * (F.ln("v") - F.ln(F.lag("v").over(w)))).alias("value"),
            base.alias("base_year"),
        )

    @cached_property
    def actuals(self) -> DataFrame:
        return vintage.freeze_first_release(self.feed).drop("base_changed")

    @cached_property
    def pairs(self) -> DataFrame:
        from tidecast.operators import metrics

        return metrics.join_actuals(self.nowcasts, self.actuals)

    @cached_property
    def trans(self) -> DataFrame:
        return transforms.transform_panel(self.dense, self.meta)

    @cached_property
    def scaled(self) -> DataFrame:
        return transforms.standardize(self.trans).drop("mu", "sigma")

    @cached_property
    def daily(self) -> DataFrame:
        return self.raw("events").filter(F.col("value").isNotNull()).groupBy(
            F.col("event_type").alias("series_id"), F.to_date("ts").alias("day")
        ).agg(F.max_by("value", "ts").alias("value"))
