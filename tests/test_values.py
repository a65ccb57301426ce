"""Hand-computed values on small panels."""

import datetime as dt
import math

import numpy as np
import pytest
from conftest import long_panel, values
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.functions import numeric as num
from tidecast.operators import bands, ensemble, forecasts, grid, impute, metrics, stats, transforms, vintage
from tidecast.plans import daily

NAN = float("nan")


def col(*xs):
    return np.array(xs, float)[:, None]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_quarter_labels(spark):
    d = F.lit("2026-05-10").cast("date")
    assert one(spark, cal.quarter_label(d)) == "2026-Q2"
    assert one(spark, cal.quarter_display(F.lit("2026-Q2"))) == "Q2 2026"
    assert one(spark, cal.quarter_from_display(F.lit("Q2 2026"))) == "2026-Q2"
    assert one(spark, cal.parse_quarter(F.lit("2026-Q2"))) == dt.date(2026, 4, 1)
    assert one(spark, cal.parse_quarter(F.lit("soon"))) is None
    assert one(spark, cal.quarter_end_month(d)) == dt.date(2026, 6, 1)


@pytest.mark.parametrize("run,bucket", [
    ("2026-03-31", "forecast"), ("2026-04-01", "m1"), ("2026-05-31", "m2"), ("2026-06-01", "m3"), ("2026-07-01", "backcast"),
])
def test_horizon(spark, run, bucket):
    assert one(spark, cal.horizon_bucket(F.lit(run).cast("date"), F.lit("2026-Q2"))) == bucket


def test_horizon_unknown(spark):
    assert one(spark, cal.horizon_bucket(F.lit("2026-03-31").cast("date"), F.lit("x"))) == "unknown"


def test_transforms(spark):
    p = long_panel(spark, col(100, 102, 105))
    assert values(transforms.transform_series(p, transforms.MOM)) == pytest.approx([None, math.log(1.02), math.log(105 / 102)])
    assert values(transforms.transform_series(p, transforms.DIFF)) == pytest.approx([None, 2, 3])
    assert values(transforms.transform_series(p, transforms.QOQ_ANN)) == pytest.approx([None, 3 * math.log(1.02), 3 * math.log(105 / 102)])
    q = transforms.transform_series(p, transforms.QOQ_ANN, "quarterly")
    assert values(q) == pytest.approx([None, math.log(1.02), math.log(105 / 102)])
    year = long_panel(spark, col(*range(100, 113)))
    assert values(transforms.transform_series(year, transforms.YOY))[12] == pytest.approx(math.log(1.12))
    five = long_panel(spark, col(100, 1, 1, 1, 110))
    assert values(transforms.transform_series(five, transforms.YOY, "quarterly"))[4] == pytest.approx(math.log(1.1))


def test_gap_and_floor(spark):
    p = long_panel(spark, col(100, NAN, 105, 0.0))
    out = values(transforms.transform_series(p, transforms.MOM))
    assert out[1] is None and out[2] is None
    assert out[3] == pytest.approx(math.log(1e-12) - math.log(105))


def test_standardize_flat(spark):
    p = long_panel(spark, np.column_stack([[1.0, 2, 3], [5.0, 5, 5], [NAN, NAN, NAN]]))
    z = transforms.standardize(p)
    assert values(z) == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert values(z, "s01") == [0, 0, 0]
    assert values(z, "s02") == [None, None, None]


def test_growth_to_level(spark):
    g = long_panel(spark, col(0.04, 0.04))
    out = transforms.growth_to_level(g, F.lit(100.0), ["entity_id", "series_id"]).orderBy("period").collect()
    assert [r["level"] for r in out] == pytest.approx([101, 102.01])
    bad = transforms.growth_to_level(long_panel(spark, col(-8.0, -8.0)), F.lit(100.0), ["entity_id"]).orderBy("period")
    assert [r["level"] for r in bad.collect()] == pytest.approx([-100, 100])


def test_quarter_aggregation(spark):
    p = long_panel(spark, col(1, 2, 3, 4, NAN, 6, 7))
    by = lambda m: [r["value"] for r in grid.agg_quarter(p, m).orderBy("quarter").collect()]
    assert by("last") == [3, 6]
    assert by("mean") == [2, 5]
    assert by("sum") == [6, 10]
    cut = grid.agg_quarter(p.filter("period > '2010-01-01'"), "mean").orderBy("quarter").collect()
    assert [r["value"] for r in cut] == [None, 5]


def test_mariano_murasawa(spark):
    out = values(grid.agg_mariano_murasawa(long_panel(spark, col(1, 1, 1, 1, 1, NAN))))
    assert out[:4] == [None] * 4 and out[4:] == [9, 8]


def test_blocks_round_trip(spark):
    p = long_panel(spark, col(1, 2, NAN, 4, 5))
    lo, hi = (p.select(f("period")).scalar() for f in (F.min, F.max))
    back = grid.unblock_quarters(grid.quarter_blocks(p), lo, hi)
    assert values(back) == [1, 2, None, 4, 5]


def test_align_keeps_gaps(spark):
    p = long_panel(spark, col(1, NAN, 3)).filter("value is not null")
    assert values(grid.align_to_grid(p)) == [1, None, 3]
    assert values(grid.align_to_grid(p, horizon=2)) == [1, None, 3, None, None]


def test_imputation(spark):
    p = long_panel(spark, col(NAN, 1, NAN, 3, NAN))
    assert values(impute.forward_fill(p)) == [None, 1, 1, 3, 3]
    assert values(impute.backfill_leading(p)) == [1, 1, None, 3, None]
    assert values(impute.impute_linear(p)) == [1, 1, 2, 3, 3]
    assert values(impute.impute_linear_no_leak(p)) == [None, 1, 2, 3, None]
    assert values(impute.impute_block(p)) == [0, 1, 2, 3, 3]
    lone = long_panel(spark, col(NAN, 1, NAN))
    assert values(impute.impute_linear(lone)) == [None, 1, None]
    assert values(impute.impute_block(lone)) == [None, 1, 1]


def test_spline_is_exact_on_a_cubic(spark):
    t = np.arange(12.0)
    y = 0.1 * t**3 - t**2 + 2 * t
    x = y.copy()
    x[[3, 6, 7]] = NAN
    assert values(impute.impute_spline(long_panel(spark, x[:, None]))) == pytest.approx(list(y))
    short = long_panel(spark, col(1, NAN, 3))
    assert values(impute.impute_spline(short)) == [1, 2, 3]


def test_outliers(spark):
    p = long_panel(spark, col(1, 2, 3, 2, 1, 2, 1000))
    assert values(impute.outlier_mad(p))[-1] is None
    assert values(impute.outlier_mad(long_panel(spark, col(1, 2, 1000)))) == [1, 2, 1000]


def test_shock_modes(spark):
    p = long_panel(spark, col(*range(12)), start="2020-01-01")
    masked = values(impute.correct_shock(p, 2))
    assert masked[0] == 0 and masked[1:9] == [None] * 8 and masked[9:] == [9, 10, 11]
    assert values(impute.correct_shock(p, 1)) == list(range(12))
    late = long_panel(spark, col(1, 2, 3), start="2020-04-01")
    assert values(impute.mask_period(late)) == [1, 2, 3]
    with pytest.raises(ValueError):
        impute.correct_shock(p, 9)


def test_publication_lag(spark):
    x = np.full((10, 3), 1.0)
    x[7:, 1] = NAN
    x[:, 2] = NAN
    out = {r["series_id"]: r["lag_months"] for r in stats.publication_lag(long_panel(spark, x)).collect()}
    assert out == {"s00": 0, "s01": 3, "s02": 10}


def pairs(spark, actual, pred):
    rows = [("m", i, a, p) for i, (a, p) in enumerate(zip(actual, pred))]
    return spark.createDataFrame(rows, "model string, t int, actual double, pred double")


def test_metrics(spark):
    p = pairs(spark, [1.0, 2.0, None, 4.0], [1.5, 1.0, 3.0, 4.0])
    row = metrics.score_nowcasts(p, ["model"], ["t"]).first()
    assert (row["mae"], row["n"]) == (0.5, 3)
    assert row["rmse"] == pytest.approx(math.sqrt((0.25 + 1) / 3))
    assert row["fda"] == 0.5
    assert p.agg(metrics.bias()).first()[0] == pytest.approx((0.5 - 1 + 0) / 3)


def test_fda_ties(spark):
    # the actual does not move at 1 (dropped); the prediction does not move at 2 (wrong)
    p = pairs(spark, [1.0, 1.0, 2.0, 3.0], [1.0, 2.0, 2.0, 3.0])
    assert metrics.with_turns(p, ["model"], ["t"]).agg(metrics.fda()).first()[0] == 0.5


def test_mase(spark):
    p = pairs(spark, [1.0, 2.0, 3.0, 4.0], [1.5, 2.5, 3.5, 4.5])
    assert metrics.mase(p, ["model"], ["t"]).first()["mase"] == 0.5
    flat = pairs(spark, [1.0, 1.0, 1.0], [1.0, 2.0, 1.0])
    assert metrics.mase(flat, ["model"], ["t"]).first()["mase"] is None


def test_crps(spark):
    rng = np.random.default_rng(0)
    draws, actual = rng.normal(size=300), 0.4
    df = spark.createDataFrame([("k", actual, float(d)) for d in draws], "k string, actual double, draw double")
    got = metrics.crps_ensemble(df, ["k"]).first()["crps"]
    want = np.abs(draws - actual).mean() - 0.5 * np.abs(draws[:, None] - draws[None]).mean()
    assert got == pytest.approx(want)
    z = spark.createDataFrame([(0.0, 0.0, 1.0)], "a double, m double, s double").select(num.crps_normal("a", "m", "s"))
    assert z.first()[0] == pytest.approx((math.sqrt(2) - 1) / math.sqrt(math.pi))


@pytest.mark.parametrize("method,preds,want", [
    ("median", [5.0, 3.0, 4.0], 4.0), ("mean", [5.0, 3.0, None], 4.0), ("trimmed", [1.0, 2.0, 9.0], 2.0), ("trimmed", [1.0, 3.0], 2.0),
    ("direction_vote", [1.0, 3.0, -10.0], 2.0), ("direction_vote", [1.0, -3.0], 1.0), ("direction_vote", [0.0, 0.0], 0.0), ("median", [None], None),
])
def test_ensembles(spark, method, preds, want):
    df = spark.createDataFrame([("q", f"m{i}", p) for i, p in enumerate(preds)], "q string, model string, pred double")
    assert ensemble.combine(df, ["q"], method).first()["pred"] == want


def test_weights_use_the_past_only(spark):
    rows = [("e", t, m, p, 0.0) for t in range(5) for m, p in (("good", 0.1), ("bad", 2.0))]
    h = spark.createDataFrame(rows, "e string, t int, model string, pred double, actual double")
    out = {r["t"]: r["pred"] for r in ensemble.combine_weighted(h, ["e"], "t").collect()}
    wg, wb = 1 / (0.01 + 0.01), 1 / (4 + 0.01)
    assert out[2] == pytest.approx(1.05)
    assert out[3] == pytest.approx((0.1 * wg + 2 * wb) / (wg + wb))
    later = h.withColumn("actual", F.when(F.col("t") == 4, 50.0).otherwise(F.col("actual")))
    assert {r["t"]: r["pred"] for r in ensemble.combine_weighted(later, ["e"], "t").collect()} == out


def test_freeze(spark):
    feed = [("2024-Q1", "gdp", d, v, b) for d, v, b in [
        (dt.date(2024, 6, 1), 2.3456, 2015), (dt.date(2024, 5, 1), 2.0004, 2015), (dt.date(2024, 9, 1), 3.0, 2020), (dt.date(2024, 4, 1), None, 2015)]]
    df = spark.createDataFrame(feed, "quarter string, metric string, seen_date date, value double, base_year int")
    row = vintage.freeze_first_release(df).first()
    assert (row["first_value"], row["latest_value"], row["base_year"], row["base_changed"]) == (2.0, 3.0, 2015, True)
    state = vintage.freeze_first_release(df.filter("seen_date < '2024-06-01'")).drop("base_changed")
    merged = vintage.merge_actuals(state, df.filter("seen_date >= '2024-06-01'")).first()
    assert (merged["first_value"], merged["latest_value"], merged["last_update_date"]) == (2.0, 3.0, dt.date(2024, 9, 1))


def test_vintage_stops_at_the_first_published_cell(spark):
    p = long_panel(spark, col(1, 2, 3, 4)).withColumn("release_date", F.expr(
        "case when period = date'2010-02-01' then date'2010-12-31' else add_months(period, 1) end"))
    v = F.array(F.lit("2010-04-15").cast("date"))
    assert values(vintage.build_vintages(p, v)) == [1, 2, 3, None]
    strict = vintage.build_vintages_strict(p, v)
    assert sorted(r["value"] for r in strict.collect()) == [1, 3]


def test_vintage_ignores_the_future(spark):
    p = long_panel(spark, col(*range(12))).withColumn("release_date", F.add_months("period", 2))
    v = vintage.vintage_dates("2010-06-01", "2010-06-01", 1, 15)
    changed = p.withColumn("value", F.when(F.col("release_date") > "2010-06-15", -99.0).otherwise(F.col("value")))
    assert values(vintage.build_vintages(p, v)) == values(vintage.build_vintages(changed, v))


def test_vintage_diff(spark):
    old = long_panel(spark, col(1, 2, NAN, 4, NAN))
    new = long_panel(spark, col(1, 2.5, 3, NAN, NAN))
    out = vintage.vintage_diff(old, new).orderBy("period").collect()
    assert [r["status"] for r in out] == ["same", "revised", "added", "removed", "same"]


def test_ar1(spark):
    x = [1.0]
    for _ in range(20):
        x.append(0.5 + 0.8 * x[-1])
    p = long_panel(spark, col(*x))
    out = forecasts.ar1_forecast(p, ["entity_id"], "period").first()
    assert out["pred"] == pytest.approx(0.5 + 0.8 * x[-1])
    preds = [r["pred"] for r in forecasts.expanding_ar1(p, ["entity_id"], "period").orderBy("period").collect()]
    assert preds[:12] == [None] * 12 and preds[12] == pytest.approx(x[12])


def test_as_of_is_strict(spark):
    d = dt.date
    v = spark.createDataFrame([("k", d(2020, 1, 5), 1.0), ("k", d(2020, 3, 5), 2.0), ("k", d(2020, 4, 1), None)], "k string, day date, value double")
    q = spark.createDataFrame([("k", x, i) for i, x in enumerate([d(2020, 1, 5), d(2020, 1, 6), d(2020, 3, 5), d(2020, 3, 6), d(2021, 7, 1)])], "k string, day date, i int")
    out = forecasts.last_known_before(v, q, ["k"], "day").orderBy("i").collect()
    assert [r["last_value"] for r in out] == [None, 1, 1, 2, 2]


def test_bands(spark):
    row = [([1.0, 2.0], [0.5, 0.5], [1.0, 0.2, 0.2, 2.0], 0.3, 10.0, 2.0)]
    df = spark.createDataFrame(row, "c array<double>, z array<double>, v array<double>, r double, mu double, sigma double")
    var = 1 + 2 * 2 * 0.2 + 4 * 2
    b = bands.confidence_bands(df).first()
    assert b["central"] == 1.5
    assert b["upper"] - b["central"] == pytest.approx(0.994457883 * math.sqrt(var + 1e-10))
    f = bands.dfm_fan(df).first()
    assert f["mean"] == 13 and f["std"] == pytest.approx(2 * math.sqrt(var + 0.3))
    assert f["p10"] < f["p25"] < f["p50"] == f["mean"] < f["p75"] < f["p90"]


def test_bootstrap_is_reproducible(spark):
    p = long_panel(spark, np.cumsum(np.random.default_rng(1).normal(size=30))[:, None]).drop("series_id")
    first, second = (bands.bootstrap_bands(p.repartition(n), ["entity_id"], 50).orderBy("period").collect() for n in (1, 5))
    assert first == second
    assert all(r["lower"] <= r["upper"] for r in first)


def test_upsert_and_backfill(spark):
    log = spark.createDataFrame([("d1", 1, 1.0), ("d2", 1, 2.0)], "run_date string, loaded int, a double")
    new = spark.createDataFrame([("d2", 2, 5.0, 9.0)], "run_date string, loaded int, a double, b double")
    out = {r["run_date"]: (r["a"], r["b"]) for r in daily.upsert_log(log, new, ["run_date"], "loaded").collect()}
    assert out == {"d1": (1.0, None), "d2": (5.0, 9.0)}


def test_identity(spark):
    df = spark.createDataFrame([(10.0, 10.0, 10.0, 10.0, 20.0, 1.0, 2.0, 3.0, 4.0, 5.0)],
                               "c double, i double, g double, x double, m double, c_g double, i_g double, g_g double, x_g double, total_g double")
    assert stats.identity_residual(df).first()["imports_identity"] == pytest.approx((100 - 20 * 5) / 20)


def test_group_subset_falls_back(spark):
    meta = spark.createDataFrame([(f"s{i}", g) for i, g in enumerate("aaab")], "series_id string, grp string")
    wanted = spark.createDataFrame([("x", ["a"]), ("y", ["b"]), ("z", ["none"])], "target string, groups array<string>")
    out = stats.select_group_subset(meta, wanted).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in out} == {"x": 3, "y": 4, "z": 4}
