"""Systems given by data, sub-blocks of moments, weights of news, segmented windows, and one bad key among good ones."""

import numpy as np
import pandas as pd
import pytest
from conftest import factor_data, long_panel, months
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.operators import bridge, bvar, dfm, impute, metrics, news, segments, selection, systems
from tidecast.plans import nowcast

E = ["entity_id"]
SYSTEMS = {"u": ["a", "b", "y"], "v": ["c", "a", "d", "e", "z"]}


@pytest.fixture(scope="module")
def mixed(spark):
    """Two keys whose systems differ in variables, width and target; targets are seen at quarter ends."""
    rng = np.random.default_rng(11)
    panel = None
    for key, names in SYSTEMS.items():
        x, _, _ = factor_data(n_t=72, n=len(names), r=1, gaps=0.03, seed=len(names))
        x[-2:, 0] = np.nan
        x[-1, 1] = np.nan
        x[[i for i in range(72) if i % 3 != 2] + [71], -1] = np.nan
        part = long_panel(spark, x, names, key)
        # a variable of no system, which must not matter
        part = part.unionByName(long_panel(spark, rng.normal(size=(72, 1)), ["other"], key))
        panel = part if panel is None else panel.unionByName(part)
    return panel.cache()


@pytest.fixture(scope="module")
def members(spark):
    rows = [(k, s, i + 1) for k, names in SYSTEMS.items() for i, s in enumerate(names)]
    return spark.createDataFrame(rows, "entity_id string, series_id string, pos int")


def table(df, value="value"):
    return {tuple(str(r[c]) for c in df.columns if c != value): r[value] for r in df.collect()}


def same(a, b, tol=1e-9):
    assert a.keys() == b.keys() and len(a) > 0
    for k in a:
        assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], abs=tol, nan_ok=True), k


def test_place_and_names(mixed, members):
    placed = systems.place(mixed, members)
    assert {(r["entity_id"], r["n"]) for r in placed.select("entity_id", "n").distinct().collect()} == {("u", 3), ("v", 5)}
    named = systems.with_names(mixed.select(*E).distinct(), members).collect()
    assert {r["entity_id"]: r["names"] for r in named} == SYSTEMS
    assert {r["series_id"] for r in systems.target_rows(mixed, members).select("series_id").distinct().collect()} == {"y", "z"}
    spread_ = systems.spread_over(mixed.select(*E).distinct(), members)
    assert spread_.count() == 8


@pytest.mark.parametrize("blocks", [True, False])
def test_bvar_of_different_systems_equals_one_by_one(mixed, members, blocks):
    how = dict(p=1, tune=False, chains=1, draws=15, burn_in=5, blocks=blocks)
    together = table(bvar.bvar_fit(mixed, members, E, **how))
    alone = {}
    for key, names in SYSTEMS.items():
        alone |= table(bvar.bvar_fit(mixed.filter(F.col("entity_id") == key), names, E, **how))
    same(together, alone)


def test_beq_of_different_systems_equals_one_by_one(mixed, members):
    target = lambda df, order: nowcast.target_rows(df, order).filter(F.month("period") % 3 == 0).select(
        *E, F.trunc("period", "quarter").alias("quarter"), F.col("value").alias("y"))
    fit = lambda df, order: bridge.beq_fit(df, target(df, order), systems.indicators(order), E, 2).drop("y")
    together = table(fit(mixed, members), "fcst")
    alone = {}
    for key, names in SYSTEMS.items():
        alone |= table(fit(mixed.filter(F.col("entity_id") == key), names), "fcst")
    same(together, alone)


def test_model_paths_by_component(spark, mixed, members):
    specs = spark.createDataFrame([("u", 1, 1), ("v", 2, 1)], "entity_id string, n_factors int, n_lags int")
    how = dict(draws=10, beq_types=(bridge.VAR_ALL,), max_iter=5)
    together = table(nowcast.model_paths(mixed, members, E, specs=specs, **how))
    assert {k[1] for k in together} == {"dfm", "bvar", "beq"}
    alone = {}
    for (key, names), (r, p) in zip(SYSTEMS.items(), [(1, 1), (2, 1)]):
        alone |= table(nowcast.model_paths(mixed.filter(F.col("entity_id") == key), names, E, r=r, p=p, **how))
    same(together, alone, 1e-8)


def test_pairs_equal_their_own_systems(spark, mixed):
    panel = mixed.filter("entity_id = 'v' and series_id in ('a', 'c', 'd', 'e')")
    # a series that begins late, and one that is nowhere observed with another
    late = (F.col("series_id") == "d") & (F.col("period") < "2011-01-01")
    panel = panel.withColumn("value", F.when(~late, F.col("value")))
    empty = panel.filter("series_id = 'a'").withColumns({"series_id": F.lit("n"), "value": F.lit(None).cast("double")})
    panel = panel.unionByName(empty)
    names = ["a", "c", "d", "e", "n"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    asked = spark.createDataFrame([(f"{a}|{b}", a, b) for a, b in pairs], "spec_id string, m1 string, m2 string")
    got = table(bridge.extrapolate_pairs(panel, asked, E, 3))
    want = {}
    for a, b in pairs:
        own = panel.filter(F.col("series_id").isin(a, b)).withColumn("spec_id", F.lit(f"{a}|{b}"))
        own = own.withColumn("series_id", F.when(F.col("series_id") == a, "m1").otherwise("m2"))
        out = bridge.extrapolate_var(own, [*E, "spec_id"], ["m1", "m2"], 3)
        want |= table(out.select(*E, "spec_id", "series_id", "period", "value"))
    same(got, want)


# --- a bad key costs nobody else ----------------------------------------------------------------


def two_keys(spark, x, bad):
    return long_panel(spark, x, entity="good").unionByName(long_panel(spark, bad, entity="bad"))


def test_bridge_with_an_infinite_cell(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    bad = x.copy()
    bad[29, 0] = np.inf
    panel = two_keys(spark, x, bad)
    quarters = months(60)[::3]
    y = spark.createDataFrame([(k, d, float(v)) for k in ("good", "bad") for d, v in zip(quarters, x[2::3, 0] + 1)], "entity_id string, quarter date, y double")
    names = spark.createDataFrame([("s00",), ("s01",)], "series_id string")
    regressors = bridge.quarter_regressors(panel).withColumn("interp_type", F.lit(903))
    design = bridge.bridge_design(bridge.bridge_specs(names, (903,)), regressors, y)
    got = {(r["entity_id"], r["spec_id"]): r for r in bridge.bridge_ols(design, E).collect()}
    assert got["good", "903|s00"]["coef"][0] == pytest.approx(1.0) and got["good", "903|s00"]["reason"] is None
    assert got["bad", "903|s00"]["coef"] is None and got["bad", "903|s00"]["reason"] == "sums are not finite"
    # the lagged target is the lagged indicator plus the constant
    assert got["bad", "903|s01"]["coef"] is not None and got["good", "903|s00"]["rank"] == 3
    whole = bridge.bridge_median(bridge.beq_fit(panel, y, ["s00", "s01"], E, 2), E)
    assert {r["entity_id"] for r in whole.collect()} == {"good", "bad"}
    assert whole.filter("entity_id = 'good' and value is not null").count() >= 18


def test_lags_and_dummies_equal_least_squares(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 1))
    q = rng.normal(size=30)
    y = rng.normal(size=30)
    y[-1] = np.nan
    quarters = months(90)[::3]
    target = spark.createDataFrame([("e", d, None if np.isnan(v) else float(v)) for d, v in zip(quarters, y)], "entity_id string, quarter date, y double")
    at = np.r_[0.0, q[:-1]]
    extra = spark.createDataFrame([("e", "q1", d, float(v), float(w)) for d, v, w in zip(quarters, q, at)], "entity_id string, series_id string, quarter date, l0 double, l1 double")
    names = spark.createDataFrame([("s00",)], "series_id string")
    terms = bridge.Terms(2, 1, 2, 2)
    days = [quarters[9], quarters[12]]
    specs = bridge.bridge_specs(names, (903,), ["q1"]).withColumn("dummies", F.array(*[F.lit(d) for d in days]))
    regressors = bridge.quarter_regressors(long_panel(spark, x), lags=2).withColumn("interp_type", F.lit(903))
    design = bridge.bridge_design(specs, regressors, target, E, extra, terms)
    coef = {r["spec_id"]: dict(zip(terms.names(), r["coef"])) for r in bridge.bridge_ols(design, E, terms).collect()}["903|s00|q1"]
    m = x[2::3, 0]
    lag = lambda v, k: np.r_[np.zeros(k), v[: len(v) - k]]
    d = np.column_stack([m, lag(m, 1), lag(m, 2), q, at, np.r_[np.nan, np.nan, y[:-2]], [c == days[0] for c in quarters], [c == days[1] for c in quarters], np.ones(30)])
    ok = ~np.isnan(d).any(1) & ~np.isnan(y)
    want = np.linalg.lstsq(d[ok], y[ok], rcond=None)[0]
    used = ["m1_l0", "m1_l1", "m1_l2", "q_l0", "q_l1", "y_lag", "d1", "d2", "const"]
    assert [coef[c] for c in used] == pytest.approx(want.tolist())
    fcst = {r["quarter"]: r["fcst"] for r in bridge.bridge_forecast(design, bridge.bridge_ols(design, E, terms), E, terms).filter("spec_id = '903|s00|q1'").collect()}
    assert fcst[quarters[-1]] == pytest.approx(float(d[-1] @ want))
    # the same through the whole fit
    paths = bridge.beq_fit(long_panel(spark, x), target, ["s00"], E, 2, (903,), terms, [str(v) for v in days], extra)
    assert {r["quarter"]: r["fcst"] for r in paths.filter("spec_id = '903|s00|q1'").collect()}[quarters[-1]] == pytest.approx(float(d[-1] @ want))


def test_autoregression_spline_and_path_with_a_bad_key(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=(40, 1)), 0)
    x[-3:] = np.nan
    bad = x.copy()
    bad[10] = np.inf
    out = {(r["entity_id"], r["period"]): r["value"] for r in bridge.extrapolate_ar(two_keys(spark, x, bad), 2).collect()}
    end = months(40)[-1]
    assert out["good", end] is not None and not np.isnan(out["good", end])
    assert out["bad", end] is None or np.isnan(out["bad", end])
    gap, worse = x.copy(), bad.copy()
    gap[5], worse[5] = np.nan, np.nan
    filled = {(r["entity_id"], r["period"]): r["value"] for r in impute.impute_spline(two_keys(spark, gap, worse)).collect()}
    assert np.isfinite(filled["good", months(40)[5]]) and np.isinf(filled["bad", months(40)[10]])
    z = rng.normal(size=(30, 3))
    odd = z.copy()
    odd[3, 1] = np.inf
    xy = two_keys(spark, z, odd).withColumn("y", F.month("period").cast("double"))
    ranked = selection.rank_lars(xy, 3).groupBy("entity_id").count().collect()
    assert {r["entity_id"]: r["count"] for r in ranked} == {"good": 3, "bad": 2}


def test_lars_over_rows_equals_in_place(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 9))
    y = x @ rng.normal(size=9) + rng.normal(size=40)
    x[:, 4] = 2.0
    at = months(40)
    xy = long_panel(spark, x).join(spark.createDataFrame([(d, float(v)) for d, v in zip(at, y)], "period date, y double"), "period")
    here = table(selection.rank_lars(xy, 6), "score")
    same(here, table(selection.rank_lars(xy, 6, block=2), "score"))
    assert all(k[1] != "s04" for k in here) and len(here) == 6


# --- news -------------------------------------------------------------------------------------------


def state_system(seed=0, n_t=30, n=5, k=3):
    rng = np.random.default_rng(seed)
    x, lam = rng.normal(size=(n_t, n)), rng.normal(size=(n, k))
    x[rng.random((n_t, n)) < 0.2] = np.nan
    a = 0.5 * np.eye(k) + 0.1 * rng.normal(size=(k, k))
    q = np.eye(k) * 0.4
    return x, lam, rng.random(n) + 0.3, a, q


def base_row(x, lam, r, a, q, at, aim):
    from types import SimpleNamespace

    from tidecast.operators import gaussian as g

    info, b, *_ = g.collapse(x.T, lam, r)
    periods = list(range(len(x)))
    return SimpleNamespace(info_old=info.ravel(), b_old=b.ravel(), a=a.ravel(), q=q.ravel(), periods_old=periods, period=periods[at], aim=aim)


@pytest.mark.parametrize("seed", range(4))
def test_weights_equal_one_smoother_per_series(seed):
    x, lam, r, a, q = state_system(seed)
    rng = np.random.default_rng(seed + 50)
    w = news._Weights(base_row(x, lam, r, a, q, 25, lam[0]), 3)
    assert w.linear
    for j in range(5):
        at = rng.choice(30, 6, replace=False)
        cells = [{"period": int(t), "was": None if np.isnan(x[t, j]) else float(x[t, j]), "now": float(rng.normal())} for t in at]
        member = {"series_id": "s", "c": lam[j], "noise": r[j], "cells": cells}
        fast = w._one(member)
        w.linear = False
        assert fast == pytest.approx(w._one(member), abs=1e-8)
        w.linear = True


def test_news_with_a_bad_series_and_a_bad_key(spark):
    x, lam, r, a, q = state_system(1)
    new = x.copy()
    new[-1] = 0.5
    panel = lambda v: long_panel(spark, v, entity="good").unionByName(long_panel(spark, v, entity="bad"))
    load = [("good", f"s{j:02d}", lam[j].tolist(), float(r[j])) for j in range(5)]
    load += [("bad", f"s{j:02d}", (lam[j] * (np.nan if j == 2 else 1)).tolist(), float(r[j])) for j in range(5)]
    load = spark.createDataFrame(load, "entity_id string, series_id string, c array<double>, noise double")
    par = spark.createDataFrame([(e, a.ravel().tolist(), q.ravel().tolist(), months(30)[-1]) for e in ("good", "bad")], "entity_id string, a array<double>, q array<double>, period date")
    rows = news.news_decompose(panel(x), panel(new), load, par, "s00", E, 3).collect()
    good = [n for n in rows if n["entity_id"] == "good"]
    assert len(good) == 5 and sum(n["contribution"] for n in good) == pytest.approx(good[0]["new_nowcast"] - good[0]["old_nowcast"])
    assert {n["contribution"] for n in rows if n["entity_id"] == "bad"} == {None}


def test_news_shares_one_pass_among_many_series(spark, monkeypatch):
    x, lam, r, a, q = state_system(2)
    new = np.nan_to_num(x) + 0.1
    load = spark.createDataFrame([("e", f"s{j:02d}", lam[j].tolist(), float(r[j])) for j in range(5)], "entity_id string, series_id string, c array<double>, noise double")
    par = spark.createDataFrame([("e", a.ravel().tolist(), q.ravel().tolist(), months(30)[-1])], "entity_id string, a array<double>, q array<double>, period date")
    run = lambda: table(news.news_decompose(long_panel(spark, x), long_panel(spark, new), load, par, "s00", E, 3).select(*E, "series_id", "contribution"), "contribution")
    whole = run()
    monkeypatch.setattr(news, "SHARE", 2)
    same(whole, run())


# --- segmented windows ------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 3])
def test_lag_over_segments_equals_a_window(spark, k):
    rng = np.random.default_rng(2)
    n = 400
    # one key has half of the rows, segments hold from none to many, and some keys are missing
    rows = pd.DataFrame({"key": rng.choice(["hot", "a", "b", None], n, p=[0.5, 0.2, 0.2, 0.1]), "t": rng.integers(0, 40, n), "u": rng.permutation(n), "v": rng.normal(size=n)})
    df = spark.createDataFrame(rows, "key string, t int, u int, v double")
    got = segments.with_lag(df, ["key"], ["t", "u"], ["v"], k)
    want = df.withColumn("w", F.lag("v", k).over(Window.partitionBy("key").orderBy("t", "u")))
    a = {(r["key"], r["u"]): r["_before"] and r["_before"]["v"] for r in got.collect()}
    b = {(r["key"], r["u"]): r["w"] for r in want.collect()}
    assert a == b
    wide = segments.with_lag(df.withColumn("t", F.lit(1)), ["key"], ["u"], ["v"], k, segment=F.floor(F.col("u") / 7))
    c = df.withColumn("w", F.lag("v", k).over(Window.partitionBy("key").orderBy("u")))
    assert {r["u"]: r["_before"] and r["_before"]["v"] for r in wide.collect()} == {r["u"]: r["w"] for r in c.collect()}


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") % 500).alias("t"), F.col("id").alias("u"), F.rand(1).alias("v")).repartition(8)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = segments.with_lag(df, ["key"], ["t", "u"], ["v"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 8 and max(p["count"] for p in parts) < 6000
        ranked = segments.with_rank(df, ["key"], "v").groupBy(F.spark_partition_id()).count().collect()
        assert len(ranked) == 8 and max(p["count"] for p in ranked) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_rank_over_segments(spark):
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(size=200) ** 3, [7.0] * 5, [np.inf]]
    rows = [("k", float(v)) for v in values] + [("one", 2.0), ("one", None), (None, 1.0)]
    got = segments.with_rank(spark.createDataFrame(rows, "key string, v double"), ["key"], "v").collect()
    ranks = sorted((r["_rank"], r["v"]) for r in got if r["key"] == "k")
    assert [r for r, _ in ranks] == list(range(1, 207)) and [v for _, v in ranks] == sorted(values)
    assert sorted((r["_rank"], r["v"]) for r in got if r["key"] == "one") == [(1, None), (2, 2.0)]


def test_direction_over_a_hot_key(spark):
    rng = np.random.default_rng(6)
    rows = [("k", int(i // 3), int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "key string, q int, d int, actual double, pred double")
    got = metrics.with_turns(df, ["key"], ["q", "d"]).agg(metrics.fda()).first()[0]
    a, p = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    assert got == pytest.approx(np.mean(np.sign(np.diff(a)) == np.sign(np.diff(p))))


# --- collinear series -------------------------------------------------------------------------------


def test_members_tell_every_pair(spark):
    rng = np.random.default_rng(9)
    a = np.cumsum(rng.normal(size=60))
    x = np.column_stack([a, a, a, a + 0.05 * rng.normal(size=60), -a, rng.normal(size=60), np.ones(60)])
    panel = long_panel(spark, x, list("abcdefg"))
    members = {r["series_id"]: r for r in selection.collinear_members(panel, 0.99).collect()}
    assert {s: r["representative"] for s, r in members.items()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    pairs = {(r["series_a"], r["series_b"]) for r in selection.collinear_pairs(panel, 0.99).collect()}
    reps = {s: r["representative"] for s, r in members.items()}
    derived = {(s, t) for s in reps for t in reps if s < t and (reps[s] == reps[t] or (reps[s], reps[t]) in pairs or (reps[t], reps[s]) in pairs)}
    corr = np.abs(np.corrcoef(x[:, :6].T))
    assert derived == {("abcdef"[i], "abcdef"[j]) for i in range(6) for j in range(i + 1, 6) if corr[i, j] >= 0.99}
    assert {s: r["n_links"] for s, r in members.items()} == {s: sum(s in p for p in derived) for s in reps}


def test_the_largest_correlation(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(50, 4))
    x[:, 2] = -x[:, 0] + 0.5 * rng.normal(size=50)
    x[4, 1] = np.nan
    x[:, 3] = 1.0
    got = selection.max_correlation(long_panel(spark, x), ["s00", "s01", "s02", "s03"]).first()
    filled = np.where(np.isnan(x), np.nanmean(x, 0), x)[:, :3]
    c = np.abs(np.corrcoef(filled.T)) - np.eye(3)
    assert got["max_corr"] == pytest.approx(c.max()) and (got["series_a"], got["series_b"]) == ("s00", "s02")


def test_wide_and_small_factor_fits_agree(spark):
    """The registered panels are one block; the same data in several blocks take the other path."""
    x, _, _ = factor_data(n_t=40, n=9, r=1, seed=6)
    panel = long_panel(spark, x)
    one, many = (dfm.dfm_fit(panel, E, 1, 1, 40, block_size=b).state.first() for b in (256, 3))
    assert one["it"] == many["it"] and one["loglik"] == pytest.approx(many["loglik"], abs=1e-8)


def test_blocks_reach_python_series_by_series(spark, monkeypatch):
    """A batch is limited in rows, so no row may hold a whole block; a block cut by batches gives the same fit."""
    x, _, _ = factor_data(n_t=40, n=11, r=1, seed=7)
    panel = long_panel(spark, x)
    groups = spark.createDataFrame([("s00", "g"), ("s01", "g"), ("s07", "h")], "series_id string, grp string")
    whole, seen, plain = dfm.dfm_fit(panel, E, 1, 1, 6, groups=groups), [], type(panel).mapInPandas
    monkeypatch.setattr(type(panel), "mapInPandas", lambda self, *a, **b: seen.append(dict(self.dtypes)) or plain(self, *a, **b))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for size in (3, 256):
            fit = dfm.dfm_fit(panel, E, 1, 1, 6, groups=groups, block_size=size)
            state, expected = fit.state.first(), whole.state.first()
            assert state["it"] == expected["it"] and state["loglik"] == pytest.approx(expected["loglik"], abs=1e-8)
            a, b = (f.loadings().orderBy("series_id").toPandas() for f in (fit, whole))
            assert a["series_id"].tolist() == b["series_id"].tolist()
            np.testing.assert_allclose(np.stack(a["c"]), np.stack(b["c"]), atol=1e-8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen and not [kind for one in seen for kind in one.values() if kind.startswith("array<array")]
