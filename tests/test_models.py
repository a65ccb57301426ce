"""Fits against direct computation on small panels."""

import math

import numpy as np
import pytest
from conftest import factor_data, long_panel, months, values
from pyspark.sql import functions as F

from tidecast.operators import bands, bridge, bvar, dfm, gaussian, news, selection, state_space, transforms
from tidecast.plans import backtest, nowcast

E = ["entity_id"]


def textbook_filter(y, c, r, a, q, z0, v0):
    """Observation by observation vector form with the innovation covariance."""
    z, v, out, loglik = z0, v0, [], 0.0
    pred = []
    for row in y:
        z, v = a @ z, a @ v @ a.T + q
        pred.append((z, v))
        ok = ~np.isnan(row)
        if ok.any():
            s = c[ok] @ v @ c[ok].T + np.diag(r[ok])
            e = row[ok] - c[ok] @ z
            gain = v @ c[ok].T @ np.linalg.inv(s)
            loglik -= 0.5 * (ok.sum() * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e))
            z, v = z + gain @ e, v - gain @ c[ok] @ v
        out.append((z, v))
    zs, vs = [out[-1][0]], [out[-1][1]]
    for t in range(len(y) - 2, -1, -1):
        j = out[t][1] @ a.T @ np.linalg.inv(pred[t + 1][1])
        vs.insert(0, out[t][1] + j @ (vs[0] - pred[t + 1][1]) @ j.T)
        zs.insert(0, out[t][0] + j @ (zs[0] - pred[t + 1][0]))
    return np.array([z for z, _ in out]), np.array(zs), np.array(vs), loglik


@pytest.fixture(scope="module")
def small():
    x, _, lam = factor_data(40, 6, 2, 0.2)
    x[7] = np.nan
    r = np.linspace(0.2, 0.7, 6)
    a, q = np.array([[0.6, 0.1], [0.0, 0.5]]), np.array([[0.4, 0.1], [0.1, 0.3]])
    return x, lam, r, a, q


def params(spark, a, q):
    k = len(a)
    row = ("e", a.ravel().tolist(), q.ravel().tolist(), [0.0] * k, np.eye(k).ravel().tolist())
    return spark.createDataFrame([row], "entity_id string, a array<double>, q array<double>, z0 array<double>, v0 array<double>")


def collapsed(spark, small):
    x, lam, r, _, _ = small
    rows = [(f"s{j:02d}", lam[j].tolist(), float(r[j])) for j in range(len(r))]
    load = spark.createDataFrame(rows, "series_id string, c array<double>, noise double")
    return state_space.kalman_collapse(long_panel(spark, x), load, 2, E)


def test_kalman_equals_the_textbook(spark, small):
    x, lam, r, a, q = small
    zf, zs, vs, loglik = textbook_filter(x, lam, r, a, q, np.zeros(2), np.eye(2))
    base, par = collapsed(spark, small), params(spark, a, q)
    got = state_space.kalman_filter(base, par, E).orderBy("period").toPandas()
    np.testing.assert_allclose(np.stack(got["z"]), zf, atol=1e-10)
    smooth = state_space.kalman_smooth(base, par, E).orderBy("period").toPandas()
    np.testing.assert_allclose(np.stack(smooth["z"]), zs, atol=1e-10)
    np.testing.assert_allclose(np.stack(smooth["v"]).reshape(-1, 2, 2), vs, atol=1e-10)
    assert state_space.kalman_loglik(base, par, E).first()["loglik"] == pytest.approx(loglik)


def test_scalar_fold_equals_grouped(spark, small):
    x, _, r, _, _ = small
    load = spark.createDataFrame([(f"s{j:02d}", [1.0], float(r[j])) for j in range(len(r))], "series_id string, c array<double>, noise double")
    base = state_space.kalman_collapse(long_panel(spark, x), load, 1, E)
    fold = state_space.kalman_filter_scalar(base, E, 0.8, 0.2).orderBy("period").toPandas()
    grouped = state_space.kalman_filter(base, params(spark, np.array([[0.8]]), np.array([[0.2]])), E).orderBy("period").toPandas()
    np.testing.assert_allclose(fold["z"], np.stack(grouped["z"])[:, 0], atol=1e-12)


def test_likelihood_never_falls():
    x, _, _ = factor_data(80, 10, 2, 0.15)
    y = ((x - np.nanmean(x, 0)) / np.nanstd(x, 0)).T
    y0 = np.nan_to_num(y)
    row = dfm._first_state(y0.T @ y0, len(y), 2, 2, None, [])
    seen = []
    for _ in range(12):
        from types import SimpleNamespace

        row = dfm._next_state(row, dfm._block_sums(y, [None] * len(y), SimpleNamespace(**row)), 0.0, True)
        seen.append(row["loglik"])
    # the first step still rests on principal components
    assert all(b > a - 1e-6 * abs(a) for a, b in zip(seen[1:], seen[2:]))


def test_lyapunov():
    a, q = np.array([[0.5, 0.2], [0.1, 0.3]]), np.eye(2)
    v = gaussian.stationary_variance(a, q)
    np.testing.assert_allclose(v, a @ v @ a.T + q, atol=1e-10)
    np.testing.assert_array_equal(gaussian.stationary_variance(2 * np.eye(2), q), np.eye(2))


def test_factors_are_recovered_and_gaps_filled(spark):
    x, f, _ = factor_data(120, 12, 2, 0.2)
    fit = dfm.dfm_fit(long_panel(spark, x), E, 2, 1, 15)
    z = np.stack(fit.factors().orderBy("period").toPandas()["z"])
    for j in range(2):
        beta = np.linalg.lstsq(z, f[:, j], rcond=None)[0]
        assert np.corrcoef(z @ beta, f[:, j])[0, 1] > 0.85
    out = fit.project().toPandas()
    assert len(out) == x.size and out["value"].notna().all()
    assert np.isfinite(fit.state.first()["loglik"])


def test_blocks_partitions_and_order_do_not_matter(spark):
    x, _, _ = factor_data(60, 11, 2, 0.2)
    p = long_panel(spark, x)
    one = dfm.dfm_fit(p, E, 2, 2, 4)
    many = dfm.dfm_fit(p.orderBy(F.rand(3)).repartition(7), E, 2, 2, 4, block_size=3)
    assert many.blocks.count() > 1
    a, b = (m.project().orderBy("series_id", "period").toPandas()["value"] for m in (one, many))
    np.testing.assert_allclose(a, b, atol=1e-8)


def test_empty_column_and_large_r(spark):
    x, _, _ = factor_data(40, 3, 1, 0.1)
    x = np.column_stack([x, np.full(40, np.nan)])
    fit = dfm.dfm_fit(long_panel(spark, x), E, 6, 1, 3)
    assert fit.state.first()["r"] == 3
    assert fit.project().filter("value is null or isnan(value)").isEmpty()


def test_group_factors_stay_in_their_group(spark):
    x, _, _ = factor_data(60, 6, 1, 0.0)
    groups = spark.createDataFrame([(f"s{j:02d}", "ab"[j % 2]) for j in range(6)], "series_id string, grp string")
    c = {r["series_id"]: r["c"] for r in dfm.dfm_fit(long_panel(spark, x), E, 1, 1, 3, groups=groups).loadings().collect()}
    assert all(c[f"s{j:02d}"][2 - j % 2] == 0 and c[f"s{j:02d}"][1 + j % 2] != 0 for j in range(6))


def test_specs_equal_single_fits(spark):
    x, _, _ = factor_data(50, 6, 2, 0.1)
    p = long_panel(spark, x)
    grid = dfm.dfm_fit(p, E, max_iter=3, specs=[(1, 1), (2, 1)]).state
    single = dfm.dfm_fit(p, E, 2, 1, 3).state.first()["loglik"]
    assert grid.filter("n_factors = 2").first()["loglik"] == pytest.approx(single)


# --- VAR ------------------------------------------------------------------------------------


def augmented(y, p, lam=0.2, theta=1.0, mu=1.0):
    n_t, n = y.shape
    sd, m = y.std(0, ddof=1), y.mean(0)
    x = np.hstack([y[p - i - 1 : n_t - i - 1] for i in range(p)])
    ys, xs = [y[p:]], [x]
    own_y, own_x = np.zeros((n * p, n)), np.zeros((n * p, n * p))
    for lag in range(1, p + 1):
        for j in range(n):
            i = (lag - 1) * n + j
            own_y[i, j] = own_x[i, i] = sd[j] * lag / lam
    ys += [own_y, np.diag(sd * m / mu), (sd * m / theta)[None]]
    xs += [own_x, np.tile(np.diag(sd * m / mu), p), np.tile(sd * m / theta, p)[None]]
    return np.vstack(ys), np.vstack(xs)


@pytest.fixture(scope="module")
def var_data():
    rng = np.random.default_rng(42)
    y = np.zeros((120, 3))
    a = np.array([[0.5, 0.1, 0.0], [0.0, 0.4, 0.2], [0.1, 0.0, 0.3]])
    for t in range(1, 120):
        y[t] = a @ y[t - 1] + rng.normal(size=3)
    return y + 0.5


NAMES = ["s00", "s01", "s02"]


def test_posterior_equals_augmented_regression(spark, var_data):
    moments = bvar.system_moments(long_panel(spark, var_data), NAMES, 2, E)
    row = bvar.minnesota_posterior(moments, E).first()
    ys, xs = augmented(var_data, 2)
    b = np.linalg.lstsq(xs, ys, rcond=None)[0]
    resid = ys - xs @ b
    np.testing.assert_allclose(np.reshape(row["b"], (3, 6)), b.T, atol=1e-8)
    np.testing.assert_allclose(np.reshape(row["sigma"], (3, 3)), resid.T @ resid / len(ys), atol=1e-8)


def test_marginal_likelihood_and_choice(spark, var_data):
    moments = bvar.system_moments(long_panel(spark, var_data), NAMES, 1, E)
    scored = bvar.bvar_log_ml(bvar.hyper_grid(moments), E).toPandas()
    r = scored.iloc[7]
    ys, xs = augmented(var_data, 1, r["lam"], r["theta"], r["mu"])
    # the same from the predictive law: rows one after the other, each a Student t given those before
    n, k, n_data = 3, 3, len(var_data) - 1
    y, x = ys[:n_data], xs[:n_data]
    px, pxy = xs[n_data:].T @ xs[n_data:], xs[n_data:].T @ ys[n_data:]
    pyy, rows = ys[n_data:].T @ ys[n_data:], len(ys) - n_data
    want = 0.0
    for row, left in zip(y, x):
        coef = np.linalg.solve(px, pxy)
        scale = pyy - pxy.T @ coef + bvar.SIGMA_PRIOR * np.eye(n)
        nu = rows - k - n + 1
        spread = scale * (1 + left @ np.linalg.solve(px, left)) / nu
        e = row - left @ coef
        want += math.lgamma((nu + n) / 2) - math.lgamma(nu / 2) - 0.5 * n * math.log(nu * math.pi)
        want += -0.5 * np.linalg.slogdet(spread)[1] - 0.5 * (nu + n) * math.log(1 + e @ np.linalg.solve(spread, e) / nu)
        px, pxy, pyy, rows = px + np.outer(left, left), pxy + np.outer(left, row), pyy + np.outer(row, row), rows + 1
    assert r["log_ml"] == pytest.approx(want)
    best = bvar.bvar_tune(moments, E).first()
    assert best["log_ml"] >= scored["log_ml"].max()


def test_draws_centre_on_the_posterior(spark, var_data):
    moments = bvar.system_moments(long_panel(spark, var_data), NAMES, 1, E)
    tuned = moments.withColumns({"lam": F.lit(0.2), "theta": F.lit(1.0), "mu": F.lit(1.0)})
    draws = bvar.posterior_draws(tuned, E, 2, 400, 50)
    assert draws.count() == 800
    mean = bvar.draw_means(draws, E).first()
    want = bvar.minnesota_posterior(moments, E).first()
    np.testing.assert_allclose(mean["b"], want["b"], atol=0.03)
    np.testing.assert_allclose(mean["sigma"], want["sigma"], atol=0.15)
    again = bvar.posterior_draws(tuned.repartition(3), E, 2, 400, 50)
    key = ["chain", "draw"]
    assert again.orderBy(*key).first()["b"] == draws.orderBy(*key).first()["b"]


def test_one_step_fan_has_no_shock(spark, var_data):
    panel = long_panel(spark, var_data)
    moments = bvar.system_moments(panel, NAMES, 2, E)
    tuned = moments.withColumns({"lam": F.lit(0.2), "theta": F.lit(1.0), "mu": F.lit(1.0)})
    draws = bvar.posterior_draws(tuned, E, 2, 30, 10).orderBy("chain", "draw")
    last = bvar.last_design(panel, NAMES, 2, E)
    x = np.concatenate([var_data[-1], var_data[-2]])
    np.testing.assert_allclose(last.first()["x_last"], x)
    first = bvar.forecast_paths(draws, last, E, 3, 0, 1).orderBy("chain", "draw").toPandas()["forecast"]
    want = [np.reshape(r["b"], (3, 6))[0] @ x for r in draws.collect()]
    np.testing.assert_allclose(first, want)
    paths = bvar.forecast_paths(draws, last, E, 3, 0, 3)
    for row in bands.draw_fan(paths, [*E, "h"]).collect():
        assert row["p10"] <= row["p25"] <= row["p50"] <= row["p75"] <= row["p90"] and row["std"] >= 0


def test_bvar_fit_shapes(spark, var_data):
    x = var_data[:60].copy()
    x[57:, 0] = np.nan
    x[np.arange(60) % 3 != 2, 2] = np.nan
    out = bvar.bvar_fit(long_panel(spark, x), NAMES, E, draws=20, burn_in=5, chains=1, blocks=False)
    assert out.count() == 180 and out.filter("value is null or isnan(value)").isEmpty()
    quarters = bvar.bvar_fit(long_panel(spark, x), NAMES, E, p=1, tune=False, draws=10, burn_in=5, chains=1, blocks=True)
    seen = {r["series_id"]: r["count"] for r in quarters.groupBy("series_id").count().collect()}
    assert seen == {"s00": 60, "s01": 60, "s02": 20}


def test_bvar_forecasts(spark):
    """The path of a missing target is not its last value, and beats it where the indicators lead."""
    rng = np.random.default_rng(5)
    gains, losses = [], []
    panels, truth = None, {}
    for s in range(6):
        x = np.zeros((150, 2))
        for t in range(1, 150):
            x[t, 0] = 0.8 * x[t - 1, 0] + rng.normal()
            x[t, 1] = 0.9 * x[t - 1, 0] + 0.1 * rng.normal()
        y = x.copy()
        y[np.arange(150) % 3 != 2, 1] = np.nan
        truth[f"e{s}"] = (y[149, 1], y[146, 1])
        y[147:, 1] = np.nan
        part = long_panel(spark, y, entity=f"e{s}")
        panels = part if panels is None else panels.unionByName(part)
    got = bvar.bvar_fit(panels, ["s00", "s01"], E, p=1, draws=60, burn_in=20, chains=1)
    last = got.filter("series_id = 's01'").groupBy("entity_id").agg(F.max_by("value", "period").alias("v")).collect()
    for r in last:
        actual, before = truth[r["entity_id"]]
        assert abs(r["v"] - before) > 1e-3
        gains.append(abs(r["v"] - actual))
        losses.append(abs(before - actual))
    assert len(gains) == 6 and sum(gains) < sum(losses)


def test_one_bad_key_does_not_end_the_others(spark, var_data):
    good = long_panel(spark, var_data[:60], entity="good")
    bad = var_data[:60].copy()
    bad[10, 1] = np.inf
    empty = var_data[:60].copy()
    empty[:, 0] = np.nan
    panel = good.unionByName(long_panel(spark, bad, entity="bad")).unionByName(long_panel(spark, empty, entity="thin"))
    out = bvar.bvar_fit(panel, NAMES, E, p=1, draws=10, burn_in=5, chains=1, blocks=False)
    seen = {r["entity_id"] for r in out.filter("series_id = 's02' and value is not null").select("entity_id").distinct().collect()}
    assert {"good", "thin"} <= seen and "bad" not in seen
    rows = bvar.minnesota_posterior(bvar.system_moments(panel, NAMES, 1, E), E).collect()
    assert {r["entity_id"] for r in rows if r["b"] is not None} == {"good"}
    assert all(r["reason"] for r in rows if r["b"] is None)
    assert "good" in {r["entity_id"] for r in dfm.dfm_fit(panel, E, 1, 1, 3).state.collect()}
    with pytest.raises(Exception, match="lags"):
        dfm.dfm_fit(good, E, 1, 6, 2).state.collect()


# --- bridge equations -----------------------------------------------------------------------


def test_spec_counts(spark):
    names = spark.createDataFrame([(f"s{i}",) for i in range(5)], "series_id string")
    assert bridge.bridge_specs(names, (903,)).count() == 15
    assert bridge.bridge_specs(names).count() == 45
    assert bridge.bridge_specs(names, (901, 902), ["q0", "q1"]).count() == 2 * 15 * 3


def test_ar_extrapolation(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(60)
    for t in range(2, 60):
        x[t] = 0.6 * x[t - 1] + 0.2 * x[t - 2] + rng.normal()
    gap = x.copy()
    gap[56:] = np.nan
    design = np.column_stack([gap[1:55], gap[0:54]])
    coef = np.linalg.lstsq(design, gap[2:56], rcond=None)[0]
    want = list(gap[:56])
    for _ in range(4):
        want.append(coef @ [want[-1], want[-2]])
    got = values(bridge.extrapolate_ar(long_panel(spark, gap[:, None]), 2))
    assert got == pytest.approx(want)


def test_var_extrapolation_fills_only_the_end(spark, var_data):
    x = var_data[:80].copy()
    x[77:, 0] = np.nan
    x[78:, 1] = np.nan
    out = bridge.extrapolate_var(long_panel(spark, x), E, NAMES, 2)
    wide = out.toPandas().pivot(index="period", columns="series_id", values="value")[NAMES].to_numpy()
    known = ~np.isnan(x)
    np.testing.assert_allclose(wide[known], x[known])
    ys, xs = augmented(x[:77], 2)
    b = np.linalg.lstsq(xs, ys, rcond=None)[0].T
    step = b @ np.concatenate([x[76], x[75]])
    assert wide[77, 0] == pytest.approx(step[0])
    assert not np.isnan(wide).any()


def test_bridge_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    ends = np.arange(2, 90, 3)
    y = 1.0 + 0.8 * x[ends, 0] - 0.4 * x[ends, 1] + rng.normal(size=30) * 0.1
    y[-1] = np.nan
    at = months(90)
    target = spark.createDataFrame(
        [("e", at[t - 2], None if np.isnan(v) else float(v)) for t, v in zip(ends, y)], "entity_id string, quarter date, y double"
    )
    names = spark.createDataFrame([("s00",), ("s01",)], "series_id string")
    regressors = bridge.quarter_regressors(long_panel(spark, x)).withColumn("interp_type", F.lit(903))
    design = bridge.bridge_design(bridge.bridge_specs(names, (903,)), regressors, target)
    coefs = bridge.bridge_ols(design, E)
    pair = coefs.filter("spec_id = '903|s00|s01'").first()
    lag = lambda v: np.concatenate([[0.0], v[:-1]])
    m1, m2 = x[ends, 0], x[ends, 1]
    ylag = np.concatenate([[np.nan], y[:-1]])
    full = np.column_stack([m1, lag(m1), m2, lag(m2), ylag, np.ones(30)])
    ok = ~np.isnan(full).any(1) & ~np.isnan(y)
    want = np.linalg.lstsq(full[ok], y[ok], rcond=None)[0]
    np.testing.assert_allclose(np.array(pair["coef"])[[0, 1, 2, 3, 6, 7]], want, atol=1e-7)
    fcst = bridge.bridge_forecast(design, coefs, E).filter("spec_id = '903|s00|s01'").orderBy("quarter").collect()
    assert fcst[-1]["fcst"] == pytest.approx(full[-1] @ want)
    parts = bridge.bridge_contributions(design, coefs, E).filter("spec_id = '903|s00|s01'").groupBy("quarter").agg(F.sum("contribution").alias("s"))
    assert parts.orderBy("quarter").collect()[-1]["s"] == pytest.approx(full[-1] @ want)
    beq = bridge.beq_fit(long_panel(spark, x), target, ["s00", "s01"], E, 2)
    assert bridge.bridge_median(beq, E).count() == 30


# --- news -----------------------------------------------------------------------------------


def test_news_equals_scenario_smoothing(spark, small):
    x, lam, r, a, q = small
    old, new = x.copy(), x.copy()
    new[-1, 0], old[-1, 0] = 0.9, np.nan
    new[-2, 2] = (0.0 if np.isnan(old[-2, 2]) else old[-2, 2]) + 0.5
    rows = [("e", f"s{j:02d}", lam[j].tolist(), float(r[j])) for j in range(len(r))]
    load = spark.createDataFrame(rows, "entity_id string, series_id string, c array<double>, noise double")
    at = months(len(x))[-1]
    par = spark.createDataFrame([("e", a.ravel().tolist(), q.ravel().tolist(), at)], "entity_id string, a array<double>, q array<double>, period date")
    got = {n["series_id"]: n for n in news.news_decompose(long_panel(spark, old), long_panel(spark, new), load, par, "s05", E, 2).collect()}
    at_end = lambda y: lam[5] @ textbook_filter(y, lam, r, a, q, np.zeros(2), np.eye(2))[1][-1]
    parts = {}
    for j in (0, 2):
        mixed = old.copy()
        mixed[:, j] = new[:, j]
        parts[f"s{j:02d}"] = at_end(mixed) - at_end(old)
    total = at_end(new) - at_end(old)
    scale = total / sum(parts.values())
    assert set(got) == set(parts)
    for name, part in parts.items():
        assert got[name]["contribution"] == pytest.approx(part * scale)
        assert got[name]["old_nowcast"] == pytest.approx(at_end(old))
    assert sum(n["contribution"] for n in got.values()) == pytest.approx(total)


def test_news_from_an_empty_vintage(spark, small):
    x, lam, r, a, q = small
    rows = [("e", f"s{j:02d}", lam[j].tolist(), float(r[j])) for j in range(len(r))]
    load = spark.createDataFrame(rows, "entity_id string, series_id string, c array<double>, noise double")
    par = spark.createDataFrame([("e", a.ravel().tolist(), q.ravel().tolist(), months(len(x))[-1])], "entity_id string, a array<double>, q array<double>, period date")
    out = news.news_decompose(long_panel(spark, np.full_like(x, np.nan)), long_panel(spark, x), load, par, "s05", E, 2).collect()
    assert len(out) == 6 and all(n["old_nowcast"] == 0 for n in out)


# --- selection ------------------------------------------------------------------------------


def lars_order(x, y, n):
    """Entry order of least angle regression, all in memory."""
    x = x - x.mean(0)
    x = x / np.linalg.norm(x, axis=0)
    res, active = y - y.mean(), []
    for _ in range(n):
        c = x.T @ res
        if not active:
            active.append(int(np.abs(c).argmax()))
        s = np.sign(c[active])
        xa = x[:, active] * s
        w = np.linalg.solve(xa.T @ xa, np.ones(len(active)))
        aa = 1 / np.sqrt(w.sum())
        u = xa @ (aa * w)
        big, a = np.abs(c[active]).max(), x.T @ u
        best, step = None, np.inf
        for j in set(range(x.shape[1])) - set(active):
            for gamma in ((big - c[j]) / (aa - a[j]), (big + c[j]) / (aa + a[j])):
                if 1e-12 < gamma < step:
                    best, step = j, gamma
        if best is None or len(active) == n:
            break
        res = res - step * u
        active.append(best)
    return active


def test_lars_order(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 7))
    y = x @ np.array([2.0, 0, -1.5, 0, 0.7, 0, 0.2]) + rng.normal(size=40) * 0.3
    at = months(40)
    xy = long_panel(spark, x).join(spark.createDataFrame([(d, float(v)) for d, v in zip(at, y)], "period date, y double"), "period")
    got = selection.rank_lars(xy, 5).orderBy(F.desc("score")).collect()
    assert [r["series_id"] for r in got] == [f"s{j:02d}" for j in lars_order(x, y, 5)]


def test_tstat_equals_regression(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 1))
    y = 0.5 * x[:, 0] + rng.normal(size=30)
    d = np.column_stack([np.ones(30), x[:, 0]])
    b, ss = np.linalg.lstsq(d, y, rcond=None)[:2]
    t = abs(b[1]) / np.sqrt(ss[0] / 28 * np.linalg.inv(d.T @ d)[1, 1])
    xy = long_panel(spark, x).join(spark.createDataFrame([(m, float(v)) for m, v in zip(months(30), y)], "period date, y double"), "period")
    assert selection.rank_tstat(xy).first()["score"] == pytest.approx(t)


def test_collinear_pairs_loses_none(spark):
    rng = np.random.default_rng(7)
    base = np.cumsum(rng.normal(size=(50, 12)), axis=0)
    x = np.column_stack([base, -base[:, :4] + rng.normal(size=(50, 4)) * 0.3, base[:, 5:7]])
    x[3, 2] = np.nan
    names = [f"s{j:02d}" for j in range(x.shape[1])]
    filled = np.where(np.isnan(x), np.nanmean(x, 0), x)
    corr = np.abs(np.corrcoef(filled.T))
    want = {(names[i], names[j]) for i in range(18) for j in range(i + 1, 18) if corr[i, j] >= 0.9}
    # s16, s17 repeat s05, s06: they are listed with those and meet others through them
    firsts = {p for p in want if not set(p) & {"s16", "s17"}} | {("s05", "s16"), ("s06", "s17")}
    got = {(r["series_a"], r["series_b"]) for r in selection.collinear_pairs(long_panel(spark, x), 0.9).collect()}
    assert got == firsts


def test_moments(spark, var_data):
    rows = selection.design_rows(long_panel(spark, var_data), NAMES, 1)
    got = selection.moment_matrix(rows.withColumn("v", F.concat("y", "x"))).toPandas()
    v = np.hstack([var_data[1:], var_data[:-1]])
    want = v.T @ v
    for r in got.itertuples():
        assert r.s == pytest.approx(want[r.i, r.j])
    assert len(got) == 21


# --- jobs -----------------------------------------------------------------------------------


def test_backtest_does_not_look_ahead(spark):
    x, _, _ = factor_data(60, 3, 1, 0.0)
    x[np.arange(60) % 3 != 2, 2] = np.nan
    panel = long_panel(spark, x)
    dated = panel.withColumn("release_date", F.date_add(F.last_day("period"), 20))
    target = panel.filter("series_id = 's02' and value is not null").select("entity_id", F.trunc("period", "quarter").alias("quarter"), "value")
    v = F.array(F.lit("2014-02-15").cast("date"))
    run = lambda d: {
        r["model"]: r["pred"] for r in backtest.run_backtest(
            backtest.vintage_systems(d, v, E), target, NAMES, E, ("dfm", "bvar", "beq", "ar1", "naive", "mean"), max_iter=3, draws=10
        ).collect()
    }
    future = dated.withColumn("value", F.when(F.col("release_date") > "2014-02-15", F.col("value") * 7 + 3).otherwise(F.col("value")))
    first, second = run(dated), run(future)
    assert first == pytest.approx(second) and all(p is not None for p in first.values())


def test_backtest_survives_a_failed_fit(spark):
    x = np.full((30, 3), np.nan)
    x[:, 0] = np.arange(30.0)
    x[5, 0] = np.inf
    x[2::3, 2] = 1.0
    dated = long_panel(spark, x).withColumn("release_date", F.last_day("period"))
    target = dated.filter("series_id = 's02' and value is not null").select("entity_id", F.trunc("period", "quarter").alias("quarter"), "value")
    v = F.array(F.lit("2012-02-15").cast("date"))
    out = backtest.run_backtest(backtest.vintage_systems(dated, v, E), target, NAMES, E, ("bvar", "naive"), draws=5).collect()
    assert {r["model"]: r["pred"] for r in out} == {"bvar": None, "naive": 1.0}


def test_run_nowcast(spark):
    x, _, _ = factor_data(60, 3, 1, 0.0)
    x[np.arange(60) % 3 != 2, 2] = np.nan
    x[56:, 2] = np.nan
    out = nowcast.run_nowcast(long_panel(spark, x), NAMES, E, max_iter=3, draws=10, beq_types=(bridge.AR_OWN,)).toPandas()
    assert set(out["model"]) == {"dfm", "bvar", "beq", "ensemble"}
    now = out[out["stage"] == "nowcast"]
    three = now[now["model"] != "ensemble"]["pred"]
    assert now[now["model"] == "ensemble"]["pred"].iloc[0] == pytest.approx(np.median(three))
    assert (out["quarter"][out["stage"] == "nowcast"] == "2014-Q3").all()
