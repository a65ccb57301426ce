"""Kalman filter and smoother over collapsed observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import gaussian as g
from tidecast.operators.dfm import key_schema
from tidecast.session import cogroup


def kalman_collapse(panel: DataFrame, loadings: DataFrame, k: int, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """Sum the observed series of every period to what the filter needs of them.

    Plain sums with map-side combine: what is shuffled per period does not
    depend on the number of series. ``loadings`` has (on..., c, noise); periods
    without any observation stay, with zero sums.
    """
    on = on or ["series_id"]
    seen = F.col("value").isNotNull()
    joined = panel.join(loadings, on)
    c = [F.col("c")[i] for i in range(k)]

    def total(x):
        return F.coalesce(F.sum(F.when(seen, x)), F.lit(0.0))

    return joined.groupBy(*keys, "period").agg(
        F.array(*[total(c[min(i, j)] * c[max(i, j)] / F.col("noise")) for i in range(k) for j in range(k)]).alias("info"),
        F.array(*[total(c[i] * F.col("value") / F.col("noise")) for i in range(k)]).alias("b"),
        F.count("value").cast("double").alias("n"),
        total(F.ln("noise")).alias("log_r"),
        total(F.col("value") * F.col("value") / F.col("noise")).alias("yy"),
    )


def _per_key(collapsed: DataFrame, params: DataFrame, keys: list[str], fn, out: str) -> DataFrame:
    """Run ``fn`` once per key over its periods (as many as the calendar has) and its parameters."""

    def work(key, rows: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        rows, par = rows.sort_values("period"), par.iloc[0]
        k = int(len(par["a"]) ** 0.5)
        info = np.stack(rows["info"].to_numpy()).astype(float).reshape(-1, k, k)
        b = np.stack(rows["b"].to_numpy()).astype(float)
        a, q, v0 = (np.asarray(par[c], float).reshape(k, k) for c in ("a", "q", "v0"))
        passed = g.filter_states(info, b, a, q, np.asarray(par["z0"], float), v0)
        res = fn(rows, info, b, a, passed)
        for name, value in zip(keys, key):
            res[name] = value
        return res[[*keys, *[c.split()[0] for c in out.split(", ")]]]

    return cogroup(collapsed, params, keys).applyInPandas(work, f"{key_schema(collapsed, keys)}, {out}")


def _frame(rows, z, v):
    return pd.DataFrame({"period": rows["period"].to_numpy(), "z": list(z), "v": [m.ravel() for m in v]})


def kalman_filter(collapsed: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Filtered and predicted states of every period."""

    def fn(rows, info, b, a, passed):
        zp, vp, zf, vf = passed
        out = _frame(rows, zf, vf)
        out["z_pred"], out["v_pred"] = list(zp), [m.ravel() for m in vp]
        return out

    out = "period date, z array<double>, v array<double>, z_pred array<double>, v_pred array<double>"
    return _per_key(collapsed, params, keys, fn, out)


def kalman_smooth(collapsed: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    def fn(rows, info, b, a, passed):
        zs, vs, _ = g.smooth_states(a, *passed)
        return _frame(rows, zs, vs)

    return _per_key(collapsed, params, keys, fn, "period date, z array<double>, v array<double>")


def kalman_loglik(collapsed: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    def fn(rows, info, b, a, passed):
        n, log_r, yy = (rows[c].to_numpy(float) for c in ("n", "log_r", "yy"))
        return pd.DataFrame({"loglik": [g.innovations_loglik(info, b, n, log_r, yy, passed[0], passed[1])]})

    return _per_key(collapsed, params, keys, fn, "loglik double")


def kalman_filter_scalar(collapsed: DataFrame, keys: list[str], a: float, q: float, z0: float = 0.0, v0: float = 1.0) -> DataFrame:
    """One-state filter as a fold of built-in functions over the periods of each key."""
    steps = collapsed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("period", F.col("info")[0].alias("i"), F.col("b")[0].alias("b")))).alias("s")
    )

    def step(acc, e):
        zp, vp = acc["z"] * a, acc["v"] * (a * a) + q
        v = vp / (1 + vp * e["i"])
        z = zp + v * (e["b"] - e["i"] * zp)
        at = F.struct(e["period"].alias("period"), z.alias("z"), v.alias("v"))
        return F.struct(z.alias("z"), v.alias("v"), F.concat(acc["path"], F.array(at)).alias("path"))

    start = F.struct(
        F.lit(z0).alias("z"), F.lit(v0).alias("v"), F.array().cast("array<struct<period:date,z:double,v:double>>").alias("path")
    )
    return steps.select(*keys, F.inline(F.aggregate("s", start, step, lambda acc: acc["path"])))
