"""Bridge equations: quarterly regressions of the target on one or two monthly indicators."""

from __future__ import annotations

from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import bvar
from tidecast.operators.dfm import key_schema
from tidecast.operators.grid import SERIES, agg_quarter, series_window
from tidecast.operators.systems import Order, own_keys, place, with_names
from tidecast.session import cogroup, cut, spread, together

# fixed values: ways to fill the ragged end
VAR_ALL, VAR_SPEC, AR_OWN, ALL_TYPES = 901, 902, 903, 904
VAR_TIGHTNESS = 0.2


class Terms(NamedTuple):
    """The longest lags any specification has, in quarters, and the most dummies.

    A specification may have fewer (columns ``lag_m``, ``lag_q``, ``lag_y`` and ``dummies``, an array of quarters, of
    ``bridge_design``'s specifications). Regressors enter with lags 0 to their longest, the target with one lag.
    """

    m: int = 1
    q: int = 1
    y: int = 1
    dummies: int = 0

    def names(self) -> list[str]:
        monthly = [f"{s}_l{i}" for s in ("m1", "m2") for i in range(self.m + 1)]
        return [*monthly, *[f"q_l{i}" for i in range(self.q + 1)], "y_lag", *[f"d{i + 1}" for i in range(self.dummies)], "const"]


REGRESSORS = Terms().names()


def bridge_specs(names: DataFrame, types: tuple[int, ...] = (ALL_TYPES,), quarterly: list[str] = ()) -> DataFrame:
    """Every single and pair of registered indicators, with each quarterly regressor or none.

    ``names`` is the registry of candidates, (series_id), or (some keys, series_id) when keys have registries of their
    own. Each entry is paired with those behind it in its registry's sorted list.
    """
    kinds = [VAR_ALL, VAR_SPEC, AR_OWN] if ALL_TYPES in types else list(types)
    own = [c for c in names.columns if c != "series_id"]
    listed = names.groupBy(*own).agg(F.array_sort(F.collect_set("series_id")).alias("all"))
    none = F.lit(None).cast("string")
    q = F.array(none, *[F.lit(s) for s in quarterly])
    first = listed.select(*own, "all", F.posexplode("all").alias("_i", "m1"))
    second = F.concat(F.array(none), F.slice("all", F.col("_i") + 2, F.size("all")))
    return (
        first.withColumn("m2", F.explode(second))
        .withColumn("q", F.explode(q))
        .withColumn("interp_type", F.explode(F.lit(kinds)))
        .withColumn("spec_id", F.concat_ws("|", F.col("interp_type").cast("string"), "m1", "m2", "q"))
        .select(*own, "spec_id", "interp_type", "m1", "m2", "q")
    )


def extrapolate_ar(panel: DataFrame, lags: int = 6, keys: list[str] = SERIES) -> DataFrame:
    """Trailing gap of every series by its own AR(p) without constant.

    A group is one series on the grid. A series that cannot be fitted keeps its gap.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        x = pdf["value"].to_numpy(float).copy()
        known = np.flatnonzero(~np.isnan(x))
        if len(known) >= lags + 2 and known[-1] < len(x) - 1:
            end = known[-1] + 1
            design = np.array([x[t - lags : t][::-1] for t in range(lags, end)]).reshape(-1, lags)
            y = x[lags:end]
            ok = ~np.isnan(design).any(1) & ~np.isnan(y)
            coef = least_squares(design[ok], y[ok]) if ok.sum() >= lags + 1 else None
            if coef is not None:
                for t in range(end, len(x)):
                    recent = x[t - lags : t][::-1]
                    if np.isnan(recent).any():
                        break
                    x[t] = recent @ coef
        return pdf.assign(value=x)

    return spread(panel, keys).groupBy(*keys).applyInPandas(fill, panel.schema)


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Coefficients of a small regression, nothing where a cell is not finite or the solver gives up."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None
    try:
        return np.linalg.lstsq(x, y, rcond=None)[0]
    except np.linalg.LinAlgError:
        return None


def _step_on(x: np.ndarray, back: np.ndarray, start: int, b: np.ndarray, lags: int) -> np.ndarray:
    """Missing cells from row ``start`` on, each step from the rows before it; ``back`` is ``x`` filled forward."""
    x, hist, n = x.copy(), np.where(np.isnan(x), back, x), x.shape[1]
    for t in range(start, len(x)):
        past = [hist[t - i] if t - i >= 0 else np.zeros(n) for i in range(1, lags + 1)]
        step = b @ np.nan_to_num(np.concatenate(past))
        x[t] = np.where(np.isnan(x[t]), step, x[t])
        hist[t] = x[t]
    return x


def extrapolate_var(panel: DataFrame, keys: list[str], order: Order, lags: int = 6, lam: float = VAR_TIGHTNESS) -> DataFrame:
    """Missing cells after the last complete period by a Minnesota VAR, step by step.

    The moments come from the forward-filled history up to that period. Keys
    whose system cannot be fitted are forward filled. ``order`` names the system (see ``systems``), and ``panel`` has
    its variables only.
    """
    series = [*keys, "series_id"]
    complete = panel.groupBy(*keys, "period").agg(
        (F.count("value") == F.count(F.lit(1))).alias("ok")
    ).groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("period"))).alias("last_full"))
    back = series_window(series).rowsBetween(Window.unboundedPreceding, 0)
    filled = panel.withColumn("filled", F.last("value", ignorenulls=True).over(back))
    ready = cut(
        filled.join(complete, keys).select(*series, "period", "value", "filled", "last_full"), "ragged"
    )
    history = ready.filter(F.col("period") <= F.col("last_full")).select(*series, "period", F.col("filled").alias("value"))
    moments = bvar.system_moments(history, order, lags, keys).filter(F.col("t") > 0)
    fitted = with_names(bvar.minnesota_posterior(moments, keys, lam).filter("b is not null").select(*keys, "b"), order)

    def extend(key, pdf: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["series_id"].unique()) if par.empty else list(par.iloc[0]["names"])
        wide = pdf.pivot(index="period", columns="series_id", values="value").reindex(columns=names).sort_index()
        x, last = wide.to_numpy(float), pdf["last_full"].iloc[0] if len(pdf) else None
        back = wide.ffill().to_numpy(float)
        if pd.isna(last) or par.empty:
            x = back
        else:
            b = np.asarray(par.iloc[0]["b"], float).reshape(len(names), len(names) * lags)
            x = _step_on(x, back, int((wide.index <= last).sum()), b, lags)
        out = pd.DataFrame(x, columns=names).assign(period=wide.index).melt("period", var_name="series_id")
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*series, "period", "value"]]

    return cogroup(ready.drop("filled"), fitted, keys).applyInPandas(
        extend, key_schema(ready, keys) + ", series_id string, period date, value double"
    )


class _History:
    """Moments of the forward-filled rows of a key's whole system, from which those of any pair are cut by index.

    Pairs differ in the rows they may use: from the first in which both have been seen for all lags to the last in which
    both are observed. The moments of each such range are summed once, over all variables at a time.
    """

    def __init__(self, x: np.ndarray, lags: int):
        self.lags, self.n = lags, x.shape[1]
        self.seen = ~np.isnan(x)
        self.back = pd.DataFrame(x).ffill().to_numpy(float)
        self.first = np.where(self.seen.any(0), self.seen.argmax(0), len(x))
        lagged = [np.vstack([np.full((i, self.n), np.nan), self.back[: len(x) - i]]) for i in range(lags + 1)]
        self.rows = np.nan_to_num(np.hstack([*lagged, np.ones((len(x), 1))]))
        self.sums: dict[tuple[int, int], np.ndarray] = {}

    def moments(self, pair: list[int]) -> SimpleNamespace | None:
        """What ``bvar`` needs to know of a pair, or nothing if its history is too short."""
        full = np.flatnonzero(self.seen[:, pair].all(1))
        if not len(full):
            return None
        end, start = int(full[-1]) + 1, int(self.first[pair].max()) + self.lags
        if end <= start:
            return None
        if (start, end) not in self.sums:
            part = self.rows[start:end]
            self.sums[start, end] = part.T @ part
        at = [*[i * self.n + j for i in range(self.lags + 1) for j in pair], self.rows.shape[1] - 1]
        m = self.sums[start, end][np.ix_(at, at)]
        past = self.back[:end, pair]
        known = [past[~np.isnan(past[:, j]), j] for j in range(len(pair))]
        return SimpleNamespace(
            n=len(pair), p=self.lags, t=end - start, end=end, tri=m[np.triu_indices(len(m))],
            mean=[v.mean() for v in known], sd=[v.std(ddof=1) if len(v) > 1 else 0.0 for v in known],
        )


def extrapolate_pairs(panel: DataFrame, pairs: DataFrame, keys: list[str], lags: int = 6, lam: float = VAR_TIGHTNESS) -> DataFrame:
    """What ``extrapolate_var`` gives for the system of every pair: ``(keys, spec_id, series_id, period, value)``.

    ``pairs`` has (some keys, spec_id, m1, m2); ``series_id`` is the slot, m1 or m2. A group is the system of one key on
    the calendar: its moments are summed once and each pair's are cut out of them, so nothing is read, shuffled or counted
    per pair. A pair that cannot be fitted is forward filled.
    """
    own = [c for c in pairs.columns if c in keys]
    asked = pairs.groupBy(*own).agg(F.collect_list(F.struct("spec_id", "m1", "m2")).alias("pairs"))
    asked = panel.select(*keys).distinct().join(asked, own) if own else panel.select(*keys).distinct().withColumn("pairs", asked.select("pairs").scalar())

    def work(key, pdf: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "spec_id", "series_id", "period", "value"]
        if par.empty:
            return pd.DataFrame(columns=columns)
        wide = pdf.pivot(index="period", columns="series_id", values="value").sort_index()
        place = {name: i for i, name in enumerate(wide.columns)}
        x, out = wide.to_numpy(float), []
        history = _History(x, lags)
        for spec in par.iloc[0]["pairs"]:
            if spec["m1"] not in place or spec["m2"] not in place:
                continue
            pair = [place[spec["m1"]], place[spec["m2"]]]
            filled, row = history.back[:, pair], history.moments(pair)
            if row is not None:
                try:
                    b = bvar._posterior(row, lam, bvar.THETA, bvar.MU)[0]
                    filled = _step_on(x[:, pair], filled, row.end, b, lags)
                except np.linalg.LinAlgError:
                    pass
            for slot, j in (("m1", 0), ("m2", 1)):
                out.append(pd.DataFrame({"spec_id": spec["spec_id"], "series_id": slot, "period": wide.index, "value": filled[:, j]}))
        if not out:
            return pd.DataFrame(columns=columns)
        return pd.concat(out).assign(**dict(zip(keys, key)))[columns]

    return cogroup(panel.select(*keys, "series_id", "period", "value"), asked, keys).applyInPandas(
        work, key_schema(panel, keys) + ", spec_id string, series_id string, period date, value double"
    )


def quarter_regressors(filled: DataFrame, keys: list[str] = SERIES, lags: int = 1) -> DataFrame:
    """Quarter-end value of every indicator, ``l0``, and its values ``lags`` quarters back, 0 where there is none."""
    ends = agg_quarter(filled, "last", keys).withColumnRenamed("quarter", "period")
    w = series_window(keys)
    return ends.select(
        *keys, F.col("period").alias("quarter"),
        *[F.coalesce(F.lag("value", i).over(w) if i else F.col("value"), F.lit(0.0)).alias(f"l{i}") for i in range(lags + 1)],
    )


def bridge_design(specs: DataFrame, regressors: DataFrame, target: DataFrame, keys: list[str] = ("entity_id",),
                  quarterly: DataFrame | None = None, terms: Terms = Terms()) -> DataFrame:
    """One row per key, specification and quarter with all regressors by name.

    ``regressors`` come from ``quarter_regressors`` with an ``interp_type``, ``quarterly`` has the same columns but that;
    ``target`` has (keys, quarter, y), y missing where unpublished. ``specs`` may belong to some of the keys, and may
    state their own ``lag_m``, ``lag_q``, ``lag_y`` and ``dummies`` within ``terms``. Regressors a specification does not
    use are 0; ``const`` is 1. ``y_known`` holds the last published target before the quarter, and ``y_lag`` is missing
    where the target of ``lag_y`` quarters ago is not published (0 without such a lag).
    """
    keys = list(keys)
    shared = [c for c in specs.columns if c in keys]
    w = Window.partitionBy(*keys).orderBy("quarter")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = F.array(F.lit(0.0), *[F.lag("y", i).over(w) for i in range(1, terms.y + 1)])
    goal = target.select(
        *keys, "quarter", "y", behind.alias("behind"), F.last("y", ignorenulls=True).over(before).alias("y_known")
    )
    for name, most in (("lag_m", terms.m), ("lag_q", terms.q), ("lag_y", terms.y)):
        if name not in specs.columns:
            specs = specs.withColumn(name, F.lit(most))
    if "dummies" not in specs.columns:
        specs = specs.withColumn("dummies", F.array().cast("array<date>"))
    size = {"m1": terms.m, "m2": terms.m, "q": terms.q}

    def pick(name: str, rows: DataFrame, *more: str) -> DataFrame:
        lags = [F.col(f"l{i}").alias(f"{name}_l{i}") for i in range(size[name] + 1)]
        return rows.select(*keys, *more, F.col("series_id").alias(name), "quarter", *lags)

    # the target joins the regressors before the specifications fan them out
    first = specs.join(pick("m1", regressors, "interp_type").join(goal, [*keys, "quarter"]), [*shared, "interp_type", "m1"])
    both = first.join(pick("m2", regressors, "interp_type"), [*keys, "interp_type", "m2", "quarter"], "left")
    if quarterly is not None:
        both = both.join(pick("q", quarterly), [*keys, "q", "quarter"], "left")
    else:
        both = both.withColumns({f"q_l{i}": F.lit(0.0) for i in range(terms.q + 1)})
    own = {"m1": F.col("lag_m"), "m2": F.col("lag_m"), "q": F.col("lag_q")}
    made = {f"{s}_l{i}": F.coalesce(F.when(own[s] >= i, F.col(f"{s}_l{i}")), F.lit(0.0)) for s in size for i in range(size[s] + 1)}
    made["y_lag"] = F.get("behind", F.col("lag_y"))
    made |= {f"d{i + 1}": F.coalesce((F.get("dummies", F.lit(i)) == F.col("quarter")).cast("double"), F.lit(0.0)) for i in range(terms.dummies)}
    return both.withColumns({**made, "const": F.lit(1.0), "min_rows": F.greatest("lag_m", "lag_q", "lag_y") + 2}).select(
        *keys, "spec_id", "interp_type", "m1", "m2", "quarter", *terms.names(), "y", "y_known", "min_rows"
    )


MIN_ROWS = 3  # fixed value: largest lag plus two, for one lag
RANK_TOL = 1e-12


def _min_norm(m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray | None, int, str | None]:
    """Minimum-norm solution of the normal equations, their rank, and why there is none."""
    if not (np.isfinite(m).all() and np.isfinite(v).all()):
        return None, 0, "sums are not finite"
    try:
        values, vectors = np.linalg.eigh(m)
    except np.linalg.LinAlgError as e:
        return None, 0, str(e)
    keep = values > RANK_TOL * max(values.max(), 0.0)
    if not keep.any():
        return None, 0, "all regressors are zero"
    return vectors[:, keep] @ ((vectors[:, keep].T @ v) / values[keep]), int(keep.sum()), None


def bridge_ols(design: DataFrame, keys: list[str], terms: Terms = Terms()) -> DataFrame:
    """Least squares per specification from sums of products; too few rows give nothing.

    The sums are ordinary aggregates, combined before the shuffle. Unused
    regressors are all zero and get coefficient 0 from the minimum-norm solution; ``rank`` counts the directions that the
    rows determine. A specification that cannot be solved has no ``coef`` and a ``reason``; others are not touched.
    """
    names = terms.names()
    usable = F.col("y").isNotNull() & F.col("y_lag").isNotNull()
    k = len(names)
    xx = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(k) for j in range(i, k)]
    xy = [F.sum(F.col(c) * F.col("y")) for c in names]
    sums = design.filter(usable).groupBy(*keys, "spec_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("min_rows").alias("least"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy")
    ).filter(F.col("n") >= F.col("least"))
    upper = np.triu_indices(k)

    def solve(batches):
        for pdf in batches:
            out = []
            for xx_flat, xy_flat in zip(pdf["xx"], pdf["xy"]):
                m = np.zeros((k, k))
                m[upper] = xx_flat
                out.append(_min_norm(m + np.triu(m, 1).T, np.asarray(xy_flat, float)))
            yield pdf[[*keys, "spec_id", "n"]].assign(**{c: [o[i] for o in out] for i, c in enumerate(("coef", "rank", "reason"))})

    return sums.mapInPandas(solve, key_schema(design, keys) + ", spec_id string, n bigint, coef array<double>, rank int, reason string")


def bridge_simple(xy: DataFrame, keys: list[str]) -> DataFrame:
    """The one-regressor case (x, y) without lags, as built-in regression aggregates."""
    return xy.groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_count("y", "x").alias("n"),
    ).filter(F.col("n") >= MIN_ROWS)


def bridge_terms(design: DataFrame, coefs: DataFrame, keys: list[str], terms: Terms = Terms()) -> DataFrame:
    """Regressor times coefficient for every term; an unknown lagged target is the last known one."""
    joined = design.join(coefs, [*keys, "spec_id"])
    values = [F.coalesce("y_lag", "y_known") if c == "y_lag" else F.col(c) for c in terms.names()]
    parts = F.array(*[
        F.struct(F.lit(c).alias("term"), (v * F.col("coef")[i]).alias("contribution"))
        for i, (c, v) in enumerate(zip(terms.names(), values))
    ])
    return joined.withColumn("terms", parts)


def bridge_forecast(design: DataFrame, coefs: DataFrame, keys: list[str], terms: Terms = Terms()) -> DataFrame:
    total = F.aggregate("terms", F.lit(0.0), lambda s, e: s + e["contribution"])
    return bridge_terms(design, coefs, keys, terms).select(*keys, "spec_id", "quarter", total.alias("fcst"), "y")


def bridge_contributions(design: DataFrame, coefs: DataFrame, keys: list[str], terms: Terms = Terms()) -> DataFrame:
    return bridge_terms(design, coefs, keys, terms).select(*keys, "spec_id", "quarter", F.inline("terms"))


def bridge_median(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Median over specifications, on the quarter-end month."""
    return forecasts.groupBy(*keys, "quarter").agg(
        F.median("fcst").alias("value"), F.count("fcst").alias("n_specs")
    ).withColumn("period", cal.quarter_end_month(F.col("quarter")))


def beq_fit(panel: DataFrame, target: DataFrame, order: Order, keys: list[str], lags: int = 6,
            types: tuple[int, ...] = (ALL_TYPES,), terms: Terms = Terms(), dummies: list[str] = (),
            quarterly: DataFrame | None = None) -> DataFrame:
    """All specifications over the indicators in ``order`` for every key, and their forecasts.

    ``panel`` is the dense monthly panel, ``target`` has (keys, quarter, y). ``order`` is one list of indicators for all
    keys or a table of them by key (see ``systems``). ``terms`` sets the lags of all specifications, ``dummies`` names
    quarters (their first days) that get a dummy, and ``quarterly``, on the quarters of the target with (keys, series_id,
    quarter, l0, l1, ...), adds quarterly regressors. Non-finite cells and unsolvable systems cost the specifications
    that hold them.
    """
    spark = panel.sparkSession
    if isinstance(order, DataFrame):
        names = order.select(*own_keys(order), "series_id")
    else:
        names = spark.createDataFrame([(s,) for s in order], "series_id string")
    extra = [] if quarterly is None else sorted(r[0] for r in quarterly.select("series_id").distinct().collect())
    terms = terms._replace(dummies=len(dummies))
    specs = bridge_specs(names, types, extra).withColumn("dummies", F.array(*[F.lit(d).cast("date") for d in dummies]).cast("array<date>"))
    specs = cut(specs, "specs")
    kinds = [VAR_ALL, VAR_SPEC, AR_OWN] if ALL_TYPES in types else list(types)
    series = [*keys, "series_id"]
    # read by every kind of fill
    used = cut(place(panel, order).select(*series, "period", "value"), "indicators")
    fills = {}
    if AR_OWN in kinds or VAR_SPEC in kinds:
        fills["ar-fills"] = lambda: quarter_regressors(extrapolate_ar(used, lags, series), series, terms.m)
    if VAR_ALL in kinds:
        fills["var-fills"] = lambda: quarter_regressors(extrapolate_var(used, keys, order, lags), series, terms.m)
    made = together(fills)
    # a single indicator as its own system is its autoregression
    parts = [made["ar-fills"].withColumn("interp_type", F.lit(k)) for k in (AR_OWN, VAR_SPEC) if k in kinds]
    if VAR_ALL in kinds:
        parts.append(made["var-fills"].withColumn("interp_type", F.lit(VAR_ALL)))
    regressors = parts[0]
    for part in parts[1:]:
        regressors = regressors.unionByName(part)
    paired = (F.col("interp_type") == VAR_SPEC) & F.col("m2").isNotNull()
    design = bridge_design(specs.filter(~paired), regressors, target, keys, quarterly, terms)
    if VAR_SPEC in kinds:
        design = design.unionByName(_own_system_design(specs.filter(paired), used, target, keys, lags, quarterly, terms))
    design = cut(design, "design")
    return bridge_forecast(design, bridge_ols(design, keys, terms), keys, terms)


def _own_system_design(pairs, used, target, keys, lags, quarterly, terms):
    """Pairs that fill their indicators by a VAR of the two: their regressors are told apart by specification."""
    fills = pairs.select(*[c for c in pairs.columns if c in keys], F.concat_ws("|", "m1", "m2").alias("spec_id"), "m1", "m2").distinct()
    spec_keys = [*keys, "spec_id"]
    filled = quarter_regressors(extrapolate_pairs(used, fills, keys, lags), [*spec_keys, "series_id"], terms.m)
    own = F.concat(F.col("series_id"), F.lit("|"), F.col("spec_id"))
    regressors = filled.withColumn("series_id", own).drop("spec_id").withColumn("interp_type", F.lit(VAR_SPEC))
    slot = lambda m: F.concat(F.lit(f"{m}|"), F.concat_ws("|", "m1", "m2"))
    named = pairs.withColumns({"_m1": F.col("m1"), "_m2": F.col("m2"), "m1": slot("m1"), "m2": slot("m2")})
    names = named.select("spec_id", "_m1", "_m2").distinct()
    design = bridge_design(named.drop("_m1", "_m2"), cut(regressors, "pair-fills"), target, keys, quarterly, terms)
    back = design.join(names, "spec_id").withColumns({"m1": F.col("_m1"), "m2": F.col("_m2")})
    return back.drop("_m1", "_m2")
