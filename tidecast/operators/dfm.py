"""Dynamic factor model fitted for every key at once.

Series are kept in blocks: one row holds some hundreds of series of one key,
each as long as the calendar. A key that fits into one block is a small
independent problem, and all its EM steps run where the row is. A wider key is
fitted by passes over its blocks: a block needs the smoothed states of its key
to refit its own loadings, and gives back the collapsed observations under
them; Spark adds those up per key, and one small recursion per key turns the
sums into the next states. Blocks reach Python series by series, so a batch has
the size of some thousand series however many there are. Only the states, a row per key, are written between
two steps; loadings follow from them and are never stored while the fit runs.
Both ways take the same steps and return the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import gaussian as g
from tidecast.operators.transforms import MIN_STD
from tidecast.session import cogroup, cut, discard, spread

BLOCK, FITS, MAX_LAGS = 256, 64, 5
STATE = (
    "k int, r int, p int, start date, groups array<string>, a array<double>, q array<double>, z0 array<double>, "
    "v0 array<double>, zs array<double>, vs array<double>, size array<double>, loglik double, it int, done boolean"
)

HELD = ["k", "r", "p", "groups", "zs", "vs", "size", "it"]  # what loadings follow from


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)


def panel_blocks(panel: DataFrame, keys: list[str], groups: DataFrame | None = None, block_size: int = BLOCK) -> DataFrame:
    """Standardised series of each key in blocks of bounded number.

    ``panel`` is dense. A key with very many series has as many rows as it
    needs, each of about ``block_size`` series.
    """
    sd = F.stddev_pop("value")
    series = panel.groupBy(*keys, "series_id").agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mu"),
        F.when(sd >= MIN_STD, sd).otherwise(F.lit(1.0)).alias("sigma"),
        F.min("period").alias("start"),
        F.array_sort(F.collect_list(F.struct("period", "value"))).alias("cells"),
    )
    if groups is not None:
        series = series.join(groups.select("series_id", "grp"), "series_id", "left")
    else:
        series = series.withColumn("grp", F.lit(None).cast("string"))
    y = F.transform("cells", lambda c: (c["value"] - F.col("mu")) / F.col("sigma"))
    series = cut(series.select(*keys, "series_id", "grp", "mu", "sigma", "start", y.alias("y")), "series")
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n_blocks = F.ceil(F.col("n") / block_size).cast("int")
    placed = series.join(sizes, keys).withColumn("n_blocks", n_blocks).withColumn(
        "block", F.pmod(F.xxhash64("series_id"), F.col("n_blocks")).cast("int")
    )
    member = F.struct("series_id", "grp", "mu", "sigma", "y")
    return spread(placed, [*keys, "block"]).groupBy(*keys, "block").agg(
        F.min("start").alias("start"), F.first("n_blocks").alias("n_blocks"), F.array_sort(F.collect_list(member)).alias("m")
    ).select(
        *keys, "block", "n_blocks", "start",
        *[F.col(f"m.{f}").alias(f) for f in ("series_id", "grp", "mu", "sigma", "y")],
    )


def _matrix(y) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in y])


def _by_series(blocks: DataFrame, keys: list[str], once: list[str], each: list[str]) -> DataFrame:
    """One row per series: its keys, ``once`` on the first series of a block (NULL on the others), ``each`` of its own.

    A batch for Python is limited in rows, so rows of bounded size bound the batch; a row per block would not.
    """
    rows = blocks.select(*keys, *once, F.posexplode(F.arrays_zip(*each)).alias("at", "series"))
    return rows.select(*keys, "at", *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in once], *[f"series.{c}" for c in each])


def _each_block(batches: Iterator[pd.DataFrame], keys: list[str], once: list[str], each: list[str]) -> Iterator[SimpleNamespace]:
    """The blocks that ``_by_series`` unfolded, one after the other; a block may go on in the next batch."""
    row = None
    for pdf in batches:
        if pdf.empty:
            continue
        at, cells = pdf["at"].to_numpy(), {c: pdf[c].to_list() for c in each}
        starts = sorted({0, *np.flatnonzero(at == 0).tolist()})
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            if at[a] == 0:
                if row is not None:
                    yield row
                row = SimpleNamespace(**{c: pdf[c].iat[a] for c in [*keys, *once]}, **{c: [] for c in each})
            for c in each:
                getattr(row, c).extend(cells[c][a:b])
    if row is not None:
        yield row


def _run_sums(rows: Iterator[SimpleNamespace], keys: list[str], sums_of) -> Iterator[pd.DataFrame]:
    """``sums_of`` each block, added up over blocks of one key that follow each other."""
    now = total = None
    for row in rows:
        key, part = {c: getattr(row, c) for c in keys}, sums_of(row)
        if key == now and len(part) == len(total):
            total = total + part
            continue
        if now is not None:
            yield pd.DataFrame([{**now, "sums": total}])
        now, total = key, part
    if now is not None:
        yield pd.DataFrame([{**now, "sums": total}])


def _allowed(grp, row) -> np.ndarray:
    """Which states each series of a block may load on."""
    names = list(row.groups)
    m = int(row.r) * int(row.p)
    out = np.zeros((len(grp), int(row.k)), dtype=bool)
    out[:, :m] = True
    for i, name in enumerate(grp):
        if name in names:
            out[i, m + names.index(name)] = True
    return out


def _loadings(y, grp, row):
    """Loadings and noise of a block: from principal components at first, then by regression."""
    k, r = int(row.k), int(row.r)
    zs = np.asarray(row.zs, float).reshape(-1, k)
    if row.it == 0:
        y0 = np.nan_to_num(y)
        f, c = zs[:, :r], np.zeros((len(y), k))
        c[:, :r] = y0 @ f / np.maximum(np.asarray(row.size, float), 1e-12)
        extra = _allowed(grp, row)[:, r * int(row.p) :]
        c[:, r * int(row.p) :] = extra * (0.5 * c[:, :1])
        noise = (y0 - c[:, :r] @ f.T).var(axis=1)
        return c, np.where(noise < g.R_START_FLOOR, g.R_START, noise)
    vs = np.asarray(row.vs, float).reshape(-1, k, k)
    return g.regress_loadings(y, zs, vs, _allowed(grp, row))


def _block_sums(y: np.ndarray, grp, row) -> np.ndarray:
    c, noise = _loadings(y, grp, row)
    return np.concatenate([part.ravel() for part in g.collapse(y, c, noise)])


def _sums(blocks: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Collapsed observations of every key under the loadings its states imply, added up over its blocks.

    The state side is one row per key; the engine broadcasts it when its
    measured size allows and otherwise joins by key, splitting a hot key.
    """

    def work(batches):
        yield from _run_sums(_each_block(batches, keys, HELD, ["grp", "y"]), keys, lambda r: _block_sums(_matrix(r.y), r.grp, r))

    joined = blocks.select(*keys, "grp", "y").join(state.select(*keys, *HELD), keys)
    parts = _by_series(joined, keys, HELD, ["grp", "y"]).mapInPandas(work, key_schema(blocks, keys) + ", sums array<double>")
    return _added(parts, keys)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``sums`` of every key added up cell by cell, combined before the shuffle: no task meets all parts of a wide key."""
    x = F.coalesce("x", F.lit(float("nan")))  # pandas hands a NaN over as NULL
    cells = parts.select(*keys, F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(
        F.sum(x).alias("x"), F.count(F.lit(1)).alias("n")
    )
    sums = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"])
    uneven = F.raise_error("blocks of a key differ in length")
    return cells.groupBy(*keys).agg(F.when(F.min("n") == F.max("n"), sums).otherwise(uneven).alias("sums"))


def _unpack(total: np.ndarray, k: int):
    n_t = len(total) // (k * k + k + 3)
    info, b, n, log_r, yy = np.split(total, np.cumsum([n_t * k * k, n_t * k, n_t, n_t]))
    return info.reshape(n_t, k, k), b.reshape(n_t, k), n, log_r, yy


def _first_state(gram: np.ndarray, n_series: int, r: int, p: int, start, names: list[str]) -> dict:
    """Principal components from the calendar-by-calendar Gram matrix and the VAR of the factors."""
    n_t = len(gram)
    lead = max(min(r, n_series - 1, n_t), 1)
    values, vectors = np.linalg.eigh(gram)
    size = np.maximum(values[::-1][:lead], 0.0)
    f = vectors[:, ::-1][:, :lead] * np.sqrt(size)
    f = f * np.where(f[np.abs(f).argmax(0), range(lead)] < 0, -1.0, 1.0)  # fixed orientation
    a, q = g.factor_var(f, p, len(names))
    zs = np.zeros((n_t, len(a)))
    zs[:, :lead] = f
    return {
        "k": len(a), "r": lead, "p": p, "start": start, "groups": names, "a": a.ravel(), "q": q.ravel(),
        "z0": np.zeros(len(a)), "v0": g.stationary_variance(a, q).ravel(), "zs": zs.ravel(), "vs": np.zeros(0),
        "size": size, "loglik": np.nan, "it": 0, "done": False,
    }


def _next_state(row: dict, total: np.ndarray, thresh: float, update: bool) -> dict:
    """Smooth under the summed observations of a key; with ``update`` refit its transition."""
    k, r, p = int(row["k"]), int(row["r"]), int(row["p"])
    info, b, n, log_r, yy = _unpack(total, k)
    a, q, v0 = (np.asarray(row[c], float).reshape(k, k) for c in ("a", "q", "v0"))
    zp, vp, zf, vf = g.filter_states(info, b, a, q, np.asarray(row["z0"], float), v0)
    zs, vs, cross = g.smooth_states(a, zp, vp, zf, vf)
    loglik = g.innovations_loglik(info, b, n, log_r, yy, zp, vp)
    change = abs(loglik - row["loglik"]) / (abs(row["loglik"]) + 1e-10)
    new = dict(row)
    new.update(zs=zs.ravel(), vs=vs.ravel(), loglik=loglik, it=int(row["it"]) + 1)
    if update:
        a, q = g.transition_step(zs, vs, cross, r, p)
        new.update(a=a.ravel(), q=q.ravel(), z0=zs[0], v0=vs[0].ravel(), done=bool(new["it"] > 3 and change < thresh))
    return new


def _order(given: dict, factors: int, lags: int) -> tuple[int, int]:
    r, p = int(given.get("n_factors", factors)), int(given.get("n_lags", lags))
    if p > MAX_LAGS:
        raise ValueError(f"{p} lags asked for; the factor VAR has {MAX_LAGS} at most")
    return r, p


def _names(groups, grouped: bool) -> list[str]:
    return sorted({x for part in groups for x in part if x is not None}) if grouped else []


def fit_small(blocks: DataFrame, keys: list[str], factors: int, lags: int, max_iter: int, thresh: float, grouped: bool) -> DataFrame:
    """All steps of every key that is one block, one row in and two out: basis and final states."""

    each = ["grp", "y"]

    def work(batches):
        out = []
        for r in _each_block(batches, keys, ["start"], each):
            y, given = _matrix(r.y), {c: getattr(r, c) for c in keys}
            n_factors, n_lags = _order(given, factors, lags)
            try:
                if np.isinf(y).any():
                    raise np.linalg.LinAlgError("a cell is infinite")
                y0 = np.nan_to_num(y)
                state = _first_state(y0.T @ y0, len(y), n_factors, n_lags, r.start, _names([r.grp], grouped))
                for _ in range(max_iter):
                    state = _next_state(state, _block_sums(y, r.grp, SimpleNamespace(**state)), thresh, True)
                    if state["done"]:
                        break
                last = _next_state(state, _block_sums(y, r.grp, SimpleNamespace(**state)), thresh, False)
                last["it"] = state["it"]
            except np.linalg.LinAlgError:
                continue  # a key that cannot be fitted has no states; other keys go on
            out += [{**given, **state, "final": False}, {**given, **last, "final": True}]
            if len(out) >= 2 * FITS:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)

    rows = _by_series(spread(blocks, [*keys, "block"]), keys, ["start"], each)
    return rows.mapInPandas(work, f"{key_schema(blocks, keys)}, {STATE}, final boolean")


def initial_states(blocks: DataFrame, keys: list[str], factors: int, lags: int, grouped: bool = False) -> DataFrame:
    """Principal components of each key and the VAR of its factors.

    The calendar-by-calendar Gram matrix is a sum over blocks, so the number of
    series does not matter; its eigenvectors are the factors up to scale.
    """

    def gram(batches):
        def one(row):
            y0 = np.nan_to_num(_matrix(row.y))
            return (y0.T @ y0).ravel()

        yield from _run_sums(_each_block(batches, keys, [], ["y"]), keys, one)

    def first(key, pdf: pd.DataFrame) -> pd.DataFrame:
        row, given = pdf.iloc[0], dict(zip(keys, key))
        total = np.asarray(row["sums"], float)
        n_t = int(round(len(total) ** 0.5))
        r, p = _order(given, factors, lags)
        names = _names([row["groups"]], grouped)
        state = _first_state(total.reshape(n_t, n_t), int(row["n"]), r, p, row["start"], names)
        return pd.DataFrame([{**given, **state}])

    schema = key_schema(blocks, keys)
    parts = _by_series(blocks, keys, [], ["y"]).mapInPandas(gram, f"{schema}, sums array<double>")
    groups = F.collect_set(F.array_sort(F.array_distinct("grp")))
    known = blocks.groupBy(*keys).agg(
        F.min("start").alias("start"), F.sum(F.size("grp")).alias("n"), F.array_distinct(F.flatten(groups)).alias("groups")
    )
    return spread(_added(parts, keys).join(known, keys), keys).groupBy(*keys).applyInPandas(first, f"{schema}, {STATE}")


def em_step(blocks: DataFrame, state: DataFrame, keys: list[str], thresh: float = 1e-4, update: bool = True) -> DataFrame:
    """Smooth every key under the loadings its last states imply, then refit its transition.

    With ``update`` off the parameters stay and only the states are refreshed.
    """

    def advance(key, parts: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        total = np.asarray(parts["sums"].iat[0], float)
        return pd.DataFrame([_next_state(old.iloc[0].to_dict(), total, thresh, update)])[list(old.columns)]

    return cogroup(_sums(blocks, state, keys), state, keys).applyInPandas(
        advance, f"{key_schema(state, keys)}, {STATE}"
    )


def fit_wide(blocks: DataFrame, keys: list[str], factors: int, lags: int, max_iter: int, thresh: float, grouped: bool):
    """Steps over the blocks of all wide keys together; settled keys are set aside."""
    state = cut(initial_states(blocks, keys, factors, lags, grouped), "state")
    finished: DataFrame | None = None
    written = [state]
    for _ in range(max_iter):
        state = cut(em_step(blocks, state, keys, thresh), "state")
        written.append(state)
        settled = state.filter("done")
        finished = settled if finished is None else finished.unionByName(settled)
        state = state.filter("not done")
        if state.isEmpty():
            break
    basis = cut(state if finished is None else state.unionByName(finished), "state")
    for old in written:
        discard(old)
    # one more pass: the states under the final parameters
    last = em_step(blocks, basis, keys, thresh, update=False).withColumn("it", F.col("it") - 1)
    return basis, cut(last, "state")


@dataclass
class DfmFit:
    """Blocks of the panel, one row of parameters and states per key, and the states the loadings rest on."""

    blocks: DataFrame
    state: DataFrame
    basis: DataFrame
    keys: list[str]

    def factors(self) -> DataFrame:
        """Smoothed state ``z`` and its variance ``v`` (row-major) per period."""
        at = F.sequence(F.lit(0), (F.size("zs") / F.col("k") - 1).cast("int"))
        rows = F.transform(at, lambda t: F.struct(
            F.add_months("start", t).alias("period"),
            F.slice("zs", t * F.col("k") + 1, F.col("k")).alias("z"),
            F.slice("vs", t * F.col("k") * F.col("k") + 1, F.col("k") * F.col("k")).alias("v"),
        ))
        return self.state.select(*self.keys, F.inline(rows))

    def loadings(self) -> DataFrame:
        """Loadings ``c``, noise ``r``, ``mu`` and ``sigma`` of every series."""

        each = ["series_id", "grp", "mu", "sigma", "y"]

        def work(batches):
            for row in _each_block(batches, keys, HELD, each):
                c, noise = _loadings(_matrix(row.y), row.grp, row)
                part = pd.DataFrame({
                    "series_id": row.series_id, "c": list(c), "noise": noise, "mu": row.mu, "sigma": row.sigma,
                })
                for key in keys:
                    part[key] = getattr(row, key)
                yield part[[*keys, "series_id", "c", "noise", "mu", "sigma"]]

        keys = self.keys
        schema = key_schema(self.blocks, keys) + ", series_id string, c array<double>, noise double, mu double, sigma double"
        joined = self.blocks.select(*keys, *each).join(self.basis.select(*keys, *HELD), keys)
        return _by_series(joined, keys, HELD, each).mapInPandas(work, schema)

    def project(self, series: list[str] | None = None) -> DataFrame:
        """Fitted path of every (or each listed) series in its own units."""
        rows = self.loadings()
        if series is not None:
            rows = rows.filter(F.col("series_id").isin(series))
        k, at = F.col("k"), F.sequence(F.lit(0), (F.size("zs") / F.col("k") - 1).cast("int"))
        value = lambda t: F.aggregate(
            F.zip_with("c", F.slice("zs", t * k + 1, k), lambda x, z: x * z), F.lit(0.0), lambda s, e: s + e
        ) * F.col("sigma") + F.col("mu")
        path = F.transform(at, lambda t: F.struct(F.add_months("start", t).alias("period"), value(t).alias("value")))
        joined = rows.join(self.state.select(*self.keys, "k", "start", "zs"), self.keys)
        return joined.select(*self.keys, "series_id", F.inline(path))


def with_specs(blocks: DataFrame, keys: list[str], specs) -> tuple[DataFrame, list[str]]:
    """Blocks under several (n_factors, n_lags): a list for all keys, or a table by key."""
    if isinstance(specs, DataFrame):
        on = [c for c in specs.columns if c in keys]
        out = blocks.join(specs, on)
    else:
        pairs = [F.struct(F.lit(r).alias("n_factors"), F.lit(p).alias("n_lags")) for r, p in specs]
        out = blocks.select("*", F.inline(F.array(*pairs)))
    return out, [*keys, "n_factors", "n_lags"]


def dfm_fit(
    panel: DataFrame, keys: list[str], r: int = 2, p: int = 4, max_iter: int = 100, thresh: float = 1e-4,
    groups: DataFrame | None = None, specs=None, block_size: int = BLOCK,
) -> DfmFit:
    """Fit every key until its likelihood settles.

    ``panel`` is dense with (keys, series_id, period, value). With ``groups``
    (series_id, grp) one more factor per group loads on that group alone. With
    ``specs`` each key is fitted under several (n_factors, n_lags), which then
    belong to the key.
    """
    blocks = panel_blocks(panel, keys, groups, block_size)
    if specs is not None:
        blocks, keys = with_specs(blocks, keys, specs)
    blocks = cut(blocks, "blocks")
    how = (r, p, max_iter, thresh, groups is not None)
    both = cut(fit_small(blocks.filter("n_blocks = 1"), keys, *how), "states")
    basis, state = (both.filter(f"final = {f}").drop("final") for f in ("false", "true"))
    wide = blocks.filter("n_blocks > 1")
    if not wide.isEmpty():
        wide_basis, wide_state = fit_wide(wide, keys, *how)
        basis, state = basis.unionByName(wide_basis), state.unionByName(wide_state)
    return DfmFit(blocks, state, basis, keys)
