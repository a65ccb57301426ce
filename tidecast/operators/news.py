"""What each newly published series did to the nowcast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.numeric import direction
from tidecast.operators import gaussian as g
from tidecast.operators.dfm import key_schema
from tidecast.operators.state_space import kalman_collapse
from tidecast.operators.vintage import vintage_diff
from tidecast.session import cut, spread


def news_scenarios(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that are new or revised and available: the rows that set each scenario apart.

    A scenario is the old data with one series brought up to date. It is kept
    as its difference to the old data, not as a copy of the panel.
    """
    diff = vintage_diff(old, new, [*keys, "series_id", "period"])
    return diff.filter(F.col("status").isin("added", "revised"))


#: Changed series of one row: so many share one backward pass and one copy of their key's sums.
SHARE = 256


def news_decompose(
    old: DataFrame, new: DataFrame, loadings: DataFrame, params: DataFrame, target: str, keys: list[str], k: int,
) -> DataFrame:
    """Contribution of every changed series to the change of the nowcast of ``target``.

    ``old`` and ``new`` are standardised with the old moments; ``params`` has (keys, a, q, period) with the period to
    nowcast. A scenario is the old data with one series brought up to date. The nowcast is linear in the collapsed
    observations, and one backward pass over the old ones gives the weight of every period, so a series with revised
    cells is one inner product; a cell that was not observed before also adds to what its period says, a change of rank
    one. The series of a key are dealt to rows of ``SHARE``, each with one copy of the key's sums. Contributions are
    scaled to add up to the total change.

    A series whose cells or loadings are not finite has no contribution (null) and takes no part in the scaling; a key
    whose states cannot be worked out has null everywhere; other keys go on.
    """
    on = [*keys, "series_id"]
    load = loadings.select(*on, "c", "noise")
    base_old = kalman_collapse(old, load, k, keys, on)
    base_new = kalman_collapse(new, load, k, keys, on)

    def as_row(base: DataFrame, name: str) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.struct("period", "info", "b")))
        return base.groupBy(*keys).agg(cells.alias("s")).select(
            *keys,
            F.transform("s", lambda e: e["period"]).alias(f"periods_{name}"),
            F.flatten(F.transform("s", lambda e: e["info"])).alias(f"info_{name}"),
            F.flatten(F.transform("s", lambda e: e["b"])).alias(f"b_{name}"),
        )

    aim = load.filter(F.col("series_id") == target).select(*keys, F.col("c").alias("aim"))
    base = cut(as_row(base_old, "old").join(params, keys).join(aim, keys), "news-base")
    changed = news_scenarios(old, new, keys).join(load, on).groupBy(*on).agg(
        F.first("c").alias("c"), F.first("noise").alias("noise"),
        F.sort_array(F.collect_list(F.struct("period", F.col("old_value").alias("was"), F.col("new_value").alias("now")))).alias("cells"),
    )
    sizes = changed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    member = F.struct("series_id", "c", "noise", "cells")
    rows = changed.join(sizes, keys).withColumn("share", F.pmod(F.xxhash64("series_id"), F.col("shares")).cast("int"))
    rows = rows.groupBy(*keys, "share").agg(F.collect_list(member).alias("members")).join(base, keys)
    ends = base.join(as_row(base_new, "new"), keys)

    def scenarios(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                given = {c: getattr(r, c) for c in keys}
                names = [m["series_id"] for m in r.members]
                try:
                    values = _Weights(r, k).nowcasts(r.members)
                except np.linalg.LinAlgError:
                    values = [None] * len(names)
                yield pd.DataFrame({**given, "series_id": names, "nowcast": values})[[*on, "nowcast"]]

    def totals(batches):
        for pdf in batches:
            out = [{**{c: getattr(r, c) for c in keys}, **{f"{e}_nowcast": _nowcast(r, e, k) for e in ("old", "new")}} for r in pdf.itertuples()]
            yield pd.DataFrame(out, columns=[*keys, "old_nowcast", "new_nowcast"])

    head = key_schema(rows, keys)
    nowcasts = cut(spread(rows, [*keys, "share"]).mapInPandas(scenarios, f"{head}, series_id string, nowcast double"), "scenarios")
    both = spread(ends, keys).mapInPandas(totals, f"{head}, old_nowcast double, new_nowcast double")
    # a hot key may have very many changed series: its totals are an aggregate, not a window
    moves = nowcasts.groupBy(*keys).agg(F.sum("nowcast").alias("s"), F.count("nowcast").alias("n"))
    raw = F.col("nowcast") - F.col("old_nowcast")
    total = F.col("new_nowcast") - F.col("old_nowcast")
    summed = F.col("s") - F.col("n") * F.col("old_nowcast")
    contribution = F.when(F.abs(summed) > 1e-12, raw * total / summed).otherwise(raw)
    return nowcasts.join(moves.join(both, keys), keys).withColumn("contribution", contribution).select(
        *on, "old_nowcast", "new_nowcast", "contribution",
        (F.abs("contribution") / (F.abs(total) + 1e-12) * 100).alias("pct_of_total"),
        direction(F.col("contribution")).alias("direction"),
    )


def _system(row, which: str, k: int):
    info = np.array(getattr(row, f"info_{which}"), float).reshape(-1, k, k)
    b = np.array(getattr(row, f"b_{which}"), float).reshape(-1, k)
    a, q = (np.asarray(m, float).reshape(k, k) for m in (row.a, row.q))
    return info, b, a, q, list(getattr(row, f"periods_{which}")).index(row.period)


def _nowcast(row, which: str, k: int) -> float | None:
    try:
        info, b, a, q, at = _system(row, which, k)
        if not info.any():
            return 0.0  # nothing observed at all: the baseline
        zs, _, _ = g.smooth_states(a, *g.filter_states(info, b, a, q, np.zeros(k), np.eye(k)))
    except np.linalg.LinAlgError:
        return None
    value = float(np.asarray(row.aim, float) @ zs[at])
    return value if np.isfinite(value) else None


class _Weights:
    """What a change of any period's collapsed observations does to the nowcast of one key.

    With ``P`` the covariance of all states given the old data, the smoothed states are ``P b``: block (s, t) of ``P`` is
    the weight of period t on period s. Blocks follow from the smoother's gains, and only those that changed cells ask
    for are formed.
    """

    def __init__(self, row, k: int):
        self.info, self.b, self.a, self.q, self.at = _system(row, "old", k)
        self.aim, self.k = np.asarray(row.aim, float), k
        self.place = {d: i for i, d in enumerate(row.periods_old)}
        passed = g.filter_states(self.info, self.b, self.a, self.q, np.zeros(k), np.eye(k))
        zp, vp, zf, vf = passed
        self.zs, self.vs, _ = g.smooth_states(self.a, *passed)
        self.gains = [vf[t] @ self.a.T @ g._right_inverse(vp[t + 1]) for t in range(len(zf) - 1)]
        # states or variances at their limits are not linear in the data
        states = max(np.abs(z).max(initial=0.0) for z in (zp, zf, self.zs))
        spreads = max(np.abs(np.diagonal(v, axis1=1, axis2=2)).max(initial=0.0) for v in (vp, self.vs))
        self.linear = states < g.STATE_LIMIT and spreads < g.VARIANCE_LIMIT
        self.blocks: dict[tuple[int, int], np.ndarray] = {}

    def block(self, s: int, t: int) -> np.ndarray:
        """Covariance of the states of periods s and t given the old data."""
        if s > t:
            return self.block(t, s).T
        if (s, t) not in self.blocks:
            out = self.vs[t]
            for i in range(t - 1, s - 1, -1):
                out = self.gains[i] @ out
                self.blocks[i, t] = out
            self.blocks[s, t] = out
        return self.blocks[s, t]

    def nowcasts(self, members) -> list[float | None]:
        return [self._one(m) for m in members]

    def _one(self, member) -> float | None:
        c, noise = np.asarray(member["c"], float), float(member["noise"])
        cells = [(self.place[e["period"]], e["was"], e["now"]) for e in member["cells"]]
        fresh = [t for t, was, _ in cells if was is None or np.isnan(was)]
        moves = {t: (now - (0.0 if t in fresh else was)) / noise for t, was, now in cells}
        if not (np.isfinite(c).all() and np.isfinite(noise) and np.isfinite(list(moves.values())).all()):
            return None
        try:
            value = self._shifted(c, noise, fresh, moves) if self.linear else self._smoothed(c, noise, fresh, moves)
        except np.linalg.LinAlgError:
            return None
        return float(value) if np.isfinite(value) else None

    def _shifted(self, c, noise, fresh, moves) -> float:
        """The nowcast after moves of ``c`` times a number in some periods, where ``fresh`` ones also gain ``c c' / noise``."""
        if not self.info.any() and not moves:
            return 0.0
        reach = lambda s: sum(self.block(s, t) @ c * x for t, x in moves.items())
        value = self.aim @ (self.zs[self.at] + reach(self.at))
        if not fresh:
            return value
        root = c / np.sqrt(noise)
        seen = np.array([root @ (self.zs[t] + reach(t)) for t in fresh])
        among = np.array([[root @ self.block(s, t) @ root for t in fresh] for s in fresh])
        to_aim = np.array([self.aim @ self.block(self.at, t) @ root for t in fresh])
        return value - to_aim @ np.linalg.solve(np.eye(len(fresh)) + among, seen)

    def _smoothed(self, c, noise, fresh, moves) -> float:
        info, b = self.info.copy(), self.b.copy()
        for t, x in moves.items():
            b[t] += c * x
            if t in fresh:
                info[t] += np.outer(c, c) / noise
        zs, _, _ = g.smooth_states(self.a, *g.filter_states(info, b, self.a, self.q, np.zeros(self.k), np.eye(self.k)))
        return self.aim @ zs[self.at]


def news_by_group(news: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    grouped = news.join(meta.select("series_id", "grp"), "series_id", "left")
    return grouped.groupBy(*keys, F.coalesce("grp", F.lit("other")).alias("grp")).agg(
        F.sum("contribution").alias("contribution"), F.count(F.lit(1)).alias("n_series")
    )


def news_order(news: DataFrame, keys: list[str]) -> DataFrame:
    """Largest absolute contribution of each key first: a range sort over all tasks."""
    return news.orderBy(*keys, F.desc(F.abs("contribution")), "series_id")
