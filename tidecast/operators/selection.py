"""Moments, correlations and the ranking of candidate indicators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.numeric import dot, safe_corr
from tidecast.operators.systems import Order, place, with_names
from tidecast.schemas import ENTITY
from tidecast.session import cut, spread

BLOCK = 256


def design_rows(panel: DataFrame, order: Order, lags: int, keys: list[str] = ENTITY) -> DataFrame:
    """One row per period with the vector of values and of ``lags`` earlier vectors.

    ``order`` names the variables of each key's system (see ``systems``), so the vectors are as long as the model
    specification and not as the data. Rows with a missing entry drop.
    """
    rows = (
        place(panel, order)
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "period")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"), F.max("n").alias("full"))
        .withColumn("y", F.transform("cells", lambda c: c["value"]))
    )
    w = Window.partitionBy(*keys).orderBy("period")
    x = F.concat(*[F.lag("y", k).over(w) for k in range(1, lags + 1)]) if lags else F.col("y")
    return (
        rows.withColumn("x", x)
        .filter((F.size("y") == F.col("full")) & (F.size("x") == F.col("full") * max(lags, 1)))
        .select(*keys, "period", "y", "x")
    )


def moment_matrix(rows: DataFrame, keys: list[str] = ENTITY, column: str = "v") -> DataFrame:
    """Sums of products of all entries of a vector column, as (i, j, s) with i <= j.

    Products leave each row unfolded and are summed on the map side; what is
    shuffled is one small triangle per key and task.
    """
    cells = F.posexplode(F.col(column)).alias("i", "a")
    left = rows.select(*keys, F.col(column).alias("_v"), cells)
    right = F.posexplode(F.slice(F.col("_v"), F.col("i") + 1, F.size("_v"))).alias("d", "b")
    return (
        left.select(*keys, "i", "a", right)
        .groupBy(*keys, "i", (F.col("i") + F.col("d")).alias("j"))
        .agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    )


def complete_rows(panel: DataFrame, keys: list[str] = ENTITY) -> DataFrame:
    """Periods in which every series of the key is observed."""
    # two distinct counts are avoided: the grid is dense, so rows are series
    counts = panel.groupBy(*keys, "period").agg(
        F.count("value").alias("n_seen"), F.count(F.lit(1)).alias("n_all")
    )
    return panel.join(
        counts.filter(F.col("n_seen") == F.col("n_all")).select(*keys, "period"), [*keys, "period"], "left_semi"
    )


def align_quarterly_xy(panel: DataFrame, target: DataFrame, keys: list[str] = ENTITY) -> DataFrame:
    """Indicators at the months of the target, on rows complete for all of them.

    ``target`` has (keys, period, y).
    """
    at = panel.join(target.filter(F.col("y").isNotNull()).select(*keys, "period", "y"), [*keys, "period"])
    return complete_rows(at, keys)


def rank_correlation(xy: DataFrame, keys: list[str] = ENTITY) -> DataFrame:
    return xy.groupBy(*keys, "series_id").agg(
        F.coalesce(safe_corr("value", "y"), F.lit(0.0)).alias("score")
    )


def rank_tstat(xy: DataFrame, keys: list[str] = ENTITY) -> DataFrame:
    """Absolute t of the slope in a regression on one indicator and a constant."""
    r, n = safe_corr("value", "y"), F.count(F.lit(1))
    t = F.abs(r) * F.sqrt((n - 2) / (1 - r * r))
    return xy.groupBy(*keys, "series_id").agg(
        F.when((n > 2) & (F.abs(r) < 1), t).otherwise(F.lit(0.0)).alias("score")
    )


def top_variables(scores: DataFrame, n: int = 20, keys: list[str] = ENTITY) -> DataFrame:
    """The ``n`` best by absolute score; the filter on the rank prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("score")), "series_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


class _Path:
    """Least angle regression of one key: the residual, the direction all active indicators share, and the next step."""

    def __init__(self, resid, u, active, xs, c_max=0.0, a_unit=0.0):
        self.resid, self.u = np.asarray(resid, float), np.asarray(u, float)
        self.active, self.xs = list(active), [np.asarray(x, float) for x in xs]
        self.c_max, self.a_unit = float(c_max), float(a_unit)

    def enter(self, name: str, x, step: float) -> bool:
        """Walk ``step`` along the direction and let ``name`` in; false, and nothing done, if the path is at its end."""
        if len(self.active) >= len(self.resid) - 1:
            return False
        resid, xs = self.resid - step * self.u, [*self.xs, np.asarray(x, float)]
        m = np.array(xs).T
        c = m.T @ resid
        m = m * np.sign(c)
        ones = np.ones(len(xs))
        try:
            solved = np.linalg.lstsq(m.T @ m, ones, rcond=None)[0]
        except np.linalg.LinAlgError:
            return False
        a_unit = 1.0 / np.sqrt(max(ones @ solved, 1e-300))
        u = m @ (a_unit * solved)
        if not np.isfinite(u).all():
            return False
        self.resid, self.u, self.xs, self.a_unit, self.c_max = resid, u, xs, a_unit, float(np.abs(c).max())
        self.active.append(name)
        return True

    def next(self, names: list[str], x: np.ndarray) -> tuple[int, float] | None:
        """Who comes next and after what step: the largest correlation at first, then the shortest step to a tie."""
        left = np.array([n not in self.active for n in names])
        if not left.any():
            return None
        c, a = x @ self.resid, x @ self.u
        if not self.active:
            cost = -np.abs(c)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                both = np.stack([(self.c_max - c) / (self.a_unit - a), (self.c_max + c) / (self.a_unit + a)])
            cost = np.where(both > 1e-12, both, np.inf).min(0)
        cost = np.where(left, cost, np.inf)
        best = int(cost.argmin())
        return (best, cost[best] if self.active else 0.0) if cost[best] < np.inf else None


def rank_lars(xy: DataFrame, n: int = 10, keys: list[str] = ENTITY, block: int = BLOCK) -> DataFrame:
    """Order in which indicators enter the least angle regression path, up to ``n`` of them.

    A key of up to ``block`` indicators is a small problem and takes all its steps where its rows are. For a wider one
    every step needs two inner products per series (with the residual and with the equiangular direction) and the
    smallest step among them: the series stay distributed, one row each, and what travels is the state of the path, one
    row per key whose vectors are as long as the calendar. No Gram matrix of all candidates is formed. Series that are
    constant never enter, series with a cell that is not finite are left out, and a key whose target is not finite, or
    whose path cannot go on, has the entries up to there.
    """
    names = [f.name for f in xy.schema if f.name in keys]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in xy.schema if f.name in keys)
    series = (
        xy.groupBy(*keys, "series_id")
        .agg(F.array_sort(F.collect_list(F.struct("period", "value", "y"))).alias("c"))
        .select(
            *keys, "series_id",
            F.transform("c", lambda c: c["value"]).alias("x"),
            F.transform("c", lambda c: c["y"]).alias("y"),
        )
    )
    sum_of = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    finite = lambda v: F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    series = series.filter(finite("x") & finite("y")).withColumn("x", F.transform("x", lambda v: v - sum_of("x") / F.size("x")))
    size = F.sqrt(dot(F.col("x"), F.col("x")))
    series = series.withColumn("_size", size).withColumn("x", F.transform("x", lambda v: F.when(F.col("_size") > 1e-12, v / F.col("_size")).otherwise(0.0)))
    series = cut(series.drop("_size"), "lars")
    total = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_series"))
    sized = series.join(total, keys)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("series_id")
        x, y, ids = np.array(pdf["x"].tolist(), float), np.asarray(pdf["y"].iloc[0], float), pdf["series_id"].tolist()
        path = _Path(y - y.mean(), np.zeros(len(y)), [], [])
        for _ in range(n):
            found = path.next(ids, x)
            if found is None or not path.enter(ids[found[0]], x[found[0]], found[1]):
                break
        out = pd.DataFrame({"series_id": path.active, "pos": range(len(path.active))})
        return out.assign(**{c: pdf[c].iloc[0] for c in names})[[*names, "series_id", "pos"]]

    small = sized.filter(F.col("n_series") <= block).drop("n_series")
    entered = spread(small, keys).groupBy(*keys).applyInPandas(whole, f"{head}, series_id string, pos int")
    wide = sized.filter(F.col("n_series") > block).drop("n_series")
    if not wide.isEmpty():
        entered = entered.unionByName(_lars_over_rows(wide, n, keys, names, head))
    return entered.join(total, keys).select(
        *keys, "series_id", (F.col("n_series") - F.col("pos")).cast("double").alias("score")
    )


def _lars_over_rows(series: DataFrame, n: int, keys: list[str], names: list[str], head: str) -> DataFrame:
    """The path of keys of many series, step by step over their rows."""
    first = series.groupBy(*keys).agg(F.first("y").alias("y"))
    state = first.select(
        *keys,
        F.transform("y", lambda v: v - F.aggregate("y", F.lit(0.0), lambda a, b: a + b) / F.size("y")).alias("resid"),
        F.array_repeat(F.lit(0.0), F.size("y")).alias("u"),
        F.array().cast("array<string>").alias("active"),
        F.array().cast("array<array<double>>").alias("xs"),
        F.lit(0.0).alias("c_max"),
        F.lit(0.0).alias("a_unit"),
    )

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per key: move the residual by the step found and turn the direction
        row = pdf.iloc[0]
        path = _Path(row["resid"], row["u"], row["active"], row["xs"], row["c_max"], row["a_unit"])
        if row["best_id"] is not None:
            path.enter(row["best_id"], row["best_x"], row["step"])
        out = {k: row[k] for k in names}
        out.update(resid=path.resid, u=path.u, active=path.active, xs=[list(x) for x in path.xs], c_max=path.c_max, a_unit=path.a_unit)
        return pd.DataFrame([out])

    schema = head + (
        ", resid array<double>, u array<double>, active array<string>, xs array<array<double>>,"
        " c_max double, a_unit double"
    )
    for _ in range(n):
        st = state.select(*keys, "resid", "u", "active", "c_max", "a_unit")
        near = series.join(st, keys).filter(~F.array_contains("active", F.col("series_id")))
        near = near.withColumn("c", dot(F.col("x"), F.col("resid"))).withColumn("a", dot(F.col("x"), F.col("u")))
        lo = F.try_divide(F.col("c_max") - F.col("c"), F.col("a_unit") - F.col("a"))
        hi = F.try_divide(F.col("c_max") + F.col("c"), F.col("a_unit") + F.col("a"))
        pos = [F.when(g > 1e-12, g).otherwise(F.lit(float("inf"))) for g in (lo, hi)]
        start = F.size("active") == 0
        # first entry: largest correlation; later ones: shortest step to a tie
        cost = F.when(start, -F.abs("c")).otherwise(F.least(*pos))
        best = near.withColumn("cost", cost).groupBy(*keys).agg(
            F.min_by(F.struct("series_id", "x", "cost", "active"), F.struct("cost", "series_id")).alias("b")
        ).select(
            *keys,
            F.col("b.series_id").alias("best_id"), F.col("b.x").alias("best_x"),
            F.when(F.size("b.active") == 0, 0.0).otherwise(F.col("b.cost")).alias("step"),
        ).filter(F.col("step") < float("inf"))
        state = cut(
            state.join(best, keys, "left").groupBy(*keys).applyInPandas(advance, schema), "lars-state"
        )
    return state.select(*keys, F.posexplode("active").alias("pos", "series_id")).select(*keys, "series_id", "pos")


WAVES = (1, 2, 3)


def _unit_vectors(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Mean-filled series as vectors ``x`` of length one, rounded, with their projections on slow waves.

    Constant and empty series have none.
    """
    whole = Window.partitionBy(*keys, "series_id")
    mean = F.avg("value").over(whole)
    centred = panel.withColumn("v", F.coalesce(F.col("value") - mean, F.lit(0.0)))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(whole))
    scaled = (
        centred.withColumn("norm", norm)
        .filter(F.col("norm") > 1e-12)
        .withColumn("v", F.col("v") / F.col("norm"))
        .withColumn("t", F.row_number().over(whole.orderBy("period")) - 0.5)
        .withColumn("len", F.count(F.lit(1)).over(whole))
    )
    along = [
        F.sum(F.col("v") * F.sqrt(2 / F.col("len")) * F.cos(F.pi() * k * F.col("t") / F.col("len"))).alias(f"p{k}")
        for k in WAVES
    ]
    rows = (
        scaled.groupBy(*keys, "series_id")
        .agg(F.array_sort(F.collect_list(F.struct("period", "v"))).alias("c"), *along)
        .withColumn("x", F.transform("c", lambda e: e["v"]))
    )
    return cut(rows.drop("c").withColumn("x", F.transform("x", lambda v: F.round(v, 12))), "unit")


def _representatives(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each set of exact copies, and how many there are."""
    return rows.groupBy(*keys, "x").agg(
        F.min("series_id").alias("series_id"), F.count(F.lit(1)).alias("n"), *[F.first(f"p{k}").alias(f"p{k}") for k in WAVES]
    )


def collinear_pairs(panel: DataFrame, limit: float = 0.99, keys: list[str] = ENTITY) -> DataFrame:
    """Pairs of series with absolute correlation of at least ``limit`` on mean-filled data.

    Unit vectors that correlate that strongly lie within ``d = sqrt(2 (1 -
    limit))`` of each other, so their projections on any unit direction differ
    by at most ``d``. Series are placed in cells of width ``2 d`` along three
    slow waves, where trending series spread out most, and each visits its own
    cell and the nearer neighbour in every dimension: no pair above the limit
    is lost and distant ones never meet. The visitor comes with both signs, so
    that a mirrored copy is found too. Exact copies of one series would form
    all pairs among themselves: they are listed against the first of them, and
    only that one meets other series. ``panel`` is dense.
    """
    rows = _unit_vectors(panel, keys)
    first = _representatives(rows, keys)
    copied = first.filter(F.col("n") > 1).select(*keys, "x", F.col("series_id").alias("series_a"))
    copies = rows.join(copied, [*keys, "x"]).filter(F.col("series_id") != F.col("series_a")).select(
        *keys, "series_a", F.col("series_id").alias("series_b"), F.lit(1.0).alias("corr")
    )
    return _close_pairs(first, limit, keys).unionByName(copies)


def collinear_members(panel: DataFrame, limit: float = 0.99, keys: list[str] = ENTITY) -> DataFrame:
    """Every series that is not constant with its ``representative`` and ``n_links``, the collinear partners it has.

    The representative is the first of the exact copies of a series; ``collinear_pairs`` has the pairs between
    representatives, so two series are collinear if they share one or if theirs are a pair.
    """
    rows = _unit_vectors(panel, keys)
    first = _representatives(rows, keys)
    pairs = _close_pairs(first, limit, keys)
    sizes = first.select(*keys, F.col("series_id").alias("representative"), F.col("n").alias("copies"))
    ends = F.explode(F.array(F.struct(F.col("series_a").alias("representative"), F.col("series_b").alias("other")),
                             F.struct(F.col("series_b").alias("representative"), F.col("series_a").alias("other"))))
    both = pairs.select(*keys, ends.alias("e")).select(*keys, "e.*")
    linked = both.join(sizes.withColumnRenamed("representative", "other"), [*keys, "other"]).groupBy(*keys, "representative").agg(F.sum("copies").alias("others"))
    named = rows.join(first.select(*keys, "x", F.col("series_id").alias("representative"), "n"), [*keys, "x"])
    return named.join(linked, [*keys, "representative"], "left").select(
        *keys, "series_id", "representative", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )


def max_correlation(panel: DataFrame, order: Order, keys: list[str] = ENTITY) -> DataFrame:
    """Largest absolute correlation between two variables of each key's system, mean-filled, and the pair that has it.

    Products of a period leave its row and are summed on the map side, as for any moment matrix; the system is named in
    its specification, so its triangle is small. Constant variables correlate with nothing.
    """
    filled = place(panel, order).select(*keys, "series_id", "period", "value")
    mean = filled.groupBy(*keys, "series_id").agg(F.avg("value").alias("m"))
    centred = filled.join(mean, [*keys, "series_id"]).select(
        *keys, "series_id", "period", F.coalesce(F.col("value") - F.col("m"), F.lit(0.0)).alias("value")
    )
    rows = design_rows(centred, order, 0, keys).select(*keys, F.col("y").alias("v"))
    sums = moment_matrix(rows, keys)
    own = sums.filter("i = j").select(*keys, "i", F.col("s").alias("ss"))
    other = own.select(*keys, F.col("i").alias("j"), F.col("ss").alias("tt"))
    pairs = sums.filter("i < j").join(own, [*keys, "i"]).join(other, [*keys, "j"])
    corr = F.abs(F.col("s") / F.sqrt(F.col("ss") * F.col("tt")))
    valid = (F.col("ss") > 1e-24) & (F.col("tt") > 1e-24)
    best = pairs.filter(valid).withColumn("corr", corr).groupBy(*keys).agg(F.max_by(F.struct("corr", "i", "j"), F.struct("corr", "i", "j")).alias("b"))
    return with_names(best, order).select(
        *keys, F.col("b.corr").alias("max_corr"), F.get("names", F.col("b.i")).alias("series_a"), F.get("names", F.col("b.j")).alias("series_b")
    )


def _close_pairs(first: DataFrame, limit: float, keys: list[str]) -> DataFrame:
    """Pairs of representatives whose vectors nearly coincide, up to the sign."""
    d = float(np.sqrt(2 * (1 - limit))) + 1e-9
    cells = [f"cell{k}" for k in WAVES]
    home = first.select(
        *keys, "series_id", "x", *[F.floor(F.col(f"p{k}") / (2 * d)).alias(f"cell{k}") for k in WAVES]
    )
    visits = first.select(
        *keys, "series_id", "x", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sgn"), *[f"p{k}" for k in WAVES],
    )
    for k in WAVES:
        at = F.col("sgn") * F.col(f"p{k}") / (2 * d)
        nearer = F.when(at - F.floor(at) < 0.5, F.floor(at) - 1).otherwise(F.floor(at) + 1)
        visits = visits.withColumn(f"cell{k}", F.explode(F.array(F.floor(at), nearer)))
    place = [*keys, *cells]
    found = _close_blocks(home, visits.select(*place, "series_id", "x"), place, limit)
    return found.groupBy(*keys, "series_a", "series_b").agg(F.max("corr").alias("corr"))


def _close_blocks(home: DataFrame, visits: DataFrame, place: list[str], limit: float) -> DataFrame:
    """Pairs of a home series and a visitor of the same cell whose unit vectors nearly coincide.

    Series of a cell are compared block by block as matrix products, and only
    the pairs found leave the task. The blocks of a crowded cell are dealt out
    over as many tasks: each takes one of the home blocks and meets all visitors block by block.
    """
    size = home.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    share = F.col("n")
    member = F.array_sort(F.collect_list(F.struct("series_id", "x")))

    def blocked(rows: DataFrame, n) -> DataFrame:
        dealt = rows.join(size, place).withColumn("block", F.pmod(F.xxhash64("series_id"), n).cast("int"))
        return dealt.groupBy(*place, "block").agg(F.first("n").alias("n"), member.alias("m"))

    left = blocked(home, F.col("n")).select(
        *place, F.pmod("block", share).alias("share"), F.col("m.series_id").alias("ids"), F.col("m.x").alias("xs")
    )
    right = blocked(visits, F.col("n")).select(
        *place, F.explode(F.sequence(F.lit(0), share - 1)).alias("share"),
        F.col("m.series_id").alias("other_ids"), F.col("m.x").alias("other_xs"),
    )
    keys = [c for c in place if not c.startswith("cell")]

    def compare(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a, b = (np.array([np.asarray(v, float) for v in m]) for m in (r.xs, r.other_xs))
                corr = np.abs(a @ b.T)
                given = [getattr(r, k) for k in keys]
                for i, j in zip(*np.nonzero(corr >= limit)):
                    if r.ids[i] < r.other_ids[j]:
                        out.append((*given, r.ids[i], r.other_ids[j], float(corr[i, j])))
            yield pd.DataFrame(out, columns=[*keys, "series_a", "series_b", "corr"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in home.schema if f.name in keys)
    joined = spread(left, [*place, "share"]).join(spread(right, [*place, "share"]), [*place, "share"])
    return joined.mapInPandas(compare, f"{schema}, series_a string, series_b string, corr double")
