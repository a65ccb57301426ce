"""Factor model, VAR, bridge equations, news and uncertainty over the whole panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast.catalog import recursions
from tidecast.catalog.panels import REGIONS, region_scaled
from tidecast.catalog.registry import query
from tidecast.functions import calendar as cal
from tidecast.operators import bands, boards, bridge, bvar, dfm, grid, news, selection, state_space, stats, transforms
from tidecast.plans import backtest, nowcast, prepare
from tidecast.session import cut

E = ["entity_id"]
SYSTEM = [*REGIONS, prepare.TARGET]


def changes(t):
    """Log changes of the 25 nations of every segment, dense."""
    return transforms.transform_series(t.dense, transforms.MOM)


def system(t):
    """Log changes (percent) of the five regions and the quarterly growth target, dense."""
    change = transforms.transform_series(t.region_dense, transforms.MOM).withColumn("value", 100 * F.col("value"))
    return prepare.with_target(change, t.growth, E)


def fit(t, r: int = 2, p: int = 2):
    return dfm.dfm_fit(changes(t), E, r, p)


# --- state space ----------------------------------------------------------------------------


@query("pca_factors")
def _(t):
    blocks = cut(dfm.panel_blocks(changes(t), E), "blocks")
    state = dfm.initial_states(blocks, E, 3, 1)
    at = F.posexplode("zs").alias("i", "factor")
    rows = state.select("entity_id", "start", "k", at)
    return rows.select(
        "entity_id", F.add_months("start", F.floor(F.col("i") / F.col("k")).cast("int")).alias("period"),
        (F.col("i") % F.col("k")).alias("component"), F.round("factor", 6).alias("factor"),
    )


@query("factor_var")
def _(t):
    blocks = cut(dfm.panel_blocks(changes(t), E), "blocks")
    return dfm.initial_states(blocks, E, 2, 2).select("entity_id", "k", "a", "q", "v0")


@query("residual_variance")
def _(t):
    f = fit(t)
    z = transforms.standardize(changes(t)).select(*E, "series_id", "period", "value")
    joined = z.join(f.loadings(), [*E, "series_id"]).join(f.factors(), [*E, "period"])
    resid = F.col("value") - bands.dot(F.col("c"), F.col("z"))
    var = joined.groupBy(*E, "series_id").agg(F.var_pop(resid).alias("v"))
    return var.select(*E, "series_id", F.when(F.col("v") < 1e-6, 0.1).otherwise(F.col("v")).alias("variance"))


def plain_loadings(t):
    """Loadings that both engines can state: fixed by the nation's number."""
    key = F.substring("series_id", 2, 9).cast("int")
    c = F.array(F.lit(1.0), (key % 3 - 1).cast("double"))
    return t.meta.select("series_id", c.alias("c"), (1 + (key % 4) / 10).alias("noise"))


def plain_params(t, k: int):
    eye = [float(i == j) for i in range(k) for j in range(k)]
    return t.panel.select(*E).distinct().select(
        *E, F.lit([0.8 * x for x in eye]).alias("a"), F.lit([0.2 * x for x in eye]).alias("q"),
        F.lit([0.0] * k).alias("z0"), F.lit(eye).alias("v0"),
    )


def collapsed(t, k: int = 2):
    return state_space.kalman_collapse(t.scaled, plain_loadings(t), k, E)


LOADED = """(SELECT s.entity_id, s.period, s.value AS v, 1.0 AS c1, CAST(CAST(substr(s.series_id, 2) AS INTEGER) % 3 - 1 AS DOUBLE) AS c2,
    1 + (CAST(substr(s.series_id, 2) AS INTEGER) % 4) / 10 AS r FROM scaled s)"""


@query("kalman_collapse", f"""
    SELECT entity_id, period, coalesce(sum(CASE WHEN v IS NOT NULL THEN c1 * c1 / r END), 0) AS i11, coalesce(sum(CASE WHEN v IS NOT NULL THEN c1 * c2 / r END), 0) AS i12,
           coalesce(sum(CASE WHEN v IS NOT NULL THEN c2 * c2 / r END), 0) AS i22, coalesce(sum(c1 * v / r), 0) AS b1, coalesce(sum(c2 * v / r), 0) AS b2,
           CAST(count(v) AS DOUBLE) AS n, coalesce(sum(CASE WHEN v IS NOT NULL THEN ln(r) END), 0) AS log_r, coalesce(sum(v * v / r), 0) AS yy
    FROM {LOADED} GROUP BY 1, 2""", "i11 i12 i22 b1 b2 log_r yy")
def _(t):
    return collapsed(t).select(
        *E, "period", F.col("info")[0].alias("i11"), F.col("info")[1].alias("i12"), F.col("info")[3].alias("i22"),
        F.col("b")[0].alias("b1"), F.col("b")[1].alias("b2"), "n", "log_r", "yy",
    )


@query("kalman_filter", f"""
    WITH RECURSIVE s AS (SELECT entity_id, period, row_number() OVER (PARTITION BY entity_id ORDER BY period) AS t,
        coalesce(sum(CASE WHEN v IS NOT NULL THEN 1 / r END), 0) AS i, coalesce(sum(v / r), 0) AS b FROM {LOADED} GROUP BY 1, 2),
    f(entity_id, t, period, z, v) AS (
      SELECT entity_id, t, period, (0.8 * 0.8 + 0.2) / (1 + (0.8 * 0.8 + 0.2) * i) * b, (0.8 * 0.8 + 0.2) / (1 + (0.8 * 0.8 + 0.2) * i) FROM s WHERE t = 1
      UNION ALL
      SELECT s.entity_id, s.t, s.period, 0.8 * f.z + (0.64 * f.v + 0.2) / (1 + (0.64 * f.v + 0.2) * i) * (b - i * 0.8 * f.z), (0.64 * f.v + 0.2) / (1 + (0.64 * f.v + 0.2) * i)
      FROM f JOIN s ON s.entity_id = f.entity_id AND s.t = f.t + 1)
    SELECT entity_id, period, z, v FROM f""", "z v")
def _(t):
    return state_space.kalman_filter_scalar(collapsed(t, 1), E, 0.8, 0.2)


SUMS = f"""(SELECT entity_id, period, coalesce(sum(CASE WHEN v IS NOT NULL THEN c1 * c1 / r END), 0) AS i11, coalesce(sum(CASE WHEN v IS NOT NULL THEN c1 * c2 / r END), 0) AS i12,
    coalesce(sum(CASE WHEN v IS NOT NULL THEN c2 * c2 / r END), 0) AS i22, coalesce(sum(c1 * v / r), 0) AS b1, coalesce(sum(c2 * v / r), 0) AS b2, count(v) AS n,
    coalesce(sum(CASE WHEN v IS NOT NULL THEN ln(r) END), 0) AS log_r, coalesce(sum(v * v / r), 0) AS yy FROM {LOADED} GROUP BY 1, 2)"""
FILTERED = f"WITH RECURSIVE {recursions.two_state_filter(SUMS)}"


def flat(name: str, *cells: tuple[int, str]):
    return [F.col(name)[i].alias(c) for i, c in cells]


@query("kalman_filter_grouped", f"""{FILTERED}
    SELECT entity_id, period, z1, z2, v11, v12, v22, p1, p2, q11, q12, q22 FROM f WHERE t > 0""", "z1 z2 v11 v12 v22 p1 p2 q11 q12 q22")
def _(t):
    rows = state_space.kalman_filter(collapsed(t), plain_params(t, 2), E)
    sym = lambda c: ((0, f"{c}11"), (1, f"{c}12"), (3, f"{c}22"))
    return rows.select(*E, "period", *flat("z", (0, "z1"), (1, "z2")), *flat("v", *sym("v")), *flat("z_pred", (0, "p1"), (1, "p2")), *flat("v_pred", *sym("q")))


@query("kalman_smooth", f"""{FILTERED},
    {recursions.TWO_STATE_SMOOTHER}
    SELECT entity_id, period, z1, z2, w11, w12, w22 FROM g""", "z1 z2 w11 w12 w22")
def _(t):
    rows = state_space.kalman_smooth(collapsed(t), plain_params(t, 2), E)
    return rows.select(*E, "period", *flat("z", (0, "z1"), (1, "z2")), *flat("v", (0, "w11"), (1, "w12"), (3, "w22")))


@query("kalman_loglik", f"""{FILTERED},
    l AS (SELECT entity_id, n * ln(2 * pi()) + log_r + ln((q11 * q22 - q12 * q12) / (v11 * v22 - v12 * v12)) + yy - 2 * (p1 * b1 + p2 * b2) + p1 * p1 * i11 + 2 * p1 * p2 * i12 + p2 * p2 * i22
        - (r1 * r1 * v11 + 2 * r1 * r2 * v12 + r2 * r2 * v22) AS term
      FROM (SELECT f.*, s.n, log_r, yy, i11, i12, i22, b1, b2, b1 - i11 * p1 - i12 * p2 AS r1, b2 - i12 * p1 - i22 * p2 AS r2 FROM f JOIN s ON s.entity_id = f.entity_id AND s.t = f.t) WHERE n > 0)
    SELECT entity_id, -0.5 * sum(term) AS loglik FROM l GROUP BY 1""", "loglik")
def _(t):
    return state_space.kalman_loglik(collapsed(t), plain_params(t, 2), E)


# --- factor model ---------------------------------------------------------------------------


@query("dfm_em_step")
def _(t):
    blocks = cut(dfm.panel_blocks(changes(t), E), "blocks")
    first = cut(dfm.initial_states(blocks, E, 2, 2), "state")
    return dfm.em_step(blocks, first, E).select(*E, "it", "k", "loglik", "a", "q")


@query("dfm_fit")
def _(t):
    return fit(t).state.select(*E, "r", "p", "it", "loglik", "done")


@query("dfm_fit_wide")
def _(t):
    """Every customer is a series of one key: more of them than one block takes, so sums are added up over blocks."""
    sales = t.raw("orders").select(
        F.lit("all").alias("entity_id"), F.col("o_custkey").cast("string").alias("series_id"), cal.month_start(F.col("o_orderdate")).alias("period"),
        F.col("o_totalprice").alias("value"),
    ).groupBy(*E, "series_id", "period").agg(F.sum("value").alias("value"))
    dense = grid.align_to_grid(sales, t.span["lo"], t.span["hi"])
    spent = dense.withColumn("value", F.ln(1 + F.coalesce("value", F.lit(0.0))))
    return dfm.dfm_fit(spent, E, 1, 1, 25, block_size=128).state.select(*E, "r", "p", "it", "loglik", "done")


@query("dfm_project")
def _(t):
    return fit(t).project()


@query("block_loadings")
def _(t):
    f = dfm.dfm_fit(changes(t), E, 1, 1, groups=t.meta)
    return f.loadings().join(t.meta.select("series_id", "grp"), "series_id").select(*E, "series_id", "grp", "c", "noise")


@query("loadings_report")
def _(t):
    cells = fit(t).loadings().select(*E, "series_id", F.posexplode("c").alias("factor", "loading"))
    return cells.filter(F.abs("loading") > 0.2)


@query("confidence_bands")
def _(t):
    f = fit(t)
    return bands.confidence_bands(f.loadings().filter("series_id = 'n0'").join(f.factors(), E)).select(
        *E, "period", "central", "lower", "upper"
    )


@query("dfm_fan_chart")
def _(t):
    f = fit(t)
    target = f.loadings().filter("series_id = 'n0'").withColumnRenamed("noise", "r")
    return bands.dfm_fan(target.join(f.factors(), E)).select(*E, "period", "mean", "std", "p10", "p25", "p50", "p75", "p90")


# --- VAR ------------------------------------------------------------------------------------


@query("minnesota_dummies", """
    WITH m AS (SELECT entity_id, series_id, avg(value) AS m, greatest(CASE WHEN stddev_samp(value) < 1e-10 THEN 1 ELSE stddev_samp(value) END, 0.01) AS s FROM scaled_region GROUP BY 1, 2),
    l AS (SELECT unnest([1, 2]) AS lag), sides AS (SELECT unnest([0, 1, 2]) AS lag)
    SELECT entity_id, series_id, 'own' || l.lag || ':' || series_id AS row_id, 'y' AS side, 0 AS lag, s * l.lag / 0.2 AS value FROM m, l
    UNION ALL SELECT entity_id, series_id, 'own' || l.lag || ':' || series_id, 'x', l.lag, s * l.lag / 0.2 FROM m, l
    UNION ALL SELECT entity_id, series_id, 'sum:' || series_id, CASE WHEN lag = 0 THEN 'y' ELSE 'x' END, lag, s * m FROM m, sides
    UNION ALL SELECT entity_id, series_id, 'level', CASE WHEN lag = 0 THEN 'y' ELSE 'x' END, lag, s * m FROM m, sides""", "value")
def _(t):
    rows = region_scaled(t).groupBy(*E, "series_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return bvar.minnesota_dummies(rows, 2)


def moments(t):
    return cut(bvar.system_moments(region_scaled(t), REGIONS, 2, E), "moments")


#: Posterior of a VAR with two lags of five series: the data and the prior's rows are added up and solved together.
POSTERIOR = f"""
    WITH RECURSIVE n AS (SELECT unnest(range(1, 6)) AS i, unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']) AS series_id),
    z AS (SELECT s.entity_id, s.period, n.i, s.value FROM scaled_region s JOIN n ON n.series_id = s.series_id),
    y AS (SELECT entity_id, period, list(value ORDER BY i) AS y FROM z GROUP BY 1, 2),
    x AS (SELECT *, lag(y) OVER w || lag(y, 2) OVER w AS x FROM y WINDOW w AS (PARTITION BY entity_id ORDER BY period)),
    r AS (SELECT entity_id, x || y AS v FROM x WHERE len(x) = 10),
    m AS (SELECT entity_id, i, avg(value) AS m, greatest(CASE WHEN stddev_samp(value) < 1e-10 THEN 1 ELSE stddev_samp(value) END, 0.01) AS s FROM z GROUP BY 1, 2),
    each_ AS (SELECT m.entity_id, list_transform(range(1, 16), lambda c: CASE WHEN c = 5 * (l.l - 1) + m.i OR c = 10 + m.i THEN s * l.l / 0.2 ELSE 0.0 END) AS v FROM m, (SELECT unnest([1, 2]) AS l) l
      UNION ALL SELECT entity_id, list_transform(range(1, 16), lambda c: CASE WHEN (c - 1) % 5 + 1 = i THEN s * m ELSE 0.0 END) FROM m
      UNION ALL SELECT entity_id, list(s * m ORDER BY i) || list(s * m ORDER BY i) || list(s * m ORDER BY i) FROM m GROUP BY 1
      UNION ALL SELECT entity_id, v FROM r),
    ij AS (SELECT entity_id, v, i, unnest(range(1, 16)) AS j FROM (SELECT *, unnest(range(1, 16)) AS i FROM each_)),
    sums AS (SELECT entity_id, i, j, sum(v[i] * v[j]) AS s, count(*) AS t FROM ij GROUP BY 1, 2, 3),
    lines AS (SELECT entity_id, i, list(s ORDER BY j) AS v, max(t) AS t FROM sums GROUP BY 1, 2),
    mat AS (SELECT entity_id, 10::BIGINT AS k, 15::BIGINT AS w, list(v ORDER BY i) AS m FROM lines WHERE i <= 10 GROUP BY 1),
    {recursions.solved("b", "mat", "entity_id")},
    yy AS (SELECT entity_id, list(v ORDER BY i) AS v, max(t) AS t FROM lines WHERE i > 10 GROUP BY 1),
    p AS (SELECT b.entity_id, b.b, yy.v, yy.t, unnest(range(1, 6)) AS i FROM b JOIN yy ON yy.entity_id = b.entity_id)
    SELECT entity_id, 'b' AS part, CAST(i AS INTEGER) AS equation, CAST(c AS INTEGER) AS place, b[c][i] AS value FROM (SELECT *, unnest(range(1, 11)) AS c FROM p)
    UNION ALL SELECT entity_id, 'sigma', CAST(i AS INTEGER), CAST(c AS INTEGER), (v[i][10 + c] - list_sum(list_transform(range(1, 11), lambda k: v[i][k] * b[k][c]))) / t FROM (SELECT *, unnest(range(1, 6)) AS c FROM p)"""


@query("minnesota_posterior", POSTERIOR, "value")
def _(t):
    rows, n = bvar.minnesota_posterior(moments(t), E), len(REGIONS)

    def cells(name: str, width: int):
        at = rows.select(*E, F.posexplode(name).alias("p", "value"))
        return at.select(*E, F.lit(name).alias("part"), (F.floor(F.col("p") / width) + 1).cast("int").alias("equation"), (F.col("p") % width + 1).cast("int").alias("place"), "value")

    return cells("b", 2 * n).unionByName(cells("sigma", n))


@query("bvar_log_ml")
def _(t):
    return bvar.bvar_log_ml(bvar.hyper_grid(moments(t)), E)


@query("bvar_tune")
def _(t):
    return bvar.bvar_tune(moments(t), E)


def draws(t):
    m = moments(t)
    return bvar.posterior_draws(m.join(bvar.bvar_tune(m, E).drop("log_ml", "edge"), E), E)


@query("bvar_posterior_draws")
def _(t):
    return bvar.draw_means(cut(draws(t), "draws"), E)


@query("bvar_fit")
def _(t):
    return bvar.bvar_fit(system(t), SYSTEM, E)


@query("bvar_fit_quarter_blocks")
def _(t):
    return bvar.bvar_fit(system(t), SYSTEM, E, p=1)


@query("bvar_fit_monthly")
def _(t):
    return bvar.bvar_fit(system(t), SYSTEM, E, blocks=False)


@query("bvar_fan_chart")
def _(t):
    last = bvar.last_design(region_scaled(t), REGIONS, 2, E)
    paths = bvar.forecast_paths(draws(t), last, E, len(REGIONS), 0, 4)
    return bands.draw_fan(paths, [*E, "h"])


# --- bridge equations -----------------------------------------------------------------------

SPECS = """
    WITH s AS (SELECT r_name AS m1 FROM region), p AS (SELECT m1, CAST(NULL AS VARCHAR) AS m2 FROM s UNION ALL SELECT a.m1, b.m1 FROM s a JOIN s b ON a.m1 < b.m1),
    q AS (SELECT CAST(NULL AS VARCHAR) AS q UNION ALL SELECT 'q1')
    SELECT concat_ws('|', CAST(interp_type AS VARCHAR), m1, m2, q) AS spec_id, CAST(interp_type AS INTEGER) AS interp_type, m1, m2, q
    FROM p, q, (SELECT unnest([901, 902, 903]) AS interp_type)"""


@query("bridge_specs", SPECS)
def _(t):
    return bridge.bridge_specs(t.region_meta.select("series_id"), quarterly=["q1"])


@query("join_spec_pairs", "SELECT a.series_id AS m1, b.series_id AS m2 FROM meta a JOIN meta b ON a.series_id < b.series_id UNION ALL SELECT series_id, NULL FROM meta")
def _(t):
    return bridge.bridge_specs(t.meta.select("series_id"), (bridge.AR_OWN,)).select("m1", "m2")


@query("stack_specs", "SELECT series_id AS m1, CAST(unnest([901, 902, 903]) AS INTEGER) AS interp_type FROM meta")
def _(t):
    return bridge.bridge_specs(t.meta.select("series_id")).filter("m2 is null").select("m1", "interp_type")


def at_vintage(t, day: str = "2001-02-15"):
    """The regional system as known on one day, on the months up to the end of its quarter."""
    return backtest.vintage_systems(dated_system(t), F.array(F.lit(day).cast("date")), E).drop("vintage_date")


def dated_system(t):
    lags = t.region_meta.select("series_id", "pub_lag_days")
    lag = F.coalesce("pub_lag_days", F.lit(45))
    return system(t).join(lags, "series_id", "left").select(
        *E, "series_id", "period", "value", F.date_add(F.last_day("period"), lag).alias("release_date")
    )


def indicators(t):
    return at_vintage(t).filter(F.col("series_id") != prepare.TARGET)


#: The regional indicators as known on one day, and each series' autoregression of six lags without constant.
KNOWN = """q AS (SELECT *, 100 * (lv - lag(lv) OVER (PARTITION BY entity_id, series_id ORDER BY period)) AS ch FROM (SELECT *, CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-12)) END AS lv FROM region_dense)),
    d AS (SELECT q.entity_id, q.series_id, q.period, q.ch, last_day(q.period) + CAST(10 + 7 * region.r_regionkey AS INTEGER) AS release_date FROM q JOIN region ON region.r_name = q.series_id),
    e AS (SELECT *, max(CASE WHEN ch IS NOT NULL AND release_date <= DATE '2001-02-15' THEN period END) OVER (PARTITION BY entity_id, series_id) AS edge FROM d),
    known AS (SELECT entity_id, series_id, period, CASE WHEN period <= edge THEN ch END AS value, row_number() OVER (PARTITION BY entity_id, series_id ORDER BY period) AS t FROM e WHERE period <= DATE '2001-03-01')"""


@query("extrapolate_ar", f"""
    WITH RECURSIVE {KNOWN},
    l AS (SELECT entity_id, series_id, list(value ORDER BY t) AS x, max(CASE WHEN value IS NOT NULL THEN t END) AS last, count(value) AS seen, count(*) AS size FROM known GROUP BY 1, 2),
    g AS (SELECT entity_id, series_id, x[t] AS y, list_transform(range(1, 7), lambda i: x[t - i]) AS v FROM (SELECT *, unnest(range(7, last + 1)) AS t FROM l WHERE seen >= 8 AND last < size)),
    u AS (SELECT entity_id, series_id, v || [y] AS v FROM g WHERE y IS NOT NULL AND len(list_filter(v, lambda a: a IS NULL)) = 0),
    ij AS (SELECT *, unnest(range(1, 8)) AS j FROM (SELECT *, unnest(range(1, 7)) AS i FROM u)),
    sums AS (SELECT entity_id, series_id, i, j, sum(v[i] * v[j]) AS s, count(*) AS n FROM ij GROUP BY 1, 2, 3, 4),
    lines AS (SELECT entity_id, series_id, i, list(s ORDER BY j) AS v FROM sums WHERE n >= 7 GROUP BY 1, 2, 3),
    mat AS (SELECT entity_id, series_id, 6::BIGINT AS k, 7::BIGINT AS w, list(v ORDER BY i) AS m FROM lines GROUP BY 1, 2),
    {recursions.solved("b", "mat", "entity_id, series_id")},
    p(entity_id, series_id, t, size, recent, b) AS (SELECT l.entity_id, l.series_id, last, size, list_transform(range(0, 6), lambda i: x[last - i]), list_transform(b, lambda r: r[1]) FROM l JOIN b ON b.entity_id = l.entity_id AND b.series_id = l.series_id
      UNION ALL SELECT entity_id, series_id, t + 1, size, [CASE WHEN len(list_filter(recent, lambda a: a IS NULL)) = 0 THEN list_sum(list_transform(range(1, 7), lambda i: recent[i] * b[i])) END] || recent[1:5], b FROM p WHERE t < size)
    SELECT k.entity_id, k.series_id, k.period, CASE WHEN k.value IS NULL AND p.t > l.last THEN p.recent[1] ELSE k.value END AS value
    FROM known k JOIN l ON l.entity_id = k.entity_id AND l.series_id = k.series_id LEFT JOIN p ON p.entity_id = k.entity_id AND p.series_id = k.series_id AND p.t = k.t""", "value")
def _(t):
    return bridge.extrapolate_ar(indicators(t))


@query("extrapolate_var")
def _(t):
    return bridge.extrapolate_var(indicators(t), E, REGIONS, 2)


DESIGN = """
    WITH r AS (SELECT entity_id, series_id, period, CAST(date_trunc('quarter', period) AS DATE) AS quarter, value AS v FROM scaled_region WHERE month(period) % 3 = 0),
    x AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY entity_id, series_id ORDER BY quarter), 0) AS l1 FROM r),
    g AS (SELECT entity_id, quarter, value AS y, lag(value) OVER (PARTITION BY entity_id ORDER BY quarter) AS y_lag FROM growth),
    p AS (SELECT a.r_name AS m1, CAST(NULL AS VARCHAR) AS m2 FROM region a UNION ALL SELECT a.r_name, b.r_name FROM region a JOIN region b ON a.r_name < b.r_name)
    SELECT a.entity_id, p.m1, p.m2, a.quarter, a.v AS m1_l0, a.l1 AS m1_l1, coalesce(b.v, 0) AS m2_l0, coalesce(b.l1, 0) AS m2_l1, g.y_lag, g.y
    FROM p JOIN x a ON a.series_id = p.m1 JOIN g ON g.entity_id = a.entity_id AND g.quarter = a.quarter
    LEFT JOIN x b ON b.series_id = p.m2 AND b.entity_id = a.entity_id AND b.quarter = a.quarter"""


def design(t):
    specs = bridge.bridge_specs(t.region_meta.select("series_id"), (bridge.AR_OWN,))
    regressors = bridge.quarter_regressors(region_scaled(t)).withColumn("interp_type", F.lit(bridge.AR_OWN))
    return bridge.bridge_design(specs, regressors, t.growth.withColumnRenamed("value", "y"))


@query("bridge_design", DESIGN, "m1_l0 m1_l1 m2_l0 m2_l1 y_lag y")
def _(t):
    return design(t).select(*E, "m1", "m2", "quarter", "m1_l0", "m1_l1", "m2_l0", "m2_l1", "y_lag", "y")


@query("bridge_ols", f"""
    SELECT entity_id, m1, regr_slope(y, m1_l0) AS slope, regr_intercept(y, m1_l0) AS intercept, CAST(regr_count(y, m1_l0) AS BIGINT) AS n
    FROM ({DESIGN}) WHERE m2 IS NULL GROUP BY 1, 2""", "slope intercept")
def _(t):
    one = design(t).filter("m2 is null").withColumnRenamed("m1_l0", "x")
    return bridge.bridge_simple(one, [*E, "m1"])


#: Normal equations of every specification, solved by Gauss-Jordan steps; unused regressors are left out.
SOLVED = f"""
    WITH RECURSIVE d AS ({DESIGN}),
    u AS (SELECT *, concat_ws('|', '903', m1, m2) AS spec_id, CASE WHEN m2 IS NULL THEN [m1_l0, m1_l1, y_lag, 1.0] ELSE [m1_l0, m1_l1, m2_l0, m2_l1, y_lag, 1.0] END AS x FROM d WHERE y IS NOT NULL AND y_lag IS NOT NULL),
    ij AS (SELECT entity_id, spec_id, len(x) AS k, x, y, i, unnest(range(1, len(x) + 2)) AS j FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM u)),
    sums AS (SELECT entity_id, spec_id, k, i, j, sum(x[i] * CASE WHEN j <= k THEN x[j] ELSE y END) AS s, count(*) AS n FROM ij GROUP BY 1, 2, 3, 4, 5),
    lines AS (SELECT entity_id, spec_id, k, i, n, list(s ORDER BY j) AS v FROM sums GROUP BY 1, 2, 3, 4, 5),
    mat AS (SELECT entity_id, spec_id, k, n, list(v ORDER BY i) AS m FROM lines GROUP BY 1, 2, 3, 4 HAVING n >= 3),
    steps(entity_id, spec_id, k, n, step, m) AS (SELECT entity_id, spec_id, k, n, 0::BIGINT, m FROM mat
      UNION ALL SELECT entity_id, spec_id, k, n, step + 1, list_transform(range(1, k + 1), lambda r: list_transform(range(1, k + 2),
        lambda c: CASE WHEN r = step + 1 THEN m[r][c] / m[r][r] ELSE m[r][c] - m[r][step + 1] * m[step + 1][c] / m[step + 1][step + 1] END)) FROM steps WHERE step < k),
    b AS (SELECT entity_id, spec_id, k, n, list_transform(m, lambda r: r[k + 1]) AS b FROM steps WHERE step = k),
    solved AS (SELECT entity_id, spec_id, n, k, CASE WHEN k = 4 THEN [b[1], b[2], 0.0, 0.0, 0.0, 0.0, b[3], b[4]] ELSE [b[1], b[2], b[3], b[4], 0.0, 0.0, b[5], b[6]] END AS coef FROM b)"""
TERMS = ", ".join(f"'{c}'" for c in bridge.REGRESSORS)
PARTS = f"""{SOLVED},
    known AS (SELECT *, concat_ws('|', '903', m1, m2) AS spec_id, last_value(y IGNORE NULLS) OVER (PARTITION BY entity_id, m1, m2 ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y_known FROM d),
    parts AS (SELECT k.entity_id, k.spec_id, k.quarter, k.y, list_transform(range(1, 9), lambda i: s.coef[i] * [m1_l0, m1_l1, m2_l0, m2_l1, 0.0, 0.0, coalesce(y_lag, y_known), 1.0][i]) AS p
      FROM known k JOIN solved s ON s.entity_id = k.entity_id AND s.spec_id = k.spec_id)"""


@query("bridge_ols_full", f"""{SOLVED} SELECT entity_id, spec_id, n, CAST(k AS INTEGER) AS rank, unnest([{TERMS}]) AS term, unnest(coef) AS coef FROM solved""", "coef")
def _(t):
    fitted = bridge.bridge_ols(design(t), E)
    terms = F.array(*[F.struct(F.lit(c).alias("term"), F.col("coef")[i].alias("coef")) for i, c in enumerate(bridge.REGRESSORS)])
    return fitted.select(*E, "spec_id", "n", "rank", F.inline(terms))


@query("bridge_forecast", f"{PARTS} SELECT entity_id, spec_id, quarter, CASE WHEN len(list_filter(p, lambda v: v IS NULL)) = 0 THEN list_sum(p) END AS fcst, y FROM parts", "fcst y")
def _(t):
    d = cut(design(t), "design")
    return bridge.bridge_forecast(d, bridge.bridge_ols(d, E), E)


@query("bridge_contributions", f"{PARTS} SELECT entity_id, spec_id, quarter, unnest([{TERMS}]) AS term, unnest(p) AS contribution FROM parts", "contribution")
def _(t):
    d = cut(design(t), "design")
    return bridge.bridge_contributions(d, bridge.bridge_ols(d, E), E)


LAGGED = bridge.Terms(m=2, q=1, y=2, dummies=2)
EVENTS = ("1998-04-01", "2000-01-01")


def lagged_design(t):
    """Lags (2, 1, 2) and two dummies where an indicator stands alone; pairs have one lag of the target and one dummy."""
    component = t.components.filter("component = 'A'").withColumnRenamed("quarter", "period")
    change = transforms.growth_dlog_rows(component, E).withColumnRenamed("period", "quarter")
    by = Window.partitionBy(*E).orderBy("quarter")
    quarterly = change.select(*E, F.lit("qA").alias("series_id"), "quarter", F.col("value").alias("l0"), F.lag("value").over(by).alias("l1"))
    specs = bridge.bridge_specs(t.region_meta.select("series_id"), (bridge.AR_OWN,), ["qA"])
    alone = F.col("m2").isNull()
    days = [F.lit(d).cast("date") for d in EVENTS]
    specs = specs.withColumns({
        "lag_y": F.when(alone, 2).otherwise(1), "lag_m": F.when(alone, 2).otherwise(1),
        "dummies": F.when(alone, F.array(*days)).otherwise(F.array(days[0])),
    })
    regressors = bridge.quarter_regressors(region_scaled(t), lags=2).withColumn("interp_type", F.lit(bridge.AR_OWN))
    return bridge.bridge_design(specs, regressors, t.growth.withColumnRenamed("value", "y"), E, quarterly, LAGGED)


@query("bridge_design_lags", f"""
    WITH r AS (SELECT entity_id, series_id, CAST(date_trunc('quarter', period) AS DATE) AS quarter, value AS v FROM scaled_region WHERE month(period) % 3 = 0),
    x AS (SELECT *, coalesce(lag(v) OVER w, 0) AS l1, coalesce(lag(v, 2) OVER w, 0) AS l2 FROM r WINDOW w AS (PARTITION BY entity_id, series_id ORDER BY quarter)),
    g AS (SELECT entity_id, quarter, value AS y, lag(value) OVER w AS y1, lag(value, 2) OVER w AS y2 FROM growth WINDOW w AS (PARTITION BY entity_id ORDER BY quarter)),
    a AS (SELECT entity_id, quarter, ln(value) - ln(lag(value) OVER (PARTITION BY entity_id ORDER BY quarter)) AS q0 FROM components WHERE component = 'A'),
    q AS (SELECT *, lag(q0) OVER (PARTITION BY entity_id ORDER BY quarter) AS q1 FROM a WHERE q0 IS NOT NULL),
    p AS (SELECT a.r_name AS m1, CAST(NULL AS VARCHAR) AS m2 FROM region a UNION ALL SELECT a.r_name, b.r_name FROM region a JOIN region b ON a.r_name < b.r_name),
    s AS (SELECT *, unnest([NULL, 'qA']) AS q FROM p)
    SELECT a.entity_id, concat_ws('|', '903', s.m1, s.m2, s.q) AS spec_id, a.quarter, a.v AS m1_l0, a.l1 AS m1_l1, CASE WHEN s.m2 IS NULL THEN a.l2 ELSE 0 END AS m1_l2,
      coalesce(b.v, 0) AS m2_l0, coalesce(b.l1, 0) AS m2_l1, 0.0::DOUBLE AS m2_l2, coalesce(q.q0, 0) AS q_l0, coalesce(q.q1, 0) AS q_l1,
      CASE WHEN s.m2 IS NULL THEN g.y2 ELSE g.y1 END AS y_lag, CASE WHEN a.quarter = DATE '{EVENTS[0]}' THEN 1.0::DOUBLE ELSE 0.0 END AS d1,
      CASE WHEN s.m2 IS NULL AND a.quarter = DATE '{EVENTS[1]}' THEN 1.0::DOUBLE ELSE 0.0 END AS d2, 1.0::DOUBLE AS const, g.y
    FROM s JOIN x a ON a.series_id = s.m1 JOIN g ON g.entity_id = a.entity_id AND g.quarter = a.quarter
    LEFT JOIN x b ON b.series_id = s.m2 AND b.entity_id = a.entity_id AND b.quarter = a.quarter
    LEFT JOIN q ON s.q = 'qA' AND q.entity_id = a.entity_id AND q.quarter = a.quarter""", "m1_l0 m1_l1 m1_l2 m2_l0 m2_l1 m2_l2 q_l0 q_l1 y_lag y")
def _(t):
    return lagged_design(t).select(*E, "spec_id", "quarter", *LAGGED.names(), "y")


@query("bridge_forecast_lags")
def _(t):
    d = cut(lagged_design(t), "design")
    return bridge.bridge_forecast(d, bridge.bridge_ols(d, E, LAGGED), E, LAGGED)


@query("bridge_median", f"""
    WITH d AS ({DESIGN}), c AS (SELECT entity_id, m1, regr_slope(y, m1_l0) AS s, regr_intercept(y, m1_l0) AS i FROM d WHERE m2 IS NULL GROUP BY 1, 2)
    SELECT d.entity_id, d.quarter, median(i + s * m1_l0) AS value, count(*) AS n_specs, CAST(d.quarter + INTERVAL 2 MONTH AS DATE) AS period
    FROM d JOIN c ON c.entity_id = d.entity_id AND c.m1 = d.m1 WHERE d.m2 IS NULL GROUP BY 1, 2""", "value")
def _(t):
    one = cut(design(t).filter("m2 is null").withColumnRenamed("m1_l0", "x"), "design")
    fitted = one.join(bridge.bridge_simple(one, [*E, "m1"]), [*E, "m1"])
    return bridge.bridge_median(fitted.withColumn("fcst", F.col("intercept") + F.col("slope") * F.col("x")), E)


@query("beq_fit")
def _(t):
    ragged = cut(at_vintage(t), "ragged")
    known = ragged.filter((F.col("series_id") == prepare.TARGET) & cal.is_quarter_end(F.col("period")))
    target = known.select(*E, cal.quarter_start(F.col("period")).alias("quarter"), F.col("value").alias("y"))
    return bridge.bridge_median(bridge.beq_fit(ragged, target, REGIONS, E), E)


# --- news -----------------------------------------------------------------------------------


def news_pair(t):
    """Two vintages of the regional system on the months of the newer one."""
    days = F.array(*[F.lit(d).cast("date") for d in ("2001-02-15", "2001-03-20")])
    both = cut(backtest.vintage_systems(dated_system(t), days, E), "vintages")
    pick = lambda d: both.filter(F.col("vintage_date") == F.lit(d).cast("date")).drop("vintage_date")
    return pick("2001-02-15"), pick("2001-03-20")


@query("news_scenarios", """
    WITH d AS (SELECT r.entity_id, r.series_id, r.period, r.value, last_day(r.period) + CAST(10 + 7 * region.r_regionkey AS INTEGER) AS release_date
      FROM (SELECT *, 100 * (lv - lag(lv) OVER (PARTITION BY entity_id, series_id ORDER BY period)) AS ch FROM (SELECT *, CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-12)) END AS lv FROM region_dense)) q
      JOIN LATERAL (SELECT q.entity_id, q.series_id, q.period, q.ch AS value) r ON TRUE JOIN region ON region.r_name = r.series_id
      UNION ALL SELECT g.entity_id, 'target', CAST(g.quarter + INTERVAL 2 MONTH AS DATE), g.value, last_day(CAST(g.quarter + INTERVAL 2 MONTH AS DATE)) + 45 FROM growth g),
    m AS (SELECT *, max(CASE WHEN value IS NOT NULL AND release_date <= DATE '2001-02-15' THEN period END) OVER s AS lo, max(CASE WHEN value IS NOT NULL AND release_date <= DATE '2001-03-20' THEN period END) OVER s AS ln FROM d WINDOW s AS (PARTITION BY entity_id, series_id))
    SELECT entity_id, series_id, period, value AS new_value FROM m WHERE value IS NOT NULL AND period <= ln AND (lo IS NULL OR period > lo) AND period <= DATE '2001-03-01'""", "new_value")
def _(t):
    return news.news_scenarios(*news_pair(t), E).select(*E, "series_id", "period", "new_value")


def news_table(t):
    old, new = news_pair(t)
    meta = t.region_meta.select("series_id", F.upper("grp").alias("grp"))
    return nowcast.run_news(old, new, prepare.TARGET, E, meta)


@query("news_decompose")
def _(t):
    return news_table(t).drop("grp", "group_contribution")


@query("news_by_group")
def _(t):
    return news_table(t).select(*E, "grp", "group_contribution").distinct()


@query("news_order")
def _(t):
    return news.news_order(news_table(t).select(*E, "series_id", "contribution"), E)


# --- jobs over targets, vintages and specifications -----------------------------------------


@query("backtest")
def _(t):
    systems = backtest.vintage_systems(dated_system(t), t.vintages, E)
    return backtest.run_backtest(systems, t.growth, SYSTEM, E)


@query("grid_search_score")
def _(t):
    systems = backtest.vintage_systems(dated_system(t), t.vintages, E)
    specs = [(r, p) for r in (2, 3, 4, 5) for p in (1, 2, 3, 4)]
    fitted = dfm.dfm_fit(systems, [*E, "vintage_date"], max_iter=30, thresh=1e-5, specs=specs)
    hit = fitted.project([prepare.TARGET]).filter(F.col("period") == cal.quarter_end_month(F.col("vintage_date")))
    actual = t.growth.select(*E, cal.quarter_end_month(F.col("quarter")).alias("period"), F.col("value").alias("actual"))
    return boards.grid_search_score(hit, actual, [*E, "period"])


def component_system(t):
    """One system per segment and component: the indicators of the component's regions and its own growth."""
    rows = [("A", ["AFRICA", "ASIA", "EUROPE"]), ("N", ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]), ("R", ["AFRICA"])]
    wanted = t.spark.createDataFrame(rows, "target string, groups array<string>")
    chosen = stats.select_group_subset(t.region_meta, wanted).withColumnRenamed("target", "component")
    change = transforms.transform_series(t.region_dense, transforms.MOM).join(chosen, "series_id")
    keys = [*E, "component"]
    growth = transforms.growth_dlog_rows(t.components.withColumnRenamed("quarter", "period"), keys)
    target = growth.withColumnRenamed("period", "quarter")
    return prepare.with_target(change.select(*keys, "series_id", "period", "value"), target, keys), keys


def component_members(rows):
    """The system of every component, its own indicators in order and its growth last."""
    last = F.col("series_id") == prepare.TARGET
    by = Window.partitionBy("component").orderBy(last, "series_id")
    return rows.select("component", "series_id").distinct().withColumn("pos", F.row_number().over(by))


@query("component_nowcasts")
def _(t):
    rows, keys = component_system(t)
    rows = cut(rows, "components")
    specs = t.spark.createDataFrame([("A", 2, 2), ("N", 1, 2), ("R", 2, 1)], "component string, n_factors int, n_lags int")
    return nowcast.model_paths(rows, component_members(rows), keys, beq_types=(bridge.VAR_ALL,), specs=specs)


@query("sector_nowcasts")
def _(t):
    line = t.raw("lineitem").select("l_partkey", "l_extendedprice", "l_discount", "l_shipdate")
    part = t.raw("part").select("p_partkey", F.col("p_brand").alias("sector"))
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    levels = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "sector", cal.quarter_start(F.col("l_shipdate")).alias("period")
    ).agg(F.sum(amount).cast("double").alias("value"))
    target = transforms.growth_dlog_rows(levels, ["sector"]).withColumnRenamed("period", "quarter")
    total = t.region_dense.groupBy("series_id", "period").agg(F.sum("value").alias("value"))
    change = transforms.transform_series(total, transforms.MOM, keys=["series_id"])
    # the few indicator rows unfold over the sectors of the part table
    sectors = part.agg(F.array_sort(F.collect_set("sector"))).scalar()
    each = change.withColumn("sector", F.explode(sectors)).select("sector", "series_id", "period", "value")
    paths = dfm.dfm_fit(prepare.with_target(each, target, ["sector"]), ["sector"], 2, 1).project([prepare.TARGET])
    return paths.filter(cal.is_quarter_end(F.col("period"))).drop("series_id")
