"""SQL for what is solved step by step: small linear systems, two-state filters, splines.

Everything is written out for the checking engine from the definitions, without numbers or expressions of the library.
"""

from __future__ import annotations


def solved(name: str, matrix: str, keys: str) -> str:
    """Common table expressions that solve the systems of ``matrix (keys, k, w, m)`` by Gauss-Jordan steps.

    ``m`` holds ``k`` rows of ``w`` numbers, the right-hand sides behind the first ``k``; ``name (keys, k, w, b)`` has the
    rows of the solutions. Needs ``WITH RECURSIVE``.
    """
    return f"""{name}_steps({keys}, k, w, step, m) AS (SELECT {keys}, k, w, 0::BIGINT, m FROM {matrix}
      UNION ALL SELECT {keys}, k, w, step + 1, list_transform(range(1, k + 1), lambda r: list_transform(range(1, w + 1),
        lambda c: CASE WHEN r = step + 1 THEN m[r][c] / m[r][r] ELSE m[r][c] - m[r][step + 1] * m[step + 1][c] / m[step + 1][step + 1] END)) FROM {name}_steps WHERE step < k),
    {name} AS (SELECT {keys}, k, w, list_transform(m, lambda r: r[k + 1 : w]) AS b FROM {name}_steps WHERE step = k)"""


def two_state_filter(collapsed: str) -> str:
    """The filter of two states with transition 0.8 and noise 0.2 each, from ``collapsed (entity_id, period, i11, ...)``.

    Gives ``f``: filtered ``z`` and ``v``, predicted ``p`` and ``q`` of every period, numbered by ``t``.
    """
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period) AS t FROM {collapsed}),
    f(entity_id, t, period, p1, p2, q11, q12, q22, v11, v12, v22, z1, z2) AS (
      SELECT DISTINCT entity_id, 0::BIGINT, NULL::DATE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM s
      UNION ALL
      SELECT entity_id, t, period, p1, p2, m11, m12, m22, s22 / sd, -s12 / sd, s11 / sd,
        p1 + (s22 * r1 - s12 * r2) / sd, p2 + (s11 * r2 - s12 * r1) / sd
      FROM (SELECT *, m22 / qd + i11 AS s11, -m12 / qd + i12 AS s12, m11 / qd + i22 AS s22, s11 * s22 - s12 * s12 AS sd,
              b1 - i11 * p1 - i12 * p2 AS r1, b2 - i12 * p1 - i22 * p2 AS r2
            FROM (SELECT s.*, 0.8 * f.z1 AS p1, 0.8 * f.z2 AS p2, 0.64 * f.v11 + 0.2 AS m11, 0.64 * f.v12 AS m12, 0.64 * f.v22 + 0.2 AS m22, m11 * m22 - m12 * m12 AS qd
                  FROM f JOIN s ON s.entity_id = f.entity_id AND s.t = f.t + 1)))"""


#: The smoother behind ``two_state_filter``: ``g`` with the smoothed ``z`` and ``w`` (the variance) of every period.
TWO_STATE_SMOOTHER = """ends AS (SELECT entity_id, max(t) AS t FROM f GROUP BY 1),
    g(entity_id, t, period, z1, z2, w11, w12, w22) AS (
      SELECT f.entity_id, f.t, period, z1, z2, v11, v12, v22 FROM f JOIN ends ON ends.entity_id = f.entity_id AND ends.t = f.t
      UNION ALL
      SELECT entity_id, t, period, z1 + j11 * d1 + j12 * d2, z2 + j21 * d1 + j22 * d2,
        v11 + (j11 * e11 + j12 * e12) * j11 + (j11 * e12 + j12 * e22) * j12, v12 + (j11 * e11 + j12 * e12) * j21 + (j11 * e12 + j12 * e22) * j22,
        v22 + (j21 * e11 + j22 * e12) * j21 + (j21 * e12 + j22 * e22) * j22
      FROM (SELECT a.*, n.q11 * n.q22 - n.q12 * n.q12 AS qd, 0.8 * (a.v11 * n.q22 - a.v12 * n.q12) / qd AS j11, 0.8 * (a.v12 * n.q11 - a.v11 * n.q12) / qd AS j12,
              0.8 * (a.v12 * n.q22 - a.v22 * n.q12) / qd AS j21, 0.8 * (a.v22 * n.q11 - a.v12 * n.q12) / qd AS j22,
              g.z1 - n.p1 AS d1, g.z2 - n.p2 AS d2, g.w11 - n.q11 AS e11, g.w12 - n.q12 AS e12, g.w22 - n.q22 AS e22
            FROM g JOIN f n ON n.entity_id = g.entity_id AND n.t = g.t JOIN f a ON a.entity_id = g.entity_id AND a.t = g.t - 1 WHERE a.t > 0))"""


def spline(table: str) -> str:
    """Common table expressions for the not-a-knot spline of ``table (entity_id, series_id, period, value)``.

    ``filled`` has every cell: the spline from four known cells on, the line between two or three, else the cell itself.
    """
    by = "PARTITION BY entity_id, series_id"
    return f"""c AS (SELECT *, CAST(row_number() OVER ({by} ORDER BY period) - 1 AS DOUBLE) AS t FROM {table}),
    k AS (SELECT entity_id, series_id, t AS x, value AS y, row_number() OVER ({by} ORDER BY t) - 1 AS i, count(*) OVER ({by}) AS n FROM c WHERE value IS NOT NULL),
    h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s, x - lag(x) OVER w AS g, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS r FROM k WINDOW w AS ({by} ORDER BY i)),
    e AS (SELECT entity_id, series_id, i, n, CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN g - h * h / g ELSE g END AS a,
        2 * (g + h) + CASE WHEN i = 1 THEN g * (g + h) / h ELSE 0 END + CASE WHEN i = n - 2 THEN h * (g + h) / g ELSE 0 END AS b,
        CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN h - g * g / h ELSE h END AS c, 6 * (s - r) AS d FROM h WHERE n >= 4 AND i BETWEEN 1 AND n - 2),
    down(entity_id, series_id, i, n, u, v) AS (SELECT entity_id, series_id, i, n, c / b, d / b FROM e WHERE i = 1
      UNION ALL SELECT e.entity_id, e.series_id, e.i, e.n, e.c / (e.b - e.a * u), (e.d - e.a * v) / (e.b - e.a * u) FROM down JOIN e ON e.entity_id = down.entity_id AND e.series_id = down.series_id AND e.i = down.i + 1),
    up(entity_id, series_id, i, n, m) AS (SELECT entity_id, series_id, i, n, v FROM down WHERE i = n - 2
      UNION ALL SELECT down.entity_id, down.series_id, down.i, down.n, v - u * m FROM up JOIN down ON down.entity_id = up.entity_id AND down.series_id = up.series_id AND down.i = up.i - 1),
    inner_m AS (SELECT h.*, m, lead(m) OVER w AS m_next, lag(m) OVER w AS m_last FROM h LEFT JOIN up ON up.entity_id = h.entity_id AND up.series_id = h.series_id AND up.i = h.i WHERE h.n >= 4
      WINDOW w AS (PARTITION BY h.entity_id, h.series_id ORDER BY h.i)),
    near AS (SELECT *, lead(h) OVER w AS h1, lead(m) OVER w AS m1, lead(m, 2) OVER w AS m2, lag(g) OVER w AS g1, lag(m) OVER w AS l1, lag(m, 2) OVER w AS l2 FROM inner_m WINDOW w AS ({by} ORDER BY i)),
    knots AS (SELECT entity_id, series_id, i, n, x, y, h, CASE WHEN i = 0 THEN ((h + h1) * m1 - h * m2) / h1 WHEN i = n - 1 THEN ((g1 + g) * l1 - g * l2) / g1 ELSE m END AS m FROM near),
    pieces AS (SELECT *, lead(x) OVER w AS xr, lead(y) OVER w AS yr, lead(m) OVER w AS mr FROM knots WINDOW w AS ({by} ORDER BY i)),
    cells AS (SELECT c.*, greatest(0, least(count(k.x) - 1, max(k.n) - 2)) AS i, max(k.n) AS n FROM c LEFT JOIN k ON k.entity_id = c.entity_id AND k.series_id = c.series_id AND k.x <= c.t GROUP BY ALL),
    total AS (SELECT entity_id, series_id, count(*) AS n FROM k GROUP BY 1, 2),
    line AS (SELECT entity_id, series_id, period, coalesce(last_value(value IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS before,
        first_value(value IGNORE NULLS) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, max(CASE WHEN value IS NOT NULL THEN t END) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
        min(CASE WHEN value IS NOT NULL THEN t END) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM cells WINDOW b AS ({by} ORDER BY t)),
    filled AS (SELECT w.entity_id, w.series_id, w.period,
        CASE WHEN w.value IS NOT NULL OR coalesce(total.n, 0) < 2 THEN w.value
          WHEN total.n < 4 THEN CASE WHEN t0 IS NULL OR t1 IS NULL THEN before ELSE before + (w.t - t0) * (after - before) / (t1 - t0) END
          ELSE (p.m * pow(p.xr - w.t, 3) + p.mr * pow(w.t - p.x, 3)) / (6 * p.h) + (p.y / p.h - p.m * p.h / 6) * (p.xr - w.t) + (p.yr / p.h - p.mr * p.h / 6) * (w.t - p.x) END AS value
      FROM cells w LEFT JOIN total ON total.entity_id = w.entity_id AND total.series_id = w.series_id
      LEFT JOIN line ON line.entity_id = w.entity_id AND line.series_id = w.series_id AND line.period = w.period
      LEFT JOIN pieces p ON p.entity_id = w.entity_id AND p.series_id = w.series_id AND p.i = coalesce(w.i, 0))"""
