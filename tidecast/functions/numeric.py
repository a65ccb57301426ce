"""Scalar rules shared by the operators."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FLOOR = 1e-12  # fixed value: growth transforms floor their argument here
STATE_LIMIT = 1e6  # fixed value: states are clipped to this magnitude
VARIANCE_LIMIT = 1e10  # fixed value: variances are clipped to [0, this]


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def floored_log(v: Column) -> Column:
    # greatest() skips NULL arguments, so a missing cell is kept missing by hand
    return F.when(v.isNotNull(), F.ln(F.greatest(v, F.lit(LOG_FLOOR))))


def clip_state(v: Column) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(STATE_LIMIT)), F.lit(-STATE_LIMIT)))


def clip_variance(v: Column) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(VARIANCE_LIMIT)), F.lit(0.0)))


def close(a: Column, b: Column, rel: float = 1e-8, absolute: float = 1e-8) -> Column:
    """Equal within tolerance; two missing values are equal, one is not."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.abs(a - b) <= absolute + rel * F.abs(b)).otherwise(
        a.isNull() & b.isNull()
    )


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) fixed by the key: the same on every engine and rerun."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation; NULL when a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def direction(v: Column, flat: float = 1e-6) -> Column:
    return F.when(v > flat, "up").when(v < -flat, "down").otherwise("flat")


def error_badge(err: Column) -> Column:
    return F.when(err < 1, "excellent").when(err < 2, "good").otherwise("fair")


def first_number(*cols: Column) -> Column:
    """First of several text columns that parses as a number (``%`` and ``,`` allowed)."""
    return F.coalesce(*[to_number(c) for c in cols])


def to_number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[%,]", "").try_cast("double")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# fixed values: coefficients of a rational approximation of the normal distribution function (error below 1e-14)
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BELOW = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
)
CDF_TURN = 7.07106781186547  # beyond it a continued fraction


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as an expression."""
    z = F.abs(x)
    horner = lambda cs: reduce(lambda acc, c: acc * z + c, cs[1:], F.lit(cs[0]))
    density = F.exp(-z * z / 2)
    near = density * horner(CDF_TOP) / horner(CDF_BELOW)
    tail = reduce(lambda acc, k: z + k / acc, (4, 3, 2, 1), z + 0.65)
    upper = F.when(z < CDF_TURN, near).otherwise(density / tail / 2.506628274631)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def crps_normal(actual, mean, std) -> Column:
    """CRPS of a normal forecast, closed form; names or columns."""
    actual, mean, std = (F.col(c) if isinstance(c, str) else c for c in (actual, mean, std))
    z = (actual - mean) / std
    density = F.exp(-z * z / 2) / F.sqrt(2 * F.pi())
    return std * (z * (2 * normal_cdf(z) - 1) + 2 * density - 1 / F.sqrt(F.pi()))
