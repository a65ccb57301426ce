"""Month and quarter arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(d: Column) -> Column:
    return F.trunc(F.to_date(d), "month")


def quarter_start(d: Column) -> Column:
    return F.trunc(F.to_date(d), "quarter")


def quarter_end_month(d: Column) -> Column:
    """First day of the last month of the quarter of ``d``."""
    return F.add_months(quarter_start(d), 2)


def month_of_quarter(d: Column) -> Column:
    return (F.month(d) - 1) % 3 + 1


def is_quarter_end(d: Column) -> Column:
    return F.month(d) % 3 == 0


def month_index(d: Column) -> Column:
    """Months since year 0, so that differences are whole months."""
    return F.year(d) * 12 + F.month(d) - 1


def months_apart(later: Column, earlier: Column) -> Column:
    return month_index(later) - month_index(earlier)


def quarter_label(d: Column) -> Column:
    """``YYYY-Qn``."""
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def parse_quarter(label: Column) -> Column:
    """First day of the quarter named ``YYYY-Qn``; NULL for anything else."""
    year = F.regexp_extract(label, r"^(\d{4})-Q([1-4])$", 1)
    quarter = F.regexp_extract(label, r"^(\d{4})-Q([1-4])$", 2)
    return F.when(
        year != "", F.make_date(year.cast("int"), quarter.cast("int") * 3 - 2, F.lit(1))
    )


def quarter_display(label: Column) -> Column:
    """``YYYY-Qn`` to ``Qn YYYY``."""
    return F.regexp_replace(label, r"^(\d{4})-(Q[1-4])$", "$2 $1")


def quarter_from_display(text: Column) -> Column:
    """``Qn YYYY`` to ``YYYY-Qn``."""
    return F.regexp_replace(text, r"^(Q[1-4]) (\d{4})$", "$2-$1")


def horizon_bucket(run_date: Column, target_quarter: Column) -> Column:
    """Where in the life of its target quarter a nowcast was made."""
    gap = months_apart(run_date, parse_quarter(target_quarter))
    return (
        F.when(gap < 0, "forecast")
        .when(gap <= 2, F.concat(F.lit("m"), (gap + 1).cast("string")))
        .when(gap > 2, "backcast")
        .otherwise("unknown")
    )


def resolve_target_quarter(stamped: Column, run_date: Column) -> Column:
    """The stamped quarter, else the quarter the run date falls in."""
    return F.when(stamped.contains("-Q"), stamped).otherwise(quarter_label(run_date))


def months_between_inclusive(lo: Column, hi: Column, step: int = 1) -> Column:
    return F.sequence(lo, hi, F.expr(f"interval {step} month"))
