"""Landed JSON and observation payloads to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.numeric import to_number
from tidecast.operators.grid import last_per_cell

MIN_OBSERVATIONS = 24  # fixed value
MISSING_MARK = "."  # fixed value


def json_records(payloads: DataFrame, fields: str, column: str = "payload") -> DataFrame:
    """Records of every payload, which is a bare list or an object with a ``value`` list."""
    listed = F.from_json(column, f"array<struct<{fields}>>")
    wrapped = F.from_json(column, f"value array<struct<{fields}>>")["value"]
    is_list = F.ltrim(column).startswith("[")
    return payloads.select(
        *[c for c in payloads.columns if c != column], F.inline(F.when(is_list, listed).otherwise(wrapped))
    )


def json_rates(payloads: DataFrame, preference: list[str], column: str = "payload") -> DataFrame:
    """Dated rates: a list, ``{"rate": [...]}`` or ``{"data": {"rate": [...]}}``.

    The value is the first column of ``preference`` that holds a number.
    """
    # field names may start with a digit, so they are quoted
    item = "struct<date string, " + ", ".join(f"`{c}` string" for c in preference) + ">"
    shapes = F.from_json(column, f"data struct<rate array<{item}>>, rate array<{item}>")
    listed = F.from_json(column, f"array<{item}>")
    rates = F.when(F.ltrim(column).startswith("["), listed).otherwise(F.coalesce(shapes["data"]["rate"], shapes["rate"]))
    rows = payloads.select(*[c for c in payloads.columns if c != column], F.inline(rates))
    value = F.coalesce(*[to_number(F.col(f"`{c}`")) for c in preference])
    return rows.withColumn("value", value).withColumn("date", F.col("date").try_cast("date")).drop(*preference).filter(
        F.col("date").isNotNull() & F.col("value").isNotNull()
    )


def observations(rows: DataFrame, keys: list[str], minimum: int = MIN_OBSERVATIONS) -> DataFrame:
    """Text observations to numbers; marked gaps go, and so do series with too few values.

    The count is an aggregate joined back, so a hot series is counted on the
    map side and its rows stay where they are.
    """
    usable = rows.filter(F.col("value") != MISSING_MARK).withColumn("value", F.col("value").try_cast("double"))
    usable = usable.filter(F.col("value").isNotNull())
    enough = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)
    return usable.join(enough.select(*keys), keys, "left_semi")


def dedup(rows: DataFrame, keys: list[str], order: str, keep: str = "last") -> DataFrame:
    """One row per key, first or last by ``order``; duplicates shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def load_series(records: DataFrame, specs: list[dict], date: str = "date", order: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Cut every specified series out of a wide multi-series dataset, in one scan.

    A spec is {series_id, value_col, filters}. Each record unfolds into the
    series whose filters it meets; missing values and repeated dates go (the
    first record of a date stays). ``keys`` are columns of the records that tell panels apart.
    """
    entries = []
    for spec in specs:
        meets = F.lit(True)
        for column, wanted in spec.get("filters", {}).items():
            if column in records.columns:
                meets = meets & (F.col(column) == wanted)
        value = F.when(meets, F.col(spec["value_col"]).cast("double"))
        entries.append(F.struct(F.lit(spec["series_id"]).alias("series_id"), value.alias("value")))
    at = F.to_date(date)
    rank = F.col(order) if order else F.col(date)
    rows = records.select(*keys, at.alias("date"), rank.alias("rank"), F.inline(F.array(*entries)))
    rows = rows.filter(F.col("value").isNotNull())
    return rows.groupBy(*keys, "series_id", "date").agg(F.min_by("value", "rank").alias("value"))


__all__ = ["dedup", "json_rates", "json_records", "last_per_cell", "load_series", "observations"]
