"""Which variables the system of a key has, and in which order.

An ``order`` is a list of names that holds for all keys, or a table ``(some of the keys, series_id, pos)`` with positions
from 1 in every system, so that systems of different variables and widths are fitted side by side. The target is last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Order = list[str] | DataFrame


def own_keys(order: DataFrame) -> list[str]:
    """The keys that a table of systems is given by."""
    return [c for c in order.columns if c not in ("series_id", "pos", "n")]


def sized(order: DataFrame) -> DataFrame:
    """The table with ``n``, the number of variables of each system."""
    own = own_keys(order)
    sizes = order.groupBy(*own).agg(F.max("pos").cast("int").alias("n"))
    return order.join(sizes, own) if own else order.withColumn("n", order.agg(F.max("pos").cast("int")).scalar())


def place(panel: DataFrame, order: Order) -> DataFrame:
    """Rows of the variables of a system, with their position ``pos`` and the size ``n`` of the system."""
    if isinstance(order, DataFrame):
        return panel.join(sized(order), [*own_keys(order), "series_id"])
    position = F.array_position(F.lit(order), F.col("series_id")).cast("int")
    return panel.withColumns({"pos": position, "n": F.lit(len(order))}).filter("pos > 0")


def spread_over(rows: DataFrame, order: Order) -> DataFrame:
    """Every row once for each variable of its system, with ``series_id``, ``pos`` and ``n``."""
    if isinstance(order, DataFrame):
        own = own_keys(order)
        names = sized(order).groupBy(*own).agg(F.collect_list(F.struct("series_id", "pos", "n")).alias("_m"))
        if not own:
            raise ValueError("a table of systems needs a key")
        return rows.join(names, own).select("*", F.inline("_m")).drop("_m")
    names = F.array(*[F.struct(F.lit(s).alias("series_id"), F.lit(i + 1).alias("pos"), F.lit(len(order)).alias("n")) for i, s in enumerate(order)])
    return rows.select("*", F.inline(names))


def with_names(rows: DataFrame, order: Order) -> DataFrame:
    """Rows of a key with ``names``, the variables of its system in order."""
    if isinstance(order, DataFrame):
        own = own_keys(order)
        listed = order.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("pos", "series_id"))).alias("_m"))
        return rows.join(listed.select(*own, F.col("_m.series_id").alias("names")), own)
    return rows.withColumn("names", F.lit(order))


def indicators(order: Order) -> Order:
    """The systems without their targets."""
    if isinstance(order, DataFrame):
        return sized(order).filter("pos < n").drop("n")
    return order[:-1]


def target_rows(rows: DataFrame, order: Order) -> DataFrame:
    """The rows of each system's target, the last of its variables."""
    if isinstance(order, DataFrame):
        last = sized(order).filter("pos = n").drop("pos", "n")
        return rows.join(last, [*own_keys(order), "series_id"])
    return rows.filter(F.col("series_id") == order[-1])
