"""Windows over keys that may hold most of the rows.

A key's rows are cut into segments along the order, each segment is sorted on its own, and what the next segment needs to
know of the one before (its last rows, or how many there are) goes through a table of one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: str, right: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def with_lag(rows: DataFrame, keys: list[str], order: list[str], values: list[str], k: int = 1, segment: Column | None = None) -> DataFrame:
    """``rows`` with ``_before``, a struct of ``values`` from the row ``k`` places back in the order of its key.

    ``segment`` must not fall along ``order``; the first column of the order by default. A task holds one segment of a
    key, and the table of segments has ``k`` rows for each, so a hot key is as wide as it has segments.
    """
    cut = rows.withColumn("_segment", segment if segment is not None else F.col(order[0]))
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    held = F.struct(*values)
    placed = cut.withColumn("_nth", F.row_number().over(inside)).withColumn("_inner", F.lag(held, k).over(inside))
    back = Window.partitionBy(*keys, "_segment").orderBy(*[F.desc(c) for c in order])
    last = cut.withColumn("_from_end", F.row_number().over(back)).filter(F.col("_from_end") <= k)
    tails = last.groupBy(*keys, "_segment").agg(F.sort_array(F.collect_list(F.struct((-F.col("_from_end")).alias("i"), held.alias("v")))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("_carried", F.slice(F.reverse(F.flatten(F.collect_list("_tail").over(earlier))), 1, k)).drop("_tail")
    joined = placed.alias("r").join(carried.alias("c"), _same("r", "c", [*keys, "_segment"]), "left")
    # the carried rows are counted backwards from the beginning of the segment
    before = F.when(F.col("r._nth") > k, F.col("r._inner")).otherwise(F.get("c._carried", k - F.col("r._nth"))["v"])
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], before.alias("_before"))


def with_rank(rows: DataFrame, keys: list[str], value: str, segments: int = 64) -> DataFrame:
    """``rows`` with ``_rank``, the place of the row by ``value`` within its key, from 1; nulls come first.

    Segments are ranges of equal width between the least and the greatest value of the key.
    """
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.alias("r").join(bounds.alias("b"), _same("r", "b", keys), "left")
    share = F.try_divide(F.col(f"r.{value}") - F.col("b._lo"), F.col("b._hi") - F.col("b._lo"))
    # beside an infinite value all others are one segment
    cell = F.least(F.floor(F.nanvl(share, F.lit(0.0)) * segments), F.lit(segments - 1))
    cut = joined.select("r.*", F.when(F.col(f"r.{value}").isNull(), -1).otherwise(F.coalesce(cell, F.lit(0))).cast("int").alias("_segment"))
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "_segment").orderBy(value)
    placed = cut.withColumn("_nth", F.row_number().over(inside)).alias("r")
    out = placed.join(counts.alias("c"), _same("r", "c", [*keys, "_segment"]))
    return out.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("c._ahead") + F.col("r._nth")).alias("_rank"))
