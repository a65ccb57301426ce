"""Files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with a ``date`` column, forced to a date whatever it was stored as."""
    return _dated(spark.read.parquet(path))


def read_wide_csv(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """Wide CSV ``date, s1, s2, ...``; cells that do not parse are missing."""
    columns = ", ".join(f"`{s}` string" for s in series)
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", schema=f"date string, {columns}", enforceSchema=False)
    return _dated(raw).select("date", *[F.col(f"`{s}`").try_cast("double").alias(s) for s in series])


def read_years(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A table kept in a folder per year, as one scan; years outside the bounds are not read."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col("year") >= first)
    if last is not None:
        rows = rows.filter(F.col("year") <= last)
    return rows.drop("year")


def _dated(df: DataFrame) -> DataFrame:
    if "date" not in df.columns:
        raise ValueError("a 'date' column is required")
    return df.withColumn("date", F.col("date").try_cast("date"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Replace a table. The old files go first, so a reader must not run at the same time."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
