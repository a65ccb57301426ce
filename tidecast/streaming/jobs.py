"""The stateful parts of the daily job as streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidecast.plans.daily import upsert_log
from tidecast.session import scratch_path

EPOCH = dt.date(1970, 1, 1)
FIRST_STATE = "first_date date, first_value double, latest_value double, last_date date, base_year int"
FIRST_OUTPUT = (
    "quarter string, metric string, first_release_date date, first_value double, latest_value double, "
    "last_update_date date, base_year int"
)
#: State with timers is kept by this store; Spark's default one has no timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class _FirstRelease(StatefulProcessor):
    """Earliest and latest sighting of one quarter and metric, forgotten ``keep`` days after the latest."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("sightings", FIRST_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.state.get()) if self.state.exists() else None
        before = now[3] if now else None
        for pdf in rows:
            seen = pdf[pdf["value"].notna()]
            if seen.empty:
                continue
            day = pd.to_datetime(seen["seen_date"]).to_numpy()
            early, late = (seen.iloc[int(i)] for i in (day.argmin(), day.argmax()))
            if now is None or early["seen_date"] < now[0]:
                year = None if pd.isna(early["base_year"]) else int(early["base_year"])
                rest = (round(float(early["value"]), 3), early["seen_date"]) if now is None else (now[2], now[3])
                now = [early["seen_date"], round(float(early["value"]), 3), *rest, year]
            if late["seen_date"] > now[3]:
                now[2], now[3] = round(float(late["value"]), 3), late["seen_date"]
        if now is None:
            return
        if now[3] != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(now[3]))
        self.state.update(tuple(now))
        yield pd.DataFrame({
            "quarter": [key[0]], "metric": [key[1]], "first_release_date": [now[0]], "first_value": [now[1]],
            "latest_value": [now[2]], "last_update_date": [now[3]], "base_year": pd.array([now[4]], "Int32"),
        })

    def _end(self, day) -> int:
        return (day - EPOCH).days * DAY_MS + self.keep * DAY_MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_release_updates(feed: DataFrame, late: int = 400, keep: int = 400) -> DataFrame:
    """Stream of (quarter, metric, value, seen_date, base_year) to the frozen table, as updates.

    State per key is the earliest and the latest sighting. A row with an earlier ``seen_date`` takes the first place and a
    later one only moves the latest value, in whatever order they come, as long as a row is no more than ``late`` days
    behind the newest of the stream; rows behind that are dropped. A key that has not been seen for ``keep`` days beyond
    that is forgotten, so state holds the recent releases and not the history; ``frozen_table`` folds the updates of a key
    that comes back later into what the table already has. A missing value is no sighting, a missing base year stays
    missing.
    """
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = feed.withColumn("seen_at", F.col("seen_date").cast("timestamp")).withWatermark("seen_at", f"{late} days")
    return timed.groupBy("quarter", "metric").transformWithStateInPandas(_FirstRelease(keep), FIRST_OUTPUT, "update", "eventTime")


def frozen_table(updates: DataFrame) -> DataFrame:
    """The frozen table from all updates so far: the first sighting never changes, the latest moves on."""
    return updates.groupBy("quarter", "metric").agg(
        F.min("first_release_date").alias("first_release_date"),
        F.min_by("first_value", "first_release_date").alias("first_value"),
        F.max_by("latest_value", "last_update_date").alias("latest_value"),
        F.max("last_update_date").alias("last_update_date"),
        F.min_by("base_year", "first_release_date").alias("base_year"),
    )


def daily_last(events: DataFrame, keys: list[str], late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Last value of every window; rows later than the watermark no longer count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(*keys, window).agg(F.max_by("value", "ts").alias("value")).select(
        *keys, F.col("window.start").alias("start"), "value"
    )


def upsert_stream(rows: DataFrame, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append each batch, one row per key, under its own number.

    A batch costs what it brings, not what the log already holds, and a batch
    that is run again after a failure overwrites itself. ``read_log`` shows the
    current rows; ``compact_log`` folds old batches into a new table.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        upsert_log(batch, batch.limit(0), keys, order).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_log(spark: SparkSession, table: str, keys: list[str], order: str) -> DataFrame:
    """Current rows: the highest ``order`` of a key wins, the later batch among equals."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(order, "batch_id"))
    return rows.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*").drop("batch_id")


def compact_log(spark: SparkSession, table: str, keys: list[str], order: str, into: str) -> None:
    read_log(spark, table, keys, order).write.mode("overwrite").parquet(f"{into}/batch_id=0")


def run_to_table(stream: DataFrame, mode: str, label: str = "stream") -> str:
    """Run a stream over all available data into Parquet and return the folder.

    In update mode every batch is kept with its number; the highest number per
    key is the current row.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, label)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/data/b={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{root}/data"


def current_rows(folder_rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in folder_rows.columns if c not in (*keys, "batch_id", "b")]
    return folder_rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
