"""Session for local runs, and the shared folder that cuts lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tidecast") -> SparkSession:
    """A ``local[n]`` session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDECAST_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode, where driver and executors
    are one process on one disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = _local_scratch()
    return root.rstrip("/")


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tidecast-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan behind it is computed once and the result survives the loss of
    any executor, which is what an iterative fit needs between two steps.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``cut``, with the rows of a key in one file: grouping by ``key`` then needs no shuffle, however often it is done."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name = os.path.basename(path).replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread(df, [key]).write.option("path", path).bucketBy(parts, key).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.cut_path, out.cut_table = path, name
    return out


def sweep_up(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles of tables that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def together(jobs: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Run independent fits at the same time, each to its written result.

    A fit is a chain of small jobs that leaves most of the cluster idle; side by side, the chains fill each other's gaps.
    """
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        started = {name: pool.submit(lambda job=job, name=name: cut(job(), name)) for name, job in jobs.items()}
        return {name: job.result() for name, job in started.items()}


def discard(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_by(df: DataFrame) -> None:
    """``discard`` for ``cut_by``."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS `{df.cut_table}`")
    discard(df)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Place rows by key for work that is heavy per row, not per byte.

    Adaptive coalescing goes by size and would run many small fits in one task;
    a stated number of partitions is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cogroup(left: DataFrame, right: DataFrame, keys: list[str]):
    """Two tables side by side per key, each placed by key; they may share a lineage."""
    fresh = right.toDF(*right.columns)
    return spread(left, keys).groupBy(*keys).cogroup(spread(fresh, keys).groupBy(*keys))
