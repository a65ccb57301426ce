"""Tables that are published together, and read while the next version is being written.

A store is a folder in shared storage. Every table of a publication is written to a fresh folder of its own; then one
small manifest, which names the current folder of every table, is committed. The manifest is a single file, put in place
by the one rename of Spark's commit protocol, so a reader sees all tables of a version or all tables of the one before.
Folders never change once written. A run that dies before its manifest leaves a folder that nobody reads.

    manifests/00000007/   name, path, format and columns of every table as of version 7
    data/log/00000007-…/  the rows that version 7 wrote
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "version long, token string, name string, path string, format string, columns string"
#: In CSV an empty text comes back as missing; the other formats keep the two apart.
FORMATS = {"parquet": {}, "csv": {"header": "true"}, "json": {}}


class Conflict(RuntimeError):
    """Another run has published since this one read the store."""


def _manifests(spark: SparkSession, root: str) -> list[Row]:
    """Manifest rows of all versions that are still kept: a few per version.

    Two runs that commit one version in the same moment both leave a manifest; the lower token holds, for everybody.
    """
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/manifests/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    holds: dict[int, str] = {}
    for r in rows:
        holds[r.version] = min(r.token, holds.get(r.version, r.token))
    return [r for r in rows if r.token == holds[r.version]]


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions that can still be read, the oldest first."""
    return sorted({r.version for r in _manifests(spark, root)})


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Row]:
    """Where each table of a version (the last one by default) lies; a store without versions has no tables."""
    rows = _manifests(spark, root)
    at = max((r.version for r in rows), default=0) if version is None else version
    found = {r.name: r for r in rows if r.version == at}
    if version is not None and not found:
        raise KeyError(f"version {version} is not in the store")
    return found


def open_table(spark: SparkSession, root: str, entry: Row) -> DataFrame:
    """The rows behind a manifest entry, with the columns and types they were written with."""
    columns = StructType.fromJson(json.loads(entry.columns))
    return spark.read.schema(columns).options(**FORMATS[entry.format]).format(entry.format).load(f"{root}/{entry.path}").select(*columns.names)


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version. What is read stays the same, however often the table is published meanwhile."""
    return open_table(spark, root, manifest(spark, root, version)[name])


def stage(tables: dict[str, DataFrame], root: str, version: int, formats: dict[str, str] = {}, partition_by: dict[str, list[str]] = {}) -> list[tuple]:
    """Write each table to a folder of its own and return the manifest entries; nothing is visible yet."""
    entries, token = [], uuid.uuid4().hex
    for name, df in tables.items():
        kind = formats.get(name, "parquet")
        path = f"data/{name}/{version:08d}-{token}"
        df.write.format(kind).options(**FORMATS[kind]).partitionBy(*partition_by.get(name, [])).save(f"{root}/{path}")
        entries.append((version, token, name, path, kind, df.schema.json()))
    return entries


def commit(spark: SparkSession, root: str, version: int, entries: list[tuple]) -> None:
    """Make a version visible. Fails with ``Conflict`` if the version exists already."""
    rows = spark.createDataFrame(entries, MANIFEST).coalesce(1)
    try:
        rows.write.mode("errorifexists").json(f"{root}/manifests/{version:08d}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"version {version} has been published by another run") from e
    if {r.token for r in _manifests(spark, root) if r.version == version} != {entries[0][1]}:
        raise Conflict(f"version {version} was published by another run in the same moment")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], *, formats: dict[str, str] = {},
            partition_by: dict[str, list[str]] = {}, based_on: int | None = None, keep: int = 2) -> int:
    """Write ``tables`` and make them current together; tables that are not named stay as they are.

    ``based_on`` is the version the new rows were derived from (the last one by default): if another run has published
    since, nothing becomes visible and ``Conflict`` is raised. The last ``keep`` versions stay readable.
    """
    last = max(versions(spark, root), default=0)
    if based_on is not None and based_on != last:
        raise Conflict(f"derived from version {based_on}, but {last} is current")
    before = manifest(spark, root, last) if last else {}
    entries = stage(tables, root, last + 1, formats, partition_by)
    token = entries[0][1]
    entries += [(last + 1, token, r.name, r.path, r.format, r.columns) for r in before.values() if r.name not in tables]
    commit(spark, root, last + 1, entries)
    expire(spark, root, keep)
    return last + 1


def expire(spark: SparkSession, root: str, keep: int) -> None:
    """Empty the manifests of all but the last ``keep`` versions, then the folders that no manifest names any more.

    In this order: a run that dies in between leaves folders behind, never a manifest without its rows. A reader of an
    expired version fails; one that needs longer than ``keep`` publications must be given more.
    """
    rows = _manifests(spark, root)
    kept = sorted({r.version for r in rows})[-keep:]
    gone = [r for r in rows if r.version not in kept]
    named = {r.path for r in rows if r.version in kept}
    for version in sorted({r.version for r in gone}):
        spark.createDataFrame([], MANIFEST).write.mode("overwrite").json(f"{root}/manifests/{version:08d}")
    for path, entry in {r.path: r for r in gone if r.path not in named}.items():
        columns = StructType.fromJson(json.loads(entry.columns))
        spark.createDataFrame([], columns).write.mode("overwrite").format(entry.format).save(f"{root}/{path}")
