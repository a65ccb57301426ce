"""Keeps each query next to its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _digits(spec: str) -> dict[str, int]:
    """``"a b:2"`` to ``{"a": 6, "b": 2}``."""
    parts = (item.partition(":") for item in spec.split())
    return {name: int(n or 6) for name, _, n in parts}


def query(key: str, sql: str | None = None, rnd: str = ""):
    """Register ``fn(t)``, where ``t`` gives the tables, under ``key``.

    ``rnd`` names the floating columns and the digits both sides are rounded
    to. Common table expressions that ``sql`` mentions are put in front of it.
    """
    digits = _digits(rnd)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(tables.Tables(spark, sf_dir))
            return out.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else out

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            body = sql.strip()
            if digits:
                swaps = ", ".join(f"round({c}, {n}) AS {c}" for c, n in digits.items())
                body = f"SELECT * REPLACE ({swaps}) FROM ({body})"
            ORACLES[key] = tables.with_ctes(body)
        return fn

    return wrap
