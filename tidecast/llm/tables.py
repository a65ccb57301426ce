"""Counts in tables of a fixed size, whatever the input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidecast.llm.words import slices

CHUNK = 1 << 14


def _small(counts: np.ndarray) -> tuple[int, bytes]:
    """Counts in the smallest unsigned integers that hold them, and their width in bytes."""
    small = counts.astype(np.min_scalar_type(int(counts.max())))
    return small.itemsize, small.tobytes()


SCHEMA = "chunk long, width long, counts binary"


def dense_chunks(table: np.ndarray) -> pa.Table:
    """The chunks of a table of counts that are not empty, for ``dense_sum``."""
    grid = np.pad(table, (0, -len(table) % CHUNK)).reshape(-1, CHUNK)
    at = np.flatnonzero(grid.any(1)).tolist()
    small = [_small(grid[k]) for k in at]
    return pa.table({"chunk": pa.array(at, pa.int64()), "width": pa.array([w for w, _ in small], pa.int64()), "counts": pa.array([raw for _, raw in small], pa.binary())})


def dense_sum(chunks: DataFrame, cells: int) -> np.ndarray:
    """Sum of tables in chunks, added up by a shuffle; ``cells`` numbers go to the driver."""

    def add(key, part):
        total = np.zeros(CHUNK, np.int64)
        for width, raw in zip(part.column("width").to_pylist(), part.column("counts").to_pylist()):
            total += np.frombuffer(raw, f"u{width}").astype(np.int64)
        width, raw = _small(total)
        return pa.table({"chunk": [key[0].as_py()], "width": [width], "counts": pa.array([raw], pa.binary())})

    out = np.zeros(-(-cells // CHUNK) * CHUNK, np.int64)
    for row in chunks.groupBy("chunk").applyInArrow(add, SCHEMA).collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], f"u{row['width']}")
    return out[:cells]


def dense_counts(rows: DataFrame, cells: int, codes_of: Callable[[pa.RecordBatch], np.ndarray], text: str | None = "text") -> np.ndarray:
    """How often ``codes_of`` gives each code below ``cells`` over all batches of ``rows``.

    Each task keeps one table and sends the chunks that are not empty, in the smallest integers that hold them; chunks
    are added up by a shuffle. The result, ``cells`` numbers, goes to the driver. With ``text`` batches are cut by size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for part in slices(batch, text) if text else [batch]:
                np.add(table, np.bincount(codes_of(part), minlength=len(table)), out=table)
        yield from dense_chunks(table).to_batches()

    return dense_sum(rows.mapInArrow(count, SCHEMA), cells)
