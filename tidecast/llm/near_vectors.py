"""Near-duplicate vectors: binary codes of random rotations say which of them need their exact cosines.

*Index.* Equal vectors are one class with a count. Every class gets, from rotations fixed by a seed, the key of a bucket
in each of several tables (the signed axis nearest to the rotated vector, for one or more rotations), a binary code (the
signs of further rotations, ``BITS`` or more of them), its stored correction factor (the inner product of the vector and
its code) and itself in four-bit steps, rounded at random so that they are right on average.

*Estimate.* Code times steps, divided by the factor, estimates the inner product of two vectors without bias; its spread
follows from the factor. Inside each bucket a class is marked if the upper confidence bound (``Z`` spreads) with another
reaches the threshold and no earlier table has the two in one bucket. Only codes travel for this.

*Recompute.* Marked classes meet again with their vectors, in the same buckets, and exact cosines in double precision
decide. A pair counts only in the first table in which it shares a bucket.

A bucket of many classes is cut into blocks, and pairs of blocks are separate groups, so no task holds a whole hot bucket
and no pair leaves a task: groups return sums of links and, for the components, one link per class.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.components import connected_components
from tidecast.session import cut, spread

SEED = 20
BITS = 256
Z = 4.0
#: Chance that a pair exactly at the threshold shares a bucket in some table.
FOUND = 0.98
#: Rows of a block; random rows of a bucket above which one more rotation goes into its key.
BLOCK, CROWD = 1024, 1024
LEVELS = 15


def rotations(dim: int, n: int, stream: int) -> np.ndarray:
    """``n`` random orthogonal matrices side by side (``dim x (n * dim)``), the same in every task."""
    rng = np.random.default_rng([SEED, dim, stream])
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, 1)


def nearest_axes(turned: np.ndarray, dim: int) -> np.ndarray:
    """Code of the signed axis nearest to each rotated copy of each row: ``2 * axis + (negative)``."""
    cells = turned.reshape(len(turned), -1, dim)
    at = np.abs(cells).argmax(2)
    return 2 * at + (np.take_along_axis(cells, at[:, :, None], 2)[:, :, 0] < 0)


@lru_cache(maxsize=256)
def meeting(dim: int, cosine: float, pairs: int = 4000) -> float:
    """Chance that two vectors of this cosine have the same nearest axis after a random rotation, from drawn pairs."""
    rng = np.random.default_rng([SEED, dim, 7])
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    c = cosine * a + math.sqrt(1 - cosine * cosine) * b
    return max(float((nearest_axes(a, dim) == nearest_axes(c, dim)).mean()), 1e-3)


def layout(dim: int, cosine: float, rows: int) -> tuple[int, int]:
    """Tables, and rotations per key: keys so long that random rows do not crowd, tables for ``FOUND`` at the threshold."""
    per_key = max(1, math.ceil(math.log(max(rows, 1) / CROWD, 2 * dim)))
    p = meeting(dim, cosine) ** per_key
    return (max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - p))) if p < 1 else 1), per_key


@lru_cache(maxsize=16)
def _frames(dim: int, tables: int, per_key: int) -> tuple[np.ndarray, np.ndarray]:
    return rotations(dim, tables * per_key, 1), rotations(dim, -(-BITS // dim), 2)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray, cosine: float, rows: int) -> dict[str, np.ndarray]:
    """Keys per table, code, factor and random four-bit steps of vectors of one length."""
    dim = vectors.shape[1]
    tables, per_key = layout(dim, cosine, rows)
    to_keys, to_code = _frames(dim, tables, per_key)
    unit = _unit(vectors)
    axes = nearest_axes(unit @ to_keys, dim).reshape(len(unit), tables, per_key)
    keys = np.zeros((len(unit), tables), np.int64)
    for j in range(per_key):
        keys = keys * (2 * dim) + axes[:, :, j]
    turned = unit @ to_code
    turned /= math.sqrt(turned.shape[1] / dim)
    bits = turned >= 0
    factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / LEVELS, 1e-12)
    # the draw depends on the vector alone, so a task that is run again gives the same steps
    draw = np.stack([np.random.default_rng(np.frombuffer(row.tobytes(), np.uint32)).random(turned.shape[1]) for row in unit]) if len(unit) else turned
    steps = np.floor((turned - low) / step + draw).clip(0, LEVELS).astype(np.uint8)
    return {"keys": keys, "code": np.packbits(bits, axis=1), "factor": factor, "low": low[:, 0], "step": step[:, 0], "steps": _nibbles(steps)}


def _nibbles(steps: np.ndarray) -> np.ndarray:
    padded = np.pad(steps, ((0, 0), (0, steps.shape[1] % 2)))
    return padded[:, ::2] << 4 | padded[:, 1::2]


def _from_nibbles(raw: np.ndarray, n: int) -> np.ndarray:
    return np.stack([raw >> 4, raw & 15], 2).reshape(len(raw), -1)[:, :n]


def upper_bounds(code: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray, steps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of coded rows with stepped rows, and how far the truth may lie above them.

    The spread of the estimate has a part from the code, which the factor gives, and one from the random rounding.
    """
    signs = (np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(bits))
    values = _from_nibbles(steps, bits).astype(np.float32) * step[:, None].astype(np.float32) + low[:, None].astype(np.float32)
    estimate = (signs @ values.T) / factor[:, None].astype(np.float32)
    from_code = (1 - factor**2).clip(0) / factor**2 / max(bits - 1, 1)
    spread = np.sqrt(from_code[:, None] + (step**2 / 4)[None, :] / factor[:, None] ** 2)
    return estimate, Z * spread


def new_here(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Which pairs of rows share no bucket in a table before this one; ``a`` and ``b`` have the keys of all tables."""
    out = np.ones((len(a), len(b)), bool)
    for t in range(table):
        out &= a[:, t, None] != b[None, :, t]
    return out


def _matrix(column: pa.ChunkedArray, kind=None) -> np.ndarray:
    """A column of lists, or of binaries, of one length as a matrix."""
    if kind is not None:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def in_blocks(rows: DataFrame, bucket: list[str], most: int) -> DataFrame:
    """Rows dealt to ``(left, right)`` pairs of blocks of their bucket, with ``own``: the row's block.

    A bucket of up to ``most`` rows is one block, which meets itself; larger ones are cut by a hash of the id, and every
    two blocks meet once.
    """
    crowded = rows.groupBy(*bucket).agg(F.ceil(F.count("*") / most).cast("int").alias("_n")).filter("_n > 1")
    sized = rows.join(crowded, bucket, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("_n")).cast("int"))
    dealt = sized.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.withColumn("left", F.least("own", "_other")).withColumn("right", F.greatest("own", "_other")).drop("_n", "_other")
    # the join may have placed rows by bucket; groups of one bucket belong in different tasks
    return spread(dealt, [*bucket, "left", "right"])


def _sides(rows: pa.Table, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    own = rows.column("own").to_numpy()
    return np.flatnonzero(own == left), np.flatnonzero(own == right)


MEET = ["dim", "table", "key"]


def mark(index: DataFrame, cosine: float) -> DataFrame:
    """``(dim, table, key, id)`` of the classes that may have a link in a bucket, by codes alone."""
    rows = index.select("id", "dim", "keys", "code", "factor", "low", "step", "steps", F.posexplode("keys").alias("table", "key"))
    rows = in_blocks(rows, MEET, BLOCK)

    def look(key, part):
        dim, table, _, left, right = (k.as_py() for k in key)
        a, b = _sides(part, left, right)
        if part.num_rows > 1 and len(a) and len(b):
            bits = -(-BITS // dim) * dim
            keys, code, steps = _matrix(part.column("keys")), _matrix(part.column("code"), np.uint8), _matrix(part.column("steps"), np.uint8)
            factor, low, step = (part.column(c).to_numpy() for c in ("factor", "low", "step"))
            estimate, reach = upper_bounds(code[a], factor[a], low[b], step[b], steps[b], bits)
            near = estimate + reach >= cosine
            if left == right:
                np.fill_diagonal(near, False)
            if near.any():
                near &= new_here(keys[a], keys[b], table)
            marked = np.union1d(a[near.any(1)], b[near.any(0)])
        else:
            marked = np.zeros(0, int)
        return part.select([*MEET, "id"]).take(pa.array(marked))

    schema = "dim int, table int, key long, id struct<vec:long,code:long>"
    return rows.groupBy(*MEET, "left", "right").applyInArrow(look, schema).distinct()


def recompute(index: DataFrame, marked: DataFrame, cosine: float) -> DataFrame:
    """``(id, n, root)`` per group: vectors linked to the class, and the least class its links in the group lead to."""
    rows = marked.join(index.select("id", "keys", "vector", "copies"), "id")
    rows = in_blocks(rows, MEET, BLOCK)

    def look(key, part):
        _, table, _, left, right = (k.as_py() for k in key)
        a, b = _sides(part, left, right)
        n, root = np.zeros(part.num_rows, np.int64), np.arange(part.num_rows)
        if part.num_rows > 1 and len(a) and len(b):
            keys, unit, copies = _matrix(part.column("keys")), _unit(_matrix(part.column("vector")).astype(float)), part.column("copies").to_numpy()
            near = (unit[a] @ unit[b].T >= cosine) & new_here(keys[a], keys[b], table)
            if left == right:
                np.fill_diagonal(near, False)
                n[a] = near @ copies[b]
            else:
                n[a], n[b] = near @ copies[b], copies[a] @ near
            root = _least(near, a, b, _by_id(part))
        linked = np.flatnonzero(n)
        ids = part.column("id").combine_chunks()
        return pa.table({"id": ids.take(pa.array(linked)), "n": n[linked], "root": ids.take(pa.array(root[linked]))})

    schema = "id struct<vec:long,code:long>, n long, root struct<vec:long,code:long>"
    return rows.groupBy(*MEET, "left", "right").applyInArrow(look, schema)


def _by_id(part: pa.Table) -> np.ndarray:
    """Rows in the order of their ids."""
    ids = part.column("id").combine_chunks()
    vec, code = (ids.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return np.lexsort((code, vec))


def _least(near: np.ndarray, a: np.ndarray, b: np.ndarray, by_id: np.ndarray) -> np.ndarray:
    """The first row by id that each row reaches over the links between rows ``a`` and rows ``b``."""
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.arange(len(by_id))
    best, before = rank, None
    while before is None or (best != before).any():
        before, best = best, best.copy()
        best[a] = np.minimum(best[a], np.where(near, best[b][None, :], len(rank)).min(1))
        best[b] = np.minimum(best[b], np.where(near, best[a][:, None], len(rank)).min(0))
        best = np.minimum(best, best[by_id[best]])
    return by_id[best]


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


NO_ID = (1 << 63) - 1


def near_duplicate_vectors(rows: DataFrame, cosine: float = 0.9, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``rows`` with ``n_links`` (other vectors of that cosine or more, found by the index) and ``component_id``.

    ``component_id`` is the smallest id that links reach, the row's own included; ``kept`` tells whether it is the row's.
    Columns of these names are replaced. Every row is a vector of its own: rows that repeat an id count each other, and a
    row without id takes part (its own component is null unless links reach an id). Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and vectors of different lengths do not link. No link below
    the threshold is returned; a pair exactly at it is found with a chance of ``FOUND``, a closer one with a higher one.
    An empty table gives an empty result.
    """
    made = ["n_links", "component_id", "kept"]
    base = rows.drop(*made)
    x = F.col(vector)
    doubles = F.transform(x, lambda v: v.cast("double") + 0.0)
    good = base.filter(usable(x)).select(F.col(vec_id).cast("long").alias("_vec"), doubles.alias("vector"))
    classes = good.groupBy("vector").agg(F.min("_vec").alias("_vec"), F.count("*").alias("copies"))
    number = F.struct(F.coalesce("_vec", F.lit(NO_ID)).alias("vec"), F.xxhash64("vector", F.lit(SEED)).alias("code"))
    classes = cut(classes.select(number.alias("id"), F.size("vector").alias("dim"), "vector", "copies"), "vector-classes")
    n = classes.count()
    index = cut(classes.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(max(1, n // 4096))).alias("share")).applyInArrow(
        lambda key, part: _encoded(part, cosine, n),
        "id struct<vec:long,code:long>, dim int, vector array<double>, copies long, keys array<long>, code binary, factor double, low double, step double, steps binary",
    ), "vector-index")
    found = cut(recompute(index, cut(mark(index, cosine), "vector-marks"), cosine), "vector-links")
    counted = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = classes.join(counted, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("vector").alias("_class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.nullif(F.coalesce("root", "id")["vec"], F.lit(NO_ID)).alias("component_id"),
    )
    linked = base.filter(usable(x)).withColumn("_class", doubles).join(placed, "_class").drop("_class")
    alone = base.filter(~usable(x)).withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col(vec_id).cast("long")})
    return linked.unionByName(alone).withColumn("kept", F.col(vec_id).cast("long").eqNullSafe(F.col("component_id")))


def _encoded(part: pa.Table, cosine: float, n: int) -> pa.Table:
    made = encode(_matrix(part.column("vector")).astype(float), cosine, n)
    lists = lambda m, kind: pa.array(list(m), pa.list_(kind))
    raw = lambda m: pa.array([row.tobytes() for row in m], pa.binary())
    more = {"keys": lists(made["keys"], pa.int64()), "code": raw(made["code"])} | {k: pa.array(made[k]) for k in ("factor", "low", "step")} | {"steps": raw(made["steps"])}
    return pa.table({c: part.column(c) for c in ("id", "dim", "vector", "copies")} | more)
