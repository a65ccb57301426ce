"""Uniform shuffle into shards of exact size by a random communication matrix.

Permuting all rows uniformly and cutting the result into shards moves, from partition ``i`` to shard ``j``, a number of
rows that follows the multivariate hypergeometric law. So the numbers are drawn first: partitions are halved like a
tree, and at each node the rows that its left half sends to every shard are drawn given what the node sends. A leaf is
one partition with exact counts. Each partition is put in random order and dealt out by its counts, rows are exchanged
once, and each shard is put in random order again.

Only DataFrame functions are used. A draw inverts the distribution function, whose weights follow from each other by
exact ratios, over all values within 12 standard deviations (what lies outside has a chance below 1e-30).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.session import cut

RANK_BITS = 33  # monotonically_increasing_id() keeps the row's place in its partition in the low 33 bits


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _next_weight(k: Column, v: Column) -> Column:
    up = (v["mark"] - k).cast("double") * (v["need"] - k).cast("double")
    return up / ((k + 1).cast("double") * (v["rest"] - v["mark"] - v["need"] + k + 1).cast("double"))


def hypergeometric(rest: Column, mark: Column, need: Column, u: Column) -> Column:
    """Marked rows among ``need`` rows drawn from ``rest`` rows of which ``mark`` are marked, for a uniform ``u``."""
    share = F.when(rest > 0, mark / rest).otherwise(0.0)
    mean = need * share
    spread = F.sqrt(mean * (1 - share) * F.greatest(rest - need, F.lit(0)) / F.greatest(rest - 1, F.lit(1)))
    least, most = F.greatest(F.lit(0).cast("long"), need - rest + mark), F.least(mark, need)
    v = F.struct(
        rest.alias("rest"), mark.alias("mark"), need.alias("need"), u.alias("u"),
        F.greatest(least, F.floor(mean - 12 * spread - 10)).alias("lo"),
        F.least(most, F.ceil(mean + 12 * spread + 10)).alias("hi"),
    )

    def total(v: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(
            F.sequence(v["lo"], v["hi"]), start,
            lambda a, k: F.struct((a["w"] * _next_weight(k, v)).alias("w"), (a["sum"] + a["w"]).alias("sum")),
            lambda a: a["sum"],
        )

    def pick(v: Column, goal: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("passed"))
        passed = F.aggregate(
            F.sequence(v["lo"], v["hi"]), start,
            lambda a, k: F.struct(
                (a["w"] * _next_weight(k, v)).alias("w"), (a["sum"] + a["w"]).alias("sum"),
                (a["passed"] + F.when(a["sum"] + a["w"] <= goal, 1).otherwise(0)).cast("long").alias("passed"),
            ),
            lambda a: a["passed"],
        )
        return F.least(v["hi"], v["lo"] + passed)

    return _let(v, lambda v: _let(total(v) * v["u"], lambda goal: pick(v, goal)))


def _deal(node: Column, rows: Column, need: Column, quota: Column, seed: int) -> Column:
    """What the left half (``need`` of the node's ``rows``) sends to each shard, of the node's ``quota``."""
    start = F.struct(
        rows.cast("long").alias("rest"), need.cast("long").alias("need"), F.array().cast("array<bigint>").alias("out")
    )

    def step(a: Column, j: Column) -> Column:
        mark = quota[j]
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, j), 11) + 0.5) / F.lit(float(1 << 53))
        return _let(
            hypergeometric(a["rest"], mark, a["need"], u),
            lambda h: F.struct(
                (a["rest"] - mark).alias("rest"), (a["need"] - h).alias("need"),
                F.concat(a["out"], F.array(h)).alias("out"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(quota) - 1), start, step, lambda a: a["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(block, quota)``: the rows that each block sends to each shard, from ``sizes (block, rows)``.

    Blocks are small integers. Row sums are the blocks' rows; column sums differ by one at most.
    """
    top = sizes.agg(F.max("block"), F.sum("rows")).first()
    levels, n = max(0, int(top[0] or 0)).bit_length(), int(top[1] or 0)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    nodes = sizes.select("block", "rows", level.alias("level"))
    nodes = nodes.groupBy("level", F.expr(f"shiftright(block, {levels} - level)").alias("node")).agg(
        F.sum("rows").alias("rows")
    )
    share = [n // shards + (j < n % shards) for j in range(shards)]
    at = nodes.filter("level = 0").select("node", "rows", F.array(*(F.lit(x).cast("long") for x in share)).alias("quota"))
    for depth in range(1, levels + 1):
        child = nodes.filter(F.col("level") == depth).select(F.col("node").alias("child"), F.col("rows").alias("child_rows"))
        both = at.join(
            child.groupBy(F.expr("shiftright(child, 1)").alias("node")).agg(
                F.coalesce(F.sum(F.expr("IF(child % 2 = 0, child_rows, 0)")), F.lit(0)).alias("left_rows")
            ), "node",
        )
        left = _deal(F.xxhash64(F.lit(depth), "node"), F.col("rows"), F.col("left_rows"), F.col("quota"), seed)
        both = both.withColumn("left", left)
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left_rows").alias("rows"), F.col("left").alias("quota")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"), (F.col("rows") - F.col("left_rows")).alias("rows"),
                F.zip_with("quota", "left", lambda q, x: q - x).alias("quota"),
            ),
        )
        at = both.select(F.inline(halves)).filter("rows > 0")
    return at.select(F.col("node").alias("block"), "quota")


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 20_11, cell_rows: int = 1 << 13) -> DataFrame:
    """All rows of ``docs`` in uniform random order over ``shards`` shards whose sizes differ by one at most.

    Adds ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each shard); input columns of these names are
    replaced. Rows are never looked at, so nulls, empty and long texts and repeated rows are rows like any other; an
    empty table stays empty. A shard is ordered in cells of about ``cell_rows`` rows, so no task holds a shard.
    """
    whole = docs.drop("shard", "slot")
    drawn = whole.select(F.struct("*").alias("doc"), F.rand(seed).alias("draw"), F.rand(seed + 1).alias("again"))
    place = F.monotonically_increasing_id()
    rows = cut(drawn.sortWithinPartitions("draw").withColumn("place", place).drop("draw"), "shard-rows")
    rows = rows.withColumn("block", F.shiftright("place", RANK_BITS))
    sizes = cut(rows.groupBy("block").agg(F.count("*").alias("rows")), "shard-sizes")
    matrix = cut(communication_matrix(sizes, shards, seed), "shard-matrix")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    cells = max(1, -(-total // (shards * cell_rows)))

    # a block's rows in random order: the first quota[0] go to shard 0, the next quota[1] to shard 1, ...
    ends = F.transform("quota", lambda _, j: F.aggregate(F.slice("quota", F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    rank = F.col("place").bitwiseAND((1 << RANK_BITS) - 1)
    sent = rows.join(matrix.select("block", ends.alias("ends")), "block").select(
        "doc", "again", "place",
        F.size(F.filter("ends", lambda e: e <= rank)).alias("shard"),
        F.floor(F.col("again") * cells).alias("cell"),
    )
    in_order = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "cell").agg(F.count("*").alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before")
    )
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("again", "place"))
    out = sent.withColumn("nth", nth).join(offsets, ["shard", "cell"])
    return out.select("doc.*", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))
