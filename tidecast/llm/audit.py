"""How quality filters interact: what every order of them removes at every step, by part of the corpus.

Whatever the order, what happens to a row depends only on the set of filters that it fails, its mask. Every mask is mapped
to an integer of one 64-bit field per (order, step), which holds 1 where the outcome is met. Multiplied by the rows of the
mask and added up over the masks of a part, the fields count all steps of all orders at once; a field cannot run over,
because no count exceeds the rows of the part.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELD = 8
#: Outcomes of a row at a step of an order.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


@lru_cache(maxsize=4)
def steps(letters: str) -> list[tuple[str, int, str]]:
    """``(order, step, filter)`` of every field."""
    return [("".join(p), k + 1, p[k]) for p in permutations(letters) for k in range(len(p))]


@lru_cache(maxsize=4)
def packed(letters: str) -> dict[str, list[int]]:
    """For each outcome, the integer of every mask; bit ``i`` of a mask: the row fails ``letters[i]``."""
    at = {letter: i for i, letter in enumerate(letters)}
    out: dict[str, list[int]] = {o: [] for o in OUTCOMES}
    for mask in range(1 << len(letters)):
        fields = np.zeros((len(OUTCOMES), len(steps(letters))), "<u8")
        for j, (order, step, letter) in enumerate(steps(letters)):
            fails = mask >> at[letter] & 1
            gone = any(mask >> at[x] & 1 for x in order[: step - 1])
            fields[:, j] = not (gone or fails), fails and not gone, fails and gone, mask == 1 << at[letter]
        for o, row in zip(OUTCOMES, fields):
            out[o].append(int.from_bytes(row.tobytes(), "little"))
    return out


def unpack(total: int, n: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(n * FIELD, "little"), "<u8").astype(np.int64)


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Outcomes of all orders of the filters ``letters``, from ``counts (part, mask, n, good, toxic)``.

    One row per part, ``filter_order`` and ``step``, zeros included, with its ``filter`` and the columns ``OUTCOMES``,
    ``good_lost`` and ``toxic_lost`` (of the rows removed here) and ``shapley`` (what the step's filter removes, summed
    over all orders). Counts may come in any number of rows per part and mask; they are added up before they meet.
    Without rows there are no parts.
    """
    n_fields = len(steps(letters))
    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in [*OUTCOMES, "good_lost", "toxic_lost", "shapley"])

    def add(key, rows):
        masks, table = rows.column("mask").to_pylist(), packed(letters)
        sums = {o: sum(n * table[o][m] for m, n in zip(masks, rows.column("n").to_pylist())) for o in OUTCOMES}
        sums |= {f"{c}_lost": sum(n * table["removed"][m] for m, n in zip(masks, rows.column(c).to_pylist())) for c in ("good", "toxic")}
        out = {name: unpack(total, n_fields) for name, total in sums.items()}
        order, step, letter = map(np.array, zip(*steps(letters)))
        out["shapley"] = np.zeros(n_fields, np.int64)
        for x in letters:
            out["shapley"][letter == x] = out["removed"][letter == x].sum()
        head = {"part": pa.array([key[0].as_py()] * n_fields, pa.string()), "filter_order": pa.array(order), "step": pa.array(step, pa.int32()), "filter": pa.array(letter)}
        return pa.table(head | {name: pa.array(v, pa.int64()) for name, v in out.items()})

    by_mask = counts.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))
    return by_mask.groupBy("part").applyInArrow(add, schema)


UPPER, ODD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
TAILS = bytes(range(0x80, 0xC0))
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _count_words(raw: bytes) -> tuple[int, int]:
    """Words between space and ``\\x09``-``\\x0D``, all and distinct; long texts are split a piece at a time."""
    if len(raw) <= PIECE:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        # a piece ends before a blank, so no word is split
        blank = BLANK.search(raw, at + PIECE)
        end = blank.start() if blank else len(raw)
        words = raw[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_faults(raw: bytes) -> int:
    """Bits for filters A to D: under 200 words; under half of them distinct; over 2 % capitals; any odd sign."""
    n, distinct = _count_words(raw)
    capitals = len(raw) - len(raw.translate(None, UPPER))
    points = len(raw.translate(None, TAILS))
    odd = len(raw.translate(None, ODD)) < len(raw)
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | odd << 3


def faults_and_digest(text: Column) -> Column:
    """``struct(faults, digest)``: the bits of ``text_faults`` and the sha256 of a text (null: of an empty one)."""

    @F.arrow_udf("faults int, digest binary")
    def look(column: pa.Array) -> pa.Array:
        texts = [raw or b"" for raw in column.cast(pa.binary()).to_pylist()]
        bits = pa.array([text_faults(raw) for raw in texts], pa.int32())
        return pa.StructArray.from_arrays([bits, pa.array([hashlib.sha256(raw).digest() for raw in texts], pa.binary())], ["faults", "digest"])

    return look(text)


#: Five filters: those of ``text_faults``, and E: the text has been seen under a smaller id.
LETTERS = "ABCDE"


def count_masks(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``(part, mask, n, good, toxic)`` of the documents under the five filters.

    Rows are counted before each shuffle, and texts only leave their task as digests, so copies, however many, arrive as
    a few counted rows per part. Null texts are empty, a null part is the empty string. A null id is no smaller than any,
    none is smaller, and it has no label. Rows that repeat an id and its text are not copies of each other. A document
    is good (toxic) if any label row of its id says so.
    """
    seen = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), faults_and_digest(F.col(text)).alias("t"))
    seen = seen.groupBy("id", "part", "t.faults", "t.digest").agg(F.count("*").alias("n"))
    marked = labels.groupBy(F.col(doc_id).alias("label_id")).agg(
        *(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in ((quality, "good"), (toxic, "toxic")))
    )
    flagged = seen.join(marked, F.col("id") == F.col("label_id"), "left").na.fill(0, ["good", "toxic"])
    grouped = flagged.groupBy("digest", "faults", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.col("n_null") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    parted = grouped.withColumn("least", least).withColumn("own", own)
    copy = 1 << LETTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("faults").alias("mask"), F.col("own").alias("n")), F.struct((F.col("faults") + copy).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    rows = parted.select("part", "good", "toxic", both.alias("m")).select("part", "m.mask", "m.n", (F.col("m.n") * F.col("good")).alias("good"), (F.col("m.n") * F.col("toxic")).alias("toxic"))
    return rows.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """All orders of the five filters over ``docs``; see ``count_masks`` for odd rows and ``interactions`` for columns."""
    return interactions(count_masks(docs, labels, **columns), LETTERS)
