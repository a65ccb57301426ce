"""Draw the documents whose words look most like a target corpus, by importance weights over hashed n-grams.

``A``-``Z`` count as ``a``-``z``; a word is a run of bytes that are digits, lower-case letters or beyond ASCII. Features
are all runs of 1 to ``n`` consecutive words, joined by one space, repeats counted; the bucket of a feature is the crc32
of its UTF-8 bytes modulo ``buckets``. A bucket's gain compares its smoothed share of the target with that of the
documents, in thousandths of a natural logarithm; a document's weight is the floored mean gain of its features. Gumbel
noise, fixed by seed and id, makes the highest sums of weight and noise a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.session import cut

#: Lowers A-Z, keeps digits, a-z and bytes beyond ASCII, and blanks all other bytes; it is the same for every byte of a
#: character beyond ASCII, so UTF-8 stays whole.
KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
TABLE = bytes(c if c in KEPT else 0x20 for c in bytes(range(256)).lower())
PIECE = 1 << 20


def word_runs(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text in order, in lists of about ``piece`` bytes; no word is split."""
    flat, at = raw.translate(TABLE), 0
    while at < len(flat):
        end = flat.find(b" ", at + piece)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def feature_codes(raw: bytes, n: int, piece: int = PIECE) -> Iterator[tuple[int, list[int]]]:
    """crc32 of the features of a text, run length by run length and piece by piece.

    The crc32 of a longer run goes on from that of the run without its last word. The last ``n - 1`` words of a piece are
    carried into the next one, where they only begin runs.
    """
    carried: list[bytes] = []
    for words in word_runs(raw, piece):
        words = carried + words
        spaced, codes = [b" " + w for w in words], list(map(zlib.crc32, words))
        for size in range(1, n + 1):
            yield size, codes[max(0, len(carried) - size + 1) :]
            codes = list(map(zlib.crc32, spaced[size:], codes))
        carried = words[len(words) - n + 1 :] if len(words) >= n else words


def _texts(column: pa.Array) -> list[bytes]:
    return [raw or b"" for raw in column.cast(pa.binary()).to_pylist()]


def bucket_counts(rows: DataFrame, text: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features per bucket over all rows: a counter per task, added up by a shuffle; ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for raw in _texts(batch.column(0)):
                for _, codes in feature_codes(raw, n):
                    found.update((np.array(codes, np.int64) % buckets).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(found.keys()), pa.int64()), "found": pa.array(list(found.values()), pa.int64())})

    out = np.zeros(buckets, np.int64)
    for row in rows.select(text).mapInArrow(count, "bucket long, found long").groupBy("bucket").agg(F.sum("found").alias("found")).collect():
        out[row["bucket"]] = row["found"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths, with one more feature in each bucket of either side."""
    s, t, k = float(own.sum()), float(target.sum()), len(own)
    each = zip(own.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in each], np.int64)


def weigh(text: Column, gain: np.ndarray, n: int = 2) -> Column:
    """``struct(n_words, n_features, weight)`` of a text; null and wordless texts have zeros."""
    buckets = len(gain)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def measure(column: pa.Array) -> pa.Array:
        rows = []
        for raw in _texts(column):
            words = features = total = 0
            for size, codes in feature_codes(raw, n):
                words += len(codes) * (size == 1)
                features += len(codes)
                total += int(gain[np.array(codes, np.int64) % buckets].sum())
            rows.append((words, features, total // features if features else 0))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_features", "weight"])

    return measure(text)


def noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, floored, from the sha256 of ``seed:id`` (null id: nothing after the colon)."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    carry: list[str] | None = None, n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """The ``carry`` columns of every row (default: all) with ``n_words, n_features, weight, score, rank``.

    ``rank`` counts the drawn documents from 1 by falling score, ties to the smaller id (then weight and features); it is
    null for the others. Drawn are ``percent`` of the documents with ``least_words`` words or more, rounded down. Columns
    of ``docs`` with the five names are replaced. Null texts, and texts without words, have no features and weight 0;
    a null id sorts first; repeated rows are documents of their own; empty tables give an empty result, and an empty
    target gives gains from smoothing alone. Texts of any length are taken in pieces.

    Scores take at most some 10^5 values (their parts are logarithms in thousandths of 64-bit counts), so the table of
    rows per score is bounded, and the rows of one score are at most the share of the noise at its mode, 1 in 2,700.
    """
    made = ["n_words", "n_features", "weight", "score", "rank"]
    kept = [c for c in (carry or docs.columns) if c not in made]
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    rows = docs.select(*kept, F.col(doc_id).alias("_id"), weigh(F.col(text), gain, n).alias("_m"))
    rows = rows.select(*kept, "_id", "_m.*").withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    rows = cut(rows, "weighed")
    able = F.col("n_words") >= least_words
    draw = rows.filter(able).count() * percent // 100
    levels = rows.filter(able).groupBy("score").agg(F.count("*").alias("_rows"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(F.col("score").alias("_level"), F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_above"))
    placed = rows.join(F.broadcast(levels), able & (F.col("score") == F.col("_level")), "left")
    near = F.coalesce(F.col("_above") < draw, F.lit(False))
    nth = F.row_number().over(Window.partitionBy("score").orderBy("_id", "weight", "n_features"))
    rank = (F.col("_above") + nth).cast("long")
    drawn = placed.filter(near).withColumn("rank", F.when(rank <= draw, rank))
    rest = placed.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*kept, *made)
