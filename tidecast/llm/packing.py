"""Best-fit packing of token runs into sequences, repacked where a lower bound leaves a gap.

Documents become pieces of at most ``size`` tokens; a longer one is cut so that its first piece is the short one. Full
pieces are sequences. The rest is dealt by hash into partitions of bounded size, and each partition is packed by best-fit
decreasing. Dual feasible functions give a lower bound on the sequences that its pieces need. A partition that meets its
bound is certified and done; the pieces of the others are dealt anew among those partitions and packed again, and the
new packing is kept if it needs fewer sequences. That ends when all are certified, when a round brings nothing, or after
``rounds``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import slices
from tidecast.session import cut

SIZE = 1024
END_ID = 2
PART_PIECES = 1 << 15
CACHE_WORDS = 1 << 18
#: How the tokenizer splits a text before it merges bytes, and the string it treats as one special token.
#: Below are the letters, numbers and blanks of Latin-1, for which the standard expressions are faster.
SPLIT = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t-\\r\\x85\\xa0"
SPLIT_LATIN = (
    f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
SPECIAL = "<|endoftext|>"


#: The letter that stands for each byte in the tokenizer's vocabulary: itself if it can be seen, else one from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {**{b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SEEN)}, **{b: chr(b) for b in _SEEN}}


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Known(dict):
    """Ids by split; one that is not there is taken from the store before, or made."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes]):
        self.make, self.before = make, before

    def __missing__(self, split: str) -> bytes:
        got = self.before.get(split)
        self[split] = got = self.make(split) if got is None else got
        return got


class Encoder:
    """Token ids of texts, equal to the tokenizer's own, as little-endian unsigned 32-bit bytes.

    The tokenizer encodes each split of a text by itself, so a split's ids are kept and looked up when it comes again.
    When the store holds ``CACHE_WORDS`` splits a new one is begun; those that come again are taken over from the last.
    Splits are merged one by one on the task's own thread: a call over many keeps some hundred bytes a split, and its
    threads, beside the tasks that fill the cores, cost twice the time.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.split_any, self.split_latin = regex.compile(SPLIT).findall, re.compile(SPLIT_LATIN).findall
        self.known = Known(self.of_split, {})

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def plain(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of_split(self, split: str) -> bytes:
        return pack_ids([t.id for t in self.merge(split.encode().decode("latin-1").translate(LETTER))])

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.plain(text)
        if len(self.known) >= CACHE_WORDS:
            self.known.before = {}
            self.known = Known(self.of_split, self.known)
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(ids: bytes, size: int = SIZE) -> list[tuple[int, bytes]]:
    """``(start, ids)`` of the pieces of a document; a long one begins with what its full pieces leave over."""
    n = len(ids) // 4
    first = (n - 1) % size + 1
    cuts = [0, *range(first, n + 1, size)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]


def tokenize(
    docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
    end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)`` of every piece of every row of ``docs``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. ``ids`` (bytes, little-endian unsigned
    32-bit) are left out unless ``with_ids``.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    last = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer_path).encode
        for batch in batches:
            for part in slices(batch):
                found = [pieces_of(ids + last, size) for ids in to_ids(part.column("text").fill_null("").to_pylist())]
                flat = [p for own in found for p in own]
                owner = np.repeat(np.arange(len(found)), [len(own) for own in found])
                columns = [
                    part.column("doc_id").take(pa.array(owner)), pa.array([k for own in found for k in range(len(own))], pa.int32()),
                    pa.array([a for a, _ in flat], pa.int64()), pa.array([len(x) // 4 for _, x in flat], pa.int64()),
                    pa.array([zlib.crc32(x) for _, x in flat], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x for _, x in flat], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that pieces of these lengths need at least: the best of three families of dual feasible functions.

    Plain volume; the functions that drop pieces below a threshold and count those above ``size`` minus it as whole; and
    the rounding ones, by which a length counts ``floor((k + 1) x) / k`` sequences unless ``(k + 1) x`` is whole.
    """
    count = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    if not count.sum():
        return 0
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    volume = np.concatenate([[0], np.cumsum(count * x)])
    for least in range(1, size // 2 + 1):
        top = size - least + 1  # lengths from here on count as whole
        middle = int(volume[top] - volume[least])
        best = max(best, int(above[top]) + -(-middle // size))
    for k in range(1, 101):
        whole = ((k + 1) * x) % size == 0
        value = np.where(whole, x * k, ((k + 1) * x // size) * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((count * value).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, longest first into the fullest sequence that has room, and the sequences used."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # sequences by what is left in them
    open_rooms, used = 0, 0  # a bit for each room that has sequences
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fit = open_rooms >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, b = size, used
            used += 1
        bins[k], offsets[k] = b, size - left
        if left > n:
            room[left - n].append(b)
            open_rooms |= 1 << (left - n)
    return bins, offsets, used


def _pack_parts(pieces: DataFrame, size: int) -> DataFrame:
    """Pack each ``part`` of ``pieces (key, length, part)``: adds ``bin``, ``offset``, the part's ``bins`` and its ``bound``."""

    def one(rows):
        rows = rows.sort_by([("length", "descending"), ("key", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, size)
        n, bound = len(lengths), lower_bound(lengths, size)
        return pa.table({
            "key": rows.column("key"), "length": rows.column("length"), "part": rows.column("part"), "bin": bins, "offset": offsets,
            "bins": np.full(n, used), "bound": np.full(n, bound),
        })

    schema = "key long, length long, part long, bin long, offset long, bins long, bound long"
    return pieces.select("key", "length", "part").groupBy("part").applyInArrow(one, schema)


def _needed(packed: DataFrame) -> tuple[int, int, int]:
    """Parts, sequences and bound, summed over the parts of a packing."""
    parts = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
    return tuple(int(x or 0) for x in parts.agg(F.count("*"), F.sum("bins"), F.sum("bound")).first())


def pack(pieces: DataFrame, *, size: int = SIZE, part_pieces: int = PART_PIECES, rounds: int = 4) -> DataFrame:
    """``(key, sequence_id, offset, certified)`` for ``pieces (key, length)`` with distinct integer keys and lengths 1 to ``size``.

    A part has about ``part_pieces`` pieces whatever the input. ``certified`` tells that the piece's part needs no fewer
    sequences. An empty input gives an empty packing. Pieces of equal length are placed in the order of their keys; keys
    that repeat are not told apart, so ``pack_documents`` numbers its pieces itself.
    """
    full = pieces.filter(F.col("length") >= size).select(
        "key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    rest = pieces.filter(F.col("length") < size)
    parts = max(1, -(-rest.count() // part_pieces))
    deal = lambda df, n, k: df.withColumn("part", F.pmod(F.xxhash64(F.lit(k), "key"), F.lit(n)))
    packed = cut(_pack_parts(deal(rest, parts, 0), size), "packed")
    done, at, turn = [(0, packed.filter("bins = bound"))], packed.filter("bins > bound"), 0
    open_parts, used, bound = _needed(at)
    for k in range(1, rounds + 1):
        if open_parts < 2 or used <= bound:
            break
        again = cut(_pack_parts(deal(at, open_parts, k), size), "packed")
        if _needed(again)[1] >= used:
            break
        turn, at = k, again.filter("bins > bound")
        done.append((k, again.filter("bins = bound")))
        open_parts, used, bound = _needed(at)
    out = full
    for k, rows in [*done, (turn, at)]:
        name = F.shiftleft((F.lit(k) * parts + F.col("part")).cast("long"), 32) + F.col("bin")
        out = out.unionByName(rows.select("key", name.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, size: int = SIZE, with_ids: bool = False, **options) -> DataFrame:
    """Pieces of all rows of ``docs`` with ``sequence_id`` (long), ``offset`` and ``certified``."""
    made = tokenize(docs, tokenizer_path, size=size, with_ids=with_ids)
    pieces = cut(made.withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("key", "length"), size=size, **options)
    return pieces.join(placed, "key").drop("key")
