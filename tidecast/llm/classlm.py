"""Language model over word classes: exchange clustering, class trigrams and word emissions.

Words are bytes outside blanks with A-Z lowered; each text ends with one end token. Every training word is in one of
``CLASSES`` classes such that class bigrams predict best; the end is a class of its own, and so is an unseen word as a
history. The ``CLUSTERED`` most frequent words are dealt first, one by one on the driver; all others then go to the class
that raises the likelihood most, and sweeps over all words follow until the likelihood settles. In every sweep the most
frequent words are dealt again, one by one, by their counts beside all other words; of the others half move at a time,
because neighbours that move at once change places for ever.

Neither the vocabulary nor its counts meet in one place. Words lie in buckets by hash, texts as word numbers in blocks of
bounded size. A bucket keeps how often each of its words stands before and after each class. In a sweep it moves its words
and tells the blocks that hold them; these tell the buckets of the neighbours by how much their counts change, and each
bucket adds the changes up. So after the first sweeps only what moved is sent. What a sweep replaces is deleted. Only the
class table is broadcast. Words move by the same table, so the new likelihood is computed before a sweep counts; one that
lowers it is undone, and fewer words move at a time.

The probability of a token is that of its class after the two classes before, times that of the word in its class. Each
class keeps room for one unseen word, as the unigram base does, and an unseen word has the sum of these rooms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.tables import dense_chunks, dense_sum
from tidecast.llm.words import mix, slices, text_bytes, word_hashes
from tidecast.session import cut, cut_by, discard, discard_by, sweep_up

CLUSTERED, CLASSES, SWEEPS = 1022, 64, 8  # the first words and their sweeps only give the start
SETTLED = 1e-4  # natural log-likelihood per token that a sweep must gain
DAMPING, MOST_DAMPING = 2, 64  # one in so many words may move in a sweep
BLOCK_BYTES = 16 << 20
PRIOR = 20.0  # weight of the shorter history, in observations


#: Rows of all steps: arrays of a bucket of words, of a block of texts, or of both.
PACKED = "bucket long, block long, a binary, b binary, c binary"
COUNTED = f"{PACKED}, d binary, e binary, f binary"  # a state with the counts of its words
TABLE, TEXT, STATE, MOVED = -1, -2, -1, -2  # as a bucket; as a block
DENSE = 1 << 24  # cells of a table that a task may hold
MAY = np.uint16(1 << 15)  # beside the class of a word that may move


def _row(bucket: int, block: int, *arrays: np.ndarray) -> tuple:
    return (bucket, block, *(x.tobytes() for x in arrays), *[None] * (3 - len(arrays)))


def _packed(rows: list[tuple], schema: str = PACKED) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names)


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned integers that hold them, whose width is put before them."""
    most = int(x.max()) if len(x) else 0
    if 1 << 16 <= most < 1 << 24:
        return np.concatenate([np.array([3], np.uint8), _three(x)])
    kind = np.min_scalar_type(most)
    return np.concatenate([np.array([kind.itemsize], np.uint8), x.astype(kind).view(np.uint8)])


def _three(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).reshape(-1)


def _from_three(raw: np.ndarray) -> np.ndarray:
    full = np.zeros((len(raw) // 3, 4), np.uint8)
    full[:, :3] = raw.reshape(-1, 3)
    return full.reshape(-1).view("<u4")


def _narrow(raw: bytes) -> np.ndarray:
    if raw[0] == 3:
        return _from_three(np.frombuffer(raw, np.uint8, offset=1))
    return np.frombuffer(raw, f"u{raw[0]}", offset=1)


def _wide(raw: bytes) -> np.ndarray:
    return _narrow(raw).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    """Like ``_small``, for numbers of both signs."""
    return _small((x << 1) ^ (x >> 63))


def _unsigned(raw: bytes) -> np.ndarray:
    x = _wide(raw)
    return (x >> 1) ^ -(x & 1)


def _summed(code: np.ndarray, n: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Each code (below ``cells``) once, in order, with the sum of its ``n``; sums of 0 are left out."""
    if cells <= DENSE and cells < 64 * len(code):
        dense = np.bincount(code, n, cells)
        code = np.flatnonzero(dense)
        return code, dense[code].astype(np.int64)
    order = np.argsort(code)
    code, n = code[order], n[order]
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    total = np.add.reduceat(n, begin, dtype=np.int64) if len(code) else n.astype(np.int64)
    some = total != 0
    return code[begin][some], total[some]


def _int_for(cells: int) -> type:
    """The type of codes below ``cells``: half as wide where that will do, as sorting them is what takes the memory."""
    return np.int32 if cells < 1 << 31 else np.int64


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket of each word; it does not fall where hashes rise."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _count_block(block: int, buckets: int, pieces: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    """Rows of ``block_counts`` for texts given as ``(hashes, where texts begin, held_out)``, and the number of every word."""
    coded = pa.chunked_array([pa.concat_arrays([pa.array(own, pa.uint64()) for own, _, _ in pieces])]).combine_chunks().dictionary_encode()
    known, number = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in (coded.dictionary, coded.indices))
    order = np.argsort(known)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    known, number = known[order], rank[number]
    n, codes, total, begin = len(known) + 1, [], np.zeros(len(known), np.int64), 0
    for own, at, held in pieces:
        now, one, _, where, inside = _sequence(number[begin : begin + len(own)], at, n - 1)
        learned = np.repeat(~held, np.diff(where))
        total += np.bincount(now[inside & learned], minlength=len(known))
        counted = pa.array(one[learned] * n + now[learned]).value_counts()
        codes.append([counted.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        begin += len(own)
    code, many = _summed(*(np.concatenate([x[k] for x in codes]) for k in (0, 1)), n * n)
    out = [_row(TABLE, block, np.bincount(code // n, minlength=n).astype(np.int32), _small(code % n), _small(many))]
    home = bucket_of(known, buckets)
    for b in np.unique(home).tolist():
        i, j = np.searchsorted(home, [b, b + 1])
        out.append(_row(b, block, known[i:j], _small(total[i:j]), np.array([i])))
    return out, number


def block_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """Per ``block`` of ``rows`` its distinct words by bucket (``a``) with their training counts (``b``, 0 included) and how
    many of its words are in buckets before (``c``), and as bucket ``TABLE`` its training bigrams: how many each word has
    (``a``), the words after it (``b``) and counts (``c``).

    In bigrams words are numbered in order of their hash, and the end comes last.
    """

    def count(key, part):
        pieces = [_piece(piece) for batch in part.to_batches() for piece in slices(batch)]
        return _packed(_count_block(key[0].as_py(), buckets, pieces)[0])

    return rows.select("block", "held_out", "text").groupBy("block").applyInArrow(count, PACKED)


def _piece(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *word_hashes(part.column("text")), np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)


def encode(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``block_counts`` for blocks of neighbours in ``docs`` (``doc_id``, ``held_out``, ``text``) whose texts hold
    about ``block_bytes``, and as bucket ``TEXT`` a row per text: the numbers (``a``, as in bigrams) of its ``n`` words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, pieces, ids = TaskContext.get().partitionId() << 32, 0, [], []

        def rows() -> Iterator[pa.RecordBatch]:
            out, number = _count_block(block, buckets, pieces)
            table, rest = _packed(out), len(out)
            names = [*table.schema.names, "n", "held_out", "doc_id"]
            none = [pa.nulls(rest, t) for t in (pa.int64(), pa.bool_(), ids[0].type)]
            yield from pa.table([*table.columns, *none], names).to_batches()
            begin, small = 0, number.max(initial=0) < 1 << 24
            for (own, at, held_out), doc_id in zip(pieces, ids):
                mine = number[begin : begin + len(own)]
                raw, width = (_three(mine), 3) if small else (mine.view(np.uint8), 4)
                words = pa.Array.from_buffers(pa.binary(), len(doc_id), [None, pa.py_buffer((width * at).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                begin += len(own)
                k, none = len(doc_id), pa.nulls(len(doc_id), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, TEXT)), pa.array(np.full(k, block)), words, none, none, pa.array(np.diff(at)), pa.array(held_out), doc_id], names)

        for batch in batches:
            for part in slices(batch):
                pieces.append(_piece(part))
                ids.append(part.column("doc_id"))
                held += part.column("text").nbytes
                if held >= block_bytes:
                    yield from rows()
                    block, held, pieces, ids = block + 1, 0, [], []
        if pieces:
            yield from rows()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"{PACKED}, n long, held_out boolean, doc_id {kind}")


def bucket_words(counted: DataFrame) -> DataFrame:
    """Per bucket its training words, totals and classes (0) as block ``STATE``; per block, where its words are (-1: not
    learned from) and how many are in buckets before."""

    def gather(key, part):
        lists = [np.frombuffer(x, np.uint64) for x in part.column("a").to_pylist()]
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, np.concatenate([_wide(x) for x in part.column("b").to_pylist()]), len(words)).astype(np.int64)
        spot = np.where(total > 0, np.cumsum(total > 0) - 1, -1).astype(np.int32)
        bucket = key[0].as_py()
        out = [_row(bucket, STATE, words[total > 0], total[total > 0], np.zeros(int((total > 0).sum()), np.uint16))]
        begin = np.cumsum([0, *map(len, lists)])
        for k, (block, before) in enumerate(zip(part.column("block").to_pylist(), part.column("c").to_pylist())):
            out.append(_row(bucket, block, spot[at[begin[k] : begin[k + 1]]], np.frombuffer(before, np.int64)))
        return _packed(out)

    return counted.filter(F.col("bucket") >= 0).groupBy("bucket").applyInArrow(gather, PACKED)


def _state(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = part.filter(pc.equal(part.column("block"), STATE)).to_pylist()[0]
    return np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.int64), np.frombuffer(row["c"], np.uint16)


def start(state: DataFrame, known: np.ndarray, names: np.ndarray, other: int) -> DataFrame:
    """``state`` with the classes ``names`` of the words ``known``, and ``other`` for the rest."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b"))):
                words = np.frombuffer(a, np.uint64)
                mine = np.full(len(words), other, np.uint16)
                if len(known) and len(words):
                    spot = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    mine = np.where(known[spot] == words, names[spot], other).astype(np.uint16)
                out.append(_row(bucket, STATE, words, np.frombuffer(b, np.int64), mine))
            yield from _packed(out).to_batches()

    return state.mapInArrow(put, PACKED)


def may_move(words: np.ndarray, mine: np.ndarray, classes: int, turn: int, damping: int) -> np.ndarray:
    """Words that may move in a turn: those without a class, and of the others one in ``damping``, others in each turn."""
    return (mine >= classes) | (mix(words ^ mix(np.full(len(words), turn + 1, np.uint64))) % np.uint64(damping) == 0)


def send(spots: DataFrame, state: DataFrame, classes: int = 0, turn: int = 0, damping: int = 1, other: int | None = None) -> DataFrame:
    """To every block the classes of its own words: spots and classes (with ``MAY`` if the word may move in this turn), or,
    with ``other``, totals and classes; a word not learned from has no total and the class ``other``."""

    def give(key, part):
        own, total, mine = _state(part)
        if other is None:
            mine = np.append(mine | np.where(may_move(own, mine, classes, turn, damping), MAY, np.uint16(0)), np.uint16(0))
        else:
            mine, total = np.append(mine, np.uint16(other)), np.append(total, 0)
        out = []
        for block, a in zip(*(part.column(c).to_pylist() for c in ("block", "a"))):
            if block != STATE:
                spot = np.frombuffer(a, np.int32)
                out.append(_row(key[0].as_py(), block, spot if other is None else _small(total[spot]), mine[spot]))
        return _packed(out)

    return spots.unionByName(state).groupBy("bucket").applyInArrow(give, PACKED)


def neighbours(sent: DataFrame, bigrams: DataFrame, size: int) -> DataFrame:
    """Per block and bucket how often those of its words that may move (``a`` entries each) stand before (code ``c``), after
    (``size + c``) class ``c`` or after themselves (``2 * size``; left out of the others); as bucket ``TABLE`` the class
    bigrams. ``bigrams`` may hold other rows."""
    width = 2 * size + 1

    def count(key, left, right):
        block, lists = key[0].as_py(), sorted(right.to_pylist(), key=lambda r: r["bucket"])
        bigram = left.filter(pc.equal(left.column("bucket"), TABLE)).to_pylist()[0]
        lefts, many = np.frombuffer(bigram["a"], np.int32), _narrow(bigram["c"])
        n = len(lefts) - 1
        kind = _int_for((n + 1) * width)
        left, right = np.repeat(np.arange(n + 1, dtype=kind), lefts), _narrow(bigram["b"]).astype(kind)
        mine = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r["b"], np.uint16) for r in lists), np.array([size - 1], np.uint16)])
        may, mine = (mine & MAY) != 0, (mine & ~MAY).astype(kind)  # the end does not move
        table = np.bincount(mine[left] * size + mine[right], many, size * size).astype(np.int64)
        out = [_row(TABLE, block, table)]
        apart, code, k = left != right, [], []
        for side, (word, beside) in enumerate(((left, right), (right, left))):
            at = np.flatnonzero(may[word] & apart)
            code.append(word[at] * width + side * size + mine[beside[at]])
            k.append(many[at])
        at = np.flatnonzero(may[left] & ~apart)
        code, k = [*code, left[at] * width + 2 * size], [*k, many[at]]
        del left, right, apart, at
        code, k = _summed(np.concatenate(code), np.concatenate(k), n * width)
        begin = 0
        for r in lists:
            spot = np.frombuffer(r["a"], np.int32)
            i, j = np.searchsorted(code, [begin * width, (begin + len(spot)) * width])
            each = np.bincount(code[i:j] // width - begin, minlength=len(spot))
            live = each > 0
            entry = np.concatenate([spot[live].astype(np.int32), each[live].astype(np.int32)])
            out.append(_row(r["bucket"], block, entry, _small(code[i:j] % width), _small(k[i:j])))
            begin += len(spot)
        return _packed(out)

    return bigrams.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(count, PACKED)


def class_table(counted: DataFrame, size: int) -> np.ndarray:
    """Class bigrams of all blocks, added up in a few tasks first."""

    def add(key, part):
        return _packed([_row(TABLE, 0, sum(np.frombuffer(x, np.int64) for x in part.column("a").to_pylist()))])

    few = counted.filter(F.col("bucket") == TABLE).groupBy(F.pmod("block", F.lit(16))).applyInArrow(add, PACKED).collect()
    return sum((np.frombuffer(r["a"], np.int64) for r in few), np.zeros(size * size, np.int64)).reshape(size, size).astype(float)


FEW = 48  # counts whose terms are looked up


def steps_of(b: np.ndarray, classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For ``gains``, by side: what a count below ``FEW`` adds, by count, class of the neighbour and class of the word."""
    some, out = np.arange(FEW)[:, None, None], []
    for t in (b, b.T):
        rows = np.ascontiguousarray(t[:classes].T)
        out.append(((_f(rows + some) - _f(rows)).reshape(-1, classes), rows))
    return out


def gains(b: np.ndarray, right: tuple, left: tuple, own: np.ndarray, old: np.ndarray, classes: int, steps: list | None = None) -> np.ndarray:
    """Likelihood (up to a term of the word) with each word in each class, all other words where they are.

    ``b`` has the class bigrams with every word in its class ``old``; ``right`` and ``left`` are ``(word, class, count)``
    of the tokens after and before, themselves (``own``) left out, by word and class.
    """
    m, size = len(old), len(b)
    out, c, w = np.zeros((m, classes)), np.arange(classes), np.arange(m)
    stay, mine, totals = np.zeros(m), [], []  # per side: how often each word stands beside its own class, and at all
    for t, (word, at, n), (step, rows) in zip((b, b.T), (right, left), steps or steps_of(b, classes)):
        n = np.asarray(n)
        more = step[np.minimum(n, FEW - 1) * size + at]
        large = np.flatnonzero(n >= FEW)
        if len(large):
            here = rows[at[large]]
            more[large] = _f(here + n[large, None]) - _f(here)
        if len(word):
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[begin]] += np.add.reduceat(more, begin, axis=0)
        before, same = t[old[word], at], at == old[word]
        stay += np.bincount(word, np.where(same, 0, _f(before) - _f(before - n)), m)
        mine.append(np.bincount(word, n * same, m))
        totals.append(np.bincount(word, n, m))
    sides = [np.zeros((m, size)) for _ in range(2)]
    for full, (word, at, n) in zip(sides, (right, left)):
        full[word, at] = n
    r, l = sides
    for t, x, y in ((b, mine[0], l), (b.T, mine[1], r)):  # the word itself is not in the cells of its old class
        hot = np.flatnonzero(x)  # for others the terms cancel
        cell, less, x = t[:classes][:, old[hot]].T, y[hot, :classes], x[hot, None]
        out[hot] += _f(cell - less + x) - _f(cell - less) - _f(cell + x) + _f(cell)
    corner = b[c, c]
    i, j = np.nonzero((r[:, :classes] > 0) & (l[:, :classes] > 0) | (own[:, None] > 0))
    here, x, y = corner[j], r[i, j], l[i, j]
    out[i, j] += _f(here + x + y + own[i]) - _f(here + x) - _f(here + y) + _f(here)
    for n, margin in zip((totals[0] + own, totals[1] + own), (b.sum(1), b.sum(0))):
        kinds, at = np.unique(n, return_inverse=True)
        out -= (_f(margin[:classes] + kinds[:, None]) - _f(margin[:classes]))[at]
        stay -= _f(margin[old]) - _f(margin[old] - n)
    cell = b[old, old]
    stay += _f(cell) - _f(cell - mine[0] - mine[1] - own)
    at_home = old < classes
    out[w[at_home], old[at_home]] = stay[at_home]
    return out


def _places(known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``words`` are among ``known`` (in order), and their places there."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    mine = np.flatnonzero(known[at] == words)
    return mine, at[mine]


def move(state: DataFrame, b: np.ndarray, classes: int, turn: int, damping: int, dealt: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Words of a bucket that go to another class in this turn, as block ``MOVED``: spots (``a``), new (``b``) and old classes.

    Only words of ``may_move`` are looked at; ``state`` has their counts. ``dealt`` are words, in order, that go to given
    classes; ``b`` has them there.
    """
    size = len(b)
    table = state.sparkSession.sparkContext.broadcast(b)
    given, classes_given = dealt or (np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    width = 2 * size + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = steps_of(table.value, classes)
        for row in (r for batch in batches for r in _rows(batch)):
            words, mine = np.frombuffer(row["a"], np.uint64), np.frombuffer(row["c"], np.uint16)
            may, new = may_move(words, mine, classes, turn, damping), mine.copy()
            here, at = _places(given, words)
            may[here], new[here] = False, classes_given[at]
            some = np.flatnonzero(may)
            each, code, count = (_wide(row[c]) for c in ("d", "e", "f"))
            first = np.cumsum(np.concatenate([[0], each]))
            for i in range(0, len(some), 512):
                at = some[i : i + 512]
                sizes = each[at]
                begin = np.cumsum(sizes) - sizes
                take = np.arange(sizes.sum()) + np.repeat(first[at] - begin, sizes)
                word, kind, n = np.repeat(np.arange(len(at)), sizes), code[take], count[take]
                own = np.zeros(len(at))
                own[word[kind == 2 * size]] = n[kind == 2 * size]
                after, before = kind < size, (kind >= size) & (kind < 2 * size)
                old = mine[at].astype(np.int64)
                score = gains(table.value, (word[after], kind[after], n[after]), (word[before], kind[before] - size, n[before]), own, old, classes, steps)
                best = score.argmax(1)
                w = np.arange(len(at))
                better = (old >= classes) | (score[w, best] > score[w, np.minimum(old, classes - 1)] + 1e-6)
                new[at] = np.where(better & (best != old), best, old)
            gone = np.flatnonzero(new != mine)
            yield from _packed([_row(row["bucket"], MOVED, gone.astype(np.int32), new[gone], mine[gone])]).to_batches()

    return state.mapInArrow(go, PACKED)


def counts_of(state: DataFrame, known: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the words ``known`` (in order, few) and how often they stand before and after each class, themselves left out."""
    width = 2 * size + 1

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in _rows(batch)):
            here, at = _places(known, np.frombuffer(row["a"], np.uint64))
            if len(here):
                each, kind, n = (_wide(row[c]) for c in ("d", "e", "f"))
                place = np.full(len(each), -1)
                place[here] = np.arange(len(here))
                word = np.repeat(place, each)
                cells = np.bincount(word[word >= 0] * width + kind[word >= 0], n[word >= 0], len(here) * width).astype(np.int64)
                yield from _packed([_row(row["bucket"], STATE, at, np.frombuffer(row["c"], np.uint16)[here], cells)]).to_batches()

    names, cells = np.zeros(len(known), np.int64), np.zeros((len(known), width), np.int64)
    for row in state.mapInArrow(look, PACKED).collect():
        at = np.frombuffer(row["a"], np.int64)
        names[at], cells[at] = np.frombuffer(row["b"], np.uint16), np.frombuffer(row["c"], np.int64).reshape(-1, width)
    return names, cells[:, :size], cells[:, size : 2 * size]


def deal(pairs: np.ndarray, names: np.ndarray, after: np.ndarray, before: np.ndarray, b: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """New classes of a few words, moved one by one while all others stay, and the class bigrams ``b`` with them there.

    ``pairs`` has their bigrams, ``after`` and ``before`` how often they stand before and after each class, themselves left out.
    """
    m, size = len(names), len(b)
    member, apart = np.eye(size)[names], pairs - np.diag(np.diag(pairs))
    all_pairs = np.zeros((m + size, m + size))  # the other words of a class are one
    all_pairs[:m, :m] = pairs
    all_pairs[:m, m:] = after - apart @ member
    all_pairs[m:, :m] = (before - apart.T @ member).T
    all_pairs[m:, m:] = b - member.T @ pairs @ member - member.T @ all_pairs[:m, m:] - all_pairs[m:, :m] @ member
    new = exchange(all_pairs, m, classes, names=np.concatenate([names, np.arange(size)]))
    member = np.eye(size)[new]
    return new[:m], member.T @ all_pairs @ member


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def changes(places: DataFrame, homes: DataFrame, moves: DataFrame, size: int) -> DataFrame:
    """By how much the counts of ``neighbours`` change with ``moves``, per block and bucket, in its form with signed counts.

    ``places`` has the places of all words by bucket, ``homes`` these and the bigrams by block.
    """
    width, none = 2 * size + 1, np.uint16(0xFFFF)

    def tell(left, right):
        out = []
        if left.num_rows and right.num_rows:
            spots = [np.frombuffer(a, np.int32) for a in left.column("a").to_pylist()]
            gone, to, old = (np.frombuffer(right.column(c)[0].as_py(), t) for c, t in (("a", np.int32), ("b", np.uint16), ("c", np.uint16)))
            n = max(int(x.max(initial=-1)) for x in [gone, *spots]) + 2  # the last is that of words not learned from
            new, was = np.full(n, none), np.full(n, none)
            new[gone], was[gone] = to, old
            for spot, bucket, block, before in zip(spots, *(left.column(c).to_pylist() for c in ("bucket", "block", "b"))):
                here = np.flatnonzero(new[spot] != none)
                if len(here):
                    out.append(_row(bucket, block, (here + np.frombuffer(before, np.int64)[0]).astype(np.int32), new[spot[here]], was[spot[here]]))
        return _packed(out)

    def count(left, right):
        if not (left.num_rows and right.num_rows):
            return _packed([])
        (bigram, *lists) = sorted(left.to_pylist(), key=lambda r: r["bucket"])  # TABLE comes first
        lefts, then, many = np.frombuffer(bigram["a"], np.int32), _narrow(bigram["b"]), _narrow(bigram["c"])
        n = len(lefts) - 1
        gone = np.concatenate([np.frombuffer(x, np.int32) for x in right.column("a").to_pylist()])
        moved, new, old = np.zeros(n + 1, bool), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        moved[gone] = True
        for to, c in ((new, "b"), (old, "c")):
            to[gone] = np.concatenate([np.frombuffer(x, np.uint16) for x in right.column(c).to_pylist()])
        kind = _int_for((n + 1) * width)
        first, code, k, new, old = np.repeat(np.arange(n + 1, dtype=np.int32), lefts), [], [], new.astype(kind), old.astype(kind)
        for side, (word, beside, at) in enumerate(((first, then, moved[then]), (then, first, np.repeat(moved, lefts)))):
            at = np.flatnonzero(at)
            word, beside = word[at].astype(kind), beside[at]
            own = (word < n) & (word != beside)  # the end keeps no counts, and a word none of itself by class
            word, beside, weight = word[own] * width + side * size, beside[own], many[at[own]].astype(_int_for(int(many.max(initial=0)) + 1))
            code += [word + old[beside], word + new[beside]]
            k += [-weight, weight]
        code, k = _summed(np.concatenate(code), np.concatenate(k), n * width)
        begin, block, out = 0, bigram["block"], []
        for r in lists:
            spot = np.frombuffer(r["a"], np.int32)
            i, j = np.searchsorted(code, [begin * width, (begin + len(spot)) * width])
            if j > i:
                live, each = np.unique(code[i:j] // width - begin, return_counts=True)
                out.append(_row(r["bucket"], block, np.concatenate([spot[live], each.astype(np.int32)]), _small(code[i:j] % width), _signed(k[i:j])))
            begin += len(spot)
        return _packed(out)

    told = places.groupBy("bucket").cogroup(moves.groupBy("bucket")).applyInArrow(tell, PACKED)
    return homes.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(count, PACKED)


def add_up(state: DataFrame, counted: DataFrame, size: int, signed: bool = False) -> DataFrame:
    """``state`` with ``counted`` added to its counts, and words that ``counted`` has as ``MOVED`` in their new classes; as
    bucket ``TABLE`` the class bigrams with a word of the bucket, and the end of a text after or before it.

    Counts of a bucket (``d``: entries of each word, ``e``: codes, ``f``: counts) have the codes of ``neighbours``.
    """
    width = 2 * size + 1

    def go(key, part):
        words, total, mine = _state(part)
        codes, counts, cells = [], [], len(words) * width
        for r in part.to_pylist():
            if r["block"] == MOVED:
                mine = mine.copy()
                mine[np.frombuffer(r["a"], np.int32)] = np.frombuffer(r["b"], np.uint16)
            elif r["block"] == STATE:
                if r["d"] is not None:
                    codes.append(np.repeat(np.arange(len(words)), _wide(r["d"])) * width + _wide(r["e"]))
                    counts.append(_wide(r["f"]))
            else:
                spot, each = np.split(np.frombuffer(r["a"], np.int32), 2)
                codes.append(np.repeat(spot.astype(np.int64), each) * width + _wide(r["b"]))
                counts.append((_unsigned if signed else _wide)(r["c"]))
        code, k = _summed(np.concatenate([np.zeros(0, np.int64), *codes]), np.concatenate([np.zeros(0, np.int64), *counts]), max(cells, 1))
        word, kind = np.divmod(code, width)
        name, end = mine[word].astype(np.int64), size - 1
        at = np.where(kind < size, name * size + kind, np.where(kind == 2 * size, name * size + name, end * size + name))
        use = (kind < size) | (kind >= size + end)
        table = np.bincount(at[use], k[use], size * size).astype(np.int64)
        bucket, each = key[0].as_py(), np.bincount(word, minlength=len(words))
        return _packed([_row(TABLE, bucket, table) + (None,) * 3, _row(bucket, STATE, words, total, mine) + tuple(x.tobytes() for x in map(_small, (each, kind, k)))], COUNTED)

    wide = [F.lit(None).cast("binary").alias(c) for c in "def"]
    added = counted.filter(F.col("bucket") != TABLE).select("*", *wide)
    return (state if "d" in state.columns else state.select("*", *wide)).unionByName(added).groupBy("bucket").applyInArrow(go, COUNTED)


def _bigram_likelihood(b: np.ndarray) -> float:
    return float(_f(b).sum() - _f(b.sum(1)).sum() - _f(b.sum(0)).sum())


def settle(spots: DataFrame, state: DataFrame, homes: DataFrame, places: DataFrame, classes: int, tokens: int, blank: int, known: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Classes of all words: those without a class get one, then sweeps until one gains less than ``SETTLED`` a token.

    A sweep deals the words ``known`` (in order; ``pairs``: their bigrams) and moves one in ``DAMPING`` of the others, or all
    if none of these moves. One that does not raise the likelihood is undone and made again with twice the damping, up to
    ``MOST_DAMPING``. ``blank`` is the number of texts that are an end after an end.
    """
    spark, size = state.sparkSession, classes + 2

    def counts(of: DataFrame, more: DataFrame, signed: bool) -> tuple[DataFrame, DataFrame, np.ndarray]:
        made = cut(add_up(of, more, size, signed), "lm-classes")
        b = class_table(made, size)
        b[-1, -1] += blank
        return made, made.filter(F.col("block") == STATE).filter(F.col("bucket") != TABLE), b

    first = cut(neighbours(send(spots, state, classes), homes, size), "lm-neighbours")
    held, counted, b = counts(state, first, False)
    discard(first)
    discard(state)  # by ``cut``
    state = counted
    sweep_up(spark)
    best, damping, turn, dealt, with_dealt = None, DAMPING, 0, None, b
    while damping <= MOST_DAMPING:
        for among in (1,) if best is None else (damping, 1):
            moves = cut(move(state, with_dealt, classes, turn, among, dealt), "lm-moves")
            moved = moves.agg(F.coalesce(F.sum(F.length("a")), F.lit(0))).first()[0]
            if moved:
                break
            discard(moves)
        if not moved:
            break
        made, new, new_b = counts(state, changes(places, homes, moves, size).unionByName(moves), True)
        discard(moves)
        now = _bigram_likelihood(new_b)
        turn += 1
        if best is None or now > best:
            gained = None if best is None else now - best
            discard(held)
            held, state, b, best = made, new, new_b, now
            if gained is not None and gained * among < SETTLED * tokens:
                break
            names, with_dealt = deal(pairs, *counts_of(state, known, size), b, classes)
            dealt = known, names.astype(np.uint16)
        else:
            discard(made)
            damping *= 2
        sweep_up(spark)
    return state.select("bucket", "block", "a", "b", "c")


def _sequence(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
    """Number of every token, end tokens included, with the two before it (before a text: end); and where texts begin."""
    sizes = np.diff(at)
    begin = at + np.arange(len(at))
    tokens = np.full(begin[-1], end, np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    tokens[inside] = ids
    one, two = np.roll(tokens, 1), np.roll(tokens, 2)
    heads = begin[:-1]
    one[heads] = two[heads] = end
    two[heads[sizes > 0] + 1] = end
    return tokens, one, two, begin, inside


def _numbers(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts from ``encode`` and where each text begins."""
    raw, at = text_bytes(part.column("a"))
    n = np.concatenate([[0], np.cumsum(part.column("n").to_numpy(zero_copy_only=False))])
    return _from_three(raw) if len(raw) == 3 * n[-1] else np.frombuffer(raw.tobytes(), np.int32), n


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray, names: np.ndarray) -> float:
    """The part of the class bigram log-likelihood that depends on which class each word is in."""
    k = int(names.max()) + 1
    b = np.zeros((k, k))
    np.add.at(b, (names[:, None], names[None, :]), pairs)
    return float(_f(b).sum() - _f(b.sum(1)).sum() - _f(b.sum(0)).sum())


def exchange(pairs: np.ndarray, free: int, classes: int, sweeps: int = SWEEPS, names: np.ndarray | None = None) -> np.ndarray:
    """Class of each word from bigram counts ``pairs`` (word before, word after), most frequent words first.

    The first ``free`` words move among ``classes`` classes, each to where the likelihood is highest given all others;
    the rest are classes of their own. Ends after a sweep without a move, or after ``sweeps``. With ``names`` all start there,
    and the rest stay.
    """
    n = len(pairs)
    names = np.concatenate([np.arange(free) % classes, classes + np.arange(n - free)]) if names is None else names
    names = names.astype(np.int64)
    k = int(names.max()) + 1
    member = np.zeros((n, k))
    member[np.arange(n), names] = 1
    after, before = pairs @ member, (pairs.T @ member)  # per word: counts by the class of the next, of the previous
    table = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(free):
            old, own = names[w], pairs[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[old] -= own
            left[old] -= own
            rest = table.copy()
            rest[old] -= right
            rest[:, old] -= left
            rest[old, old] -= own
            c = np.arange(classes)
            rows = _f(rest[:classes] + right) - _f(rest[:classes])
            columns = _f(rest[:, :classes].T + left) - _f(rest[:, :classes].T)
            corner = rest[c, c]
            both = _f(corner + right[c] + left[c] + own) - _f(corner)
            gain = rows.sum(1) - rows[c, c] + columns.sum(1) - columns[c, c] + both
            out, into = rest.sum(1)[:classes] + left[c], rest.sum(0)[:classes] + right[c]
            gain -= _f(out + right.sum() + own) - _f(out) + _f(into + left.sum() + own) - _f(into)
            new = int(gain.argmax())
            if new != old and gain[new] > gain[old] + 1e-9:
                table = rest
                table[new] += right
                table[:, new] += left
                table[new, new] += own
                after[:, old] -= pairs[:, w]
                after[:, new] += pairs[:, w]
                before[:, old] -= pairs[w]
                before[:, new] += pairs[w]
                names[w] = new
                moved += 1
        if not moved:
            break
    return names


def transitions(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log10 P(class | two classes before), from class trigram counts (two before, one before, class).

    Trigrams are smoothed towards bigrams and these towards single classes, which have one added; rows sum to one.
    """
    k = len(counts)
    single = (counts.sum((0, 1)) + 1) / (counts.sum() + k)
    two = counts.sum(0)
    bigram = (two + prior * single) / (two.sum(1, keepdims=True) + prior)
    return np.log10((counts + prior * bigram) / (counts.sum(2, keepdims=True) + prior))


def score_texts(docs: DataFrame, held_out, *, doc_id: str = "doc_id", text: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` for every row of ``docs``.

    ``held_out`` is a boolean column; its rows are scored but not learned from. A null, empty or blank text is one end
    token. Scores are log10 probabilities; ``base_score`` is the unigram model with one added to each count. All training
    words are in classes; ``clustered`` is how many of them are dealt first. Without training rows all tokens are unseen.
    Repeated rows are learned from and scored one by one, with equal scores; a text of any length is scored whole, its
    words in slices; of classes equally good for a word the first is taken; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size_of = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    encoded = cut(encode(rows, max(16, -(-size_of // BLOCK_BYTES))), "lm-words")
    texts, bigrams = encoded.filter(F.col("bucket") == TEXT), encoded.filter(F.col("bucket") == TABLE).select("bucket", "block", "a", "b", "c")
    train = texts.filter(~F.col("held_out"))
    placed = cut(bucket_words(encoded.filter(F.col("bucket") >= 0).select("bucket", "block", "a", "b", "c")), "lm-places")
    spots, vocabulary = placed.filter(F.col("block") != STATE), placed.filter(F.col("block") == STATE)
    # every sweep reads these: each block and each bucket stays where it is
    homes, places = cut_by(bigrams.unionByName(spots), "block", "lm-homes"), cut_by(spots, "bucket", "lm-places-by-bucket")
    sweep_up(spark)

    def block_words(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        return np.concatenate([np.zeros(0, np.int64), *(_wide(r["a"]) for r in parts)]), np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r["b"], np.uint16) for r in parts)])

    def most_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                words, total = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                top = np.lexsort((words, -total))[:clustered]
                sums = np.zeros((2, len(top)), np.int64)
                if len(top):
                    sums[:, 0] = total.sum(), len(total)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words[top], total[top], *sums)], ["word", "total", "tokens", "types"])

    some = cut(vocabulary.mapInArrow(most_frequent, "word long, total long, tokens long, types long"), "lm-frequent")
    sums = some.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    ends, blank = (int(x) for x in train.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") == 0).cast("long")), F.lit(0))).first())
    tokens, distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)

    frequent = some.orderBy(F.desc("total"), "word").limit(clustered).collect()  # CLUSTERED rows
    codes = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(codes)
    known, m = codes[order], len(codes)
    rank = np.empty(m, np.int64)
    rank[:] = order  # frequency rank of the words in order of their hash

    ranked = send(spots, start(vocabulary, known, rank, m), other=m)

    def pairs_of(left, right):
        bigram = left.filter(pc.equal(left.column("bucket"), TABLE)).to_pylist()[0]
        lefts, then, many = np.frombuffer(bigram["a"], np.int32), _wide(bigram["b"]), _wide(bigram["c"])
        mine = np.append(block_words(right)[1].astype(np.int64), m + 1)
        return dense_chunks(np.bincount(np.repeat(mine, lefts) * (m + 2) + mine[then], many, (m + 2) ** 2).astype(np.int64))

    pairs = homes.groupBy("block").cogroup(ranked.groupBy("block")).applyInArrow(pairs_of, "chunk long, width long, counts binary")
    pairs = dense_sum(pairs, (m + 2) ** 2).reshape(m + 2, m + 2).astype(float)
    k = min(classes, max(m, 1))
    names = exchange(pairs, m, k)
    other, end, size = k, k + 1, k + 2
    state = cut(start(vocabulary, known, names[rank] if m else np.zeros(0, np.int64), other), "lm-start")
    if m:
        state = settle(spots, state, homes, places, k, tokens, blank, known, pairs[np.ix_(rank, rank)])
    discard_by(homes)
    discard_by(places)
    words = cut(send(spots, state, other=other), "lm-classes-of-blocks")

    def triples(left, right):
        _, mine = block_words(right)
        table = np.zeros(size**3, np.int64)
        for batch in left.to_batches():
            for part in slices(batch, "a"):
                ids, at = _numbers(part)
                now, one, two, _, _ = _sequence(mine[ids], at, end)
                table += np.bincount((two * size + one) * size + now, minlength=size**3)
        return dense_chunks(table)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.zeros((2, size), np.int64)
            for b, c in zip(batch.column("b").to_pylist(), batch.column("c").to_pylist()):
                total, mine = np.frombuffer(b, np.int64), np.frombuffer(c, np.uint16)
                held += np.stack([np.bincount(mine, total, size), np.bincount(mine, minlength=size)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(held[0]), pa.array(held[1])], ["class", "held", "types"])

    sweep_up(spark)
    learned = train.select("block", "n", "a").groupBy("block").cogroup(words.groupBy("block"))
    steps = transitions(dense_sum(learned.applyInArrow(triples, "chunk long, width long, counts binary"), size**3).reshape(size, size, size).astype(float))
    mass = np.ones(size)  # tokens, types and the room of an unseen word
    for r in state.mapInArrow(by_class, "class long, held long, types long").groupBy("class").agg(F.sum("held").alias("held"), F.sum("types").alias("types")).collect():
        mass[r["class"]] += r["held"] + r["types"]
    mass[end] = ends + 1
    unseen = np.log10((10.0 ** steps[:, :, :k] / mass[:k]).sum(2) + 10.0 ** steps[:, :, other])
    sweep_up(spark)
    model = spark.sparkContext.broadcast((steps, unseen, mass))  # of a size fixed by CLASSES

    def score(left, right):
        steps, unseen, mass = model.value
        count, mine = block_words(right)
        out = []
        for batch in left.to_batches():
            for part in slices(batch, "a"):
                ids, at = _numbers(part)
                now, one, two, begin, inside = _sequence(mine[ids], at, end)
                c = np.full(len(now), ends, np.int64)
                c[inside] = count[ids]
                base = np.add.reduceat(np.log10((c + 1) / (tokens + distinct + 1)), begin[:-1])
                token = np.where(now == other, unseen[two, one], steps[two, one, now] + np.log10((c + 1) / mass[now]))
                model_score = np.add.reduceat(token, begin[:-1])
                n = np.diff(begin)
                out.append(pa.table({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": n,
                    "n_known": np.add.reduceat((c > 0).astype(np.int64), begin[:-1]), "train_tokens": np.full(len(n), tokens),
                    "base_score": base, "score": model_score, "perplexity": 10 ** np.minimum(-model_score / n, 300),
                }))
        return pa.concat_tables(out) if out else None

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    empty = pa.table({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": [], "perplexity": []})

    def one_block(left, right):
        return score(left, right) or empty

    return texts.select("doc_id", "held_out", "block", "n", "a").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(one_block, schema)
