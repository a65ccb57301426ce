"""Exact Jaccard self-join of documents on word n-grams by grouped prefixes.

A document is the set of its distinct shingles. Shingles are put in one global order, rare ones first (frequencies are
counted over the whole corpus in a table of fixed size, so rarity is approximate, which only affects speed). Two sets
with a similarity of at least t share l shingles in their prefixes of ``n - ceil(t n) + l`` shingles; here l is one, and
one more for every ``STEP`` shingles of the smaller set.

1. Equal sets become one set; sets with the same size and prefix become one group, so copies cost nothing further.
2. Groups that meet at a shingle few groups have are paired one by one. A pair is dropped if its sizes rule the
   similarity out, if it shares fewer than l such shingles, or if the parity sketches of two single sets differ in more
   bits than similar sets can differ in shingles. At a shingle of many groups no pairs are formed: the groups are chained
   in order of size (a chain breaks where sizes differ too much), so what a pair shares there need not be counted.
3. What pairs and chains connect is a family; similar sets are always in one. Families are expanded to their sets and
   verified with all shingles. A family is cut into blocks of bounded size in order of set size, and only blocks whose
   sizes allow the similarity meet. From two blocks comes a forest of verified links at most, never their pairs: links
   that join what is joined already add nothing to the components.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm.components import connected_components
from tidecast.llm.tables import dense_counts
from tidecast.llm.words import mix, shingle_hashes, slices, word_hashes
from tidecast.session import cut

TABLE_BITS = 22
FEW = 32  # groups at a shingle that are still paired one by one
STEP = 64
SKETCH = 8  # 64-bit words of a parity sketch
MEMBER_BITS = 23
BLOCK_SHINGLES = 1 << 18


def document_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and where each text's set begins."""
    hashes, at = shingle_hashes(*word_hashes(texts), n)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(at)))


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def shingle_frequencies(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Documents per cell of a table of ``2^TABLE_BITS`` cells into which shingles are hashed; its size is fixed."""
    rows = docs.select(F.col(text).alias("text"))
    return dense_counts(rows, 1 << TABLE_BITS, lambda part: _cells(document_sets(part.column("text"), n)[0], TABLE_BITS))


def _code(values: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of values, whatever their order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
    size = np.diff(begin).astype(np.uint64)
    return mix((total[begin[1:]] - total[begin[:-1]]) ^ mix(size + np.uint64(salt)))


def _pair_code(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The same as 16 bytes."""
    both = np.stack([_code(values, begin, 0x51ED270B), _code(values, begin, 0x2545F491)], axis=1)
    raw = both.astype(">u8").tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def required(n, percent: int):
    """Shingles that a set of ``n`` shares at least with any similar set."""
    return (n * percent + 99) // 100


def _sketches(hashes: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    """``SKETCH`` 64-bit words per set: each bit is the parity of the shingles that fall on it."""
    total = np.zeros((len(begin) - 1, SKETCH), np.uint64)
    some = np.flatnonzero(np.diff(begin))
    spot = mix(hashes)
    bit = np.uint64(1) << (spot & np.uint64(63))
    word = (spot >> np.uint64(6)) % np.uint64(SKETCH)
    for k in range(SKETCH if len(some) else 0):
        total[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begin[some])
    return [pa.array(total[:, k].view(np.int64)) for k in range(SKETCH)]


def describe(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """``docs`` with what is known of each text's shingle set.

    ``_n`` its size, ``_set`` a code of the set, ``_group`` of size and prefix, ``_prefix``, the sketch ``_s0`` ..., and
    ``_text``, a code of the text.
    """
    spark = docs.sparkSession
    frequency = spark.sparkContext.broadcast(np.minimum(shingle_frequencies(docs, text, n), (1 << 31) - 1).astype(np.int32))
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    marks = [f"_s{k}" for k in range(SKETCH)]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, begin = document_sets(part.column("text"), n)
        size = np.diff(begin)
        rank = frequency.value[_cells(hashes, TABLE_BITS)]
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((hashes, rank, owner))
        length = np.where(size > 0, np.minimum(size, size - required(size, percent) + 1 + size // STEP), 0)
        inside = np.arange(len(hashes)) - np.repeat(begin[:-1], size) < np.repeat(length, size)
        prefix = hashes[order][inside]
        ends = np.concatenate([[0], np.cumsum(length)])
        group = _code(prefix ^ mix(np.repeat(size, length).astype(np.uint64)), ends, 0x6A09E667)
        more = [
            pa.array(size.astype(np.int64)), _pair_code(hashes, begin), pa.array(group.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(prefix.view(np.int64))), *_sketches(hashes, begin),
        ]
        base = part.drop_columns(["text"])
        return pa.RecordBatch.from_arrays([*base.columns, *more], [*base.schema.names, "_n", "_set", "_group", "_prefix", *marks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield one(part)

    more = "_n long, _set binary, _group long, _prefix array<long>, " + ", ".join(f"{s} long" for s in marks)
    return rows.mapInArrow(run, f"{schema}, {more}")


def group_links(groups: DataFrame, sets: DataFrame, percent: int, few: int = FEW) -> DataFrame:
    """``(a, b)``: pairs and chain links of the groups ``(_group, _n, _prefix)``; ``sets`` are the distinct sets.

    A group of the key is its prefix code and size together.
    """
    at = groups.select(F.struct("_group", "_n").alias("g"), F.explode("_prefix").alias("shingle"))
    by_size = Window.partitionBy("shingle").orderBy("g._n", "g._group")
    met = at.select(
        "g", F.count("*").over(by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"),
        F.collect_list("g").over(by_size.rowsBetween(1 - few, -1)).alias("before"),
    ).filter("m > 1")
    fits = lambda x: x["_n"] * 100 >= F.col("g._n") * percent
    chain = met.filter(F.col("m") > few).select(F.try_element_at("before", F.lit(-1)).alias("a"), F.col("g").alias("b"))
    chain = chain.filter(F.col("a").isNotNull() & (F.col("a._n") * 100 >= F.col("b._n") * percent))
    pairs = met.filter(F.col("m") <= few).select(F.explode(F.filter("before", fits)).alias("a"), F.col("g").alias("b"))
    least = 1 + F.floor(F.least("a._n", "b._n") / STEP)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least).drop("shared")

    marks = [f"_s{k}" for k in range(SKETCH)]
    alone = sets.groupBy(F.struct("_group", "_n").alias("g")).agg(F.count("*").alias("sets"), *(F.first(s).alias(s) for s in marks))
    one = lambda side: alone.select(F.col("g").alias(side), F.when(F.col("sets") == 1, F.struct(*marks)).alias(f"s{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    apart = sum((F.bit_count(F.col(f"sa.{s}").bitwiseXOR(F.col(f"sb.{s}"))) for s in marks), F.lit(0))
    # similar sets differ in at most (100 - percent) / (100 + percent) of both sizes together
    close = apart * (100 + percent) <= (F.col("a._n") + F.col("b._n")) * (100 - percent)
    kept = both.filter(F.coalesce(close, F.lit(True))).select("a", "b")
    return kept.unionByName(chain.distinct())


def families(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(_set, _n, _text, family)`` of all distinct sets that may be similar to another one."""
    linked = connected_components(group_links(groups, sets, percent))
    roots = linked.select(F.col("node._group").alias("_group"), F.col("node._n").alias("_n"), F.xxhash64("root").alias("family"))
    members = sets.select("_set", "_n", "_group", "_text").join(roots, ["_group", "_n"], "left")
    several = sets.groupBy("_group", "_n").agg(F.count("*").alias("sets")).filter("sets > 1").select("_group", "_n", F.lit(True).alias("shared"))
    members = members.join(several, ["_group", "_n"], "left").filter("family IS NOT NULL OR shared")
    return members.select("_set", "_n", "_text", F.coalesce("family", F.xxhash64("_group", "_n")).alias("family"))


def texts_of(base: DataFrame, members: DataFrame) -> DataFrame:
    """``(_text, text)``: one row for each text of ``members``, and some others.

    A bit table of a fixed size keeps most other texts from being shuffled; what passes it by chance does no harm.
    """
    bits = dense_counts(members.select("_text"), 1 << MEMBER_BITS, lambda b: _cells(b.column("_text").to_numpy().view(np.uint64), MEMBER_BITS), None)
    known = base.sparkSession.sparkContext.broadcast(np.packbits(bits > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cells(batch.column("_text").to_numpy().view(np.uint64), MEMBER_BITS)
            yield batch.filter(pa.array((known.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1))

    passed = base.select(F.xxhash64("text").alias("_text"), "text").mapInArrow(run, "_text long, text string")
    return passed.groupBy("_text").agg(F.first("text").alias("text"))


def _forest(sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the similar sets among ``sets`` (only those between left and not left, if both occur)."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    words, at = np.unique(flat, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    parent, links = np.arange(len(sets)), []
    across = left.any() and not left.all()
    present = np.zeros(len(words), np.int32)
    for i in range(len(sets)):
        if across and not left[i]:
            continue
        other = parent != parent[i]
        other &= ~left if across else np.arange(len(sets)) > i
        other &= (size * 100 >= size[i] * percent) & (size[i] * 100 >= size * percent)
        pick = np.flatnonzero(other)
        if not len(pick):
            continue
        present[at[begin[i] : begin[i] + size[i]]] = 1
        if len(pick) * 4 > len(sets):
            same = np.add.reduceat(present[at], begin)[pick]
        else:
            same = np.array([present[at[begin[j] : begin[j] + size[j]]].sum() for j in pick])
        present[at[begin[i] : begin[i] + size[i]]] = 0
        for j in pick[100 * same >= percent * (size[i] + size[pick] - same)].tolist():
            if parent[j] != parent[i]:
                links.append((i, j))
                parent[parent == parent[j]] = parent[i]
    return links


def verified_links(members: DataFrame, texts: DataFrame, n: int, percent: int, block_shingles: int) -> DataFrame:
    """``(a, b)``: links between sets that join all that are similar.

    ``members (family, _set, _n, _text)`` are the distinct sets of families; ``texts`` has their texts (``_text, text``).
    """
    in_order = Window.partitionBy("family").orderBy("_n", "_set")
    before = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    placed = members.select("family", "_set", "_n", "_text", F.floor(before / block_shingles).alias("block"))
    blocks = placed.groupBy("family", "block").agg(F.min("_n").alias("least"), F.max("_n").alias("most"))
    a, b = blocks.alias("a"), blocks.alias("b")
    fit = (F.col("a.family") == F.col("b.family")) & (F.col("a.block") <= F.col("b.block"))
    fit &= F.col("b.least") * percent <= F.col("a.most") * 100
    pairs = a.join(b, fit).select(F.col("a.family").alias("family"), F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    ends = pairs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = placed.join(ends, ["family", "block"]).select("family", "i", "j", "block", "_set", "_text").join(texts, "_text")

    def verify(key, rows):
        i, j = key[1].as_py(), key[2].as_py()
        ids, left, sets = [], [], []
        for batch in rows.to_batches():
            for part in slices(batch):
                hashes, begin = document_sets(part.column("text"), n)
                ids += part.column("_set").to_pylist()
                left += [x == i for x in part.column("block").to_pylist()]
                sets += [hashes[p:q] for p, q in zip(begin, begin[1:])]
        order = sorted(range(len(ids)), key=ids.__getitem__)  # arrival order does not matter
        side = np.array([left[k] for k in order]) if i != j else np.ones(len(ids), bool)
        links = _forest([sets[k] for k in order], side, percent)
        a, b = ([ids[order[link[x]]] for link in links] for x in (0, 1))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.select("family", "i", "j", "block", "_set", "text").groupBy("family", "i", "j").applyInArrow(verify, "a binary, b binary")


def jaccard_classes(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``(doc_id, text_code, n_shingles, component, root)`` for every row: its shingle count and class.

    Documents link when ``100 * shared >= percent * union`` of their distinct ``n``-word shingles; a class is what links
    reach. ``component`` is the smallest id in the class. Fewer than ``n`` words count as one shingle; a null, empty or
    blank text has none and is a class of its own, named by its own id. Repeated rows are linked like other copies.
    Ids may be null or repeated: ``text_code``, a hash of the text, tells rows of one id apart.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seen = cut(describe(base, "text", n, percent), "jaccard-sets")
    some, marks = seen.filter("_n > 0"), [f"_s{k}" for k in range(SKETCH)]
    sets = some.groupBy("_set").agg(*(F.first(c).alias(c) for c in ["_n", "_group", *marks]), F.min("_text").alias("_text"))
    sets = cut(sets, "jaccard-distinct")
    groups = some.groupBy("_group", "_n").agg(F.first("_prefix").alias("_prefix"))
    members = cut(families(groups, sets, percent), "jaccard-members")
    links = cut(verified_links(members, texts_of(base, members), n, percent, block_shingles), "jaccard-links")
    roots = connected_components(links).select(F.col("node").alias("_set"), "root")
    labelled = seen.select("doc_id", "_text", "_n", "_set").join(roots, "_set", "left").withColumn("root", F.coalesce("root", "_set"))
    least = labelled.filter("_n > 0").groupBy("root").agg(F.min("doc_id").alias("component"))
    return labelled.join(least, "root", "left").select(
        "doc_id", F.col("_text").alias("text_code"), F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"),
        F.when(F.col("_n") > 0, F.col("root")).alias("root"),
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, then the smallest hash of its text. Blank texts all stay."""
    classes = jaccard_classes(docs, doc_id=doc_id, text=text, **options).filter("root IS NOT NULL")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_code")
    best = classes.groupBy("root").agg(F.min(key).alias("best")).select(F.col("best.doc_id").alias("best_id"), F.col("best.text_code").alias("best_code"))
    code = F.xxhash64(F.col(text))
    blank = F.coalesce(F.col(text), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    rows = docs.filter(~blank).select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), code.alias("code"))
    kept = rows.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("code") == F.col("best_code")), "left_semi")
    once = kept.groupBy("id", "code").agg(F.first("doc").alias("doc"))
    return once.select("doc.*").unionByName(docs.filter(blank))
