"""Exact BM25 top-k over sharded inverted indexes with block-max pruning.

Texts are cut into shards of bounded size. A shard's index has, for each word, its documents with their impacts (the BM25
weight without the word's idf). Words that many documents of the shard hold also have their impacts as columns of a grid,
and for each block of ``BLOCK`` documents the largest impact. Statistics of the whole corpus (documents, mean length,
documents per word) are counted first, so shards score alike. For a query the postings of its rarer words are added up;
with the block maxima of its common words they bound what any document of a block can score. Blocks with the highest
bounds are visited first, and those whose bound is below the k-th best score so far are never opened. The best of all
shards are merged. A few shards, as many as the root of their number, are searched first: a query's k-th best score among
them is the least that a document of any other shard must reach, so those hand over few documents instead of k each.

The pivot test of block-max WAND is made for all blocks of a shard at once instead of document by document, and for a batch
of queries at a time, so blocks that many queries open are scored by one matrix product. That product is in single
precision: it only says which documents can be among the best, and these are scored again in double precision, word by word
in one order, so the result is exact and equal texts have equal scores. Queries are a table in the shared folder that every
shard reads through in blocks.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm.words import slices, text_bytes, word_hashes
from tidecast.session import cut, scratch_path

K1, B = 1.2, 0.75
BLOCK = 64
SHARD_BYTES, SHARD_DOCS = 32 << 20, 1 << 15
COMMON, COLUMNS = 32, 1024  # one document in so many holds a common word; columns of the grid at most
QUERIES, FIRST, RUN = 128, 4, 16  # queries of a batch, blocks that a query opens first, blocks of one product


def document_terms(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Text number, word and count of every distinct word of every text, and the words of each text."""
    words, at = word_hashes(texts)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    return owner[head], words[head], np.diff(np.append(head, len(words))), np.diff(at)


class Index:
    """Postings of one shard; documents are numbered in the order in which they were given."""

    def __init__(self, docs: np.ndarray, words: np.ndarray, counts: np.ndarray, lengths: np.ndarray, mean: float, overwrite: bool = False):
        """Postings as integers of word, document and count, sorted in place and taken apart again.

        With ``overwrite`` that is done in the memory of ``docs``, ``words`` and ``counts`` (32, 64 and 32 bits).
        """
        self.n, self.blocks = len(lengths), -(-len(lengths) // BLOCK)
        self.words, tf = np.unique(words), np.unique(counts)
        low, high = len(tf).bit_length(), len(tf).bit_length() + self.n.bit_length()
        if len(self.words).bit_length() + high > 64:
            raise ValueError("a shard has too many words and documents")
        keys = words if overwrite else words.copy()
        self.docs = docs if overwrite else np.empty(len(docs), np.int32)
        self.slot = counts if overwrite else np.empty(len(docs), np.int32)  # word of each posting
        for at in self._runs(len(keys)):
            keys[at] = np.searchsorted(self.words, keys[at])
            keys[at] = (keys[at] << high) | (docs[at].astype(np.uint64) << low) | np.searchsorted(tf, counts[at]).astype(np.uint64)
        keys.sort()
        self.impact = keys.view(float)
        rest = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        for at in self._runs(len(keys)):
            key = keys[at]
            self.slot[at] = key >> high
            self.docs[at] = (key >> low) & ((1 << (high - low)) - 1)
            n = tf[key & ((1 << low) - 1)].astype(float)
            self.impact[at] = n * (K1 + 1) / (rest[self.docs[at]] + n)
        self.first = np.append(np.flatnonzero(np.diff(self.slot, prepend=-1)), len(keys))
        df = np.diff(self.first)
        place = self.docs.astype(np.int64)
        place <<= 32
        for at in self._runs(len(place)):
            place[at] |= np.arange(at.start, at.stop)
        place.sort()
        self.by_doc = place.astype(np.int32)  # postings of each document, words in order: the lower half
        del place
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=self.n))])
        common = np.argsort(-df, kind="stable")[:COLUMNS]
        common = np.sort(common[df[common] * COMMON >= self.n])
        self.column = np.full(len(df), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.grid = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        for c, w in enumerate(common.tolist()):
            i, j = self.first[w], self.first[w + 1]
            self.grid[self.docs[i:j], c] = self.impact[i:j]
        self.top = self.grid.reshape(self.blocks, BLOCK, -1).max(1) if len(common) else np.zeros((self.blocks, 0), np.float32)

    @staticmethod
    def _runs(n: int, most: int = 1 << 18) -> Iterator[slice]:
        for a in range(0, n, most):
            yield slice(a, min(a + most, n))

    @staticmethod
    def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())

    def search(self, words: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best documents with their scores, best first, earlier document first on ties; and the blocks opened."""
        return self.search_all([(words, weights)], k, np.zeros(1))[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """As ``search`` for each of ``queries``; documents that score less than its ``floor`` are left out."""
        if not len(self.words) or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0), 0)] * len(queries)
        n, size = len(queries), self.blocks * BLOCK
        common, rare = np.zeros((n, self.grid.shape[1]), np.float32), np.empty((n, size), np.float32)
        asked, slack = [], np.empty(n)
        words, back = np.unique(np.concatenate([w for w, _ in queries]), return_inverse=True)
        place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        place = np.where(self.words[place] == words, place, -1)[back]  # of each word of each query
        cuts = np.cumsum([len(w) for w, _ in queries])
        for j, (spot, (_, weights)) in enumerate(zip(np.split(place, cuts[:-1]), queries)):
            hit = spot >= 0
            spot, weights = spot[hit], weights[hit]
            asked.append((spot, weights))
            slack[j] = (len(spot) + 8) * 2.0**-22  # twice the most that single precision can be off
            column = self.column[spot]
            often = column >= 0
            common[j] = np.bincount(column[often], weights[often], common.shape[1])
            a, b = self.first[spot[~often]], self.first[spot[~often] + 1]
            post = self._ranges(a, b)
            rare[j] = np.bincount(self.docs[post], self.impact[post] * np.repeat(weights[~often], b - a), size)
        bound = (rare.reshape(n, self.blocks, BLOCK).max(2) + common @ self.top.T) * (1 + slack)[:, None]
        first = min(max(FIRST, -(-k // BLOCK)), self.blocks)
        opened, worst = np.zeros((n, self.blocks), bool), np.array(floor, float)
        new = np.flatnonzero(worst <= 0)  # a floor says more than a few blocks would
        for j, blocks in zip(new.tolist(), np.argpartition(-bound[new], first - 1, axis=1)[:, :first].tolist()):
            got = np.concatenate([rare[j, b * BLOCK : (b + 1) * BLOCK] + self.grid[b * BLOCK : (b + 1) * BLOCK] @ common[j] for b in blocks])
            worst[j] = np.partition(got, -k)[-k] * (1 - slack[j]) if len(got) >= k else 0
            opened[j, blocks] = True
        may = (bound >= worst[:, None]) & (bound > 0)
        opened |= may
        found = []  # query, document and score of all that may be among the best
        for b in range(0, self.blocks, RUN):
            some = np.flatnonzero(may[:, b : b + RUN].any(1))
            if len(some):
                i, j = b * BLOCK, min(b + RUN, self.blocks) * BLOCK
                got = common[some] @ self.grid[i:j].T
                got += rare[some, i:j]
                least = np.maximum(worst[some] * (1 - slack[some]), np.finfo(np.float32).tiny)
                x, y = np.nonzero(got >= least[:, None].astype(np.float32))
                found.append((some[x], y + i, got[x, y]))
        own, docs, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(own, kind="stable")
        docs, score, cuts = docs[order], score[order], np.searchsorted(own[order], np.arange(n + 1))
        full, out = np.zeros(len(self.words)), []
        for j, (spot, weights) in enumerate(asked):
            best, about = docs[cuts[j] : cuts[j + 1]], score[cuts[j] : cuts[j + 1]]
            if not len(best):
                out.append((np.zeros(0, np.int64), np.zeros(0), int(opened[j].sum())))
                continue
            if len(best) > k:
                best = best[about >= np.partition(about, -k)[-k] * (1 - 2 * slack[j])]
            np.add.at(full, spot, weights)
            a, b = self.begin[best], self.begin[best + 1]
            post = self.by_doc[self._ranges(a, b)]
            exact = np.bincount(np.repeat(np.arange(len(best)), b - a), self.impact[post] * full[self.slot[post]], len(best))
            full[spot] = 0
            keep = np.lexsort((best, -exact))[:k]
            keep = keep[(exact[keep] >= floor[j]) & (exact[keep] > 0)]
            out.append((best[keep], exact[keep], int(opened[j].sum())))
        return out


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``k`` best documents of every query; ties go to the smaller id.

    A query weighs each of its words by how often it holds it. Only documents that share a word with the query are
    ranked, so a null or blank query or text has no rows. Repeated documents are ranked one by one; repeated query ids
    are merged into one query.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "search-texts")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, n, total = [], 0, 0
            for part in slices(batch):
                _, words, _, lengths = document_terms(part.column("text"))
                own, df = np.unique(words, return_counts=True)
                parts.append((own, df))
                n, total = n + len(lengths), total + int(lengths.sum())
            words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            df = np.bincount(at, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df), pa.nulls(len(words), pa.int64())], ["word", "df", "length"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n]), pa.array([total])], ["word", "df", "length"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, words, counts, _ = document_terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(owner)), pa.array(words.view(np.int64)), pa.array(counts)], ["query_id", "word", "n"])

    seen = cut(rows.select("text").mapInArrow(frequencies, "word long, df long, length long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("length").alias("length")), "search-words")
    n, total = (int(x or 0) for x in seen.filter("word IS NULL").agg(F.sum("df"), F.sum("length")).first())
    asked = queries.select(F.col(query_id).alias("query_id"), F.coalesce(F.col(query), F.lit("")).alias("text"))
    kind = asked.schema["query_id"].dataType.simpleString()
    asked = asked.mapInArrow(terms, f"query_id {kind}, word long, n long")
    weight = F.col("n") * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.groupBy("query_id", "word").agg(F.sum("n").alias("n")).join(seen, "word").select("query_id", F.struct("word", weight.alias("weight")).alias("term"))
    ready = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))

    def write(asked: DataFrame, label: str) -> str:
        path = scratch_path(spark, label)
        asked.select("query_id", "word", "weight", F.coalesce("floor", F.lit(0.0)).alias("floor")).write.option("parquet.block.size", 8 << 20).parquet(path)
        return path

    def hits(rows: DataFrame, path: str) -> DataFrame:
        return rows.select("doc_id", "text").mapInArrow(search_shards(path, k, total / max(n, 1)), f"query_id {kind}, doc_id {id_kind}, score double")

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    path = write(ready.select("query_id", "terms.word", "terms.weight", F.lit(0.0).alias("floor")), "search-queries")
    files = sorted(os.path.basename(f) for f in rows.inputFiles())
    step = math.isqrt(len(files))
    if step < 2:
        return ranked(hits(rows, path), k)
    early = F.col("_metadata.file_name").isin(files[::step])
    first = cut(ranked(hits(rows.filter(early), path), k), "search-first")
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("floor"))
    again = spark.read.parquet(path).drop("floor")
    path = write(again.join(floors, again["query_id"].eqNullSafe(floors["q"]), "left"), "search-floors")
    return ranked(first.drop("rank").unionByName(hits(rows.filter(~early), path)), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of the ``k`` best of ``hits`` by query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search_shards(path: str, k: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts a task's texts into shards and searches each for all queries below ``path``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = []  # scores of the best so far in this task, by batch of queries

        def finish(ids: list, parts: list) -> Iterator[pa.RecordBatch]:
            own = pa.concat_arrays(ids)
            by_id = np.asarray(pa.compute.array_sort_indices(own))
            own = own.take(pa.array(by_id))
            ids.clear()  # an id's column keeps its whole batch, texts and all
            place = np.empty(len(by_id), np.int32)
            place[by_id] = np.arange(len(by_id))
            lengths = np.concatenate([p[3] for p in parts])[by_id]
            columns = [np.concatenate([p.pop(0) for p in parts]) for _ in range(3)]  # a shard's postings are held once while its index is made
            parts.clear()
            columns[0] = place[columns[0]]
            index = Index(*columns, lengths, mean, overwrite=True)
            del columns
            for at, asked in enumerate(query_batches(path)):
                if at == len(tops):
                    tops.append(np.repeat(asked.column("floor").to_numpy()[:, None], k, axis=1))
                offsets, words = asked.column("word").offsets.to_numpy(), asked.column("word").values.to_numpy().view(np.uint64)
                weights = asked.column("weight").values.to_numpy()
                got = index.search_all([(words[a:b], weights[a:b]) for a, b in zip(offsets, offsets[1:])], k, tops[at].min(1))
                names = np.repeat(np.arange(len(got)), [len(best) for best, _, _ in got])
                for j in np.unique(names).tolist():
                    scores = got[j][1]
                    tops[at][j] = np.sort(np.concatenate([tops[at][j], scores]))[-k:]
                yield pa.RecordBatch.from_arrays(
                    [asked.column("query_id").take(pa.array(names)), own.take(pa.array(np.concatenate([best for best, _, _ in got]))), pa.array(np.concatenate([x for _, x, _ in got]))],
                    ["query_id", "doc_id", "score"],
                )

        ids, parts, held, size, batch, part = [], [], 0, 0, None, None
        for batch in batches:
            for part in slices(batch):
                if ids and (size >= SHARD_BYTES or held >= SHARD_DOCS):
                    yield from finish(ids, parts)
                    ids, parts, held, size = [], [], 0, 0
                owner, words, counts, lengths = document_terms(part.column("text"))
                ids.append(part.column("doc_id"))
                parts.append([(owner + held).astype(np.int32), words, counts.astype(np.int32), lengths])
                held += len(lengths)
                size += len(text_bytes(part.column("text"))[0])
        del batch, part
        if ids:
            yield from finish(ids, parts)

    return search


def query_batches(path: str) -> Iterator[pa.RecordBatch]:
    """The weighted queries below ``path``, a block at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    for info in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(QUERIES)
