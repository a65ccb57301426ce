"""Words, components, near duplicates, search and class language model against brute force."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from fixtures import bm25, classes, empty_docs, near_copies, odd_docs, shingles, words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import classlm, search
from tidecast.llm.components import connected_components
from tidecast.llm.jaccard import document_sets, jaccard_classes, keep_one
from tidecast.llm.search import B, BLOCK, K1, Index, document_terms, top_k
from tidecast.llm.words import slices, word_hashes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0bé東.", max_size=30)), max_size=8))
def test_word_hashes_follow_the_words(texts):
    found, at = word_hashes(pa.array(texts, pa.string()))
    expected = [w for t in texts for w in words_of(t)]
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts]
    assert len(found) == len(expected)
    assert len({(h, w) for h, w in zip(found.tolist(), expected)}) == len(set(expected)) == len(set(found.tolist()))
    hashes, begin = document_sets(pa.array(texts, pa.string()), 3)
    assert np.diff(begin).tolist() == [len(shingles(t, 3)) for t in texts]


def test_slices_keep_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 0, 500, 3, 90, 90)]), pa.array(range(6))], ["text", "k"])
    parts = list(slices(batch, most=100))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6))
    assert len(parts) > 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(200, i) for i in range(150, 200)]
    links = [*chain, *star, (7, 7), (None, 3), (300, 301), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 150 for i in range(150, 201)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1 << 18), (5, 80, 1 << 18), (3, 80, 150)])
def test_jaccard_classes(spark, n, percent, block):
    texts = near_copies()
    got = jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string"), n=n, percent=percent, block_shingles=block).collect()
    assert {r["doc_id"]: r["component"] for r in got} == classes(texts, n, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, n)) for i, t in texts}


def test_jaccard_odd_rows(spark):
    docs = odd_docs(spark)
    got = jaccard_classes(docs).collect()
    assert len(got) == docs.count()
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add((r["n_shingles"], r["component"]))
    assert by_id[1] == by_id[2] == {(10, 1)}
    assert by_id[3] == {(0, 3)} and by_id[4] == {(0, 4)} and by_id[5] == {(0, 5)}
    assert by_id[None] == {(5, None)} and by_id[8] == {(1, 8), (4, 8)}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids == {1: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1, 8: 2, 9: 1}
    assert jaccard_classes(empty_docs(spark)).count() == 0 and keep_one(empty_docs(spark)).count() == 0


def test_top_k(spark):
    texts = near_copies()
    queries = [(1, texts[3][1]), (2, "w1 w1 W2 unseen"), (3, "nothing known"), (4, None), (5, "tail")]
    got = top_k(
        spark.createDataFrame(texts, "doc_id long, text string").repartition(3),
        spark.createDataFrame(queries, "query_id long, query string"), k=7,
    ).collect()
    for q, rows in bm25(texts, queries, 7).items():
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [round(s, 9) for _, _, s in mine] == [round(s, 9) for _, s in rows]
        assert [d for _, d, _ in mine] == [d for d, _ in rows]


def test_search_prunes_blocks():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"c{i}" for i in range(30)], 20)) for _ in range(BLOCK * 40)]
    texts[700] = "rare words here " * 3
    owner, words, counts, lengths = document_terms(pa.array(texts))
    index = Index(owner, words, counts, lengths, lengths.mean())
    asked = np.unique(word_hashes(pa.array(["rare words here c1"]))[0])
    best, _, opened = index.search(asked, np.array([9.0 if w not in word_hashes(pa.array(["c1"]))[0] else 0.1 for w in asked]), 1)
    assert best.tolist() == [700] and opened < index.blocks


def test_top_k_odd_rows(spark):
    docs = odd_docs(spark)
    queries = docs.selectExpr("doc_id AS query_id", "text AS query")
    got = top_k(docs, queries, k=3).collect()
    assert all(r["score"] > 0 for r in got) and {r["query_id"] for r in got} == {1, 2, None, 6, 7, 8, 9}
    assert top_k(empty_docs(spark), queries).count() == 0
    assert top_k(docs, queries.limit(0)).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(np.kron([[1, 8], [6, 1]], np.ones((6, 6)))).astype(float)
    pairs = np.pad(pairs, ((0, 2), (0, 2)), constant_values=2.0)
    start = np.concatenate([np.arange(12) % 2, [2, 3]])
    names = classlm.exchange(pairs, 12, 2)
    assert classlm.likelihood(pairs, names) > classlm.likelihood(pairs, start)
    assert names[12:].tolist() == [2, 3]
    for w in range(12):  # no single move helps
        other = names.copy()
        other[w] = 1 - other[w]
        assert classlm.likelihood(pairs, other) <= classlm.likelihood(pairs, names) + 1e-6


def test_transitions_sum_to_one():
    counts = np.random.default_rng(2).poisson(0.4, (7, 7, 7)).astype(float)
    assert np.allclose((10 ** classlm.transitions(counts)).sum(2), 1)


def lm_base(rows):
    train = [words_of(t) for _, t, held in rows if not held]
    counts = collections.Counter(w for t in train for w in t)
    n, v = sum(counts.values()) + len(train), len(counts) + bool(train)
    out = collections.defaultdict(list)
    for i, t, _ in rows:
        cs = [counts[w] for w in words_of(t)] + [len(train)]
        out[i].append((len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 1) / (n + v + 1)) for c in cs)))
    return out


def test_class_lm(spark):
    rng = np.random.default_rng(8)
    tongues = [[f"{p}{i}" for i in range(60)] for p in "abc"]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(rng.choice(tongues[i % 3], 30)), zlib.crc32(str(i).encode()) % 7 == 2))
    rows += [(1000, None, False), (1001, "", True), (1002, "never seen before", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r for r in classlm.score_texts(df, df["held"], clustered=150, classes=6).collect()}
    for i, (expected,) in lm_base(rows).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == expected[:3]
        assert r["base_score"] == pytest.approx(expected[3])
    held = [got[i] for i, t, h in rows if h and i < 1000]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.95 * len(held)


def test_class_lm_odd_rows(spark):
    docs = odd_docs(spark)
    got = classlm.score_texts(docs, docs["doc_id"] == 8)
    assert got.count() == docs.count() and got.filter("score IS NULL OR score > 0").count() == 0
    # only the two rows without a length are learned from: twelve words and an end, and an end
    few = classlm.score_texts(docs, docs["n_chars"] != -1).filter("held_out").collect()
    assert {r["train_tokens"] for r in few} == {14}
    known = collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"]) for r in few)
    assert known[1, 13, 13] == 2 and known[4, 1, 1] == known[5, 1, 1] == 1 and known[8, 2, 1] == 1 and known[6, 40_001, 1] == 1
    again = collections.Counter((r["doc_id"], round(r["score"], 9)) for r in few)
    assert {n for (i, _), n in again.items() if i == 1} == {2}, "repeated rows have the same score"
    assert classlm.score_texts(empty_docs(spark), F.col("doc_id") == 8).count() == 0


def test_gains_are_those_of_single_moves():
    rng = np.random.default_rng(0)
    n, k = 30, 4
    pairs = rng.poisson(1.5, (n + 1, n + 1)).astype(float)
    pairs[3] *= 20
    names = np.concatenate([rng.integers(0, k, n), [k + 1]])
    names[5] = k  # not in a class yet

    def table(names):
        member = np.eye(k + 2)[names]
        return member.T @ pairs @ member

    apart, member = pairs - np.diag(np.diag(pairs)), np.eye(k + 2)[names]
    sides = [(*np.nonzero(x), x[np.nonzero(x)].astype(int)) for x in ((apart @ member)[:n], (apart.T @ member)[:n])]
    got = classlm.gains(table(names), *sides, np.diag(pairs)[:n], names[:n], k)
    for w in range(n):
        after = [classlm._bigram_likelihood(table(np.where(np.arange(n + 1) == w, c, names))) for c in range(k)]
        assert np.allclose(got[w] - got[w, 0], np.array(after) - after[0])


def test_frequent_words_are_dealt_beside_all_others():
    """Their moves are those of an exchange that knows every word, and the class bigrams with them are those of a count."""
    rng = np.random.default_rng(6)
    n, k, m = 40, 4, 12
    pairs = rng.poisson(rng.gamma(0.4, 3, (n + 1, n + 1))).astype(float)
    names = np.concatenate([rng.integers(0, k, n), [k + 1]])
    apart, member = pairs - np.diag(np.diag(pairs)), np.eye(k + 2)[names]
    b = member.T @ pairs @ member
    got, with_them = classlm.deal(pairs[:m, :m], names[:m], (apart @ member)[:m], (apart.T @ member)[:m], b, k)
    assert np.array_equal(got, classlm.exchange(pairs, m, k, names=names)[:m]) and not np.array_equal(got, names[:m])
    member = np.eye(k + 2)[np.concatenate([got, names[m:]])]
    assert np.array_equal(with_them, member.T @ pairs @ member)
    assert classlm._bigram_likelihood(with_them) > classlm._bigram_likelihood(b)


def test_few_sweeps_settle(spark, monkeypatch):
    """Neighbours that move at once change places again and again: sweeps of all words were undone, then too few moved."""
    rng, sweeps, changes = np.random.default_rng(3), [], classlm.changes
    monkeypatch.setattr(classlm, "changes", lambda *a: sweeps.append(1) or changes(*a))
    odds = 1 / np.arange(1, 401)
    words = [rng.permutation(400) for _ in range(8)]
    rows = [(i, " ".join(f"w{words[(i + j) % 8][w]}" for j, w in enumerate(rng.choice(400, 60, p=odds / odds.sum()))), False) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4)
    assert classlm.score_texts(df, df["held"], clustered=30, classes=8).count() == 150
    assert len(sweeps) <= 12  # 15 before


def test_rare_words_have_classes(spark):
    rng = np.random.default_rng(4)
    tongues = [[f"{p}{i}" for i in range(60)] for p in "abc"]
    rows = [(i, " ".join(rng.choice(tongues[i % 3], 30)), i % 7 == 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4)
    got = classlm.score_texts(df, df["held"], clustered=9, classes=6).filter("held_out").collect()  # 9 of 180 words are dealt first
    assert sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)


def test_index_is_made_in_little_memory():
    """What is held while an index is made, by posting; the index itself has about 40 bytes when most blocks have one."""
    import tracemalloc

    rng = np.random.default_rng(1)
    at = rng.permutation(rng.choice(3000 * 20000, 200000, replace=False))
    docs, words, lengths = (at % 3000).astype(np.int32), (at // 3000).astype(np.uint64), rng.integers(50, 500, 3000)
    counts = rng.integers(1, 5, len(at)).astype(np.int32)
    tracemalloc.start()
    index = Index(docs, words, counts, lengths, 200.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 62 * len(at)
    order = np.lexsort((docs, words))
    tf = counts[order].astype(float)
    expected = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs[order]] / 200.0))
    np.testing.assert_allclose(index.impact, expected, rtol=1e-15)
    assert np.array_equal(index.words, np.unique(words)) and np.array_equal(np.diff(index.first), np.unique(words, return_counts=True)[1])


def test_index_is_made_in_the_memory_of_its_postings():
    import tracemalloc

    rng = np.random.default_rng(2)
    at = rng.permutation(rng.choice(3000 * 20000, 200000, replace=False))
    docs, words, lengths = (at % 3000).astype(np.int32), (at // 3000).astype(np.uint64), rng.integers(50, 500, 3000)
    counts = rng.integers(1, 5, len(at)).astype(np.int32)
    kept = Index(docs, words, counts, lengths, 200.0)
    tracemalloc.start()
    index = Index(docs, words, counts, lengths, 200.0, overwrite=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(at)
    for name in ("words", "first", "docs", "slot", "impact", "by_doc", "begin", "column", "grid", "top"):
        assert np.array_equal(getattr(index, name), getattr(kept, name))


def test_top_k_searches_a_few_shards_first(spark, monkeypatch, tmp_path):
    """The k-th best of these is the least that other shards hand over; ties with it go to the smaller id as before."""
    paths = {}
    monkeypatch.setattr(search, "scratch_path", lambda _, label: paths.setdefault(label, f"{tmp_path}/{label}"))
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"w{j}" for j in rng.zipf(1.3, 40) % 500)) for i in range(900)]
    texts += [(i + 900, texts[i % 30][1]) for i in range(300)]  # eleven equal texts at the top
    queries = [(None, texts[50][1]), *((i, texts[i][1]) for i in range(0, 900, 30)), (7, "w1 w2 unseen"), (8, "unseen")]
    got = top_k(spark.createDataFrame(texts, "doc_id long, text string").repartition(9), spark.createDataFrame(queries, "query_id long, query string"), k=4).collect()
    want = bm25(texts, queries, 4)
    for q, rows in want.items():
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(d, round(s, 9)) for _, d, s in mine] == [(d, round(s, 9)) for d, s in rows]
    floors = {r["query_id"]: r["floor"] for r in spark.read.parquet(paths["search-floors"]).collect()}
    assert floors.keys() == {q for q, rows in want.items() if rows}
    assert all(0 < floor <= want[q][3][1] + 1e-9 for q, floor in floors.items())


def test_long_queries_walk_few_postings(monkeypatch):
    """Documents as queries: most postings of their words are those of common words, which a product scores."""
    rng = np.random.default_rng(6)
    odds = 1 / np.arange(1, 3001)
    texts = [" ".join(f"w{i}" for i in rng.choice(3000, 120, p=odds / odds.sum())) for _ in range(1500)]
    texts[900] = texts[37]  # equal texts tie, the earlier comes first
    owner, words, counts, lengths = document_terms(pa.array(texts))
    index = Index(owner, words, counts, lengths, lengths.mean())
    df = dict(zip(index.words.tolist(), np.diff(index.first).tolist()))
    asked = [(words[owner == d], np.array([counts[i] * math.log(1 + (1500 - df[words[i]] + 0.5) / (df[words[i]] + 0.5)) for i in np.flatnonzero(owner == d)])) for d in range(30, 90)]
    walked, ranges = [], Index._ranges
    monkeypatch.setattr(Index, "_ranges", staticmethod(lambda a, b: walked.append(int((b - a).sum())) or ranges(a, b)))
    got = [index.search(*q, 10) for q in asked]
    assert sum(walked) < 0.25 * sum(df[w] for own, _ in asked for w in own.tolist())
    impact, place = np.zeros((1500, len(index.words))), np.searchsorted(index.words, words)
    impact[owner, place] = counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / lengths.mean())[owner])
    for (own, weights), (best, scores, _) in zip(asked, got):
        full = impact[:, np.searchsorted(index.words, own)] @ weights
        expected = np.lexsort((np.arange(1500), -full.round(9)))[:10]
        assert best.tolist() == expected.tolist() and np.allclose(scores, full[expected], rtol=1e-12)
    assert got[7][0][:2].tolist() == [37, 900] and got[7][1][0] == got[7][1][1]
    batch = index.search_all(asked, 10, np.array([scores[4] for _, scores, _ in got]))
    for (best, scores, _), (some, high, _) in zip(got, batch):  # a floor leaves out what is below it and nothing else
        assert some.tolist() == best[scores >= scores[4]].tolist() and np.array_equal(high, scores[scores >= scores[4]])


def test_sweeps_leave_no_tables_behind(spark, monkeypatch):
    """However many sweeps there are, one table of classes and counts is held beside the one being made."""
    live, most, kept = collections.Counter(), collections.Counter(), {}

    def cut(df, label):
        out = write(df, label)
        kept[out.cut_path] = label
        live[label] += 1
        most[label] = max(most[label], live[label])
        return out

    def discard(df):
        live[kept.pop(df.cut_path)] -= 1
        drop(df)

    write, drop = classlm.cut, classlm.discard
    monkeypatch.setattr(classlm, "cut", cut)
    monkeypatch.setattr(classlm, "discard", discard)
    rng = np.random.default_rng(4)
    tongues = [[f"{p}{i}" for i in range(60)] for p in "abc"]
    rows = [(i, " ".join(rng.choice(tongues[i % 3], 30)), i % 7 == 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4)
    assert classlm.score_texts(df, df["held"], clustered=9, classes=6).count() == 300
    assert most["lm-classes"] + live["lm-start"] <= 2 and most["lm-neighbours"] <= 2
    assert live["lm-classes"] + live["lm-start"] == 1 and not live["lm-neighbours"]


def test_only_words_that_may_move_are_counted(spark):
    """The counts of a turn are those of all words, without the words that may not move in it."""
    rng = np.random.default_rng(3)
    rows = [(i, False, " ".join(f"w{j}" for j in rng.integers(0, 90, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "block long, held_out boolean, text string").withColumn("block", F.col("block") % 3)
    counted = classlm.block_counts(docs, 4).cache()
    placed = classlm.bucket_words(counted).cache()
    spots, state = placed.filter(F.col("block") != classlm.STATE), placed.filter(F.col("block") == classlm.STATE)
    bigrams, found = counted.filter(F.col("bucket") == classlm.TABLE), []
    for damping in (1, 3):
        made = classlm.neighbours(classlm.send(spots, state, 4, 7, damping), bigrams, 6).collect()
        cells = collections.Counter()
        for r in made:
            if r["bucket"] == classlm.TABLE:
                cells["table", r["block"]] = r["a"]
                continue
            spot, each = np.split(np.frombuffer(r["a"], np.int32), 2)
            for s, c, k in zip(np.repeat(spot, each).tolist(), classlm._wide(r["b"]).tolist(), classlm._wide(r["c"]).tolist()):
                cells[r["bucket"], r["block"], s, c] += k
        found.append(cells)
    may = {r["bucket"]: classlm.may_move(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["c"], np.uint16), 4, 7, 3) for r in state.collect()}
    assert 0 < sum(m.sum() for m in may.values()) < 60
    assert found[1] == {key: n for key, n in found[0].items() if key[0] == "table" or may[key[0]][key[2]]}


def test_changes_of_counts_are_those_of_a_recount(spark):
    """What a sweep sends of the words that moved leaves the counts and class bigrams that a full count gives."""
    rng = np.random.default_rng(5)
    rows = [(i, False, " ".join(f"w{j}" for j in rng.integers(0, 90, 40 * (i != 7)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "block long, held_out boolean, text string").withColumn("block", F.col("block") % 3)
    counted = classlm.block_counts(docs, 4).cache()
    placed = classlm.bucket_words(counted).cache()
    spots, state = placed.filter(F.col("block") != classlm.STATE), placed.filter(F.col("block") == classlm.STATE)
    bigrams = counted.filter(F.col("bucket") == classlm.TABLE)
    known = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in state.collect()]))

    def count(of):
        made = classlm.add_up(of, classlm.neighbours(classlm.send(spots, of, 4), bigrams, 6), 6).cache()
        return made.filter(F.col("bucket") != classlm.TABLE), classlm.class_table(made, 6)

    first, b = count(classlm.start(state, known, rng.integers(0, 5, len(known)), 4))
    moves = classlm.move(first, b, 4, 7, 3).cache()
    gone = sum(len(r["a"]) for r in moves.collect()) // 4
    assert 0 < gone < 60
    sent = classlm.changes(spots, bigrams.unionByName(spots), moves, 6)
    made = classlm.add_up(first, sent.unionByName(moves), 6, True).cache()
    new, table = made.filter(F.col("bucket") != classlm.TABLE), classlm.class_table(made, 6)
    again, expected = count(new.select("bucket", "block", "a", "b", "c"))
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, again.collect()))
    assert np.array_equal(table, expected) and not np.array_equal(table, b)


def test_texts_are_kept_as_word_numbers(spark, monkeypatch):
    """No table that is written holds texts, and the tables that sweeps read are gone at the end."""
    seen, cut = [], classlm.cut
    monkeypatch.setattr(classlm, "cut", lambda df, label: seen.append(df.columns) or cut(df, label))
    docs = spark.createDataFrame([(i, f"a b c d{i % 5}", i % 3 == 0) for i in range(30)], "doc_id long, text string, held boolean")
    assert classlm.score_texts(docs, docs["held"], clustered=3, classes=2).count() == 30
    assert seen and not any("text" in columns for columns in seen)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lm_")]


def test_small_integers():
    for most in (0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, 1 << 40):
        x = np.array([0, most // 2, most])
        assert np.array_equal(classlm._wide(classlm._small(x).tobytes()), x)
        assert np.array_equal(classlm._unsigned(classlm._signed(x - most // 3).tobytes()), x - most // 3)
