"""Decontamination, the registered queries and the pipeline."""

import collections
import re

import public_tokenizers
import pytest
from fixtures import LOWER, bm25, classes, empty_docs, odd_docs, words_of

import __spark_entry__ as entry
import check
import corpus_pipeline
from tidecast.llm import decontaminate, packing
from tidecast.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(text, items, n=10):
    """Hit words and the items that occur, position by position."""
    w, hit, found = tokens(text), set(), set()
    for i, t in items:
        own = tokens(t)
        size = min(n, len(own))
        for a in range(len(own) - size + 1 if own else 0):
            for b in range(len(w) - size + 1):
                if w[b : b + size] == own[a : a + size]:
                    hit.update(range(b, b + size))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "The cat sat on the mat and looked at the other cat today"), (2, "Of some WORDS"), (10, "東京 wörds"), (3, None), (4, "--"), (2, "of some"), (20, "the cat")]


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_hits(spark, most):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd_docs(spark)
    more = spark.createDataFrame([(50, "x the Cat, sat on-the mat; and looked at the OTHER cat the cat"), (51, "É TOKYO 東京\nwörds K")], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    got = decontaminate.mark(docs, benchmark, n=10, most_broadcast=most).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == hits(r["text"], ITEMS)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    clean = decontaminate.remove_documents(docs, benchmark)
    assert clean.columns == docs.columns
    expected = collections.Counter(r["doc_id"] for r in docs.collect() if not hits(r["text"], ITEMS)[1])
    assert collections.Counter(r["doc_id"] for r in clean.collect()) == expected
    cut = collections.Counter(map(tuple, decontaminate.remove_spans(docs, benchmark).select("doc_id", "text").collect()))
    whole = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect() if not hits(r["text"], ITEMS)[1])
    assert not whole - cut and cut.total() == docs.count()
    left = {i: t for i, t in cut}
    assert left[50] == "x" and left[51] == "É TOKYO K"


def test_no_items_or_documents(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd_docs(spark)
    assert decontaminate.mark(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.remove_documents(docs, benchmark.filter("item_id IN (3, 4)")).count() == docs.count()
    assert decontaminate.mark(empty_docs(spark), benchmark).count() == 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, key):
    assert check.compare(spark, check.connect(SF), key, SF).startswith("ok")


def test_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_search_query(spark):
    got = QUERIES["op3_bm25"](spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = bm25(docs, [(i, t) for i, t in docs if i % 100 == 0], 10)
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["doc_id"], round(r["score"], 8)))
    assert dict(found) == {q: [(i, round(v, 8)) for i, v in rows] for q, rows in want.items() if rows}


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    ids = [r["doc_id"] for r in good.collect()]
    assert sum(labels.get(i) == 0 for i in ids) <= 0.05 * sum(v == 0 for v in labels.values())
    assert sum(labels.get(i) == 1 for i in ids) >= 0.97 * sum(v == 1 for v in labels.values())

    told = stage["language ID"](spark, docs, SF).collect()
    assert all(any(c.isalpha() for c in r["text"]) for r in told) and len(told) >= 0.95 * docs.count() - 5

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = [r["doc_id"] for r in stage["n-gram Jaccard join"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()]
    of = classes(rows, 5, 80)
    blank = [i for i, t in rows if not words_of(t)]
    assert sorted(kept) == sorted({c for i, c in of.items() if i not in blank} | set(blank))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(tokens(t)[a : a + 10]) for _, t in items for a in range(max(1, len(tokens(t)) - 9))}
    assert all(len(g) == 10 for g in grams)
    clean = {i for i, t in rows if not any(tuple(tokens(t)[a : a + 10]) in grams for a in range(len(tokens(t)) - 9))}
    left = stage["benchmark decontamination"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert {r["doc_id"] for r in left.collect()} == clean and len(clean) < len(rows)

    packed = stage["best-fit packing"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    mine = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(mine.plain(t)) // 4 + 1 for _, t in rows)


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in got} <= ids and len(got) > 100
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 1024
