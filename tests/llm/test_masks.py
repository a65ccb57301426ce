"""Near-duplicate vectors, importance resampling and the audit of filters against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from fixtures import empty_docs, odd_docs, words_of
from pyspark.sql import functions as F

from tidecast.llm import audit, near_vectors, queries, resample

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def near_families(seed=1, dim=64):
    """Families around random centres at many distances, a hot one, exact copies, and unrelated vectors."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [rng.normal(size=dim) for _ in range(300)]
    for size, noise in [(150, 0.25), (30, 0.05), (40, 0.45), (25, 0.33), (60, 0.5)]:
        centre = unit(rng.normal(size=dim))
        rows += [3 * (centre + noise * unit(rng.normal(size=dim)) * rng.random() ** 0.2) for _ in range(size)]
    rows += [rows[310]] * 20 + [rows[5]] * 3 + [2.0 * rows[6]]
    return [(int(i), [float(np.float32(v)) for v in x], 0) for i, x in zip(rng.permutation(len(rows)), rows)]


def brute_links(rows, cosine):
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near


def components(near, ids):
    left, out = set(range(len(ids))), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            todo += [j for j in np.flatnonzero(near[i]) if j not in seen and j in left]
            left -= set(todo)
        out |= {ids[i]: min(ids[j] for j in seen) for i in seen}
    return out


@pytest.mark.parametrize("block", [1024, 32])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = near_families()
    near, ids = brute_links(rows, 0.9), [r[0] for r in rows]
    got = {r["vec_id"]: r for r in near_vectors.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), 0.9).collect()}
    want = dict(zip(ids, near.sum(1)))
    assert set(got) == set(ids)
    # no link below the threshold, and nearly all above it
    assert all(got[i]["n_links"] <= want[i] for i in ids)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * near.sum() > 20_000
    whole = components(near, ids)
    assert np.mean([got[i]["component_id"] == whole[i] for i in ids]) >= 0.98
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    copies = [i for i, x, _ in rows if x == rows[310][1]]
    assert len({got[i]["n_links"] for i in copies}) == 1 and len(copies) == 21


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(500, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.concatenate([a, 0.9005 * a + math.sqrt(1 - 0.9005**2) * b])
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(pairs)], "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_duplicate_vectors(df, 0.9).agg(F.sum("n_links")).first()[0]
    assert 0.95 * 1000 <= got <= 1000


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 48))
    x[200:] = x[:200] + 0.3 * rng.normal(size=(200, 48))
    made = near_vectors.encode(x, 0.9, 400)
    bits = -(-near_vectors.BITS // 48) * 48
    estimate, reach = near_vectors.upper_bounds(*(made[k] for k in ("code", "factor", "low", "step", "steps")), bits)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = ~np.eye(400, dtype=bool)
    wrong = (estimate - u @ u.T)[off]
    assert abs(wrong.mean()) < 0.002
    assert abs((estimate - u @ u.T)[np.arange(200), np.arange(200, 400)].mean()) < 0.01
    assert np.mean(np.abs(wrong) > reach[off]) < 1e-3


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 0.0]
    rows = [(1, one, 7), (1, one, 8), (2, [2.0, 4.0, 0.1], 7), (3, None, 7), (4, [], 7), (5, [0.0, 0.0, 0.0], 7), (6, [nan, 1.0, 1.0], 7), (7, [inf, 1.0, 1.0], 7),
            (8, [None, 1.0, 1.0], 7), (None, [1.0, 2.0, 0.0], 7), (9, [1.0, 2.0], 7), (10, [-1.0, -2.0, 0.0], 7), (None, [0.0, -5.0, 1.0], 7), (11, [1e-38, 2e-38, 0.0], 7), (12, [0.0, -0.0, 3.0], 7), (13, [-0.0, 0.0, 3.0], 7)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS + ", n_links int, id int, key int")
    got = near_vectors.near_duplicate_vectors(df, 0.9)
    assert got.columns == ["vec_id", "embedding", "label", "id", "key", "n_links", "component_id", "kept"]
    out = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect())
    assert out == Counter(
        [(1, 4, 1, True)] * 2 + [(2, 4, 1, False), (None, 4, 1, False), (11, 4, 1, False), (12, 1, 12, True), (13, 1, 12, False), (None, 0, None, True)]
        + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    )
    empty = near_vectors.near_duplicate_vectors(spark.createDataFrame([], VECTORS), 0.9)
    assert empty.count() == 0


def brute_resample(rows, target, percent=25):
    word = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def codes(w):
        runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        return [zlib.crc32(f.encode()) % 10000 for f in runs]

    words = [word(text) for _, text in rows]
    own, other = Counter(c for w in words for c in codes(w)), Counter(c for t in target for c in codes(word(t)))
    s, t = sum(own.values()), sum(other.values())
    gain = [math.floor(1000 * math.log((other[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for (i, _), w in zip(rows, words):
        c = codes(w)
        weight = sum(gain[x] for x in c) // len(c) if c else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = able[: len(able) * percent // 100]
    ranked = Counter((*r[:4], k + 1) for k, r in enumerate(drawn))
    rest = Counter((*r[:4], None) for r in out) - Counter((*r[:4], None) for r in drawn)
    return ranked + rest


def test_resample_odd_rows(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame(
        [(i, f"The cat sat on mat {i % 5} " * 5 + "ÄÖ_x 9z\x00q", "en", "a", 1) for i in range(20, 60)], "doc_id long, text string, lang string, source string, n_chars long"
    ), allowMissingColumns=True)
    target = spark.createDataFrame([("the cat sat",), (None,), ("on mat 3 the Cat",), ("",)], "text string")
    docs = docs.withColumn("rank", F.lit("old"))
    got = resample.importance_resample(docs, target)
    assert got.columns == [c for c in docs.columns if c not in ("n_words", "score", "rank")] + ["n_words", "n_features", "weight", "score", "rank"]
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], ["the cat sat", None, "on mat 3 the Cat", ""])
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()) == want
    assert resample.importance_resample(empty_docs(spark), target).count() == 0
    none = resample.importance_resample(docs, target.limit(0), carry=["doc_id"])
    assert none.filter("rank is not null").count() == 41 // 4


def test_resample_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op12_resample"](spark, SF)
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(docs, target)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_do_not_depend_on_pieces(n):
    raw = " ".join(f"Wörd{i % 7}-x{i}" for i in range(60)).encode()
    w = raw.translate(resample.TABLE).split()
    want = Counter((k, zlib.crc32(b" ".join(w[i : i + k]))) for k in range(1, n + 1) for i in range(len(w) - k + 1))
    for piece in (1, 7, 50, 1 << 20):
        got = Counter((k, c) for k, codes in resample.feature_codes(raw, n, piece) for c in codes)
        assert got == want


def brute_audit(docs, labels):
    first, marks, out = {}, {}, {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (max(good, int(q == 1)), max(toxic, int(t == 1)))
    marks.pop(None, None)
    for i, text, part in docs:
        text, part = text or "", part or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        good, toxic = marks.get(i, (0, 0))
        for p in permutations("ABCDE"):
            gone = False
            for k, x in enumerate(p):
                row = out.setdefault((part, "".join(p), k + 1), [0] * 6)
                hit = fails[x]
                for j, v in enumerate([not gone and not hit, hit and not gone, hit and gone, hit and sum(fails.values()) == 1, hit and not gone and good, hit and not gone and toxic]):
                    row[j] += int(v)
                gone = gone or hit
    shapley = Counter()
    for (part, order, k), row in out.items():
        shapley[part, order[k - 1]] += row[1]
    return {(part, order, k): (*row, shapley[part, order[k - 1]]) for (part, order, k), row in out.items()}


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(250))
    more = [(20 + i, t, s) for i, t in enumerate([text, text, text + " #", "a " * 300, None, text]) for s in ("a", None)] + [(3, text, "z"), (None, text, "z"), (None, text, "a")]
    docs = odd_docs(spark).select("doc_id", "text", "source", "n_chars", "root").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    labels = [(1, 1, 0), (1, 0, 1), (20, 1, 0), (21, 0, 1), (22, None, 1), (3, 1, 1), (None, 1, 1), (99, 1, 1)]
    marks = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = audit.audit(docs.withColumn("n", F.lit(1)).withColumn("mask", F.lit(2)), marks)
    assert audit_rows(got) == brute_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels)
    assert audit.audit(empty_docs(spark), marks).count() == 0
    alone = audit.audit(docs, marks.limit(0))
    assert alone.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_fields_hold_large_counts(spark):
    n = (1 << 62) - 1
    counts = spark.createDataFrame([("p", 3, n, 1, 0), ("p", 3, 5, 0, 1), ("p", 0, n - 5, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): r for r in audit.interactions(counts, "ab").collect()}
    assert got["ab", 1]["removed"] == n + 5 == got["ba", 1]["removed"] and got["ab", 2]["redundant"] == n + 5
    assert got["ba", 2]["kept"] == n - 5 and got["ab", 1]["good_lost"] == 1 and got["ab", 2]["unique_fails"] == 0


@pytest.mark.parametrize("size", [10, 1 << 20])
def test_words_of_long_texts(monkeypatch, size):
    monkeypatch.setattr(audit, "PIECE", size)
    text = " \t".join(f"wörd{i % 50}" * (1 + i % 9) for i in range(3000)) + "\x0b\x1cend\n"
    w = re.findall("[^\x20\x09-\x0d]+", text)
    assert audit._count_words(text.encode()) == (len(w), len(set(w)))
    assert len(words_of(text)) == len(w)
