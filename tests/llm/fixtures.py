"""Small tables and brute-force versions shared by the tests of the subpackage."""

import collections
import math
import re

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words_of(text)
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else []))


def odd_docs(spark):
    """Nulls, empty, blank, very long, tied and repeated rows, and columns named like those the operators make."""
    long_text = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, "The cat sat on the mat and looked at the other cat", "en", "a", 50),
        (1, "The cat sat on the mat and looked at the other cat", "en", "a", 50),
        (2, "the CAT sat on the mat and looked at the other cat", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", "a", 4),
        (None, "nobody owns this text of some words", "en", "a", 3),
        (None, "nobody owns this text of some words", None, "b", 3),
        (6, long_text, "en", "a", len(long_text)),
        (7, "Ünïcödé wörds ñ ß 東京 \U0001f600", "de", "b", 10),
        (8, "one", "en", "a", 3),
        (8, "another text under the same id", "en", "a", 3),
        (9, "1234 5678 !!!", "xx", "a", 13),
    ]
    clash = ["shard", "slot", "n_words", "n_hit", "items", "spans", "score", "predicted", "accepted", "lang_pred", "id", "code", "found_id", "block", "root", "doc", "text_code"]
    return spark.createDataFrame([(*r, *([7] * len(clash))) for r in rows], DOCS + "".join(f", {c} int" for c in clash))


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def near_copies(seed=3, families=6, copies=9, words=60):
    """Texts of families whose members differ in a few words, with exact copies and shared passages."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 25))
    out = []
    for f in range(families):
        base = list(rng.choice(vocabulary, words)) + (passage if f % 2 else [])
        for c in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = str(rng.choice(vocabulary))
            out.append(" ".join(text) + (" tail" * int(rng.integers(0, 3))))
    out += [out[0], out[0], out[5], out[0].upper()]
    return list(enumerate(out, 100))


def classes(texts, n, percent):
    """Component (smallest id) of each id by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def bm25(texts, queries, k):
    """The best documents of each query by scoring every document."""
    counts = {i: collections.Counter(words_of(t)) for i, t in texts}
    df = collections.Counter(w for c in counts.values() for w in c)
    n, mean = len(counts), sum(sum(c.values()) for c in counts.values()) / len(counts)
    out = {}
    for q, text in queries:
        scores = {}
        for i, c in counts.items():
            v = sum(
                m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                for w, m in collections.Counter(words_of(text)).items() if w in c
            )
            if v > 0:
                scores[i] = v
        out[q] = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out
