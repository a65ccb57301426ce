"""Quality of a document by attention over its passages, learned from document labels alone.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded from what its bytes and words are
like; gated attention weights the encodings, and a logistic unit scores the weighted mean. All weights are learned
together from a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.sampling import first_of_each
from tidecast.llm.words import slices, span_hashes, text_bytes, word_spans

PASSAGE_WORDS = 48
SAMPLE_ROWS = 1500  # labelled documents per class
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 300, 0.02, 1e-4
THRESHOLD = 0.3
CLASSES = 16


def _byte_classes() -> np.ndarray:
    """Class of each byte; what is not named is in class 0."""
    out = np.zeros(256, np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", "!", "|", "#$%&*@^~", ".,;:?", "'\"()[]{}<>", "+-=/\\_`"]
    for k, group in enumerate(groups, 1):
        out[list(group.encode())] = k
    out[0x80:0xC0], out[0xC3], out[0xC4:0xE0], out[0xE0:] = 12, 13, 14, 15
    return out


_CLASS = _byte_classes()


def passage_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of each text, and where each text's passages begin.

    Shares of the byte classes; mean length of words; shares of words that repeat the one before, that are distinct and
    that are upper-case; and the number of words. A text without words is one passage of zeros.
    """
    raw, at = text_bytes(texts)
    start, end = word_spans(raw, at) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.searchsorted(start, at)
    words = np.diff(first)
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    begin = np.concatenate([[0], np.cumsum(passages)])
    out = np.zeros((begin[-1], CLASSES + 5))
    if not len(start):
        return out, begin
    place = np.arange(len(start)) - np.repeat(first[:-1], words)
    passage = place // PASSAGE_WORDS + np.repeat(begin[:-1], words)
    head = np.flatnonzero(place % PASSAGE_WORDS == 0)
    last = np.append(head[1:], len(start)) - 1
    span = np.diff(np.append(start[head], end[-1]))
    byte_passage = np.repeat(passage[head], span)
    stretch = raw[start[0] : end[-1]]
    counts = np.bincount(byte_passage * CLASSES + _CLASS[stretch], minlength=len(out) * CLASSES).reshape(-1, CLASSES)
    n = np.bincount(passage, minlength=len(out))
    some = np.maximum(n, 1)
    out[:, :CLASSES] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    h = span_hashes(raw, start, end)
    out[:, CLASSES] = np.bincount(passage, end - start, len(out)) / some / 10
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    out[:, CLASSES + 1] = np.bincount(passage, again, len(out)) / some
    order = np.lexsort((h, passage))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    out[:, CLASSES + 2] = np.bincount(passage[order], new, len(out)) / some
    loud = (_CLASS[raw[start]] == 2) & (_CLASS[raw[np.minimum(start + 1, len(raw) - 1)]] == 2)
    out[:, CLASSES + 3] = np.bincount(passage, loud, len(out)) / some
    out[:, CLASSES + 4] = np.log1p(n) / 4
    return out, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh((x - m["mean"]) / m["sd"] @ m["w"] + m["b"])
    t, g = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    a = (t * g) @ m["a"]
    bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    e = np.exp(a - np.maximum.reduceat(a, begin[:-1])[bag])
    s = e / np.add.reduceat(e, begin[:-1])[bag]
    z = np.add.reduceat(h * s[:, None], begin[:-1])
    return {"h": h, "t": t, "g": g, "s": s, "z": z, "bag": bag, "p": _sigmoid(z @ m["c"] + m["d"])}


def train(x: np.ndarray, begin: np.ndarray, y: np.ndarray, seed: int = 9) -> dict[str, np.ndarray]:
    """Weights that fit the bags' labels, by Adam on the cross-entropy of all bags at once; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    m = {
        "w": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
    }
    fixed = {"mean": x.mean(0), "sd": x.std(0) + 1e-3}
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    one = {k: np.zeros_like(v) for k, v in m.items()}
    two = {k: np.zeros_like(v) for k, v in m.items()}
    scaled = (x - fixed["mean"]) / fixed["sd"]
    for step in range(1, STEPS + 1):
        f = _forward({**m, **fixed}, x, begin)
        h, t, g, s, bag = f["h"], f["t"], f["g"], f["s"], f["bag"]
        top = (f["p"] - y) * weight
        dz = top[:, None] * m["c"]
        ds = (dz[bag] * h).sum(1)
        da = s * (ds - np.add.reduceat(s * ds, begin[:-1])[bag])
        dt = da[:, None] * m["a"] * g * (1 - t**2)
        dg = da[:, None] * m["a"] * t * g * (1 - g)
        dh = (s[:, None] * dz[bag] + dt @ m["v"].T + dg @ m["u"].T) * (1 - h**2)
        grad = {"w": scaled.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ da, "c": f["z"].T @ top, "d": top.sum(keepdims=True)}
        for k in m:
            slope = grad[k] + DECAY * m[k]
            one[k] = 0.9 * one[k] + 0.1 * slope
            two[k] = 0.999 * two[k] + 0.001 * slope**2
            m[k] = m[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return {**m, **fixed}


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> dict:
    """Weights learned from at most ``rows`` labelled documents of each class, those with the smallest hashes of the id.

    Rows whose label is not 0 or 1, and labels without a document, are left out; an id with both labels counts in both
    classes. Of texts that share an id the one whose features come first is taken. Without any labelled document, and so
    with an empty table, the weights are empty, and every score is 0.5.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL").distinct()
    picked = first_of_each(known.withColumn("code", F.xxhash64("id")), "y", ["code", "id"], rows).select("id", "y")
    rows_of = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, begin = passage_features(part.column("text"))
                cells = [x[a:b].astype(np.float32).tobytes() for a, b in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(cells, pa.binary())], ["id", "y", "x"])

    found = rows_of.mapInArrow(encode, f"id {rows_of.schema['id'].dataType.simpleString()}, y int, x binary")
    found = found.groupBy("id", "y").agg(F.min("x").alias("x"))
    got = sorted(((r["id"], r["y"], r["x"]) for r in found.collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    if not got:
        return {}
    bags = [np.frombuffer(x, np.float32).reshape(-1, CLASSES + 5).astype(float) for _, _, x in got]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in bags])])
    return train(np.concatenate(bags), begin, np.array([y for _, y, _ in got]))


def score(docs: DataFrame, model: dict, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from ``threshold`` on); these names are replaced.

    Null, empty and wordless texts are scored as one blank passage, texts of any length by all their passages. Repeated
    rows are scored one by one; an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    keep = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x, begin = passage_features(part.column(text))
                p = _forward(known.value, x, begin)["p"] if known.value else np.full(part.num_rows, 0.5)
                more = [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "score", "predicted"])

    return keep.mapInArrow(run, f"{schema}, score double, predicted int")
