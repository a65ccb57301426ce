"""Licence notices and texts in documents, by the Dice coefficient over word bigrams.

A text is lowered and reduced to words of letters and digits; bigrams (a single word stands for itself) are compared with
those of each template. Lines are compared with one-line notices as a whole. Besides, windows over the whole text, of as
many words as the template has, are compared with notices, header notices and full texts, so that a notice inside a longer line
or over several lines and a licence text of any layout are found.

Two sets of sizes a and b cannot be more alike than ``2 min(a, b) / (a + b)``, so templates whose size rules the threshold
out are not compared. A window that reaches p shares at least ``p / (2 - p)`` of the template's bigrams: only windows with
so many occurrences of them are looked at, which leaves out none that could reach it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.licence_texts import TEXTS
from tidecast.llm.words import mix, slices, span_hashes, text_bytes, word_spans

#: Usual one-line notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Released under the 3-clause BSD License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
THRESHOLD = 80  # percent


WORD = re.compile("[a-z0-9]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def bigrams_of(text: str) -> list[str]:
    """Distinct bigrams, sorted, of the words of letters and digits; ``A``-``Z`` count as ``a``-``z``."""
    words = WORD.findall(text.translate(LOWER))
    return sorted({" ".join(p) for p in zip(words, words[1:])} or set(words))


def best_template(grams: set[str], known: dict[str, frozenset[str]], percent: int) -> tuple[str, float] | None:
    """The template most alike, and how much, if that is ``percent`` or more; of equals the first by name."""
    best = None
    for name in sorted(known):
        own = known[name]
        both = len(grams) + len(own)
        if 200 * min(len(grams), len(own)) < percent * both:
            continue
        alike = 2 * len(grams & own) / both
        if alike * 100 >= percent and (best is None or alike > best[1]):
            best = name, alike
    return best


_PLAIN = np.full(256, 32, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _PLAIN[_c] = _c
_PLAIN[65:91] = np.arange(97, 123)


def bigram_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every bigram of words of letters and digits, where each text's begin, first byte of each in its text, and
    the byte after it."""
    raw, at = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = _PLAIN[raw]
    first, last = word_spans(plain, at)
    words = span_hashes(plain, first, last)
    owner = np.searchsorted(at, first, "right") - 1
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    mine = owner[pair]
    grams = mix(words[pair] * np.uint64(0x9DDFEA08EB382D69) + words[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
    return grams, np.searchsorted(mine, np.arange(len(at))), first[pair] - at[mine], last[pair + 1] - at[mine]


class Windows:
    """Templates of two words and more, for windows of their size."""

    def __init__(self, templates: list[tuple[str, str, bool]], percent: int) -> None:
        hashes = [bigram_hashes(pa.array([body]))[0] for _, body, _ in templates]
        some = [k for k, h in enumerate(hashes) if len(h)]
        self.percent = percent
        self.names, self.notice = [templates[k][0] for k in some], [templates[k][2] for k in some]
        self.width = [len(hashes[k]) for k in some]  # bigrams, repeated ones too
        self.own = [np.unique(hashes[k]) for k in some]
        self.need = np.array([max(-(-percent * len(own) // (200 - percent)), 1) for own in self.own], np.int64)
        self.every = np.unique(np.concatenate(self.own)) if some else np.zeros(0, np.uint64)
        self.member = np.array([np.isin(self.every, own) for own in self.own]).T if some else np.zeros((0, 0), bool)

    def likely(self, grams: np.ndarray, begin: np.ndarray) -> list[tuple[int, int]]:
        """Texts and templates that share as many distinct bigrams as a window needs."""
        if not len(self.every) or not len(grams):
            return []
        spot = np.minimum(np.searchsorted(self.every, grams), len(self.every) - 1)
        hit = np.flatnonzero(self.every[spot] == grams)
        owner = np.searchsorted(begin, hit, "right") - 1
        pairs = np.unique(owner * len(self.every) + spot[hit])
        owner, gram = np.divmod(pairs, len(self.every))
        texts, head, count = np.unique(owner, return_index=True, return_counts=True)
        out = []
        for text, i, n in zip(texts.tolist(), head.tolist(), count.tolist()):
            if n >= self.need.min():
                out += [(text, t) for t in np.flatnonzero(self.member[gram[i : i + n]].sum(0) >= self.need).tolist()]
        return out

    def places(self, grams: np.ndarray, t: int) -> list[tuple[int, int, int, float]]:
        """First bigram, the one after the last, shared ones and likeness of the best window of each run of overlapping
        windows that reach the threshold."""
        own, width, need = self.own[t], min(self.width[t], len(grams)), int(self.need[t])
        total = np.concatenate([[0], np.cumsum(np.isin(grams, own))])
        begins = np.flatnonzero(total[width:] - total[:-width] >= need).tolist()
        known, seen, out = set(own.tolist()), {}, []
        shared, at, run_end, all_grams = 0, None, -1, grams.tolist()

        def put(k: int) -> None:
            nonlocal shared
            g = all_grams[k]
            seen[g] = seen.get(g, 0) + 1
            shared += seen[g] == 1 and g in known

        def take(k: int) -> None:
            nonlocal shared
            g = all_grams[k]
            seen[g] -= 1
            if not seen[g]:
                del seen[g]
                shared -= g in known

        for i in begins:
            if at is not None and i < at + width:
                for k in range(at, i):
                    take(k)
                for k in range(at + width, i + width):
                    put(k)
            else:
                seen, shared = {}, 0
                for k in range(i, i + width):
                    put(k)
            at = i
            alike = 2 * shared / (len(seen) + len(own))
            if alike * 100 >= self.percent:
                if i >= run_end:
                    out.append((i, i + width, shared, alike))
                elif alike > out[-1][3]:
                    out[-1] = (i, i + width, shared, alike)
                run_end = i + width
        return out

    def find(self, texts: pa.Array, taken: dict[int, set[int]]) -> list[tuple[int, int, str, float]]:
        """Text, line of the first word, name and likeness of all spans; of overlapping ones that which shares most
        bigrams. Notices that touch a line of ``taken`` are left out."""
        grams, begin, first, last = bigram_hashes(texts)
        found: dict[int, list] = {}
        for text, t in self.likely(grams, begin):
            a, b = begin[text], begin[text + 1]
            found.setdefault(text, []).extend((-shared, -alike, self.names[t], i, j, t) for i, j, shared, alike in self.places(grams[a:b], t))
        out = []
        for text, spans in found.items():
            breaks = np.flatnonzero(np.frombuffer(texts[text].as_py().encode(), np.uint8) == 10)
            kept: list[tuple[int, int]] = []
            for _, alike, name, i, j, t in sorted(spans):
                if any(i < y and x < j for x, y in kept):
                    continue
                a = begin[text]
                top, bottom = np.searchsorted(breaks, [first[a + i], last[a + j - 1] - 1]).tolist()
                if self.notice[t] and any(top <= n <= bottom for n in taken.get(text, ())):
                    continue
                kept.append((i, j))
                out.append((text, top, name, -alike))
        return out


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, percent: int = THRESHOLD) -> DataFrame:
    """``(doc_id, line, licence, dice)``: the most alike notice of every line that reaches ``percent``, and every other span
    of the text that does, with the line in which it begins.

    Lines are counted from 0 in the whole text. Of templates equally alike the first by name is given. Null, empty and
    wordless lines match nothing; repeated rows repeat their matches; a text of any length is scanned whole, line by line
    and in windows; without templates or rows the result is empty.
    ``templates`` takes the place of the notices and of ``TEXTS``.
    """
    bodies = [(name, body, True) for name, body in (TEMPLATES if templates is None else templates).items()]
    if templates is None:
        bodies += [(name, body, False) for name, each in TEXTS.items() for body in each]
    known = {name: frozenset(bigrams_of(body)) for name, body in (TEMPLATES if templates is None else templates).items()}
    known = {name: grams for name, grams in known.items() if grams}
    every = sorted({g for own in known.values() for g in own})
    some = "(?i)" + "|".join(g.replace(" ", "[^a-z0-9]+") for g in every)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "line", "licence", "dice"]
    shared = docs.sparkSession.sparkContext.broadcast(Windows(bodies, percent))  # the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_line = re.compile(some)
        for batch in batches:
            for part in slices(batch):
                found, taken = [], {}
                hit = pc.fill_null(pc.match_substring_regex(part.column("text"), some), False).to_numpy(zero_copy_only=False) if every else np.zeros(part.num_rows, bool)
                for k in np.flatnonzero(hit).tolist():
                    for n, line in enumerate(part.column("text")[k].as_py().split("\n")):
                        if in_line.search(line) and (best := best_template(set(bigrams_of(line)), known, percent)):
                            found.append((k, n, *best))
                            taken.setdefault(k, set()).add(n)
                found += shared.value.find(part.column("text"), taken)
                if found:
                    k, n, licence, alike = (list(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(k)), pa.array(n, pa.int64()), pa.array(licence), pa.array(alike)], names
                    )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, line long, licence string, dice double")
