"""Language of a text as the one whose dictionary lets zstandard write it in the fewest bytes.

Each language has a raw-content dictionary: lines of a bounded sample of its training texts. Texts and lines are reduced
to lower-case letters and single blanks, so layout, digits and shouting do not matter. The whole text is compressed in
windows of bounded size, once per language, each window by itself: a dictionary saves a bounded number of bytes, so the
share it saves would fall with the length of one output. The prediction is the language with the smallest sum; it is
rejected when the second smallest is narrowly larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.sampling import first_of_each
from tidecast.llm.words import slices

SAMPLE_ROWS = 512  # training texts per language
SAMPLE_CHARS = 4096  # of each of them
DICTIONARY_BYTES = 1 << 17
MOST_LANGUAGES = 512
LEVEL = 6
WINDOW_BYTES = 1 << 14
NARROW = 0.05  # held-out texts of 100 letters and more at sf0.01 have 0.065 at least, texts of no language 0.046 at most
UNKNOWN = "und"


def letters(texts: pa.Array) -> pa.Array:
    """Lower-case letters with one blank for all that stands between; null becomes empty."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\p{L}]+", " "), " ")


def sample(docs: DataFrame, text: str, lang: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(lang, text)``: for each language the texts with the smallest hashes, equal texts once, nulls left out."""
    at = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text <> ''")
    codes = at.select("lang", F.xxhash64("text").alias("code")).distinct()
    picked = first_of_each(codes, "lang", ["code"], rows)
    whole = at.withColumn("code", F.xxhash64("text")).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    return whole.join(F.broadcast(picked), ["lang", "code"]).dropDuplicates(["lang", "code"]).orderBy("lang", "code").select("lang", "text")


def fit_dictionaries(docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary of at most ``size`` bytes for each value of ``lang``, from at most ``SAMPLE_ROWS`` texts of each.

    Lines that occur in the samples of several languages tell nothing and are left out.
    """
    n = docs.select(lang).filter(F.col(lang).isNotNull()).distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: dictionaries would have no bound")
    rows = sample(docs, text, lang).collect()
    lines: dict[str, dict[str, None]] = {}
    for row in rows:
        clean = letters(pa.array(row["text"].split("\n"))).to_pylist()
        lines.setdefault(row["lang"], {}).update(dict.fromkeys(x for x in clean if x))
    several: dict[str, int] = {}
    for own in lines.values():
        for x in own:
            several[x] = several.get(x, 0) + 1
    alone = {k: [x for x in own if several[x] == 1] or list(own) for k, own in lines.items()}
    return {k: " ".join(own).encode()[:size] for k, own in sorted(alone.items()) if own}


_COMPRESSORS: dict[tuple, list] = {}


def _compressors(dictionaries: dict[str, bytes], level: int) -> list:
    import zstandard

    key = (level, *dictionaries.items())
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        made = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def sizes_of(raw: bytes, compressors: list, window: int = WINDOW_BYTES) -> list[int]:
    """Bytes of output of each compressor, over windows of equal size and at most ``window`` bytes."""
    n = max(-(-len(raw) // window), 1)
    parts = [raw[len(raw) * k // n : len(raw) * (k + 1) // n] for k in range(n)]
    return [sum(len(c.compress(x)) for x in parts) for c in compressors]


def judge(sizes: list[int], names: list[str], narrow: float) -> tuple[str, float, bool]:
    """Language, score and acceptance from the compressed sizes; a tie goes to the first name and is rejected."""
    best = min(sizes)
    score = 1 / sum(2.0 ** max(best - s, -1000) for s in sizes)
    rest = sorted(sizes)[1:2]
    wide = not rest or (rest[0] - best) / rest[0] >= narrow
    return names[sizes.index(best)], score, wide


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text", narrow: float = NARROW, level: int = LEVEL) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``accepted`` (these names are replaced), row by row.

    A null text or one without letters is ``und`` with score 0 and rejected; so is every text if there are no
    dictionaries. ``accepted`` is false where the runner-up's output is less than ``narrow`` larger, relative to it; of
    equal outputs the first language by name is given, and not accepted. A text of any length is compressed whole, in
    windows; a text of a few words may save no whole byte with any dictionary, and is then such a tie. Repeated rows are
    judged one by one; an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)  # MOST_LANGUAGES * DICTIONARY_BYTES at most
    keep = docs.drop("lang_pred", "score", "accepted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pressed = list(known.value), _compressors(known.value, level)
        for batch in batches:
            for part in slices(batch, text):
                out = []
                for clean in letters(part.column(text)).to_pylist():
                    raw = clean.encode()
                    out.append(judge(sizes_of(raw, pressed), names, narrow) if raw and names else (UNKNOWN, 0.0, False))
                lang, score, accepted = zip(*out)
                more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "lang_pred", "score", "accepted"])

    return keep.mapInArrow(run, f"{schema}, lang_pred string, score double, accepted boolean")
