"""Find benchmark items inside documents by their runs of words, and remove what was found.

``A``-``Z`` count as ``a``-``z``; a word is a run of characters that are digits, lower-case letters or beyond ASCII. A
window is ``n`` consecutive words of an item; an item of fewer words is one window. The hashes of all windows are
broadcast as a set while their number is within ``most_broadcast`` (beyond it the same join is shuffled), every run of
words of every document is looked up in the set, and hits are verified by their words.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words once A-Z are lower-cased, and before that.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """``A``-``Z`` lowered, all else as it is; ``lower`` does the same, faster, where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def count_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), "")).cast("long")


def item_windows(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``(item, size, phrase, code)``: every window of every item and its hash. Items without words have none."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), _words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    windows = words.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    run = F.slice("w", F.col("at"), F.col("size"))
    return windows.select("item", "size", F.array_join(run, " ").alias("phrase"), F.xxhash64(run).alias("code")).distinct()


def find_windows(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, *, doc_id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", most_broadcast: int = 1 << 21,
) -> DataFrame:
    """``(doc_id, text_code, start, size, item)``: every occurrence of every window, ``start`` counted in words from 0.

    ``text_code`` is a hash of the text, so documents that share an id, or have none, are told apart; repeated rows
    repeat their occurrences. Null and wordless texts or items, and empty tables, give no rows.
    """
    windows = item_windows(benchmark, n, item, item_text)
    sizes, codes = windows.agg(F.sort_array(F.collect_set("size")), F.count("code")).first()
    known = windows.select("size", "code").distinct()
    if codes <= most_broadcast:
        known = F.broadcast(known)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_code"), _words(F.col(text)).alias("w"))
    hits = []
    for size in sizes or [n]:
        at = words.select("doc_id", "text_code", "w", F.posexplode("w").alias("start", "_"))
        run = F.slice("w", F.col("start") + 1, size)
        # only these columns leave the text: its words are never repeated for each of its positions
        runs = at.filter(F.col("start") <= F.size("w") - size).select(
            "doc_id", "text_code", "start", F.lit(size).alias("size"), F.xxhash64(run).alias("code"), F.array_join(run, " ").alias("phrase")
        )
        hits.append(runs.join(known.filter(F.col("size") == size).select("code"), "code", "left_semi").drop("code"))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    return found.join(windows.select("size", "phrase", "item"), ["size", "phrase"]).select("doc_id", "text_code", "start", "size", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, **columns) -> DataFrame:
    """``(doc_id, text_code, n_hit, items, spans)`` of the documents in which a window occurs.

    ``n_hit``: words inside any occurrence; ``items``: sorted ids as strings; ``spans``: maximal runs of hit words as
    ``(start, end)``, end excluded.
    """
    key = ["doc_id", "text_code"]
    found = find_windows(docs, benchmark, n, **columns)
    ends = found.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    by_start = Window.partitionBy(*key).orderBy("start")
    before = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = (F.col("start") > F.col("before")) | (F.col("before") == 0)
    runs = ends.withColumn("before", before).withColumn("run", F.sum(new.cast("int")).over(by_start))
    runs = runs.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy(*key).agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    items = found.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    left, right = spans.alias("l"), items.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.text_code").eqNullSafe(F.col("r.text_code"))
    return left.join(right, same).select("l.doc_id", "l.text_code", "n_hit", "items", "spans")


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``spans`` (replacing columns of these names), row by row."""
    found = contamination(docs, benchmark, n, doc_id=doc_id, text=text, **columns).alias("found")
    base = docs.drop("n_words", "n_hit", "items", "spans").select(
        F.struct("*").alias("doc"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("code"), count_words(F.col(text)).alias("n_words")
    )
    same = F.col("id").eqNullSafe(F.col("found.doc_id")) & (F.col("code") == F.col("found.text_code"))
    return base.join(found, same, "left").select(
        "doc.*", "n_words",
        F.coalesce("found.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("found.items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("found.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """``docs`` without those in which a window of the benchmark occurs; all columns and other rows as they are."""
    found = find_windows(docs, benchmark, n, doc_id=doc_id, text=text, **columns).select(
        F.col("doc_id").alias("found_id"), F.col("text_code").alias("found_code")
    ).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("code"))
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("code") == F.col("found_code"))
    return rows.join(found, same, "left_anti").select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, text: str = "text", **columns) -> DataFrame:
    """``docs`` with hit words and what separates them cut out of ``text``; documents without hits as they are."""
    rows = mark(docs, benchmark, n, text=text, **columns)
    words, gaps = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
    body = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    w, g = F.regexp_extract_all(body, F.lit(words), 1), F.regexp_extract_all(body, F.lit(gaps), 1)
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))
    kept = F.filter(
        F.transform(w, lambda x, i: F.when(~inside(i), F.concat(x, F.get(g, i + 1)))), lambda x: x.isNotNull()
    )
    cut_text = F.trim(F.concat(F.get(g, F.lit(0)), F.array_join(kept, "")))
    return rows.withColumn(text, F.when(F.col("n_hit") > 0, cut_text).otherwise(F.col(text))).select(*docs.columns)
