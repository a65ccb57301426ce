"""One query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import audit, classlm, decontaminate, langid, licences, quality
from tidecast.llm.jaccard import jaccard_classes
from tidecast.llm.near_vectors import near_duplicate_vectors
from tidecast.llm.packing import pack_documents
from tidecast.llm.registry import ORACLES, QUERIES, query, table
from tidecast.llm.resample import importance_resample
from tidecast.llm.search import top_k
from tidecast.llm.sharding import shuffle_into_shards
from tidecast.llm.warc import LEAST_PAYLOAD, read_archives, write_archives
from tidecast.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_bm25")
def op3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return top_k(docs, asked, k=10)


def remainder(column: str, by: int):
    """``crc32`` of a value as text, modulo ``by``; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = langid.fit_dictionaries(docs.filter(remainder("doc_id", 3) != 1))
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


@query(
    "op5_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
    f AS (SELECT *, CASE WHEN size >= {LEAST_PAYLOAD} THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p)
    SELECT page_id, size::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), archives)
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def licence_sql() -> str:
    """Every non-empty line against every template, sizes bounds left out."""
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in licences.bigrams_of(body))}])" for name, body in licences.TEMPLATES.items())
    lower = f"translate(l, '{decontaminate.UPPER}', '{decontaminate.UPPER.lower()}')"
    return f"""
    WITH t(licence, own) AS (VALUES {values}),
    lines AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents),
    each_line AS (SELECT r, doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS l FROM lines),
    words AS (SELECT r, doc_id, line, regexp_extract_all({lower}, '[a-z0-9]+') AS w FROM each_line),
    grams AS (
        SELECT r, doc_id, line,
               list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g
        FROM words WHERE len(w) > 0
    ),
    alike AS (
        SELECT r, doc_id, line, licence, 2 * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice
        FROM grams, t WHERE list_has_any(g, own)
    )
    SELECT doc_id, line, licence, dice FROM alike WHERE dice * 100 >= {licences.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, licence) = 1
    """


@query("op6_licences", licence_sql())
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op7_jaccard")
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard_classes(table(spark, sf_dir, "documents"), n=3, percent=90)
    return classes.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@query("op8_class_lm")
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.UPPER.lower()}'), '{SPLIT}')"


@query(
    "op10_decontamination",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
    bw AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, n, list_slice(w, pos, pos + n - 1) AS run FROM bw),
    sizes AS (SELECT DISTINCT n FROM windows),
    dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n),
    hits AS (SELECT r, pos, windows.n, item FROM dw JOIN windows ON windows.n = dw.n AND windows.run = list_slice(w, pos, pos + dw.n - 1)),
    covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY r),
    items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
    """,
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return marked.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op11_near_vectors",
    """
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (
        SELECT r, e, sqrt(list_dot_product(e, e)) AS norm FROM v
        WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
    ),
    links AS (
        SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e)
        WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
    ),
    reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
    roots AS (SELECT reach.x AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
    counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM v JOIN roots USING (r) LEFT JOIN counts USING (r)
    """,
)
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.select("vec_id", "n_links", "component_id", "kept")


#: Every distinct feature's crc32 is taken byte by byte from a table that its own rule gives.
RESAMPLE = f"""
    WITH crc AS (
        SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t
        FROM range(256) AS r(i)
    ),
    dw AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    tw AS (SELECT {WORDS} AS w FROM benchmark),
    df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM dw),
    tf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM tw),
    all_f AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM tf)),
    bytes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) AS b FROM all_f),
    codes AS (
        SELECT f, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[1 + xor(a & 255, x)]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
        FROM bytes, crc
    ),
    dc AS (SELECT r, bucket FROM df JOIN codes USING (f)),
    own AS (SELECT bucket, count(*) AS s FROM dc GROUP BY bucket),
    target AS (SELECT bucket, count(*) AS t FROM tf JOIN codes USING (f) GROUP BY bucket),
    gains AS (
        SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)
               / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tf) + 10000))))::BIGINT AS gain
        FROM range(10000) AS b(bucket) LEFT JOIN own USING (bucket) LEFT JOIN target USING (bucket)
    ),
    sums AS (SELECT r, count(*) AS n, sum(gain) AS total FROM dc JOIN gains USING (bucket) GROUP BY r),
    weighed AS (
        SELECT dw.r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
               CASE WHEN n > 0 THEN floor(total / n)::BIGINT ELSE 0 END AS weight,
               ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
        FROM dw LEFT JOIN sums USING (r)
    ),
    scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
    placed AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) OVER () AS able
        FROM scored WHERE n_words >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 25 // 100 THEN place END AS rank
    FROM scored LEFT JOIN placed USING (r)
    """


@query("op12_resample", RESAMPLE)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op13_filter_audit",
    r"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
    marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    fails AS (
        SELECT r, part, coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic,
               MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                    'C': 100 * (strlen(text) - strlen(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
                    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, false)} AS f
        FROM w LEFT JOIN marks USING (doc_id)
    ),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ),
    steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
    each AS (
        SELECT part, filter_order, step, filter_order[step] AS letter, good, toxic, f[filter_order[step]] AS hit,
               len(list_filter(range(1, step), lambda k: f[filter_order[k]])) > 0 AS gone,
               len(list_filter(map_values(f), lambda v: v)) = 1 AS once
        FROM fails, steps
    ),
    counted AS (
        SELECT part, filter_order, step, letter AS filter, count(*) FILTER (NOT gone AND NOT hit) AS kept, count(*) FILTER (hit AND NOT gone) AS removed,
               count(*) FILTER (hit AND gone) AS redundant, count(*) FILTER (hit AND once) AS unique_fails,
               count(*) FILTER (hit AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (hit AND NOT gone AND toxic = 1) AS toxic_lost
        FROM each GROUP BY ALL
    )
    SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
