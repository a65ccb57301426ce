"""Landed files to rows, with every record that cannot be used kept beside them.

A file is cut into records where it lies: a task reads a file, finds the records by a pattern and knows at which byte
each begins. What a record says is worked out by column expressions; a record that says nothing usable gets a ``reason``.
``split`` then gives the rows and the rejected records ``(file, offset, reason, record)`` of one scan.

Files are the unit of reading, so a landing folder may hold any number of them but each must fit into a task. They are
read by Spark's own reader, from whatever store holds them. Partition columns in the path come along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidecast.functions.numeric import to_number
from tidecast.sources import releases

# Records begin and end here; a record that is not closed ends where the next one begins. Group ``r`` is the record.
EVENT = rb"(?P<r>BEGIN:VEVENT.*?(?:END:VEVENT|(?=BEGIN:VEVENT)|(?=END:VCALENDAR)|\Z))"
LINE = rb'(?P<r>(?:[^"\r\n]+|"[^"]*"?)+)'
TABLE_ROW = rb"(?P<r><tr\b.*?(?:</tr>|(?=<tr\b)|(?=</table>)|\Z))"
#: A wrapping object is passed over; what is left are objects without objects inside, strings taken as a whole.
OBJECT = (
    rb'\{\s*"[^"]*"\s*:\s*(?=[\[{])'
    rb'|(?P<r>\{(?:[^{}"]+|"(?:[^"\\]|\\.)*")*(?:\}|(?=[{"])|\Z))'
)
#: Records of a file that go into one batch.
BATCH = 4096


def records(spark: SparkSession, path: str, pattern: bytes, glob: str | None = None) -> DataFrame:
    """``(partition columns..., file, offset, record)`` of all files under ``path``; ``offset`` counts bytes from 0.

    ``file`` is the path below ``path``. An empty file has no records. Bytes that are not UTF-8 are replaced.
    """
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    own = ("path", "modificationTime", "length", "content")
    kept = [f for f in found.schema.fields if f.name not in own]
    files = found.select(*[f.name for f in kept], F.col("path").alias("file"), "content")
    schema = StructType([*kept, StructField("file", StringType()), StructField("offset", LongType()), StructField("record", StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(pattern, re.DOTALL | re.IGNORECASE)
        for batch in batches:
            for i in range(batch.num_rows):
                head = [batch.column(j)[i] for j in range(batch.num_columns - 1)]
                content = batch.column(batch.num_columns - 1)[i].as_py() or b""
                at, texts = [], []
                for m in cut.finditer(content):
                    if m["r"] is not None:
                        at.append(m.start("r"))
                        texts.append(m["r"].decode("utf-8", "replace"))
                    if len(at) == BATCH:
                        yield _batch(head, at, texts, batch.schema)
                        at, texts = [], []
                if at:
                    yield _batch(head, at, texts, batch.schema)

    rows = files.mapInArrow(scan, schema)
    # the reader may spell the folder's own path in another way, so only its last name is looked for
    folder = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    return rows.withColumn("file", F.regexp_replace("file", f"^.*?/{folder}/", ""))


def _batch(head: list[pa.Scalar], at: list[int], texts: list[str], schema: pa.Schema) -> pa.RecordBatch:
    names = [*schema.names[:-1], "offset", "record"]
    return pa.RecordBatch.from_arrays([*[pa.repeat(h, len(at)) for h in head], pa.array(at, pa.int64()), pa.array(texts, pa.string())], names)


class Landed(NamedTuple):
    """Usable rows, and the records that are not usable: file, offset, reason, record."""

    rows: DataFrame
    rejects: DataFrame


ORIGIN = ("file", "offset", "reason", "record")


def split(tagged: DataFrame, columns: list[str]) -> Landed:
    """The rows without a ``reason``, with their ``columns``; the others with where they came from."""
    return Landed(tagged.filter("reason is null").select(*columns), tagged.filter("reason is not null").select(*ORIGIN))


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The reason of the first test that holds, null if none does."""
    return F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in tests])


def _partitions(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("file", "offset", "record")]


def calendar_events(spark: SparkSession, path: str, glob: str | None = None) -> Landed:
    """Events of calendar files: ``(partition columns..., file, release_date, title, dataset_id, ref_...)``.

    Long lines that are folded onto the next one are joined. Rejected are events that are not closed, or have no start,
    a start that is no date, or no title.
    """
    found = records(spark, path, EVENT, glob)
    body = F.regexp_replace("record", r"\r?\n[ \t]", "")
    start = F.regexp_extract(body, r"DTSTART[^:\r\n]*:(\d{8})", 1)
    title = F.trim(F.regexp_extract(body, r"SUMMARY[^:\r\n]*:([^\r\n]+)", 1))
    tagged = found.withColumns({
        "_start": start, "release_date": F.try_to_timestamp(start, F.lit("yyyyMMdd")).cast("date"), "title": title,
        "reason": first_reason(
            (~F.upper("record").endswith("END:VEVENT"), "not closed"), (start == "", "no start"),
            (F.try_to_timestamp(start, F.lit("yyyyMMdd")).isNull(), "no date"), (title == "", "no title"),
        ),
    })
    out = split(tagged, [*_partitions(found), "file", "release_date", "title"])
    return Landed(releases.with_reference(out.rows), out.rejects)


def csv_lines(spark: SparkSession, path: str, columns: list[str], glob: str | None = None) -> DataFrame:
    """Text cells of delimited files with a header, and a ``reason`` for lines of the wrong width.

    Quoted cells may hold commas, doubled quotes and line breaks. The header is the record at the beginning of a file; its
    names are matched without regard to case and order, and a file without one of ``columns`` has all its lines rejected.
    """
    found = records(spark, path, LINE, glob)
    raw = F.regexp_extract_all(F.concat(F.lit(","), "record"), F.lit(r'(?s),("(?:[^"]|"")*"|[^",]*)(?=,|$)'), F.lit(1))
    clean = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    joined = F.length(F.array_join(raw, ",")) == F.length("record")
    cells = found.withColumn("cells", F.when(joined, clean))
    parts = _partitions(found)
    # headers are one row per file; every line meets the header of its file
    heads = cells.filter("offset = 0").select(F.col("file").alias("_file"), F.transform("cells", lambda c: F.lower(F.trim(c))).alias("names"))
    lines = cells.filter("offset > 0").join(heads, F.col("file") == F.col("_file"), "left").drop("_file")
    missing = F.lit(False)
    for c in columns:
        missing = missing | ~F.coalesce(F.array_contains("names", c.lower()), F.lit(False))
    reason = first_reason(
        (missing, "header lacks a column"), (F.col("cells").isNull(), "broken quotes"),
        (F.size("cells") != F.size("names"), "wrong number of cells"),
    )
    values = {c: F.get("cells", F.array_position("names", c.lower()).cast("int") - 1) for c in columns}
    return lines.withColumns({**values, "reason": reason}).select(*parts, "file", "offset", "record", *columns, "reason")


def release_lines(spark: SparkSession, path: str, title_map: DataFrame, glob: str | None = None, extra: list[str] = ()) -> Landed:
    """Releases from delimited files: dates in either of two formats, titles mapped exactly to a dataset or to none.

    Rejected are lines of the wrong width, without a title, or without a date that can be read.
    """
    lines = csv_lines(spark, path, ["release_date", "title", "reference_period", *extra], glob)
    text = F.trim("release_date")
    when = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("d MMMM yyyy", "yyyy-MM-dd")]).cast("date")
    reason = F.coalesce("reason", first_reason(
        (F.coalesce(F.trim("title"), F.lit("")) == "", "no title"), (when.isNull(), "no date"),
    ))
    tagged = lines.withColumn("reason", reason).withColumns({
        "release_date": when, "title": F.trim("title"), "reference_period": F.trim("reference_period")})
    parts = [c for c in _partitions(lines) if c not in ("reason", "release_date", "title", "reference_period", *extra)]
    out = split(tagged, [*parts, "file", "release_date", "title", "reference_period", *extra])
    return Landed(out.rows.join(title_map.select("title", "dataset_id"), "title", "left"), out.rejects)


def json_objects(spark: SparkSession, path: str, fields: dict[str, str], required: list[str] = (), glob: str | None = None) -> Landed:
    """Flat records of JSON files, in a bare list or below any wrapping names: ``(partition columns..., file, fields...)``.

    ``fields`` gives the type of each. Rejected are records that do not parse, lack a required field, or hold a value that
    is not of its type; a field that is null or absent is null.
    """
    found = records(spark, path, OBJECT, glob)
    text = StructType([*[StructField(c, StringType()) for c in fields], StructField("_bad", StringType())])
    parsed = F.from_json("record", text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = found.withColumn("_o", parsed)
    cast = {c: F.col(f"_o.`{c}`").try_cast(kind) for c, kind in fields.items()}
    tests = [(F.col("_o").isNull() | F.col("_o._bad").isNotNull(), "not a record")]
    tests += [(F.col(f"_o.`{c}`").isNull(), f"no {c}") for c in required]
    tests += [(F.col(f"_o.`{c}`").isNotNull() & cast[c].isNull(), f"{c} is no {kind}") for c, kind in fields.items() if kind != "string"]
    tagged = rows.withColumn("reason", first_reason(*tests)).withColumns(cast)
    return split(tagged, [*_partitions(found), "file", *[f"`{c}`" for c in fields]])


def dated_rates(spark: SparkSession, path: str, preference: list[str], glob: str | None = None) -> Landed:
    """Dated rates from JSON files of any of the wrapped shapes: ``(partition columns..., file, date, value)``.

    The value is the first column of ``preference`` that holds a number. Rejected are records that do not parse, have no
    date, or hold no number in any of these columns.
    """
    found = records(spark, path, OBJECT, glob)
    text = StructType([StructField(c, StringType()) for c in ["date", *preference, "_bad"]])
    rows = found.withColumn("_o", F.from_json("record", text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    value = F.coalesce(*[to_number(F.col(f"_o.`{c}`")) for c in preference])
    date = F.col("_o.date").try_cast("date")
    reason = first_reason(
        (F.col("_o").isNull() | F.col("_o._bad").isNotNull(), "not a record"), (date.isNull(), "no date"), (value.isNull(), "no number"),
    )
    return split(rows.withColumns({"reason": reason, "date": date, "value": value}), [*_partitions(found), "file", "date", "value"])


def forecast_cells(spark: SparkSession, path: str, labels: list[str], glob: str | None = None) -> Landed:
    """Forecasts in tables of HTML files: ``(partition columns..., file, indicator, route, label, value)``.

    ``route`` tells what a row is about (``releases.route_of``). Headings and rows of header cells are passed over; rejected
    are rows that are not closed, have fewer than three cells, or hold no number under any label.
    """
    found = records(spark, path, TABLE_ROW, glob)
    cells = F.regexp_extract_all("record", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    rows = found.withColumn("cells", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))
    rows = rows.withColumn("indicator", releases.indicator_name(F.get("cells", F.lit(0))))
    header = F.lower("record").contains("<th") & (F.size("cells") == 0)
    rows = rows.filter(~header & ~F.coalesce(F.col("indicator").isin(releases.HEADINGS), F.lit(False)))
    values = F.array(*[F.struct(F.lit(label).alias("label"), to_number(F.get("cells", F.lit(i + 2))).alias("value")) for i, label in enumerate(labels)])
    numbers = F.filter(values, lambda v: v["value"].isNotNull())
    reason = first_reason(
        (~F.lower("record").endswith("</tr>"), "not closed"), (F.size("cells") < 3, "fewer than three cells"),
        (F.coalesce("indicator", F.lit("")) == "", "no indicator"), (F.size(numbers) == 0, "no number"),
    )
    out = split(rows.withColumns({"reason": reason, "_v": numbers}), [*_partitions(found), "file", "indicator", "_v"])
    parts = [*_partitions(found), "file", "indicator"]
    return Landed(out.rows.select(*parts, releases.route_of(F.col("indicator")).alias("route"), F.inline("_v")), out.rejects)
