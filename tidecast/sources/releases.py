"""Release calendars and forecast tables from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.numeric import to_number

# fixed values: title fragments and the series they announce; the first match counts
TITLE_RULES = [
    ("index of industrial production", "ipi"),
    ("monthly manufacturing statistics", "ipi"),
    ("consumer price index", "cpi_headline"),
    ("producer price index", "ppi"),
    ("labour force statistics", "u_rate"),
    ("labour force survey report", "u_rate"),
    ("employment statistics", "u_rate"),
    ("monthly external trade statistics", "external_trade"),
    ("malaysia external trade indices", "external_trade"),
    ("export import statistics", "external_trade"),
    ("performance of wholesale", "wrt"),
    ("volume index of wholesale", "wrt"),
    ("quarterly services statistics", "services"),
    ("volume index of services", "services"),
    ("construction statistics", "construction"),
    ("monthly rubber statistics", "rubber"),
    ("gross domestic product first quarter", "gdp"),
    ("gross domestic product second quarter", "gdp"),
    ("gross domestic product third quarter", "gdp"),
    ("gross domestic product fourth quarter", "gdp"),
    ("gross domestic product 20", "gdp"),
    ("advance gross domestic product", "gdp_advance"),
    ("leading, coincident & lagging", "leading"),
    ("malaysian economic indicators", "leading"),
    ("business tendency statistics", "business_tendency"),
    ("labour productivity", "productivity"),
    ("quarterly balance of payments", "bop"),
    ("international investment position", "iip"),
    ("services producer price index", "services_ppi"),
    ("manufacturing industry capacity", "capacity_utilisation"),
]
# fixed values: words for months and quarters
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
QUARTERS = ["first quarter", "second quarter", "third quarter", "fourth quarter", "q1", "q2", "q3", "q4"]
# fixed values: forecast table headings and component names
HEADINGS = [
    "Markets", "Overview", "GDP", "Labour", "Prices", "Money", "Trade", "Business", "Consumer", "Government", "Housing",
]
COMPONENTS = {
    "Consumer Spending": "consumption",
    "Gross Fixed Capital Formation": "investment",
    "Government Spending": "government",
    "Exports": "exports",
    "Imports": "imports",
}
# fixed values: what names growth of the total, over the year and over the quarter
YEARLY_GROWTH = ["GDP Annual Growth", "GDP Growth Rate YoY"]
QUARTERLY_GROWTH = "GDP Growth Rate"
# fixed value: years that count as such in a title
YEAR = r"(20\d{2})"


def match_title(title: Column, rules: list[tuple[str, str]] = TITLE_RULES) -> Column:
    """Series of the first rule whose fragment the title contains."""
    low = F.lower(title)
    return F.coalesce(*[F.when(low.contains(text), F.lit(series)) for text, series in rules])


def _year(text: Column) -> Column:
    found = F.regexp_extract(text, YEAR, 1)
    return F.when(found != "", found.cast("int"))


def _period(year: Column, first: Column, last: Column) -> Column:
    return F.struct(year.alias("year"), first.cast("int").alias("month_start"), last.cast("int").alias("month_end"))


def reference_period(title: Column) -> Column:
    """(year, first month, last month) named in a title: a quarter, a month, else the year alone."""
    low = F.lower(title)
    options = []
    for i, word in enumerate(QUARTERS):
        q = i % 4
        year = _year(F.substring_index(low, word, -1))
        options.append((low.contains(word) & year.isNotNull(), _period(year, F.lit(3 * q + 1), F.lit(3 * q + 3))))
    for i, word in enumerate(MONTHS):
        found = F.regexp_extract(low, word + r"[,\s]+" + YEAR, 1)
        options.append((found != "", _period(found.cast("int"), F.lit(i + 1), F.lit(i + 1))))
    any_year = _year(low)
    for i, word in enumerate(QUARTERS):
        q = i % 4
        options.append((low.contains(word) & any_year.isNotNull(), _period(any_year, F.lit(3 * q + 1), F.lit(3 * q + 3))))
    none = F.lit(None).cast("int")
    last = _period(any_year, none, none)
    return reduce(lambda rest, o: F.when(o[0], o[1]).otherwise(rest), reversed(options), last)


def with_reference(events: DataFrame) -> DataFrame:
    """Series and reference period of each titled event, each worked out once per row."""
    found = F.struct(match_title(F.col("title")).alias("dataset_id"), reference_period(F.col("title")).alias("ref"))
    return events.select("*", F.inline(F.array(found))).select(
        *events.columns, "dataset_id", F.col("ref.year").alias("ref_year"),
        F.col("ref.month_start").alias("ref_month_start"), F.col("ref.month_end").alias("ref_month_end"),
    )


def read_ics(spark: SparkSession, path: str) -> DataFrame:
    """Calendar files as whole texts in ``value``."""
    return spark.read.text(path, wholetext=True)


def parse_ics(calendars: DataFrame, column: str = "value") -> DataFrame:
    """Events of calendar texts; blocks without a start or a summary are skipped."""
    keep = [c for c in calendars.columns if c != column]
    blocks = calendars.select(*keep, F.explode(F.split(column, "END:VEVENT")).alias("block")).filter(
        F.col("block").contains("BEGIN:VEVENT")
    )
    start = F.regexp_extract("block", r"DTSTART:(\d{8})T", 1)
    title = F.trim(F.regexp_extract("block", r"SUMMARY:([^\r\n]+)", 1))
    return with_reference(
        blocks.select(*keep, F.try_to_timestamp(start, F.lit("yyyyMMdd")).cast("date").alias("release_date"), title.alias("title"))
        .filter((F.col("title") != "") & F.col("release_date").isNotNull())
    )


def parse_release_table(rows: DataFrame, title_map: DataFrame) -> DataFrame:
    """Release rows with dates in either of two formats and an exact title to series map."""
    text = F.trim("release_date")
    when = F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMMM yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    ).cast("date")
    clean = rows.withColumn("release_date", when).withColumn("title", F.trim("title")).withColumn(
        "reference_period", F.trim("reference_period")
    )
    valid = clean.filter(F.col("release_date").isNotNull() & (F.col("title") != ""))
    return valid.join(title_map.select("title", "dataset_id"), "title", "left")


def schedule(events: DataFrame) -> DataFrame:
    """Events with a known series and period, as (series_id, ref_period, release_date, title)."""
    known = events.filter(
        F.col("dataset_id").isNotNull() & F.col("ref_year").isNotNull() & F.col("ref_month_start").isNotNull()
    )
    return known.select(
        F.col("dataset_id").alias("series_id"),
        F.make_date("ref_year", "ref_month_end", F.lit(1)).alias("ref_period"), "release_date", "title",
    )


def keyword_filter(events: DataFrame, words: list[str]) -> DataFrame:
    """Events whose title contains any of the words, whatever the case."""
    low = F.lower("title")
    return events.filter(reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words]))


def indicator_name(cell: Column) -> Column:
    """The first cell of a row without the units in brackets at its end."""
    name = F.regexp_replace(cell, r"\s*\(.*?\)\s*$", "")
    return F.regexp_replace(F.trim(name), r"\s+", " ")


def parse_forecast_tables(pages: DataFrame, labels: list[str], column: str = "html") -> DataFrame:
    """Forecast cells of HTML tables: (page columns..., indicator, label, value).

    A table row has an indicator, an actual and one forecast per label. Units in
    brackets at the end of the indicator go, headings are skipped.
    """
    keep = [c for c in pages.columns if c != column]
    rows = pages.select(
        *keep, F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr")
    )
    cells = F.regexp_extract_all(F.col("tr"), F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    rows = rows.withColumn("cells", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))
    rows = rows.filter(F.size("cells") >= 3).withColumn("indicator", indicator_name(F.get("cells", F.lit(0))))
    rows = rows.filter((F.col("indicator") != "") & ~F.col("indicator").isin(HEADINGS))
    entries = F.array(*[
        F.struct(F.lit(label).alias("label"), to_number(F.get("cells", F.lit(i + 2))).alias("value"))
        for i, label in enumerate(labels)
    ])
    return rows.select(*keep, "indicator", F.inline(entries)).filter(F.col("value").isNotNull())


def component_of(indicator: Column, names: dict[str, str] = COMPONENTS) -> Column:
    """Component whose name the indicator starts with."""
    return F.coalesce(*[F.when(indicator.startswith(prefix), F.lit(key)) for prefix, key in names.items()])


def route_of(indicator: Column) -> Column:
    """What a forecast row is about: ``gdp_yoy``, ``gdp_qoq``, ``component:<name>``, or nothing that is followed."""
    yearly = reduce(lambda a, b: a | b, [indicator.contains(name) for name in YEARLY_GROWTH])
    quarterly = indicator.contains(QUARTERLY_GROWTH) & ~indicator.contains("YoY")
    return F.when(yearly, "gdp_yoy").when(quarterly, "gdp_qoq").otherwise(F.concat(F.lit("component:"), component_of(indicator)))
