"""Parsers on files and texts, sinks, and streams against batch."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidecast.operators import vintage
from tidecast.sources import payloads, readers, releases
from tidecast.streaming import jobs


def test_csv(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("date,x1,x2\n2020-01-01,1.5,\n2020-02-01,oops,3\n")
    rows = readers.read_wide_csv(spark, str(tmp_path / "wide.csv"), ["x1", "x2"]).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2020, 1, 1), 1.5, None), (dt.date(2020, 2, 1), None, 3.0)]


def test_a_date_column_is_required(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError):
        readers.read_panel(spark, path)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "vintage string, v double")
    readers.write_parquet(df, str(tmp_path / "p"), ["vintage"])
    readers.write_parquet(df.filter("vintage = 'a'"), str(tmp_path / "p"), ["vintage"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    readers.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_records_in_both_shapes(spark):
    rec = [{"date": "2020-01-01", "x": 1.0}, {"date": "2020-02-01", "x": None}]
    df = spark.createDataFrame([(1, json.dumps(rec)), (2, json.dumps({"value": rec}))], "id int, payload string")
    assert payloads.json_records(df, "date date, x double").groupBy("id").count().filter("count = 2").count() == 2


def test_rates(spark):
    nested = {"data": {"rate": [{"date": "2020-01-01", "buying_rate": "n/a", "selling_rate": "4.2"}, {"date": "bad", "buying_rate": "1"}]}}
    flat = {"rate": [{"date": "2020-01-02", "buying_rate": 4, "selling_rate": 5}]}
    df = spark.createDataFrame([(json.dumps(nested),), (json.dumps(flat),)], "payload string")
    rows = payloads.json_rates(df, ["buying_rate", "selling_rate"]).orderBy("date").collect()
    assert [r["value"] for r in rows] == [4.2, 4.0]


def test_observations(spark):
    rows = [("long", str(i)) for i in range(24)] + [("long", "."), ("short", "1")]
    df = spark.createDataFrame(rows, "series_id string, value string")
    assert payloads.observations(df, ["series_id"]).count() == 24


@pytest.mark.parametrize("title,want", [
    ("Index of Industrial Production, March 2026", (2026, 3, 3)),
    ("Gross Domestic Product First Quarter 2026", (2026, 1, 3)),
    ("Consumer Price Index, April 2026", (2026, 4, 4)),
    ("Q3 2025 Services", (2025, 7, 9)),
    ("Review 2024 of the fourth quarter", (2024, 10, 12)),
    ("Annual report 2023", (2023, None, None)),
    ("No period at all", (None, None, None)),
])
def test_reference_period(spark, title, want):
    row = spark.createDataFrame([(title,)], "title string").select(releases.reference_period(F.col("title")).alias("p")).first()["p"]
    assert tuple(row) == want


@pytest.mark.parametrize("title,want", [
    ("Services Producer Price Index 2024", "ppi"),  # the earlier rule wins
    ("Gross Domestic Product Second Quarter 2025", "gdp"),
    ("Advance Gross Domestic Product Q1", "gdp_advance"),
    ("Household Survey", None),
])
def test_titles(spark, title, want):
    assert spark.range(1).select(releases.match_title(F.lit(title)).alias("x")).first()["x"] == want


def test_calendar_file(spark, tmp_path):
    text = "\r\n".join([
        "BEGIN:VCALENDAR", "BEGIN:VEVENT", "DTSTART:20260512T120000", "SUMMARY:Consumer Price Index, April 2026", "END:VEVENT",
        "BEGIN:VEVENT", "SUMMARY:no start", "END:VEVENT", "BEGIN:VEVENT", "DTSTART:20260513T120000", "SUMMARY:Unknown thing", "END:VEVENT", "END:VCALENDAR",
    ])
    (tmp_path / "2026.ics").write_text(text)
    events = releases.parse_ics(releases.read_ics(spark, str(tmp_path)))
    assert events.count() == 2
    row = releases.schedule(events).first()
    assert (row["series_id"], row["ref_period"], row["release_date"]) == ("cpi_headline", dt.date(2026, 4, 1), dt.date(2026, 5, 12))
    assert releases.keyword_filter(events, ["PRICE"]).count() == 1


def test_release_rows(spark):
    rows = [(" 5 March 2024", "A ", "Jan"), ("2024-03-06", "B", "Feb"), ("soon", "A", "x"), ("2024-03-07", "", "x")]
    df = spark.createDataFrame(rows, "release_date string, title string, reference_period string")
    known = spark.createDataFrame([("A", "a")], "title string, dataset_id string")
    out = releases.parse_release_table(df, known).orderBy("release_date").collect()
    assert [(r["release_date"], r["dataset_id"]) for r in out] == [(dt.date(2024, 3, 5), "a"), (dt.date(2024, 3, 6), None)]


def test_forecast_table(spark):
    page = """<tr class=x><td>Overview</td><td>1</td><td>2</td></tr><tr><th>h</th></tr>
    <tr><td><a>Exports</a> (MYR Million)</td><td>1</td><td>1,234.5</td>
    <td> 5% </td><td>-</td></tr><tr><td>x</td><td>1</td></tr>"""
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    out = releases.parse_forecast_tables(df, ["Q1", "Q2", "Q3", "Q4"])
    rows = out.withColumn("component", releases.component_of(F.col("indicator"))).orderBy("label").collect()
    assert [(r["component"], r["label"], r["value"]) for r in rows] == [("exports", "Q1", 1234.5), ("exports", "Q2", 5.0)]


def test_load_series(spark):
    rows = [("2020-01-01", "abs", 1, 5.0), ("2020-01-01", "abs", 2, 6.0), ("2020-01-01", "growth", 3, 7.0), ("2020-02-01", "abs", 4, None)]
    df = spark.createDataFrame(rows, "date string, series string, k int, v double")
    specs = [{"series_id": "a", "value_col": "v", "filters": {"series": "abs", "division": "x"}}, {"series_id": "b", "value_col": "v"}]
    out = payloads.load_series(df, specs, order="k").orderBy("series_id").collect()
    assert [(r["series_id"], r["value"]) for r in out] == [("a", 5.0), ("b", 5.0)]


FEED = "quarter string, metric string, seen_date date, value double, base_year int"


def test_stream_equals_batch_when_releases_arrive_out_of_order(spark, tmp_path):
    d = dt.date
    batches = [
        [("2024-Q1", "gdp", d(2024, 6, 1), 2.0, 2015), ("2024-Q1", "cpi", d(2024, 6, 1), None, 2015)],
        [("2024-Q1", "gdp", d(2024, 5, 1), 1.5, 2015), ("2024-Q2", "gdp", d(2024, 8, 1), 3.0, 2015)],
        [("2024-Q1", "gdp", d(2024, 9, 1), 2.5, 2020), ("2024-Q1", "cpi", d(2024, 7, 1), 4.0, None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    folder = jobs.run_to_table(jobs.first_release_updates(stream), "update")
    got = jobs.frozen_table(spark.read.parquet(folder))
    everything = spark.createDataFrame([r for b in batches for r in b], FEED)
    want = vintage.freeze_first_release(everything).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_old_releases_leave_the_state(spark, tmp_path):
    d = dt.date
    batches = [
        [(f"2020-Q{q}", "gdp", d(2020, 2 * q, 1), float(q), None) for q in (1, 2, 3, 4)],
        [("2020-Q4", "gdp", d(2020, 7, 20), 3.5, 2015), ("2020-Q4", "gdp", d(2020, 9, 1), 9.0, None)],
        [("2022-Q1", "gdp", d(2022, 5, 1), 7.0, 2015)],
        [("2022-Q2", "gdp", d(2022, 6, 1), 8.0, 2015), ("2020-Q1", "gdp", d(2022, 6, 2), 0.5, 2020)],
    ]
    root, state = str(tmp_path / "out"), []

    def keep(batch, i):
        batch.write.mode("overwrite").parquet(f"{root}/data/b={i}")

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        stream = spark.readStream.schema(FEED).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = jobs.first_release_updates(stream, late=60, keep=200).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        state.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    # four keys (and their timers) are held; a watermark of March 2022 forgets them all
    assert state[1] >= 4 and state[2] < state[1], state
    got = {r["quarter"]: r for r in jobs.frozen_table(spark.read.parquet(f"{root}/data")).collect()}
    late = got["2020-Q4"]
    assert (late["first_release_date"], late["first_value"], late["base_year"], late["latest_value"]) == (d(2020, 7, 20), 3.5, 2015, 9.0)
    # a key that comes back after it was forgotten keeps its first value
    back = got["2020-Q1"]
    assert (back["first_value"], back["latest_value"], back["base_year"], back["last_update_date"]) == (1.0, 0.5, None, d(2022, 6, 2))


def test_log_stream_last_wins(spark, tmp_path):
    schema = "run_date string, loaded int, value double"
    table = str(tmp_path / "log")
    for i, rows in enumerate([[("d1", 1, 1.0), ("d2", 1, 2.0)], [("d2", 2, 9.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.upsert_stream(stream, table, ["run_date"], "loaded", str(tmp_path / "check")).awaitTermination()
    rows = jobs.read_log(spark, table, ["run_date"], "loaded").orderBy("run_date").collect()
    assert [(r["run_date"], r["value"]) for r in rows] == [("d1", 1.0), ("d2", 9.0)]
    jobs.compact_log(spark, table, ["run_date"], "loaded", str(tmp_path / "compact"))
    assert jobs.read_log(spark, str(tmp_path / "compact"), ["run_date"], "loaded").count() == 2
