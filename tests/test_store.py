"""Published tables and landed files."""

import json
import os
import re

import numpy as np
import pytest
from conftest import factor_data, long_panel
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.plans import daily, nowcast
from tidecast.sources import landed, versioned


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values_of(df):
    return sorted(r["v"] for r in df.collect())


def test_reader_between_write_and_publish(spark, tmp_path):
    root = str(tmp_path / "store")
    assert versioned.versions(spark, root) == [] and versioned.manifest(spark, root) == {}
    versioned.publish(spark, root, {"a": numbers(spark, 1), "b": numbers(spark, 10)})
    opened = versioned.read_table(spark, root, "a")
    entries = versioned.stage({"a": numbers(spark, 2), "b": numbers(spark, 20)}, root, 2)
    # the rows of the next version lie there, and nobody sees them
    assert values_of(versioned.read_table(spark, root, "a")) == [1]
    versioned.commit(spark, root, 2, entries)
    assert [values_of(versioned.read_table(spark, root, n)) for n in "ab"] == [[2], [20]]
    assert values_of(opened) == [1]
    assert values_of(versioned.read_table(spark, root, "b", version=1)) == [10]


def test_tables_that_are_not_named_stay(spark, tmp_path):
    root = str(tmp_path / "store")
    versioned.publish(spark, root, {"a": numbers(spark, 1), "b": numbers(spark, 10)}, formats={"b": "csv"})
    versioned.publish(spark, root, {"a": numbers(spark, 2)})
    versioned.publish(spark, root, {"a": numbers(spark, 3)})
    assert values_of(versioned.read_table(spark, root, "b")) == [10]
    assert versioned.versions(spark, root) == [2, 3]


def test_old_versions_expire(spark, tmp_path):
    root = str(tmp_path / "store")
    for i in range(1, 5):
        versioned.publish(spark, root, {"a": numbers(spark, i)}, keep=2)
    assert versioned.versions(spark, root) == [3, 4]
    with pytest.raises(KeyError):
        versioned.read_table(spark, root, "a", version=1)
    held = [sum(spark.read.schema("v int").parquet(f"{root}/data/a/{d}").count() for d in [name]) for name in sorted(os.listdir(f"{root}/data/a"))]
    assert held == [0, 0, 1, 1]


def test_a_dead_run_leaves_nothing_visible(spark, tmp_path):
    root = str(tmp_path / "store")
    versioned.publish(spark, root, {"a": numbers(spark, 1)})

    @F.udf("int")
    def fail(v):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        versioned.publish(spark, root, {"b": numbers(spark, 5), "a": numbers(spark, 2).select(fail("v").alias("v"))})
    assert values_of(versioned.read_table(spark, root, "a")) == [1] and set(versioned.manifest(spark, root)) == {"a"}
    assert versioned.publish(spark, root, {"a": numbers(spark, 2)}) == 2


def test_conflicts(spark, tmp_path):
    root = str(tmp_path / "store")
    versioned.publish(spark, root, {"a": numbers(spark, 1)})
    versioned.publish(spark, root, {"a": numbers(spark, 2)}, based_on=1)
    with pytest.raises(versioned.Conflict):
        versioned.publish(spark, root, {"a": numbers(spark, 3)}, based_on=1)
    late = versioned.stage({"a": numbers(spark, 4)}, root, 2)
    with pytest.raises(versioned.Conflict):
        versioned.commit(spark, root, 2, late)
    # two manifests of one version, as two commits in the same moment would leave: one holds for everybody
    early = versioned.stage({"a": numbers(spark, 5)}, root, 3)
    versioned.commit(spark, root, 3, early)
    spark.createDataFrame([(3, "0" * 32, *early[0][2:])], versioned.MANIFEST).write.mode("append").json(f"{root}/manifests/00000003")
    assert versioned.manifest(spark, root)["a"].token == "0" * 32
    assert values_of(versioned.read_table(spark, root, "a")) == [5]


def test_types_and_folders_come_back(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.sql("SELECT 1 AS k, date'2001-02-03' AS d, cast(null AS double) AS x, 'a,\"b\"' AS s UNION ALL SELECT 2, null, 1.5D, ''")
    versioned.publish(spark, root, {"p": df, "c": df, "j": df}, formats={"c": "csv", "j": "json"}, partition_by={"p": ["k"]})
    want = sorted(map(str, df.collect()))
    for name in "pcj":
        got = versioned.read_table(spark, root, name)
        assert got.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, got.collect())) == [w.replace("s=''", "s=None") if name == "c" else w for w in want]


def day_store(spark, tmp_path, **options):
    x, _, _ = factor_data(n_t=60, n=3)
    months = long_panel(spark, x, ["a", "b", "target"], "e")
    systems = months.withColumn("value", F.when((F.col("series_id") != "target") | cal.is_quarter_end(F.col("period")), F.col("value")))
    feed = spark.createDataFrame([("2014-Q4", "e", "2015-02-10", 1.25, 2010)], "quarter string, metric string, seen_date string, value double, base_year int")
    feed = feed.withColumn("seen_date", F.to_date("seen_date"))
    args = {"run_date": F.lit("2015-01-20").cast("date"), "metric": F.col("entity_id"), "models": nowcast.SIMPLE}
    return str(tmp_path / "day"), systems, feed, {**args, **options}


def test_a_day_twice_is_a_day_once(spark, tmp_path):
    root, systems, feed, args = day_store(spark, tmp_path)
    run = lambda f: daily.run_daily(spark, root, systems, ["a", "b", "target"], ["entity_id"], f, **args)
    assert run(feed) == 1
    first = sorted(map(str, versioned.read_table(spark, root, "log").collect()))
    assert run(feed.withColumn("value", F.lit(9.0)).withColumn("seen_date", F.date_add("seen_date", 5))) == 2
    assert sorted(map(str, versioned.read_table(spark, root, "log").collect())) == first
    frozen = versioned.read_table(spark, root, "actuals").collect()
    assert [(r["first_value"], r["latest_value"]) for r in frozen] == [(1.25, 9.0)]
    assert set(versioned.manifest(spark, root)) == {"log", "actuals", "scores", "dashboard"}
    assert {r["model"] for r in versioned.read_table(spark, root, "log").collect()} == {"ar1", "naive", "mean", "ensemble"}


def test_simple_paths_by_hand(spark):
    from tidecast.operators import forecasts

    y = [1.0, 2.0, None, 1.5, 3.0, 2.5, 4.0]
    rows = [("e", f"{2000 + i // 4}-{i % 4 * 3 + 1:02d}-01", v) for i, v in enumerate(y)] + [("one", "2000-01-01", 5.0)]
    known = spark.createDataFrame(rows, "entity_id string, quarter string, value double").withColumn("quarter", F.to_date("quarter"))
    got = {(r["entity_id"], r["model"], r["step"]): r["pred"] for r in forecasts.steps_ahead(known, ["entity_id"], ["ar1", "naive", "mean"]).collect()}
    seen = [v for v in y if v is not None]
    b, a = np.polyfit(seen[:-1], seen[1:], 1)
    assert got["e", "ar1", 1] == pytest.approx(a + b * 4) and got["e", "ar1", 2] == pytest.approx(a + b * (a + b * 4))
    assert got["e", "naive", 2] == 4.0 and got["e", "mean", 1] == pytest.approx(np.mean(seen))
    assert ("one", "ar1", 1) not in got and got["one", "ar1", 0] == 5.0


# --- landed files -----------------------------------------------------------------------------


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return path


def rejects_of(got, folder):
    rows = got.rejects.collect()
    for r in rows:
        whole = (folder / r["file"]).read_bytes()
        assert whole[r["offset"] :].startswith(r["record"].encode()[:5]), "the offset leads to the record"
    return sorted((r["file"], r["reason"]) for r in rows)


def test_calendar_files(spark, tmp_path):
    event = lambda *lines: "\r\n".join(["BEGIN:VEVENT", *lines, "END:VEVENT", ""])
    good = event("DTSTART:20240105T000000Z", "SUMMARY:Consumer Price Index, Dec", " ember 2023")
    folder = tmp_path / "cal"
    write(folder, "a.ics", "BEGIN:VCALENDAR\r\nX-NOTE:ü\r\n" + good + event("SUMMARY:x") + event("DTSTART:20249945T0", "SUMMARY:x") + "BEGIN:VEVENT\r\nDTSTART:20240101T\r\nSUMMARY:cut\r\n" + good + event("DTSTART;TZID=X:20240110T000000", "SUMMARY:  ") + "END:VCALENDAR")
    write(folder, "b.ics", "BEGIN:VEVENT\nDTSTART:20240201T000000Z\nSUMMARY:the end is m")
    write(folder, "c.ics", "")
    got = landed.calendar_events(spark, str(folder))
    rows = got.rows.collect()
    assert [(r["file"], str(r["release_date"]), r["title"], r["dataset_id"], r["ref_month_end"]) for r in rows] == [("a.ics", "2024-01-05", "Consumer Price Index, December 2023", "cpi_headline", 12)] * 2
    assert rejects_of(got, folder) == [("a.ics", "no date"), ("a.ics", "no start"), ("a.ics", "no title"), ("a.ics", "not closed"), ("b.ics", "not closed")]


def test_release_files(spark, tmp_path):
    folder = tmp_path / "csv"
    write(folder, "a.csv", 'reference_period,TITLE,release_date\nq1,"A, ""b""",2024-01-05\nq2,"two\nlines",5 January 2024\nq3,A,soon\nq4,,2024-01-05\nq5,A\nq6,x"y,2024-01-05\n')
    write(folder, "b.csv", "title,when\nA,2024-01-05\n")
    titles = spark.createDataFrame([('A, "b"', "one")], "title string, dataset_id string")
    got = landed.release_lines(spark, str(folder), titles)
    rows = {(r["title"], str(r["release_date"]), r["reference_period"], r["dataset_id"]) for r in got.rows.collect()}
    assert rows == {('A, "b"', "2024-01-05", "q1", "one"), ("two\nlines", "2024-01-05", "q2", None)}
    found = rejects_of(got, folder)
    assert ("a.csv", "no date") in found and ("a.csv", "no title") in found and ("a.csv", "wrong number of cells") in found
    assert ("a.csv", "broken quotes") in found and ("b.csv", "header lacks a column") in found and len(found) == 5


def test_json_files(spark, tmp_path):
    folder = tmp_path / "json"
    good = {"date": "2024-01-01", "quantity": 1.5, "flag": 'br{ace} "q" ü'}
    write(folder, "part=1/a.json", json.dumps([good, {"date": "2024-02-01", "quantity": None}], ensure_ascii=False))
    write(folder, "part=2/b.json", json.dumps({"data": {"rate": [good]}}) + "\n" + json.dumps({"value": [{"quantity": 2}, {"date": "x"}, {"date": "2024-01-01", "quantity": "many"}]}))
    write(folder, "part=2/c.json", '[{"date": "2024-03-01", "quantity": 3}, {"date": "2024-03-02", {"date": "2024-03-03"}, {"date": "2024-04')
    got = landed.json_objects(spark, str(folder), {"date": "date", "quantity": "double", "flag": "string"}, ["date"])
    rows = sorted((r["part"], str(r["date"]), r["quantity"], r["flag"]) for r in got.rows.fillna(0.0).fillna("").collect())
    flag = 'br{ace} "q" ü'
    assert rows == [(1, "2024-01-01", 1.5, flag), (1, "2024-02-01", 0.0, ""), (2, "2024-01-01", 1.5, flag), (2, "2024-03-01", 3.0, ""), (2, "2024-03-03", 0.0, "")]
    assert [w for _, w in rejects_of(got, folder)] == ["date is no date", "no date", "quantity is no double", "not a record", "not a record"]


def test_rates_and_pages(spark, tmp_path):
    rates, pages = tmp_path / "rates", tmp_path / "pages"
    write(rates, "a.json", '{"rate":[{"date":"2024-01-01","a":"-","b":"1,000.5"},{"date":"2024-01-02","a":"2%"},{"date":"no","a":1},{"date":"2024-01-03"}]}')
    got = landed.dated_rates(spark, str(rates), ["a", "b"])
    assert sorted((str(r["date"]), r["value"]) for r in got.rows.collect()) == [("2024-01-01", 1000.5), ("2024-01-02", 2.0)]
    assert [w for _, w in rejects_of(got, rates)] == ["no date", "no number"]
    write(pages, "p.html", "<TABLE><tr><th>h</th></tr><tr class='x'><td><b>GDP Growth Rate</b> (%)</td><td>1</td><td>2,5%</td><td>-</td></tr><tr><td>Exports of goods</td><td>1</td><td> 7 </td></tr><tr><td>Prices</td><td>1</td><td>2</td></tr><tr><td>Odd</td><td>1</td></tr><tr><td></td><td>1</td><td>2</td></tr></TABLE>")
    got = landed.forecast_cells(spark, str(pages), ["Q1", "Q2"])
    assert sorted((r["indicator"], r["route"], r["label"], r["value"]) for r in got.rows.collect()) == [("Exports of goods", "component:exports", "Q1", 7.0), ("GDP Growth Rate", "gdp_qoq", "Q1", 25.0)]
    assert [w for _, w in rejects_of(got, pages)] == ["fewer than three cells", "no indicator"]


def test_a_file_without_records_is_no_failure(spark, tmp_path):
    write(tmp_path / "odd", "a.json", b"\xff\xfe{{{{")
    write(tmp_path / "odd", "b.json", b'[{"date": "2024-01-01", "flag": "\xff"}]')
    got = landed.json_objects(spark, str(tmp_path / "odd"), {"date": "date", "flag": "string"}, ["date"])
    assert [r["flag"] for r in got.rows.collect()] == ["�"]
    assert {r["reason"] for r in got.rejects.collect()} == {"not a record"}
    assert re.match(r"\{", got.rejects.first()["record"])
