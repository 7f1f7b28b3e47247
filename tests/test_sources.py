"""Readers and writers on small files written for the test."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType, TimestampNTZType

from daypanel.operators.reshape import promote_header, q
from daypanel.plans import panels
from daypanel.session import scratch_dir, stage
from daypanel.sources import files, html, json_items, sinks
from daypanel.streaming import ingest

SCHEMA = StructType().add("Kreis/Stadt", StringType()).add("f", DoubleType()).add("i", DoubleType()).add("update", TimestampNTZType())


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_wide_file(spark, tmp_path, rows):
    path = write(
        tmp_path / "conf.csv",
        "Province/State,Country/Region,Lat,Long,1/22/20,1/23/20,bad\n"
        ",Aland,1.5,2.5,1,,3\n"
        '"P, 1",Bland,1.0,2.0,4,x,6\n',
    )
    got = files.wide_to_long(files.read_wide(spark, path), 4, "n").select("Province/State", "Country/Region", "date", "n")
    d1, d2 = dt.date(2020, 1, 22), dt.date(2020, 1, 23)
    assert rows(got) == sorted(
        [(None, "Aland", d1, 1.0), (None, "Aland", d2, None), (None, "Aland", None, 3.0),
         ("P, 1", "Bland", d1, 4.0), ("P, 1", "Bland", d2, None), ("P, 1", "Bland", None, 6.0)],
        key=lambda r: [(v is not None, str(v)) for v in r],
    )


@pytest.mark.parametrize(
    "name, want", [("1/22/20", dt.date(2020, 1, 22)), ("1/2/1999", dt.date(1999, 1, 2)), ("2/30/20", None), ("Lat", None), ("12/31/69", dt.date(1969, 12, 31))]
)
def test_header_dates(name, want):
    assert files.header_date(name) == want


def test_country_pipeline(spark, tmp_path):
    head = "Province/State,Country/Region,Lat,Long,1/22/20,1/23/20\n"
    conf = write(tmp_path / "c.csv", head + ",A,1,1,10,20\nP,B,2,2,1,2\nQ,B,3,3,3,4\n")
    dea = write(tmp_path / "d.csv", head + ",A,1,1,1,2\nP,B,2,2,0,1\nQ,B,3,3,1,1\n")
    rec = write(tmp_path / "r.csv", head + ",A,1.1,1,5,6\nP,B,2,2,0,0\n")
    wide = [files.read_wide(spark, p) for p in (conf, dea, rec)]
    got = {(r["region"], r["date"].day): r for r in panels.country_panel(*wide).collect()}
    assert (got["A", 23]["conf"], got["A", 23]["rec"], got["A", 23]["active"]) == (20, 6, 12)
    assert (got["B", 23]["conf"], got["B", 23]["dea"], got["B", 23]["rec"]) == (6, 2, None)
    shifted = {r["region"]: r["rec"] for r in panels.country_panel(*wide, natural=True).where("day(date) = 22").collect()}
    assert shifted == {"A": None, "B": None}


def test_european_numbers(spark, tmp_path, rows):
    path = write(tmp_path / "a.csv", "Kreis/Stadt;f;i;update\nBad-Ort;1.234,5;7;2020-05-01 09:00:00\nB;;0,25;2020-05-01 09:00:00\n")
    at = dt.datetime(2020, 5, 1, 9)
    assert rows(files.read_csv2(spark, path, SCHEMA)) == [("B", None, 0.25, at), ("Bad-Ort", 1234.5, 7.0, at)]


def test_snapshot_folder(spark, tmp_path, rows):
    line = "Bad - Ort;1,5;7;2020-05-0{0} 09:00:00\n"
    write(tmp_path / "f" / "a.csv", "Kreis/Stadt;f;i;update\n" + line.format(1) * 2)
    write(tmp_path / "f" / "sub" / "b.csv", "another;set;of;names\n" + line.format(2))
    got = files.read_folder(spark, str(tmp_path / "f"), SCHEMA)
    assert sorted(r["file_name"] for r in got.collect()) == ["a.csv", "a.csv", "b.csv"]
    clean = panels.clean_snapshots(got.drop("file_name"), "Kreis/Stadt")
    assert rows(clean.select("Kreis/Stadt", "f")) == [("BadOrt", 1.5), ("BadOrt", 1.5)]


def sheet(rows):
    return "Titel\nStand\n\nLandkreis;43922;43923\n" + "".join(f"{r}\n" for r in rows)


def test_sheet_range(spark, tmp_path, rows):
    conf = write(tmp_path / "c" / "s.txt", sheet(["A;1;2", "B;;4", ";7;8", "Summe;9;9", "Stadt;;", "cut;0;0"]))
    dea = write(tmp_path / "d" / "s.txt", sheet(["A;0;1"]))
    read = [files.read_range(spark, p, skip=3, n_max=n) for p, n in ((conf, 5), (dea, 39))]
    d1, d2 = dt.date(2020, 4, 1), dt.date(2020, 4, 2)
    assert rows(panels.district_long(*read)) == [
        (None, d1, 7.0, 0.0), (None, d2, 8.0, 0.0), ("A", d1, 1.0, 0.0), ("A", d2, 2.0, 1.0), ("B", d1, 0.0, 0.0), ("B", d2, 4.0, 0.0),
    ]


PAGE = """<html><!-- <table> --><table><tr><th></th><th colspan=2>letzte 7</th></tr>
<tr><td>Kreis<td>Tage &amp; N&auml;chte<td> In&shy;zidenz
<tr><td>A<br>B</td><td>1</td><td>2<table><tr><td>inner</td></tr></table></td></tr></table>
<TABLE><TR><TD>x</TD></TR></TABLE></html>"""


def test_html(spark, rows):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None), (4, "<table><tr><td>open")], "page_id int, html string")
    got = [(p, t, r, tuple(c)) for p, t, r, c in rows(html.read_html_tables(pages))]
    assert got == [
        (1, 0, 0, ("", "letzte 7", "letzte 7")),
        (1, 0, 1, ("Kreis", "Tage & Nächte", "In\xadzidenz")),
        (1, 0, 2, ("A B", "1", "2")),
        (1, 1, 0, ("inner",)),
        (1, 2, 0, ("x",)),
        (4, 0, 0, ("open",)),
    ]


def test_header_promotion(spark, rows):
    data = [(0, ["", "letzte"]), (1, ["Kreis", "7 Tage"]), (2, ["A", "5"]), (3, ["total", "9"])]
    df = spark.createDataFrame([(1, r, c) for r, c in data], "page int, row_idx int, cells array<string>")
    two = promote_header(df, ["page"], [" Kreis", "letzte 7 Tage", "fehlt"], header_rows=2, drop_rows=(3,))
    assert rows(two) == [(1, 2, "A", "5", None)]
    one = promote_header(df, ["page"], ["letzte"])
    assert rows(one) == [(1, 1, "7 Tage"), (1, 2, "5"), (1, 3, "9")]


def test_json(spark, rows):
    body = '{"items":[{"article":"A","timestamp":"2020040100","views":3,"x":1},{"article":"A","timestamp":"bad","views":4}]}'
    landed = spark.createDataFrame([("de", "A", body), ("de", "B", '{"items":[]}'), ("de", "C", "{}"), ("en", "A", body)], "lang string, title string, body string")
    got = json_items.items_by_title(landed, json_items.titles_frame(spark, ["A", "A", "B", "C"]))
    assert rows(got.select("article", "day", "views")) == [("A", None, 4), ("A", dt.date(2020, 4, 1), 3)]
    none = json_items.items_by_title(landed, json_items.titles_frame(spark, []))
    assert none.count() == 0 and none.columns == ["lang", "title", "article", "day", "views"]


def test_snapshots_replace_their_day(spark, tmp_path, rows):
    df = spark.createDataFrame([("A", 1.5), ("B", None)], "k string, x double")
    folder, d1, d2 = str(tmp_path / "out"), dt.date(2020, 5, 1), dt.date(2020, 5, 2)
    for fmt in ("csv2", "csv", "parquet"):
        base = f"{folder}/{fmt}"
        for day in (d1, d2, d1):
            sinks.write_snapshot(df, base, day, fmt)
        if fmt == "csv2":
            back = files.read_csv2(spark, base, df.schema)
        else:
            reader = spark.read.schema(df.schema).option("header", True)
            back = (reader.parquet if fmt == "parquet" else reader.csv)(base)
        assert rows(back.groupBy("snapshot", "k").agg(F.sum("x").cast("double"))) == [(d1, "A", 1.5), (d1, "B", None), (d2, "A", 1.5), (d2, "B", None)]
    with pytest.raises(ValueError):
        sinks.write_snapshot(df, folder, d1, "xlsx")


def test_published_table(spark, tmp_path, rows):
    df = spark.createDataFrame([("A", 1.5)], "k string, x double")
    sinks.publish_table(df, "aktu_data", str(tmp_path / "t"))
    assert rows(spark.table("aktu_data")) == [("A", 1.5)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stamp_and_stage(spark, rows, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _stamp_and_stage(spark, rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _stamp_and_stage(spark, rows):
    df = files.stamp(spark.createDataFrame([("A",)], "k string"), dt.datetime(2020, 5, 1, 9))
    assert dict(df.dtypes)["update"] == "timestamp_ntz"
    assert rows(stage(df)) == [("A", dt.datetime(2020, 5, 1, 9))]
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


@pytest.mark.parametrize("ingest_rows", [ingest.ingest_snapshots, ingest.ingest_keyed])
def test_stream_equals_batch(spark, tmp_path, rows, ingest_rows):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "ck")
    line = "K{0};1,5;{0};2020-05-{1:02d} 09:00:00\n"
    head = "Kreis/Stadt;f;i;update\n"

    def run():
        stream = ingest.stream_folder(spark, str(folder), SCHEMA, files_per_batch=1)
        ingest_rows(stream, table, checkpoint).awaitTermination()
        batch = files.read_folder(spark, str(folder), SCHEMA).drop("file_name").distinct()
        got = rows(ingest.read_ingested(spark, table, SCHEMA))
        assert got == rows(batch)
        return len(got)

    write(folder / "a.csv", head + line.format(1, 20) * 3 + line.format(2, 20) + "K9;;;\n")
    write(folder / "b.csv", head + line.format(2, 20) + line.format(3, 21) + "K9;;;\n")
    assert run() == 4
    # A later file with an old day: its new row is kept, its known row is not repeated.
    write(folder / "c.csv", head + line.format(1, 20) + line.format(4, 1))
    assert run() == 5
    assert run() == 5


def test_ingest_reads_the_touched_days_only(spark, tmp_path, rows):
    table = str(tmp_path / "table")
    assert rows(ingest.read_ingested(spark, table, SCHEMA)) == []
    assert ingest.read_ingested(spark, table, SCHEMA).schema == SCHEMA
    df = spark.createDataFrame([("K", 1.5, 1.0, dt.datetime(2020, 5, d, 9)) for d in (1, 2, 3)], SCHEMA)
    df.withColumn(ingest._DAY, F.to_date("update")).write.partitionBy(ingest._DAY).parquet(f"{table}/batch=0")
    one = ingest.read_ingested(spark, table, SCHEMA, with_batch=True).where(F.col(ingest._DAY).isin([dt.date(2020, 5, 2)]))
    assert one.count() == 1 and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().executedPlan().toString()


def test_range_over_several_splits(spark, tmp_path, rows):
    lines = ["title", "Kreis;1;2"] + [f"k{i};{i};{i}" for i in range(200)]
    write(tmp_path / "s" / "sheet.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = files.read_range(spark, str(tmp_path / "s"), skip=1, n_max=150)
        assert got.rdd.getNumPartitions() >= 1
        cells = sorted((r.row_idx, r.cells[0]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert cells == [(0, "Kreis")] + [(i + 1, f"k{i}") for i in range(150)]


def test_numbers_survive_a_european_file(spark, tmp_path):
    values = [1e-13, 1e27, 1.2345678901234567e-05, 0.1234567890123456, 1234567890123456789012345678.5, -3.0, 0.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, x double")
    sinks.write_snapshot(df, str(tmp_path / "out"), dt.date(2020, 5, 1), "csv2")
    back = files.read_csv2(spark, str(tmp_path / "out"), df.schema)
    assert {r.k: r.x for r in back.collect()} == dict(enumerate(values))
    write(tmp_path / "de" / "x.csv", "k;x\n1;1.234,5\n2;1234567890123456789012345678,5\n3;abc\n")
    got = {r.k: r.x for r in files.read_csv2(spark, str(tmp_path / "de"), df.schema).collect()}
    assert got == {1: 1234.5, 2: 1234567890123456789012345678.5, 3: None}


def test_wide_files_of_different_days(spark, tmp_path, rows):
    write(tmp_path / "w" / "a.csv", "P,C,Lat,Long,1/22/20\n,X,1,2,5\n")
    write(tmp_path / "w" / "b.csv", "P,C,Lat,Long,1/23/20,1/24/20\n,X,1,2,6,7\n")
    got = rows(files.read_wide_long(spark, str(tmp_path / "w"), 4, "conf").select("date", "conf"))
    assert got == [(dt.date(2020, 1, 22), 5.0), (dt.date(2020, 1, 23), 6.0), (dt.date(2020, 1, 24), 7.0)]
    with pytest.raises(Exception):
        files.read_wide(spark, [str(tmp_path / "w" / "a.csv"), str(tmp_path / "w" / "b.csv")]).collect()


def test_spans_of_html_cells(spark, rows):
    page = (
        "<table><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr>"
        "<tr><td rowspan=3 colspan=2>y<td>3<tr><td>4</tr></table>"
        "<table><tr><td colspan=5000>w</td></tr><tr><td>a<td>b</tr></table>"
    )
    got = [(t, r, list(c)) for _, t, r, c in rows(html.read_html_tables(spark.createDataFrame([(1, page)], "page_id int, html string")))]
    assert got == [
        (0, 0, ["x", "1"]), (0, 1, ["x", "2"]), (0, 2, ["y", "y", "3"]), (0, 3, ["y", "y", "4"]),
        (1, 0, ["w"] * 1000), (1, 1, ["a", "b"]),
    ]


def test_scratch_folders_end_with_the_session(tmp_path):
    import subprocess
    import sys

    code = (
        "from daypanel.session import stage\n"
        "from pyspark.sql import SparkSession\n"
        "b = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')\n"
        "s = b.config('spark.checkpoint.dir', 'file://%s').getOrCreate()\n"
        "assert stage(s.range(3)).count() == 3\n"
        "s.stop()\n" % tmp_path
    )
    root = str(__import__("pathlib").Path(__file__).parents[1])
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=root, capture_output=True)
    for _ in range(100):  # the JVM may outlive the process by a moment
        if not list(tmp_path.glob("*/staged-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("*/staged-*")) and not list(tmp_path.glob("local-*"))


def bytes_read(spark):
    """Bytes that the local file system has given out so far."""
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    return stats.getLong("bytesRead")


def test_first_lines_do_not_read_long_files(spark, tmp_path, rows):
    import gzip

    folder = tmp_path / "long"
    folder.mkdir()
    body = "".join(f"{i};{i * 7919 % 1000003};some text to fill the line\n" for i in range(2_500_000))
    for name in ("a.txt", "b.txt"):
        (folder / name).write_text(f"title {name}\nhead\n" + body)
    with gzip.open(folder / "c.txt.gz", "wt", compresslevel=1) as out:
        out.write("title c\nhead\n" + body)
    write(folder / "sub" / "d.txt", "title d\nhead\nlast line without an end")
    write(folder / "sub" / "e.txt", "")
    before = bytes_read(spark)
    got = rows(files.first_lines(spark, str(folder), 4).select(F.regexp_extract("file", "([a-z])\\.txt", 1), "line", "value"))
    read = bytes_read(spark) - before
    line = "{0};{1};some text to fill the line"
    assert got == sorted(
        [(f, i, v) for f in "abc" for i, v in enumerate([f"title {f}.txt" if f < "c" else "title c", "head", line.format(0, 0), line.format(1, 7919)])]
        + [("d", 0, "title d"), ("d", 1, "head"), ("d", 2, "last line without an end")]
    )
    assert read < 1_000_000
    # The tasks read the files themselves, which no statistic of Spark shows.
    for name in ("a.txt", "c.txt.gz"):
        began = time.perf_counter()
        files._opened(str(folder / name), 4)
        assert time.perf_counter() - began < 0.2
    # Where Spark reads the files, the lines are the same.
    whole = rows(files.first_lines(spark, str(folder), 4, opened=()).select(F.regexp_extract("file", "([a-z])\\.txt", 1), "line", "value"))
    assert whole == got


def test_first_lines_of_many_files_in_one_task(spark, tmp_path):
    for i in range(40):
        write(tmp_path / "many" / f"{i}.txt", "".join(f"{i} {j}\n" for j in range(i)))
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = files.first_lines(spark, str(tmp_path / "many"), 5, opened=()).collect()
            assert sorted(got) == sorted(files.first_lines(spark, str(tmp_path / "many"), 5).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.line, r.value) for r in got) == sorted((j, f"{i} {j}") for i in range(40) for j in range(min(i, 5)))
        assert all(r.file.endswith(f"/{r.value.split()[0]}.txt") for r in got)


def test_cells_of_a_line(spark):
    lines = {
        "a,b": ["a", "b"], "": [None], ",": [None, None], ",x,": [None, "x", None], '"P, 1",2': ["P, 1", "2"], 'x,"say ""hi"", you",': ["x", 'say "hi", you', None],
        '"",1': [None, "1"], '"open,1': ['"open', "1"], 'a"b,c"d': ['a"b', 'c"d'], "ü,é": ["ü", "é"], '"' * 5001 + ",1": ['"' * 2499 , "1"],
    }
    df = spark.createDataFrame([(k,) for k in lines], "v string").select("v", files.csv_cells(F.col("v")).alias("cells"))
    got = {r.v: r.cells for r in df.collect()}
    long = '"' * 5001 + ",1"
    assert {k: v for k, v in got.items() if k != long} == {k: v for k, v in lines.items() if k != long}
    assert got[long][-1] == "1"
    semi = spark.createDataFrame([("a|b|\"c|d\"",)], "v string").select(files.csv_cells(F.col("v"), "|").alias("c")).first().c
    assert semi == ["a", "b", "c|d"]


def test_wide_folder_by_name(spark, tmp_path, rows):
    write(tmp_path / "w" / "a.csv", "\ufeffP,C,1/22/20,note\n,X,5,9\n\nP,C,1/22/20,note\n\"a, b\",Y,x,\n")
    write(tmp_path / "w" / "b.csv", "1/24/20,1/23/20,C,P\n7,6,X,\n8\n1,2,Z,q,surplus\n")
    write(tmp_path / "w" / "c.csv", "C,1/25/20\nW,3\n")
    write(tmp_path / "w" / "d.csv", "")
    d = lambda n: dt.date(2020, 1, n)
    got = rows(files.read_wide_long(spark, str(tmp_path / "w"), ["P", "C"], "conf"))
    want = [
        (None, "X", d(22), 5.0), (None, "X", None, 9.0), ("a, b", "Y", d(22), None), ("a, b", "Y", None, None),
        (None, "X", d(24), 7.0), (None, "X", d(23), 6.0), (None, None, d(24), 8.0), (None, None, d(23), None), ("q", "Z", d(24), 1.0), ("q", "Z", d(23), 2.0),
        (None, "W", d(25), 3.0),
    ]
    assert got == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])


def test_a_header_a_file_plans_at_once(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    start = dt.date(2000, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(1500)]
    for i, day in enumerate(days):
        (folder / f"{i}.csv").write_text(f"P,C,Lat,Long,{day.month}/{day.day}/{day.year}\n,X,1,2,{i}\n")
    began = time.perf_counter()
    long = files.read_wide_long(spark, str(folder), ["P", "C", "Lat", "Long"], "conf")
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - began < 60
    assert plan.count("FileScan text") == 1 and "Union" not in plan and len(plan) < 20_000
    assert {r.date: r.conf for r in long.collect()} == {day: float(i) for i, day in enumerate(days)}


def test_spans_wider_than_the_cells_of_the_table(spark, rows):
    page = (
        "<table><tr><td colspan=5>x<td>y</tr><tr><td colspan=3>u<td colspan=3>w</tr></table>"
        "<table><tr><td rowspan=0>a<td>1<tr><td>2<tr><td>3</table><table><tr><td colspan=0>a<td colspan=-2 rowspan=x>b</table>"
    )
    got = [(t, r, list(c)) for _, t, r, c in rows(html.read_html_tables(spark.createDataFrame([(1, page)], "page_id int, html string")))]
    assert got == [
        (0, 0, list("xxxxxy")), (0, 1, list("uuuwww")), (1, 0, ["a", "1"]), (1, 1, ["a", "2"]), (1, 2, ["a", "3"]), (2, 0, ["a", "b"]),
    ]


def test_keyed_state_survives_restarts_and_repeated_batches(spark, tmp_path, rows):
    """State and table agree after a batch that was written but not committed; the table is never read."""
    import shutil

    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "ck")
    line = "K{0};1,5;{0};2020-05-{1:02d} 09:00:00\n"
    head = "Kreis/Stadt;f;i;update\n"

    def run():
        stream = ingest.stream_folder(spark, str(folder), SCHEMA)
        query = ingest.ingest_keyed(stream, table, checkpoint)
        query.awaitTermination()
        assert table not in str(query.lastProgress)
        return rows(ingest.read_ingested(spark, table, SCHEMA).select("i"))

    write(folder / "a.csv", head + line.format(1, 20) * 2 + line.format(2, 20))
    assert run() == [(1.0,), (2.0,)]
    write(folder / "b.csv", head + line.format(2, 20) + line.format(3, 1))
    assert run() == [(1.0,), (2.0,), (3.0,)]
    # The commit of the second batch gets lost: it runs again on the state of the first and replaces its rows.
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run() == [(1.0,), (2.0,), (3.0,)]
    # Without the table, only new rows come: what was seen is known from the state alone.
    shutil.move(table, str(tmp_path / "moved"))
    write(folder / "c.csv", head + line.format(1, 20) + line.format(4, 1))
    assert run() == [(4.0,)]


def test_published_snapshots_are_whole(spark, tmp_path, rows):
    import threading

    folder, day, other = str(tmp_path / "pub"), dt.date(2020, 5, 1), dt.date(2020, 5, 2)
    frame = lambda v, n=2000: spark.range(n).select(F.col("id").alias("k"), F.lit(float(v)).alias("x")).repartition(4)
    schema = frame(0).schema
    assert sinks.read_published(spark, folder, schema).collect() == []
    sinks.publish_snapshot(frame(0), folder, day)
    sinks.publish_snapshot(frame(9, 3), folder, other)
    old = sinks.read_published(spark, folder, schema, day)
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            r = sinks.read_published(spark, folder, schema, day).agg(F.count("k"), F.min("x"), F.max("x")).first()
            seen.append(tuple(r))

    reader = threading.Thread(target=watch)
    reader.start()
    try:
        for v in (1, 2, 3):
            sinks.publish_snapshot(frame(v), folder, day)
    finally:
        stop.set()
        reader.join()
    assert seen and all(n == 2000 and lo == hi for n, lo, hi in seen)
    # A writer that ends before its mark leaves the version before.
    sinks._write(frame(7, 5), f"{folder}/snapshot={day}/version=dead", "parquet")
    now = sinks.read_published(spark, folder, schema)
    assert rows(now.groupBy("snapshot").agg(F.count("k"), F.max("x"))) == [(day, 2000, 3.0), (other, 3, 9.0)]
    # A frame made before reads on what it has resolved.
    assert old.agg(F.max("x")).first()[0] == 0.0
    assert sinks.remove_versions(spark, folder, keep=2) == 2
    assert rows(sinks.read_published(spark, folder, schema).groupBy("snapshot").agg(F.max("x"))) == [(day, 3.0), (other, 9.0)]
    with pytest.raises(ValueError):
        sinks.remove_versions(spark, folder, keep=0)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "csv2"])
def test_published_formats(spark, tmp_path, rows, fmt):
    df = spark.createDataFrame([("A", 1.5), ("B", None)], "k string, x double")
    day = dt.date(2020, 5, 1)
    for _ in range(2):
        sinks.publish_snapshot(df, str(tmp_path), day, fmt)
    assert rows(sinks.read_published(spark, str(tmp_path), df.schema, day, fmt)) == [("A", 1.5, day), ("B", None, day)]
