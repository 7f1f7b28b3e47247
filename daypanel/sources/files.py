"""Delimited text: wide panels, European files, snapshot folders, ranges of a sheet."""

from __future__ import annotations

import datetime as dt
import io
import re
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, StringType, StructField, StructType

from daypanel.functions.dates import date_mdy
from daypanel.operators.reshape import q, quoted
from daypanel.session import stage

#: Stores whose files Python tasks open by themselves, and so read no further than they need.
OPENED = ("file",)
#: Where Spark reads the files, each goes to a task of its own, uncut.
_UNCUT = {"spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40)}


def _opened(path: str, n: int) -> list[str]:
    """The first ``n`` lines of one file, without a byte order mark; a compressed file is unpacked only so far."""
    system, name = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))
    with io.TextIOWrapper(system.open_input_stream(name, compression="detect"), encoding="utf-8-sig", errors="replace") as lines:
        return [line.rstrip("\n") for line in islice(lines, n)]


def first_lines(spark: SparkSession, path: str, n: int, opened: Sequence[str] = OPENED) -> DataFrame:
    """The first ``n`` lines of every file of a folder, as (file, line, value) with lines from zero; written once.

    In the stores of ``opened`` Spark lists the files and tasks open them, so what is read does not grow with the
    files. In any other store Spark reads the files, each whole in one task. Sub-folders count too.
    """
    schema = "file string, line long, value string"
    names = ["file", "line", "value"]
    home = spark._jvm.org.apache.hadoop.fs.Path(path)

    def open_each(batches):
        for batch in batches:
            for file, name in zip(*(c.to_pylist() for c in batch.columns)):
                lines = _opened(name, n)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=names)

    def head(batches):
        last, seen = None, 0
        for batch in batches:
            files = batch.column(0).dictionary_encode()
            at = files.indices.to_numpy()
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            if files.dictionary[int(at[0])].as_py() == last:
                place[: starts[1] if len(starts) > 1 else len(at)] += seen
            last, seen = files.dictionary[int(at[-1])].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), batch.column(1)], names=names).filter(pa.array(place < n))

    file = F.col("_metadata.file_path").alias("file")
    if home.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() in opened:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return stage(listed.select(file, "path").mapInArrow(open_each, schema), "first-lines")
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return stage(lines.select(file, "value").mapInArrow(head, schema), "first-lines", _UNCUT)


def csv_cells(line: Column, sep: str = ",") -> Column:
    """Cells of a line of delimited text; quoted cells may hold separators and doubled quotes. Empty cells are NULL."""
    mark = re.escape(sep)
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{mark}("[^"]*+(?:""[^"]*+)*+"|[^{mark}]*+)'), F.lit(1))
    bare = F.transform(found, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    cells = F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, mark, -1))
    return F.transform(cells, lambda c: F.nullif(c, F.lit("")))


def read_wide(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A wide panel: id columns, then one column per date. All text; only the header line is read ahead.

    The files share one header; reading a file whose header differs raises.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    names = reader.csv(path).schema
    return reader.schema(names).option("enforceSchema", False).csv(path)


def read_wide_long(spark: SparkSession, path: str, ids: int | Sequence[str], value: str) -> DataFrame:
    """All wide files of a folder, whatever days each has, as (ids, date, value).

    One scan of text, joined by file with the headers, so neither the plan nor its making depends on how many
    headers there are. A header gives the place of each id column and the date of each other place; a line gives
    its cells by place. ``ids`` names the id columns, or counts them: then they are the first of each file,
    and files that name them otherwise have other columns, missing ones NULL. A header that is no date gives a NULL
    date, missing cells are NULL, surplus cells are left out; blank lines and repeats of the file's header are no rows.
    """
    heads = first_lines(spark, path, 1).where("value IS NOT NULL")
    heads = heads.select("file", F.col("value").alias("head"), csv_cells(F.col("value")).alias("names"))
    if isinstance(ids, int):
        lists = heads.select(F.slice("names", 1, ids).alias("names")).distinct().collect()
        listed = list(dict.fromkeys(n for r in sorted(lists, key=lambda r: [x or "" for x in r.names]) for n in r.names))
        is_id = lambda name, at: at < ids
    else:
        listed = list(ids)
        is_id = lambda name, at: F.coalesce(name.isin(listed), F.lit(False))
    slots = F.filter(
        F.transform("names", lambda name, at: F.struct(at.alias("at"), date_mdy(name).alias("date"), is_id(name, at).alias("is_id"))),
        lambda slot: ~slot["is_id"],
    )
    heads = heads.select(
        "file", "head", F.transform(slots, lambda s: F.struct(s["at"].alias("at"), s["date"].alias("date"))).alias("slots"),
        *[(F.array_position("names", F.lit(name)) - 1).cast("int").alias(f"id{i}") for i, name in enumerate(listed)],
    )
    # Written once: otherwise the parsing of the headers runs again in every task that reads lines.
    heads = stage(heads, "headers")
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file")).join(heads, "file").where(F.col("value") != F.col("head"))
    rows = lines.select(csv_cells(F.col("value")).alias("cells"), "slots", *[f"id{i}" for i in range(len(listed))])
    cell = F.transform("slots", lambda s: F.struct(s["date"].alias("date"), F.get("cells", s["at"]).try_cast("double").alias("value")))
    named = [F.when(F.col(f"id{i}") >= 0, F.get("cells", F.col(f"id{i}"))).alias(name) for i, name in enumerate(listed)]
    return rows.select(*named, F.inline(cell).alias("date", value))


def header_date(name: str) -> dt.date | None:
    """Date of an ``M/d/yy`` or ``M/d/yyyy`` column header, by the rule of ``date_mdy``."""
    found = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", name)
    if not found:
        return None
    month, day, year = (int(g) for g in found.groups())
    if len(found.group(3)) == 2:
        year += 2000 if year < 69 else 1900
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def wide_to_long(df: DataFrame, ids: int | Sequence[str], value: str) -> DataFrame:
    """Wide panel to (ids, date, value) with ``M/d/yy`` headers; a header that is no date gives a NULL date.

    The headers are read once when the plan is made, so no row parses a date.
    """
    names = df.columns[:ids] if isinstance(ids, int) else list(ids)
    cells = []
    for c in df.columns:
        if c not in names:
            day = header_date(c)
            shown = f"DATE'{day.isoformat()}'" if day else "CAST(NULL AS DATE)"
            cells.append(f"struct({shown} AS date, try_cast({quoted(c)} AS DOUBLE) AS {quoted(value)})")
    return df.selectExpr(*[quoted(n) for n in names], f"inline(array({', '.join(cells)}))")


def as_text_schema(schema: StructType) -> StructType:
    """The schema with fractional columns as text: no parser or carrier type takes digits off a number."""

    def kind(t: DataType) -> DataType:
        return StringType() if isinstance(t, (DoubleType, FloatType, DecimalType)) else t

    return StructType([StructField(f.name, kind(f.dataType), f.nullable) for f in schema])


def to_declared(df: DataFrame, schema: StructType) -> DataFrame:
    """Fractional columns from decimal-comma text (``1.234,5``, ``1,5E-13``) to their declared type."""
    wanted = {f.name: f.dataType for f in schema if isinstance(f.dataType, (DoubleType, FloatType, DecimalType))}
    return df.select(*[F.translate(q(c), ",.", ".").try_cast(wanted[c]).alias(c) if c in wanted else q(c) for c in df.columns])


def csv2_options(reader):
    """Semicolon-separated, with a header line in every file; columns by position."""
    return reader.option("sep", ";").option("header", True).option("enforceSchema", True)


def read_csv2(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """European delimited text with a declared schema; fractional columns have a decimal comma."""
    return to_declared(csv2_options(spark.read).schema(as_text_schema(schema)).csv(path), schema)


def read_folder(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All snapshot files of a folder, columns by position, each file once, with its name.

    Sub-folders count too, so a folder written per day reads in one scan.
    """
    reader = csv2_options(spark.read).option("recursiveFileLookup", True).schema(as_text_schema(schema))
    named = reader.csv(folder).select("*", F.col("_metadata.file_name").alias("file_name"))
    return to_declared(named, schema)


def stamp(df: DataFrame, at: dt.datetime, name: str = "update") -> DataFrame:
    """Add the snapshot time, given by the caller so that a rerun gives the same rows.

    It is written as a wall-clock time; the time zone of the session does not shift it.
    """
    return df.withColumn(name, F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"))


def read_range(spark: SparkSession, path: str, skip: int, n_max: int, sep: str = ";") -> DataFrame:
    """A range of each file: skip title lines, then a header line and at most ``n_max`` rows.

    Gives (file, row_idx, cells) with row zero the header, for ``promote_header`` or ``range_to_long``. Only the
    first lines of each file are read.
    """
    lines = first_lines(spark, path, skip + 1 + n_max).where(F.col("line") >= skip)
    return lines.select("file", (F.col("line") - skip).cast("int").alias("row_idx"), F.split("value", re.escape(sep), -1).alias("cells"))


def range_to_long(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Range rows to (file, key, header text, value): the first column is the key, the rest are cells.

    The header is matched to the cells by position, so its names need not be known.
    """
    header = rows.where(F.col("row_idx") == 0).select("file", F.col("cells").alias("header"))
    body = rows.where(F.col("row_idx") > 0).join(header, "file")
    pairs = F.arrays_zip(F.col("header").alias("header"), F.col("cells").alias("cells"))
    long = body.select(
        "file",
        F.nullif(F.trim(F.col("cells")[0]), F.lit("")).alias(key),
        F.posexplode(pairs).alias("pos", "cell"),
    )
    return long.where(F.col("pos") > 0).select(
        "file", key, F.col("cell.header").alias(name), F.col("cell.cells").try_cast("double").alias(value)
    )
