"""Writers: dated snapshots, European CSV, published report tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from daypanel.functions.text import comma_text
from daypanel.operators.reshape import q
from daypanel.sources.files import as_text_schema, csv2_options, to_declared

_FRACTIONS = ("double", "float", "decimal")


def decimal_comma(df: DataFrame) -> DataFrame:
    """Fractional columns as text with a decimal comma; other columns unchanged."""
    kinds = dict(df.dtypes)
    return df.select(
        *[comma_text(q(c)).alias(c) if kinds[c].startswith(_FRACTIONS) else q(c) for c in df.columns]
    )


def write_snapshot(df: DataFrame, folder: str, as_of: dt.date, fmt: str = "parquet") -> str:
    """Write one day's snapshot to ``folder/snapshot=<date>``; a rerun replaces that day only.

    ``fmt`` is ``parquet``, ``csv`` or ``csv2`` (semicolon, decimal comma). Later reads of one day touch
    only its folder.
    """
    path = f"{folder}/snapshot={as_of.isoformat()}"
    _write(df, path, fmt)
    return path


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = (decimal_comma(df) if fmt == "csv2" else df).write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "csv2"):
        writer.option("header", True).option("sep", ";" if fmt == "csv2" else ",").csv(path)
    else:
        raise ValueError("fmt is 'parquet', 'csv' or 'csv2'")


def _store(spark: SparkSession, folder: str):
    """The file system of a folder, and a maker of paths in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _listed(spark: SparkSession, folder: str) -> list[str]:
    store, path = _store(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path(folder))) if store.exists(path(folder)) else []


def _versions(spark: SparkSession, folder: str, as_of: dt.date | None = None) -> dict[str, list[str]]:
    """Published versions of each day, oldest first, by the marks in the folder. Marks are ``<number>.<version>``."""
    days = [f"snapshot={as_of.isoformat()}"] if as_of else _listed(spark, f"{folder}/_published")
    found = {day: [name for name in _listed(spark, f"{folder}/_published/{day}") if name[0].isdigit()] for day in days}
    return {day: sorted(names, key=lambda n: (int(n.split(".")[0]), n)) for day, names in found.items() if names}


def publish_snapshot(df: DataFrame, folder: str, as_of: dt.date, fmt: str = "parquet") -> str:
    """Write one day's snapshot so that readers never see it half done; gives the folder of its version.

    The rows go to a folder of their own. When all of it is written, one rename puts a mark beside the marks of earlier versions;
    readers take the day's last mark. Until then they read the version before, and a writer that is killed
    leaves rows that no mark names. Of two writers at once both versions stay, and the later mark counts.
    """
    spark, day = df.sparkSession, f"snapshot={as_of.isoformat()}"
    version = uuid.uuid4().hex
    _write(df, f"{folder}/{day}/version={version}", fmt)
    earlier = _versions(spark, folder, as_of).get(day, [])
    number = int(earlier[-1].split(".")[0]) + 1 if earlier else 1
    store, path = _store(spark, folder)
    marks = f"{folder}/_published/{day}"
    store.mkdirs(path(marks))
    store.create(path(f"{marks}/_{version}")).close()
    if not store.rename(path(f"{marks}/_{version}"), path(f"{marks}/{number}.{version}")):
        raise OSError(f"the mark of version {version} could not be set in {marks}")
    return f"{folder}/{day}/version={version}"


def read_published(spark: SparkSession, folder: str, schema: StructType, as_of: dt.date | None = None, fmt: str = "parquet") -> DataFrame:
    """The published rows of one day or of all, with their day as ``snapshot``; an empty frame where there are none.

    The version of each day is resolved here: a frame goes on reading it while newer ones are published.
    """
    whole = StructType([*schema.fields, StructField("snapshot", DateType()), StructField("version", StringType())])
    current = [f"{folder}/{day}/version={names[-1].split('.')[1]}" for day, names in _versions(spark, folder, as_of).items()]
    if not current:
        return spark.createDataFrame([], whole).drop("version")
    if fmt == "csv2":
        text = csv2_options(spark.read).schema(as_text_schema(whole)).option("basePath", folder).csv(current)
        return to_declared(text, whole).drop("version")
    reader = spark.read.schema(whole).option("basePath", folder).option("header", True)
    return (reader.parquet if fmt == "parquet" else reader.csv)(*([current] if fmt == "csv" else current)).drop("version")


def remove_versions(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Remove all but the last ``keep`` versions of every day, and how many that were. Readers of the kept ones are not disturbed."""
    if keep < 1:
        raise ValueError("the last version of a day stays")
    store, path = _store(spark, folder)
    removed = 0
    for day, names in _versions(spark, folder).items():
        for name in names[:-keep]:
            # The mark goes first: no reader resolves a version that is being removed.
            store.delete(path(f"{folder}/_published/{day}/{name}"), False)
            store.delete(path(f"{folder}/{day}/version={name.split('.')[1]}"), True)
            removed += 1
    return removed


def write_daily_csv2(df: DataFrame, folder: str, day: str) -> str:
    """Write a frame of many days as one csv2 sub-folder per day.

    Rows are rebalanced by day: Spark splits a day with very many rows over several tasks and files and
    packs small days together, so neither one huge file nor many tiny ones come out.
    """
    flat = decimal_comma(df).withColumn("snapshot", F.to_date(q(day)))
    balanced = flat.hint("rebalance", F.col("snapshot"))
    balanced.write.mode("overwrite").partitionBy("snapshot").option("header", True).option("sep", ";").csv(folder)
    return folder


def publish_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Offer a report table under a view name and, with a path, store it as parquet."""
    if path is not None:
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df
