"""Session helpers: a local session for tests and benches, scratch folders, staged frames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, app: str = "daypanel") -> SparkSession:
    """A local session with one shuffle partition per core; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DAYPANEL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path for staged files, which every executor can reach; removed when the application ends.

    It lies under ``spark.checkpoint.dir``, or where that is unset under the warehouse, which is shared
    by contract. Both are resolved by the Hadoop file system of their scheme.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    # One folder for all that the application stages: it has to exist for its removal to be noted.
    root = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "staged", conf: Mapping[str, str] | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    For frames that several branches of a plan use, such as a panel that gives both the region list and
    the rows of a report: otherwise every branch scans the raw records again, since each prunes other
    columns. The panel is far smaller than its records, and a lost executor costs no recomputation.
    ``conf`` holds settings for this write only.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    before = {key: spark.conf.get(key, None) for key in conf or {}}
    for key, value in (conf or {}).items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
