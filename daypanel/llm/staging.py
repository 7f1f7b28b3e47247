"""Tables written once below the shared checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from daypanel.session import scratch_dir


#: Spark removes the shuffle files of a finished write at once instead of when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that Spark hands to a Python task at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write a frame to the folder all executors share and read it back.

    It cuts the lineage: a lost executor costs no more than the tasks that were running on it, and the
    shuffle files behind the table are removed, since nothing needs them any more. ``batch`` is the number
    of rows that Python tasks of the frame take at once, for rows that are large themselves.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    own = {_CLEAN: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
