"""Snapshot folder as a stream: only new files are read, exact duplicates are dropped for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from daypanel.operators.reshape import q, quoted
from daypanel.sources.files import as_text_schema, csv2_options, to_declared

#: Partition column of the table: the day of the stamp.
_DAY = "_stamp_day"


def stream_folder(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The files of a csv2 folder as a stream, each new file once."""
    reader = csv2_options(spark.readStream).option("recursiveFileLookup", True).schema(as_text_schema(schema))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return to_declared(reader.csv(folder), schema)


def ingest_snapshots(stream: DataFrame, table: str, checkpoint: str, stamp: str = "update") -> StreamingQuery:
    """Append the rows a stream brings and the table lacks, then stop when no file is left.

    The table is its own memory: each batch is made distinct (combined map-side, so a row with very many
    copies is no hot key) and compared with the earlier batches over the stamp days it holds. The table is
    partitioned by that day, so a late file reads its own days and not the history between. No watermark, so
    a late file is never dropped and no state grows. A batch is read once, writes only its own folder, and
    so replaces itself when it is repeated after a failure. One table belongs to one checkpoint.
    """
    schema, columns = stream.schema, stream.columns

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.distinct().withColumn(_DAY, F.to_date(q(stamp)))
        if batch_id > 0:
            rows = rows.persist()
            days = [r[0] for r in rows.select(_DAY).distinct().collect()]
            earlier = read_ingested(batch.sparkSession, table, schema, with_batch=True).where(F.col("batch") < batch_id)
            held = F.col(_DAY).isin([d for d in days if d is not None])
            earlier = earlier.where(held | F.col(_DAY).isNull() if None in days else held).select(*[q(c) for c in columns])
            seen = earlier.toDF(*[f"_seen_{i}" for i in range(len(columns))])
            same = [rows[quoted(c)].eqNullSafe(seen[f"_seen_{i}"]) for i, c in enumerate(columns)]
            rows.join(seen, on=same, how="left_anti").write.mode("overwrite").partitionBy(_DAY).parquet(f"{table}/batch={batch_id}")
            rows.unpersist()
        else:
            rows.write.mode("overwrite").partitionBy(_DAY).parquet(f"{table}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: Keyed state on the disks of the executors, its changes saved with the checkpoint.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def ingest_keyed(stream: DataFrame, table: str, checkpoint: str, stamp: str = "update") -> StreamingQuery:
    """Append the rows that no earlier batch brought, as ``ingest_snapshots`` does, without reading the table.

    The rows seen are keyed state, spread by row over the tasks and saved with the checkpoint: a batch looks up its own
    rows and no others, so its cost does not depend on how long the table is. There is no watermark, so late files lose nothing; the
    state grows by the distinct rows, which the table holds as well. A repeated batch starts from the state before
    it and replaces its own folder. The number of state partitions is that of shuffles when the checkpoint is new.
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(_DAY).parquet(f"{table}/batch={batch_id}")

    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        return (
            stream.dropDuplicates(stream.columns)
            .withColumn(_DAY, F.to_date(q(stamp)))
            .writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_ingested(spark: SparkSession, table: str, schema: StructType, with_batch: bool = False) -> DataFrame:
    """The rows of the table with the declared columns; an empty frame where no batch has been written yet."""
    whole = StructType(list(schema.fields) + [StructField("batch", IntegerType()), StructField(_DAY, DateType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(whole).parquet(table) if exists else spark.createDataFrame([], whole)
    return rows if with_batch else rows.drop("batch", _DAY)
