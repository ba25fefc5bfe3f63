"""Exactly-once output of streams: batches by number, so that a repeated batch takes its own place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenframe.session import ensure_checkpoint_dir

BATCH = "batch_number"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Rows of one batch. Written again, after a failure or a restart, they replace the first attempt's."""
    batch.write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={number}")


def start(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Runs the stream over what is there now. In ``append`` mode every batch is kept, in ``complete`` mode the
    last one holds all rows. A run on the same folder goes on where the one before stopped."""
    return (stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: write_batch(batch, number, folder))
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())


def read_batches(spark: SparkSession, folder: str, schema, last_only: bool = False) -> DataFrame:
    """The rows of all finished batches, or of the last; an unfinished attempt is not read."""
    paths = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    files = paths.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    for status in files.listStatus(paths) if files.exists(paths) else ():
        number = status.getPath().getName().partition("=")[2]
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append((int(number), status.getPath().toString()))
    done = [path for _, path in sorted(done)]
    return spark.read.schema(schema).parquet(*(done[-1:] if last_only else done)) if done else spark.createDataFrame([], schema)


def run(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """The stream's rows once it has read what is there now."""
    folder = new_folder(spark, f"stream-{name}")
    start(stream, folder, mode).awaitTermination()
    return read_batches(spark, folder, stream.schema, mode == "complete")
