"""Streams to written tables: every batch is a folder of its own that a replay overwrites, so that nothing is written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import new_path, ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Processors with named state need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(spark)


def write_batch(path: str):
    """For foreachBatch: batch k goes to the folder batch=k under path, whole or not at all visible, and again to the same on a replay."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that its source has now. Source positions, state and results lie in the shared folder."""
    path = new_path(stream.sparkSession, name)
    running = (
        stream.writeStream.foreachBatch(write_batch(f"{path}/out")).outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/state").start()
    )
    running.awaitTermination()
    if (failed := running.exception()) is not None:
        raise failed
    names = [F.col(c) for c in stream.columns]
    read = stream.sparkSession.read.schema(stream.schema).option("basePath", f"{path}/out")
    return read.parquet(f"{path}/out/batch=*").select(*names)


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of files as a stream of its rows, a file at a time, oldest first."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}*")
