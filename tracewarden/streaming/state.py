"""Running streams with keyed state in the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewarden.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(rows: DataFrame, ts: Column, delay_ms: int, columns: list[Column]) -> DataFrame:
    """The columns of a stream, whose watermark follows ``ts`` (epoch milliseconds).

    The event-time column itself is left out: rows the watermark has passed are not dropped unseen, the processors
    tell them apart.
    """
    return rows.withColumn("_event_time", F.timestamp_millis(ts)).withWatermark("_event_time", f"{delay_ms} milliseconds").select(*columns)


def start(out: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Start a query whose state lies in the checkpoint, in the store that keyed processors need."""
    spark = out.sparkSession
    ship_package(spark)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = out.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before)


def folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch owns a folder, which a replay overwrites: what was written twice is there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a ``folder_sink`` wrote so far; nothing if no batch was."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch bigint").parquet(path).drop("batch")
