"""Keys that come again in a stream, whichever batches their rows came in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.functions.sqltext import quoted

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def count_keys(stream: DataFrame, key: str, home: str, **trigger) -> StreamingQuery:
    """Keep the number of rows of every key as keyed state, which never expires.

    Rows of a key are combined before they are shuffled. Each batch writes the keys that it changed under its
    own number, so a batch that is repeated after a failure replaces itself; ``repeated_keys`` reads the result.
    """
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        counted = stream.groupBy(stream[quoted(key)].alias("key")).agg(F.count(F.lit(1)).alias("rows"))

        def changed(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/keys/batch={number}")

        writer = counted.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{home}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def repeated_keys(spark: SparkSession, home: str) -> DataFrame:
    """``(key, rows, batches)`` of the keys on several rows, null among them; ``batches`` that had rows of it."""
    states = spark.read.parquet(f"{home}/keys")
    return states.groupBy("key").agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("batches")).filter("rows > 1")
