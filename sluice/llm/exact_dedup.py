"""Exact copies, by a stateful stream with keyed state on disk.

The files of a folder are read as a stream. State is kept by RocksDB for each SHA-256 digest of
a text and never expires: the stable identifier of the row that stays (the largest id), the
locator of its content (file and row in it), and the number of rows. Rows of a digest are
combined before they are shuffled, so a digest with a third of all rows is a few rows a batch.
A micro-batch appends the states that it changed; after the last one, the newest state of each
digest is the result. A stream can go on later where it stopped, over new files.

Every row whose digest has another row is a hit, and its full bytes are compared with the
content at the locator. Hits of one digest are spread over salted copies of that content, so no
task compares a whole large group. Rows that differ (a digest met by chance) are grouped by
their full text instead.

Null text equals empty text. Of rows with one id, the last in file order counts as the largest;
a null id is smaller than any other. An empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.workspace import workspace, written

FILES_PER_BATCH = 256
#: Rows of one digest compared in one place.
SALT_ROWS = 512
#: Digests whose rows are found by a broadcast list of 8-byte hashes; with more, by a join.
BROADCAST_DIGESTS = 1_000_000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else every state partition takes megabytes of disk before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
_LOCATOR = ["id", "file", "place"]


def sha256(text: Column) -> Column:
    """32 raw bytes."""
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(
        F.col(id_column).cast("long").alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("place"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def _narrow(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([schema[n] for n in dict.fromkeys(names)])


def _as_pattern(path: str) -> str:
    """A pattern that only ``path`` matches: a stream takes a pattern for one file too."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def digest_states(
    spark: SparkSession, path: str, home: str, id_column: str = "doc_id", text_column: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """digest, keep (id, file, place), n for every digest in the Parquet files at ``path``.

    ``home``: a shared folder with the stream's checkpoint and its changed states.
    """
    schema = _narrow(spark.read.parquet(path).schema, id_column, text_column)
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_as_pattern(path))
        rows = _rows(stream, id_column, text_column).withColumn("digest", digest(F.col("text")).cast("binary"))
        states = rows.groupBy("digest").agg(F.max(F.struct(*_LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("n"))

        def append(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{home}/states/batch={batch}")  # a repeated batch replaces itself

        running = states.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").foreachBatch(append)
        running.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    newest = F.max_by(F.struct("keep", "n"), "n").alias("state")
    kept = _states(spark, f"{home}/states").groupBy("digest").agg(newest)
    return kept.select("digest", "state.keep", "state.n")


def _states(spark: SparkSession, path: str) -> DataFrame:
    locator = "struct<id: bigint, file: string, place: bigint>"
    return spark.read.schema(f"digest binary, keep {locator}, n bigint").parquet(path)


def exact_copies(
    spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """id, keep_id, group_size, kept, digest for every row of the Parquet files at ``path``."""
    home = f"{workspace(spark)}/exact-copies-{uuid.uuid4().hex}"
    states = written(digest_states(spark, path, home, id_column, text_column, digest, files_per_batch), "digest-states")
    shared = states.where("n > 1").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
    docs = _rows(spark.read.parquet(path), id_column, text_column).withColumn("digest", digest(F.col("text")).cast("binary"))

    if shared.count() <= BROADCAST_DIGESTS:
        near = F.broadcast(shared.select(F.xxhash64("digest").alias("h")).distinct())
        docs_near = docs.join(near, F.xxhash64("digest") == F.col("h"), "left_semi")
    else:
        docs_near = docs
    # texts of copies go once through a shuffle and are not written
    salt = F.pmod(F.xxhash64("file", "place"), F.col("salts")).cast("int")
    hits = docs_near.join(shared.select("digest", "salts", "keep"), "digest").withColumn("salt", salt)
    located = (F.col("file") == F.col("keep.file")) & (F.col("place") == F.col("keep.place"))
    contents = hits.where(located).select("digest", F.col("text").alias("content"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    compared = hits.join(contents, ["digest", "salt"]).withColumn("same", F.col("text") == F.col("content"))
    # digests that met by chance: none, in all likelihood
    strangers = written(compared.where("not same").select("digest", *_LOCATOR, "text"), "strangers")
    groups = strangers.groupBy("digest", "text").agg(F.max(F.struct(*_LOCATOR)).alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
    own = strangers.join(groups, ["digest", "text"]).select("file", "place", "own_keep", "own_n")
    gone = strangers.groupBy("digest").agg(F.count(F.lit(1)).alias("strangers"))

    sizes = states.join(gone, "digest", "left").select("digest", "keep", (F.col("n") - F.coalesce("strangers", F.lit(0))).alias("n"))
    sizes = written(sizes, "sizes")  # so that the next join can be split at a hot digest
    rows = docs.select("digest", *_LOCATOR).join(sizes, "digest").join(own, ["file", "place"], "left")
    keep = F.coalesce("own_keep", "keep")
    return rows.select(
        "id",
        keep["id"].alias("keep_id"),
        F.coalesce("own_n", "n").alias("group_size"),
        ((F.col("file") == keep["file"]) & (F.col("place") == keep["place"])).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
