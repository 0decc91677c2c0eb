"""Token ids as binary files: ORC in id order, and what can be read from them without the ids.

Each file holds one range of document ids, sorted, as rows (doc_id, start_in_file, n_tokens,
ids). ORC writes the id lists as run-length encoded integers, keeps minima and maxima of doc_id
for each stripe and row group, and a Bloom filter on it, so a reader of a few documents skips
the rest, and a reader of all splits files at stripes. A small manifest table (one row per file)
has each file's first token number, so ``start`` is global without rewriting a file.

Null texts are empty: the end id alone. Rows with a null id come first; rows with equal ids are
ordered by a hash of the text, then by the text. An empty table gives empty files. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.pretokens import ids_encoder, with_end
from sluice.llm.registry import importable

#: Options of the ORC writer.
ORC_OPTIONS = {
    "compression": "none",  # ids are run-length encoded already
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Bytes of input for one output file, about.
FILE_BYTES = 256 << 20
_FILE_ROW = "part long, doc_id long, start_in_file long, n_tokens long, ids array<int>"


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = ids_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids, edges in encoder.ids_of(batch.column(1)):
                ids, edges = with_end(ids, edges, end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, part, np.int64)),
                        batch.column(0).slice(a, b - a),
                        pa.array(start + edges[:-1]),
                        pa.array(np.diff(edges)),
                        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    names=["part", "doc_id", "start_in_file", "n_tokens", "ids"],
                )
                start += int(edges[-1])

    return run


def _bytes_read(df: DataFrame) -> int:
    """Spark's own estimate of what a scan of ``df`` reads, without reading it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, files: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> None:
    """Encode every text, append ``end_id`` and write ``path``/ids and ``path``/manifest.

    ``files``: ranges of document ids; by default enough for about FILE_BYTES of input each, and
    at least one for each shuffle partition of the session.
    """
    spark = docs.sparkSession
    importable(spark)
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if files is None:
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _bytes_read(chosen) // FILE_BYTES)
    # the text decides only between equal digests
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = chosen.repartitionByRange(files, "doc_id").sortWithinPartitions(*order)
    writer = ordered.mapInArrow(_encoded(tokenizer, end_id), _FILE_ROW).write
    writer.options(**ORC_OPTIONS).orc(f"{path}/ids")
    parts = spark.read.orc(f"{path}/ids").groupBy("part").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"),
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.orc(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids."""
    rows = spark.read.orc(f"{path}/ids")
    starts = spark.read.orc(f"{path}/manifest").select("part", "start")
    return rows.join(starts, "part").select("doc_id", (F.col("start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        edges = lists.offsets.to_numpy()
        crc = [zlib.crc32(memoryview(ids[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """The documents of ``read_token_files`` with the crc32 of their ids instead of the ids."""
    importable(tokens.sparkSession)
    return tokens.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
