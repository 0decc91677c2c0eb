"""Token counts: a map-side two-tier lookup, with no shuffle of pre-tokens.

Tier one is a hash table of the corpus's frequent pre-tokens and their lengths in ids, at most
``table_size`` entries whatever the corpus, and broadcast. Tier two is each worker's bounded
cache (``pretokens``), which encodes what tier one lacks. The table only saves time: counts are
the tokenizer's own for every text.

The table is found in one pass over all texts: each task keeps a bounded tally (rare entries are
dropped when it is full), and the tallies, one row per task, are merged in a tree.

Null texts count as empty: no bytes, no tokens. Repeated rows and ids give one row each, a null
id stays null, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.pretokens import Encoder
from sluice.llm.registry import importable

#: Entries of the broadcast table; with keys of at most KEY_CHARS letters, a few MB at most.
TABLE_SIZE = 32_768
KEY_CHARS = 32
#: Tallies merged in one task.
FAN_IN = 32

_encoders: dict[tuple, Encoder] = {}


def _cut(tally: Counter, size: int) -> Counter:
    return Counter(dict(sorted(tally.items(), key=lambda e: (-e[1], e[0]))[:size])) if len(tally) > size else tally


def _tally(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    tally.update(text.split(" ")[1:])
                    if len(tally) > 16 * size:
                        tally = _cut(tally, 4 * size)
        tally = Counter({k: n for k, n in tally.items() if n > 1 and len(k) <= KEY_CHARS and k.isalpha()})
        blob = json.dumps(_cut(tally, size)).encode()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "tally": pa.array([blob], pa.binary())})

    return run


def _merged(size: int):
    def run(group):
        total: Counter = Counter()
        for blob in group["tally"]:
            total.update(json.loads(blob))
        return group.head(1).assign(tally=json.dumps(_cut(total, size)).encode())

    return run


def frequent_pretokens(texts: DataFrame, size: int = TABLE_SIZE) -> list[str]:
    """At most ``size`` of the most frequent words after a space, over all rows of a one-column table."""
    rows = texts.mapInArrow(_tally(size), "part long, tally binary")
    levels = max(1, math.ceil(math.log(max(2, texts.rdd.getNumPartitions()), FAN_IN)))
    for _ in range(levels):
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(_merged(size), "part long, tally binary")
    total: Counter = Counter()
    for row in rows.collect():  # one row
        total.update(json.loads(bytes(row["tally"])))
    return sorted(_cut(total, size))


def token_counts(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", table_size: int = TABLE_SIZE
) -> DataFrame:
    """``id_column``, n_bytes, n_tokens for every row of ``docs``; ``tokenizer`` names a public file."""
    spark = docs.sparkSession
    importable(spark)
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    words = frequent_pretokens(chosen.select("text"), table_size)
    encode = Encoder(public_tokenizers.path(tokenizer), lengths=True)
    table = spark.sparkContext.broadcast({word: encode(" " + word) for word in words})
    table_key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((tokenizer, table_key))
        if encoder is None:
            _encoders.clear()
            encoder = Encoder(public_tokenizers.path(tokenizer), lengths=True, frequent=table.value)
            _encoders[tokenizer, table_key] = encoder
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(map(encoder, texts), pa.int64()),
                ],
                names=["id", "n_bytes", "n_tokens"],
            )

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)
