"""Best-fit packing in a tree: documents into as few sequences of a fixed length as it can.

A document's ids and its end id are one piece, or, when longer than a sequence, a first shorter
piece and then full ones. Full pieces are sequences by themselves. All other pieces are items
of the first round: each task packs its own best-fit, longest first, emits every bin with at
most ``slack`` free places and hands its other bins on. In the next round these bins are items
for one task out of ``fan_in``, and so on to a single task.

A task packs at most CHUNK items at a time, so its memory is bounded, and a bin has at most
``capacity`` members, each of one id at least. When a round saves less than a twentieth of its
bins (two bins over half full never merge), what is left is emitted as it is, so that no task
has to work through bins that fit nowhere. Nothing is left out.

Null texts are empty documents: the end id alone. Repeated rows are packed one by one; their
null or equal ids stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.pretokens import ids_encoder, with_end
from sluice.llm.registry import importable
from sluice.workspace import written

CAPACITY = 2048
#: Free places with which a bin counts as nearly full.
SLACK = 16
FAN_IN = 8
#: Items packed at once.
CHUNK = 200_000
#: A round that saves a smaller share of its bins is the last one.
LEAST_GAIN = 0.05

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_PIECE_SQL = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint"
_BIN_SQL = f"size long, done boolean, members array<struct<{_PIECE_SQL}>>"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    """One row per document: its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            docs = batch.column(0).to_pylist()
            for first, last, ids, edges in encoder.ids_of(batch.column(1)):
                ids, edges = with_end(ids, edges, end_id)
                for doc, at, to in zip(docs[first:last], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    n = to - at
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[at + a : at + b])))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECE)
            members = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PIECE, strict=True)], [n for n, _ in _PIECE])
            size = members.field("length")
            full = pa.array(size.to_numpy() == capacity)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32)), members)
            yield pa.RecordBatch.from_arrays([size, full, each], names=["size", "done", "members"])

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Places of the items in each bin: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: there is a bin with r places
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            chosen = by_free[free].pop()
            if not by_free[free]:
                open_ ^= 1 << free
            bins[chosen].append(item)
        else:
            free, chosen = capacity, len(bins)
            bins.append([item])
        if left := free - size:
            by_free[left].append(chosen)
            open_ |= 1 << left
    return bins


def _pack(capacity: int, slack: int):
    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        sizes, members = table.column("size").to_numpy(), table.column("members").combine_chunks()
        bins = best_fit(sizes, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
        total = np.array([sizes[b].sum() for b in bins], np.int64)
        moved = members.take(pa.array(order))
        edges = moved.offsets.to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(edges[np.cumsum([0, *map(len, bins)])].astype(np.int32)), moved.values)
        return pa.RecordBatch.from_arrays([pa.array(total), pa.array(total >= capacity - slack), lists], names=["size", "done", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield packed(held)
                held = []
        if sum(b.num_rows for b in held):
            yield packed(held)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        members, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = np.diff(edges)
        length = members.field("length").to_numpy()
        before = np.concatenate([[0], np.cumsum(length)])
        offset = before[:-1] - np.repeat(before[edges[:-1]], counts)
        sequence = np.repeat(batch.column(0).to_numpy(), counts)
        columns = [members.field(n) for n, _ in _PIECE]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset.astype(np.int64))], names=[*(n for n, _ in _PIECE), "sequence_id", "offset"])


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, slack: int = SLACK,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    importable(docs.sparkSession)
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    pieces = written(chosen.mapInArrow(_pieces(tokenizer, end_id, capacity), _BIN_SQL), "pieces")
    bins, rest = [pieces.where("done")], pieces.where("not done")
    before = rest.count()
    tasks = max(1, min(rest.rdd.getNumPartitions(), -(-before // 1000)))
    while before:
        packed = written(rest.repartition(tasks).mapInArrow(_pack(capacity, slack), _BIN_SQL), "bins")
        left = packed.where("not done").count()
        if tasks == 1 or left > (1 - LEAST_GAIN) * before:
            bins.append(packed)
            break
        bins.append(packed.where("done"))
        rest, before, tasks = packed.where("not done"), left, -(-tasks // FAN_IN)
    every = bins[0]
    for more in bins[1:]:
        every = every.unionByName(more)
    numbered = every.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.mapInArrow(_places, f"{_PIECE_SQL.replace(':', '')}, sequence_id long, offset long")
