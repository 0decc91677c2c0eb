"""Near copies by SimHash: fingerprints that differ in at most ``max_bits`` bits are linked.

Words are runs without ASCII white space, A-Z in lower case; every shingle of ``shingle`` words
(a shorter text is one shingle) is hashed with XXH64, seed 42, and a fingerprint bit is set when
it is set in more than half of the hashes. No word at all: fingerprint zero.

Links are found between distinct fingerprints by pigeonring filtering. The 64 bits are cut into
``2 * max_bits + 1`` segments on a ring. If two fingerprints differ in at most ``max_bits`` bits,
then from some segment on, going round the ring, every chain of l segments differs in at most
l * max_bits / segments bits. The first two segments of such a chain are thus equal, which is the
join key; the further chains are checked on the candidates, and what passes gets the full
Hamming check. Texts with one fingerprint are one row before any of this.

Where more than ``bucket`` fingerprints share a key, pairs would grow with the square of the
group. Those fingerprints are linked exactly by another way: two of them differ in at most two
bits if and only if they share a point at distance one or less, so each meets the others at its
65 such points, and each point links its members to their smallest.

Null text is empty. Repeated rows and ids are kept; a null id takes part but is no component id.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.line_runs import located
from sluice.llm.registry import importable
from sluice.workspace import written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints with one key that are compared pair by pair.
BUCKET = 32
#: Words hashed at once, so that a very long text needs bounded memory.
BLOCK = 1 << 18

#: Places of dropped rows (16 bytes each) that are broadcast; with more, texts are shuffled to them.
BROADCAST_ROWS = 2_000_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), 0
    last = max(1, len(words) - shingle + 1)
    for at in range(0, last, BLOCK):
        part = words[at : min(at + BLOCK, last) + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]  # noqa: B905
        hashes = np.fromiter(map(_hash, shingles), np.uint64)
        total += len(hashes)
        for k, column in enumerate(hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T):
            counts[8 * k : 8 * k + 8] += np.bincount(column, minlength=256) @ _BITS
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str, shingle: int = SHINGLE) -> DataFrame:
    """id, fingerprint (64 bits as a signed long)."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, shingle) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fingerprint"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, fingerprint long")


def _segments(count: int) -> list[int]:
    """Bit masks of the segments, as signed longs."""
    edges = [round(64 * k / count) for k in range(count + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _chain(masks: list[int], start: int, length: int) -> int:
    found = 0
    for k in range(length):
        found |= masks[(start + k) % len(masks)]
    return found


def _viable(difference: Column, masks: list[int], max_bits: int) -> Column:
    """Whether some start has all its chains within their budgets."""
    m = len(masks)
    starts = []
    for start in range(m):
        within = [F.bit_count(difference.bitwiseAND(F.lit(_chain(masks, start, n)))) <= n * max_bits // m for n in range(1, m)]
        condition = within[0]
        for more in within[1:]:
            condition = condition & more
        starts.append(condition)
    found = starts[0]
    for more in starts[1:]:
        found = found | more
    return found


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of the distinct longs in column ``fingerprint`` that connect all that differ in at
    most ``max_bits`` bits: every such pair outside large buckets, and enough to connect them inside."""
    masks = _segments(2 * max_bits + 1)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.col("fingerprint").bitwiseAND(F.lit(_chain(masks, k, 2))).alias("bits")) for k in range(len(masks))]))
    keyed = written(prints.select("fingerprint", keys.alias("key")).select("fingerprint", "key.*"), "keys")
    sizes = written(keyed.groupBy("start", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    keyed = written(keyed.join(sizes, ["start", "bits"]), "shared-keys")
    small = keyed.where(F.col("n") <= bucket)
    a, b = small.select("start", "bits", F.col("fingerprint").alias("a")), small.select("start", "bits", F.col("fingerprint").alias("b"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b, ["start", "bits"]).where("a < b").where(_viable(difference, masks, max_bits)).where(F.bit_count(difference) <= max_bits).select("a", "b")
    crowded = keyed.where(F.col("n") > bucket).select(F.col("fingerprint").alias("a")).distinct()
    return pairs.union(_by_points(crowded, max_bits)).distinct()


def _by_points(prints: DataFrame, max_bits: int) -> DataFrame:
    if max_bits != 2:
        raise ValueError("large buckets are linked through points at distance one, which is exact for two bits")
    flips = [0, *(1 << k for k in range(63)), -(1 << 63)]
    points = prints.select("a", F.explode(F.array(*[F.col("a").bitwiseXOR(F.lit(x)) for x in flips])).alias("point"))
    least = points.groupBy("point").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "b")
    return points.join(least, "point").where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"))


def near_copies(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, fingerprint (long), component (smallest id reachable through links) for every row."""
    rows = written(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    distinct = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct-fingerprints")
    linked = written(components(links(distinct.select("fingerprint"), max_bits, bucket)), "components")
    of = distinct.join(linked, F.col("fingerprint") == F.col("node"), "left")
    of = of.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    lowest = of.groupBy("root").agg(F.min("least").alias("component"))
    found = of.select("fingerprint", "root").join(lowest, "root").select("fingerprint", "component")
    return rows.join(found, "fingerprint").select("id", "fingerprint", "component")


def representatives(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; of rows with one id, the first in file order.

    Rows without an id stay unless their component has one with an id, or an earlier one without.
    """
    docs = located(docs)
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")]
    rows = docs.select(F.struct(F.col(id_column).isNull().alias("unnamed"), F.col(id_column).alias("id"), *place).alias("key"), F.col(text_column).alias("text"))
    found = near_copies(rows, shingle, max_bits, bucket, "key", "text")
    dropped = written(found.where(F.col("id") != F.col("component")).select("id._file", "id._place"), "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.select(F.struct("*").alias("row"), *place).join(dropped, ["_file", "_place"], "left_anti").select("row.*")
