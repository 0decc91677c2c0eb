"""Row positions that stay the same however often, and wherever, a table is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.cells import ORD, quoted
from sluice.workspace import written

#: Bytes of a lookup of files, parts or splits that may be sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 256 << 20
#: Which file, and which split of it, a row read from text came from.
FILE_PLACE = ("__file", "__start")


def _offsets(sizes: DataFrame, *key: str) -> DataFrame:
    """``key`` and ``__before``, the rows of all keys before it; one small row per file, part or split, written."""
    earlier = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    offsets = written(offsets, "offsets")
    size = F.sum(sum(F.octet_length(F.col(name).cast("string")) for name in key) + 24)
    return F.broadcast(offsets) if (offsets.agg(size).first()[0] or 0) <= BROADCAST_BYTES else offsets


def parquet_with_positions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``_ord``: files in path order, rows in file order.

    Every row knows its file and its place in it, so only the number of rows per
    file has to be counted, which Parquet answers from its footers. A column of the
    file that is called ``_ord`` itself keeps its values under another name.
    """
    df = own_position_renamed(spark.read.parquet(path))
    names = df.columns
    if len(df.inputFiles()) <= 1:
        return df.select(*map(quoted, names), F.col("_metadata.row_index").alias(ORD))
    file = F.col("_metadata.file_path")
    lookup = _offsets(df.groupBy(file.alias("__file")).agg(F.count(F.lit(1)).alias("n")), "__file")
    placed = df.select(*map(quoted, names), file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    placed = placed.join(lookup, "__file").withColumn(ORD, F.col("__before") + F.col("__row"))
    return placed.select(*map(quoted, names), ORD)


def own_position_renamed(df: DataFrame) -> DataFrame:
    """A source's own column ``_ord`` under a name that is free, so that it is not taken for the row position."""
    taken, name = {c.lower() for c in df.columns}, "ord"
    while name in taken:
        name += "_"
    return df.withColumnsRenamed({c: name for c in df.columns if c.lower() == ORD})


def with_positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """Any table, written once with ``_ord``: in the given order, else as it comes.

    The written copy fixes which row got which number; positions follow from it and
    the row count of each written part, so no task ever sees more than its part. A
    table that has positions already is left as it is.
    """
    if ORD in df.columns:
        return df
    names = df.columns
    if order:
        df = df.orderBy(*order)
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    landed = written(df.withColumn("__id", F.monotonically_increasing_id()), "extract")
    lookup = _offsets(landed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")), "__part")
    placed = landed.withColumn("__part", part).join(lookup, "__part").withColumn(ORD, F.col("__before") + place)
    return placed.select(*map(quoted, names), ORD)


def file_place() -> list[Column]:
    """The columns of ``FILE_PLACE`` for a table that is just being read."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]


def with_file_positions(df: DataFrame) -> DataFrame:
    """Rows just read from text files, written once with ``_ord``: files in path order, rows in file order.

    A reader takes each split of a file in one go, so the rows of a split have consecutive numbers
    in the written copy, and only the first number and the size of each split have to be known.
    ``df`` may bring the columns of ``FILE_PLACE`` itself.
    """
    names = [name for name in df.columns if name not in FILE_PLACE]
    df = df if "__file" in df.columns else df.select("*", *file_place())
    landed = written(df.withColumn("__id", F.monotonically_increasing_id()), "extract")
    splits = landed.groupBy(*FILE_PLACE).agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    placed = landed.join(_offsets(splits, *FILE_PLACE), [*FILE_PLACE])
    placed = placed.withColumn(ORD, F.col("__before") + F.col("__id") - F.col("__first"))
    return placed.select(*map(quoted, names), ORD)
