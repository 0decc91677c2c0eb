"""A bitmap of bounded size by which rows that surely have no partner stay where they are.

A lookup in a long list would shuffle every row of the table that is looked up. Here each entry of the
list sets one of ``PLACES`` bits, and a row whose bit is not set is surely not in the list. Only the
others have to be compared with it. The bits are a table of at most ``PLACES / 64`` rows of two longs
whatever the list's length, so they can always be broadcast. With n entries at hashed places a row that is
not in the list is let through with a chance of n / PLACES at most; an entry always is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MiB of bits, in 2^20 rows at most.
PLACES = 1 << 26


def sieve(entries: DataFrame, place: Column) -> DataFrame:
    """The bits ``(__word, __bits)`` that the entries set; ``place`` is any whole number made from an entry."""
    marks = entries.select(F.pmod(place, F.lit(PLACES)).alias("place"))
    marks = marks.selectExpr("shiftright(place, 6) AS __word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit")
    return marks.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))


def sifted(df: DataFrame, place: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may be among the entries, and those that surely are not; null is at no place."""
    at = F.pmod(place, F.lit(PLACES))
    marked = df.withColumn("__place", at).join(F.broadcast(bits), F.expr("shiftright(__place, 6) = __word"), "left")
    caught = F.expr("coalesce(getbit(__bits, CAST(__place & 63 AS INT)) = 1, false)")
    gone = ("__place", "__word", "__bits")
    return marked.filter(caught).drop(*gone), marked.filter(~caught).drop(*gone)
