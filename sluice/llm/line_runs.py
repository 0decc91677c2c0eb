"""Repeated runs of lines, found by a suffix array over line ids, and removed but for their first place.

A line id is a 128-bit hash of the line. Prefix doubling: level 0 numbers the ids that occur more
than once in their order; level k + 1 numbers the pairs (number of the 2^k lines from here, number of
the 2^k lines after them) that occur more than once. Places whose window is unique drop out, so a
level holds repeated windows only, in suffix order, each with its first place; the last level is
reached when no window of that length repeats.

The levels are then read from long to short as intervals of suffixes with a common prefix, which
gives for every place the longest run that also starts at an earlier place, exactly. A node is
a set of places that share their first ``off`` lines. Level k splits it by the window after these:
places that share the window move on together to a node with ``off + 2^k`` lines, in which all
but the first have found an earlier copy of that length. Within a split the places are alike for
any shorter extension, so only the first one stays behind to be compared with the others.

Runs of ``min_words`` words or more are removed wherever an earlier copy exists; "earlier" is by
document id, then place in the document, so the first copy of a passage always stays. Only numbers
move between tasks: a group of places is aggregated and joined with its first place, never
gathered. Aggregates are written before they are joined, so that Spark can split the join at a hot
group, and each round is written, so a lost executor costs one round.

Null text stays null and has no lines. Null ids come first; rows with equal ids are ordered by their place in the
files. Blank lines are lines of no words. A text that loses all its lines is empty. An empty table
gives an empty result. All other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.mixing import words
from sluice.workspace import written

MIN_WORDS = 50

#: Runs to remove (8 bytes each, and 16 a document) that are broadcast; with more, texts are shuffled to them.
BROADCAST_RUNS = 4_000_000

_PLACE = ["d", "line"]


def located(docs: DataFrame) -> DataFrame:
    """``docs`` as a direct scan of files, so that every row has a place that does not change."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "located")


def _key() -> list[Column]:
    return [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")]


def _numbered(classes: DataFrame, *order: str) -> DataFrame:
    """``classes`` with a number in the given order."""
    return classes.orderBy(*order).withColumn("name", F.monotonically_increasing_id())


def _classes(rows: DataFrame, *key: str) -> DataFrame:
    first = F.min(F.struct(*_PLACE)).alias("first")
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    return written(_numbered(repeated, *key).select(*key, "name", F.col("first.d").alias("first_d"), F.col("first.line").alias("first_line")), "classes")


def _levels(lines: DataFrame) -> list[DataFrame]:
    """d, line, name, first_d, first_line of the places whose window of 2^k lines repeats, for each k."""
    classes = _classes(lines, "h1", "h2")
    levels = [written(lines.join(classes, ["h1", "h2"]).select(*_PLACE, "name", "first_d", "first_line", "words"), "level")]
    while True:
        step, last = 1 << (len(levels) - 1), levels[-1]
        after = last.select("d", (F.col("line") - step).alias("line"), F.col("name").alias("next"))
        pairs = written(last.select(*_PLACE, F.col("name").alias("head")).join(after, _PLACE), "pairs")
        classes = _classes(pairs, "head", "next")
        if classes.isEmpty():
            return levels
        levels.append(written(pairs.join(classes, ["head", "next"]).select(*_PLACE, "name", "first_d", "first_line"), "level"))


def _later(rows: DataFrame) -> Column:
    return (F.col("d") != F.col("first_d")) | (F.col("line") != F.col("first_line"))


def _longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """d, line, length: the longest run from each place that also starts earlier."""
    node = ["node_d", "node_line", "off"]
    found, members = [], None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k].select(*_PLACE, "name", "first_d", "first_line")
        # the root: what no longer window has taken along
        root = level
        if k + 1 < len(levels):
            root = level.join(levels[k + 1].where(_later(levels[k + 1])).select(*_PLACE), _PLACE, "left_anti")
        shared = root.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
        root = root.join(written(shared, "shared"), "name")
        moved = root.select(*_PLACE, F.col("first_d").alias("node_d"), F.col("first_line").alias("node_line"), F.lit(1 << k).alias("off"))
        if members is not None:
            window = level.select("d", F.col("line").alias("at"), "name")
            named = written(members.withColumn("at", F.col("line") + F.col("off")).join(window, ["d", "at"], "left").drop("at"), "named")
            first = F.min(F.struct(*_PLACE)).alias("first")
            splits = named.where("name is not null").groupBy(*node, "name").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
            splits = written(splits.select(*node, "name", F.col("first.d").alias("first_d"), F.col("first.line").alias("first_line")), "splits")
            split = written(named.join(splits, [*node, "name"], "left"), "split")
            on = split.where("first_d is not null").select(*_PLACE, F.col("first_d").alias("node_d"), F.col("first_line").alias("node_line"), (F.col("off") + (1 << k)).alias("off"))
            behind = split.where(F.col("first_d").isNull() | ~_later(split)).select(*_PLACE, *node)
            company = behind.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*node)
            moved = moved.unionByName(on).unionByName(behind.join(written(company, "company"), node))
        members = written(moved, "members")
        new = members.where((F.col("d") != F.col("node_d")) | (F.col("line") != F.col("node_line")))
        found.append(new.select(*_PLACE, F.col("off").alias("length")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*_PLACE).agg(F.max("length").alias("length"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """_file, _place, runs: the lines to remove from each row of ``located`` docs, as disjoint
    structs (first, last) in order, counted from 0. Rows without any are absent."""
    text = F.col(text_column).cast("string")
    line = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), words(x).alias("words"))
    rows = docs.where(text.isNotNull()).select(F.col(id_column).alias("id"), *_key(), F.transform(F.split(text, "\n", -1), line).alias("lines"))
    rows = written(rows.orderBy("id", "_file", "_place").withColumn("d", F.monotonically_increasing_id()).drop("id"), "lines")
    lines = rows.select("d", F.posexplode("lines").alias("line", "x")).select(*_PLACE, "x.*")
    levels = _levels(lines)
    within = Window.partitionBy("d").orderBy("line")  # one document
    counted = levels[0].select(*_PLACE, "words", F.sum("words").over(within).alias("through"))
    runs = _longest_earlier(levels).join(counted, _PLACE).withColumn("last", F.col("line") + F.col("length") - 1)
    ends = counted.select("d", F.col("line").alias("last"), F.col("through").alias("end"))
    runs = runs.join(ends, ["d", "last"]).where(F.col("end") - F.col("through") + F.col("words") >= min_words)
    reached = F.max("last").over(within.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*_PLACE, "last", F.coalesce(F.col("line") > reached + 1, F.lit(True)).cast("int").alias("opens"))
    runs = runs.withColumn("island", F.sum("opens").over(within)).groupBy("d", "island").agg(F.min("line").alias("first"), F.max("last").alias("last"))
    removed = runs.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return rows.select("d", "_file", "_place").join(removed, "d").select("_file", "_place", "runs")


def _without(lines: Column, runs: Column) -> Column:
    """The lines between the runs."""

    def kept(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.try_element_at(runs, i)["last"] + 1)
        end = F.when(i == F.size(runs), F.size(lines)).otherwise(F.try_element_at(runs, i + 1)["first"])
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), kept))


def without_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", report: tuple[str, str] | None = None
) -> DataFrame:
    """``docs`` with later copies of repeated runs removed from ``text_column``.

    ``report``: names of two more columns, the number of lines a text had and of those removed.
    """
    docs = located(docs)
    runs = written(repeated_runs(docs, min_words, id_column, text_column), "runs")
    if (runs.agg(F.sum(F.size("runs") + 2)).first()[0] or 0) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    rows = docs.select(F.struct("*").alias("row"), *_key()).join(runs, ["_file", "_place"], "left")
    lines, found = F.split(F.col("row")[text_column].cast("string"), "\n", -1), F.col("runs")
    text = F.when(found.isNull(), F.col("row")[text_column]).otherwise(F.array_join(_without(lines, found), "\n"))
    columns = [(text if c == text_column else F.col("row")[c]).alias(c) for c in docs.columns]
    if report:
        removed = F.aggregate(F.coalesce(found, F.array().cast("array<struct<first:int,last:int>>")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
        columns += [F.coalesce(F.size(lines), F.lit(0)).alias(report[0]), removed.alias(report[1])]
    return rows.select(*columns)
