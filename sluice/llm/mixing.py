"""Mixing sources to target weights by hash thresholds, without sorting documents.

Sources in code point order (null last) get the weights in turn. Targets share all words by
weight; a target stops at ``most`` times its source's size and the excess is shared again by
weight. A source is then taken a whole number of times, and once more for the documents whose
hash lies below a threshold: the words of a source are summed by hash bucket, the bucket in which
its budget runs out is split again by the next hash bits, and so on to one hash value, which is
taken if that brings the sum nearer. Thresholds for smaller budgets are lower, so mixes nest.

The hash is of the document's id and text: reruns agree, and only rows equal in both go together. Null
text has no words, a null id hashes like an empty one, null is a source of its own, sources without
words get target 0, an empty table gives an empty result; other columns stay out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.workspace import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
HASH_BITS = 60
#: Hash bits that each round of histograms looks at: 4,096 buckets a source.
STEP_BITS = 12
#: Sources whose plan is broadcast; with more it is joined by shuffle.
BROADCAST_SOURCES = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(identifier: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of the id's digits and the text."""
    digest = F.md5(F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size → the same with ``target``. One row per source."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    share = weighed.select(
        "*",
        F.sum("source_size").over(every).alias("words"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum(F.col("source_size") * most).over(earlier), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("weight_before"),
    )
    # with all sources of less need stopped, is this one above its limit?
    rest = (F.col("words") - F.col("words_before")).cast("double") / (F.col("weights") - F.col("weight_before"))
    share = share.withColumn("stops", F.col("source_size") * most <= rest * F.col("weight"))
    stopped = lambda column: F.sum(F.when(F.col("stops"), F.col(column)).otherwise(0)).over(every)
    share = share.select("*", stopped("source_size").alias("stopped_size"), stopped("weight").alias("stopped_weight"))
    open_words = F.col("words") - F.col("stopped_size") * most
    open_share = (F.col("weight") * open_words).cast("double") / F.nullif(F.col("weights") - F.col("stopped_weight"), F.lit(0))
    limit = (F.col("source_size") * most).cast("double")
    return share.select("source", "source_size", F.when(F.col("stops"), limit).otherwise(open_share).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where each source's budget runs out.

    ``rows``: source, size, h. ``budgets``: source, budget (words). Returns source, budget,
    ``edge`` (the hash value in which it runs out; null if it never does) and ``edge_taken``
    (whether the rows of that hash value are nearer in than out).
    """
    at = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = rows.alias("r").join(
            at.alias("a"),
            F.col("r.source").eqNullSafe(F.col("a.source")) & (F.shiftright("r.h", shift + STEP_BITS) == F.col("a.prefix")),
        )
        histogram = inside.groupBy("a.source", "a.budget", "a.before", F.shiftright("r.h", shift).alias("bucket")).agg(F.sum("r.size").alias("size"))
        so_far = Window.partitionBy("source").orderBy("bucket")
        summed = histogram.withColumn("through", F.col("before") + F.sum("size").over(so_far)).where("through > budget")
        first = F.min_by(F.struct("bucket", "size", "through"), "bucket").alias("edge")
        at = summed.groupBy("source", "budget").agg(first).select(
            "source", "budget", F.col("edge.bucket").alias("prefix"),
            (F.col("edge.through") - F.col("edge.size")).alias("before"), F.col("edge.size").alias("size"),
        )
    return at.select("source", F.col("prefix").alias("edge"), (F.col("before") + F.col("size") / 2.0 <= F.col("budget")).alias("edge_taken"))


def planned(
    docs: DataFrame, weights: tuple[int, ...], most: int, id_column: str, text_column: str, source_column: str
) -> tuple[DataFrame, DataFrame]:
    """The size and hash of every row; for every source, plan_source, source_size, target, whole, edge, edge_taken."""
    rows = written(
        docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words(F.col(text_column)).alias("size"), row_hash(F.col(id_column), F.col(text_column)).alias("h")),
        "sizes",
    )
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.coalesce(F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(most)), F.lit(0))
    wanted = written(wanted.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    edges = thresholds(rows, wanted.where(F.col("whole") < most).select("source", "budget"))
    plan = wanted.join(edges.withColumnRenamed("source", "edge_source"), F.col("source").eqNullSafe(F.col("edge_source")), "left")
    return rows, written(plan.drop("edge_source", "budget").withColumnRenamed("source", "plan_source"), "plan")


def _copies(h: Column) -> Column:
    more = (h < F.col("edge")) | ((h == F.col("edge")) & F.col("edge_taken"))
    return F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """id, source, size, source_size, target, copies (how often the mix takes the document) for every row."""
    rows, plan = planned(docs, weights, most, id_column, text_column, source_column)
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    return taken.select("id", "source", "size", "source_size", "target", _copies(F.col("h")).alias("copies"))


def repeated(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; no text is shuffled unless sources are very many."""
    _, plan = planned(docs, weights, most, id_column, text_column, source_column)
    plan = plan.select("plan_source", "whole", "edge", "edge_taken")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_column).alias("source"), row_hash(F.col(id_column), F.col(text_column)).alias("h"))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("copies", _copies(F.col("h"))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


SQL = """
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
w AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source)),
o AS (
  SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER b, 0) AS words_before, coalesce(sum(weight) OVER b, 0) AS weight_before
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, 3 * source_size <= (words - words_before)::DOUBLE / (weights - weight_before) * weight AS stops FROM o),
e AS (
  SELECT *, sum(CASE WHEN stops THEN source_size ELSE 0 END) OVER () AS stopped_size,
         sum(CASE WHEN stops THEN weight ELSE 0 END) OVER () AS stopped_weight FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE
              ELSE (weight * (words - 3 * stopped_size))::DOUBLE / nullif(weights - stopped_weight, 0) END AS target
  FROM e),
p AS (
  SELECT *, coalesce(least(floor(target / nullif(source_size, 0)), 3), 0)::BIGINT AS whole FROM t),
u AS (
  SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) - size AS before
  FROM (SELECT source, h, sum(size) AS size FROM s GROUP BY source, h))
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.whole + CASE WHEN p.whole < 3 AND u.before + u.size / 2.0 <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source
       JOIN u ON s.source IS NOT DISTINCT FROM u.source AND s.h = u.h
"""
