"""Documents through the stages of a training corpus, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import line_runs, mixing, packing, quality, simhash
from sluice.llm.queries import END_ID, TOKENIZER
from sluice.llm.registry import unused
from sluice.workspace import workspace


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject as poor or toxic."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which no word is left by that."""
    had = docs.columns
    lines, removed = unused("lines", had), unused("removed", had)
    left = line_runs.without_repeats(docs, report=(lines, removed))
    emptied = (F.col(removed) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD)
    return left.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(had)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack(docs, TOKENIZER, END_ID)


STAGES = [
    ("quality classifier", accept),
    ("line dedup", drop_repeated_runs),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: The classifier, the components and the packing are iterative; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{workspace(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
