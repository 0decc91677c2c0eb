"""One query for each operator, with the parameters it runs with in production."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import divergence, exact_dedup, line_rules, line_runs, middle, mixing, neighbours, packing, quality, simhash, suffix_model, token_counts, token_files
from sluice.llm.registry import query, table
from sluice.workspace import workspace

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)
    return counts.withColumn("over_limit", counts["n_tokens"] > 1024)


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{workspace(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return token_files.digests(token_files.read_token_files(spark, path))


@query("op3_source_mixing", mixing.SQL)
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "poor", "toxic", "rejected")


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


@query("op6_collision_neighbours")
def op6_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.without_repeats(table(spark, sf_dir, "documents"), report=("n_lines", "n_removed"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


@query("op8_exact_dedup", exact_dedup.SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_copies(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op9_suffix_tree_scores")
def op9_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_model.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


@query("op11_source_divergence", divergence.SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op12_fill_in_middle", middle.SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op13_line_rules", line_rules.SQL)
def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.clean_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
