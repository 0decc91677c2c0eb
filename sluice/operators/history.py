"""Catalog and history: questions about runs, datasets and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.desc("created_at"), F.desc("id"))


def by_id(records: DataFrame, value: str, column: str = "id") -> DataFrame:
    return records.filter(F.col(column) == value)


def choose_dataset(datasets: DataFrame, mentioned: str | None = None) -> DataFrame:
    """The dataset whose name a text mentions (longest name wins), else the newest."""
    newest = (F.desc("created_at"), F.desc("id"))
    if mentioned:
        name = F.lower(F.replace("display_name", F.lit("_"), F.lit(" ")))
        text = F.lit(mentioned.lower().replace("_", " "))
        named = F.when((name != "") & F.contains(text, name), F.length("display_name")).otherwise(0)
        return datasets.orderBy(named.desc(), *newest).limit(1)
    return datasets.orderBy(*newest).limit(1)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return (
        runs.orderBy(F.desc("created_at"), F.desc("run_id"))
        .limit(limit)
        .select("run_id", "status", "display_name", "created_at", "decision", "score_after", "dataset_id", "review_id")
    )


def current_reviews(review_events: DataFrame) -> DataFrame:
    """Latest event of every review, with when it was opened."""
    return (
        review_events.groupBy("id")
        .agg(
            F.max_by(F.struct("run_id", "status", "staged_path", "dataset_id"), "created_at").alias("last"),
            F.min("created_at").alias("created_at"),
            F.max(F.when(F.col("status") != "pending", F.col("created_at"))).alias("resolved_at"),
        )
        .select("id", "last.*", "created_at", "resolved_at")
    )


def review_queue(review_events: DataFrame, runs: DataFrame, issues: DataFrame, repairs: DataFrame) -> DataFrame:
    """Reviews newest first, each with its residual issues and the repairs still open."""
    residual = issues.filter("stage = 'after'").groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "column", "issue_type", "severity", "row_count"))).alias(
            "residual_issues"
        )
    )
    waiting = F.col("disposition").isin("review", "suggested") | ~F.col("applied")
    planned = repairs.filter(waiting).groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "strategy", "column", "disposition"))).alias("open_repairs")
    )  # a run has a few dozen of either, whatever the size of its table
    about = runs.select("run_id", "display_name", "decision", "score_after")
    return (
        current_reviews(review_events)
        .join(about, "run_id", "left")
        .join(residual, "run_id", "left")
        .join(planned, "run_id", "left")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def totals(datasets: DataFrame, review_events: DataFrame) -> DataFrame:
    """Published datasets and pending reviews."""
    published = datasets.agg(F.count(F.lit(1)).alias("datasets"))
    pending = current_reviews(review_events).agg(F.count_if(F.col("status") == "pending").alias("pending_reviews"))
    return published.withColumn("k", F.lit(1)).join(pending.withColumn("k", F.lit(1)), "k").drop("k")
