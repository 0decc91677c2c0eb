"""Headline queries, timed once each after a short warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from queries import QUERIES
from queries.lens import lens
from queries.registry import table
from sluice import audit
from sluice.operators.inspection import Inspection
from sluice.operators.issues import detect
from sluice.operators.profile import profile_rows
from sluice.operators.rows import key_conflicts


def full_profile(spark: SparkSession, sf_dir: str) -> int:
    with Inspection(table(spark, sf_dir, "lineitem")) as inspection:
        return len(profile_rows(inspection))


def duplicate_check(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    with Inspection(table(spark, sf_dir, "lineitem")) as inspection:
        return inspection.copies


def events_conflicts(spark: SparkSession, sf_dir: str) -> int:
    return key_conflicts(table(spark, sf_dir, "events"), "user_id").count()


def dirty_gate(spark: SparkSession, sf_dir: str) -> int:
    return audit(lens(spark, sf_dir), detail=False).validation.score_after


def detect_documents(spark: SparkSession, sf_dir: str) -> int:
    with Inspection(table(spark, sf_dir, "documents")) as inspection:
        return len(detect(inspection))


def _rows(name: str):
    def run(spark: SparkSession, sf_dir: str) -> int:
        result: DataFrame = QUERIES[name](spark, sf_dir)
        return len(result.collect())

    return run


HEADLINES = {
    "b1_profile_lineitem": full_profile,
    "b2_duplicates_lineitem": duplicate_check,
    "b3_key_conflicts_events": events_conflicts,
    "b4_detect_repair_redetect_lens": dirty_gate,
    "b5_sum_by_group_lineitem": _rows("A04_sum_by_group"),
    "b5_top_k_orders": _rows("A05_top_orders"),
    "b6_detect_documents": detect_documents,
    "b7_top_values_documents": _rows("P11_top_values_documents"),
    "b8_parse_numbers_lens": _rows("R03_coerce_numeric_float"),
    "b9_drop_exact_duplicates_lens": _rows("R08_drop_exact_duplicates"),
    "b10_publish_and_ask_lineitem": _rows("V08_gate_publish_ask_lineitem"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with Inspection(table(spark, sf_dir, "nation")) as inspection:  # classes loaded, code compiled
        detect(inspection)
    took = {}
    for name, run in HEADLINES.items():
        start = time.perf_counter()
        run(spark, sf_dir)
        took[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took}
    print(json.dumps(line | {"sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
