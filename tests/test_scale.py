"""Operators that must hold at any size: deletion by position, hot values, merged sketches, first rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluice import Gate, Inspection, Rules, Source
from sluice.functions.cells import ORD
from sluice.operators import rows, sieve, sketches
from sluice.operators.ask import preview
from sluice.operators.issues import detect, flagged_rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def few_places(monkeypatch):
    """So few that most bits are set by several entries."""
    monkeypatch.setattr(sieve, "PLACES", 64)


@pytest.mark.parametrize("seed", range(3))
def test_deletion_by_position(spark, few_places, seed):
    draw = random.Random(seed)
    made = [(i, draw.choice(["a", "b", None, "c" * 300]), draw.choice([1.0, -0.0, 0.0, float("nan"), None])) for i in range(200)]
    df = spark.createDataFrame(made, f"{ORD} bigint, a string, b double").repartition(5)
    first = {}
    for i, a, b in made:
        first.setdefault((a, "nan" if b != b else b), i)
    assert sorted(r[ORD] for r in rows.drop_copies(df).collect()) == sorted(first.values())
    for collapse in (True, False):
        first = {}
        for i, a, _ in made:
            first.setdefault(a if a is not None or collapse else i, i)
        found = rows.keep_first(df, "a", Rules(collapse_null_keys=collapse))
        assert found.columns == df.columns
        assert sorted(r[ORD] for r in found.collect()) == sorted(first.values())


def test_nothing_to_delete(spark, few_places):
    df = spark.range(50).selectExpr(f"id AS {ORD}", "id AS k")
    assert rows.drop_copies(df).count() == rows.keep_first(df, "k").count() == 50
    assert rows.drop_copies(df.limit(0)).count() == 0


def test_without_positions(spark):
    df = spark.sql("SELECT * FROM VALUES ('x', 1), ('x', 2), (null, 3), (null, 4), ('x', 1) AS t(k, v)")
    assert rows.drop_copies(df).count() == 4
    assert sorted(str(r.k) for r in rows.keep_first(df, "k").collect()) == ["None", "None", "x"]


def test_kept_rows_are_not_shuffled(spark):
    """Only rows whose bit is set are compared with the list; the branch of all others has no exchange but the bits'."""
    df = spark.range(1000).selectExpr(f"id AS {ORD}", "repeat('wide', 50) AS wide", "id % 900 AS k")
    gone = rows.later_rows(df.selectExpr(ORD, "k AS __key"), ["__key"])
    assert gone.count() == 100
    caught, kept = sieve.sifted(df, F.col(ORD), sieve.sieve(gone, F.col(ORD)))
    assert "Exchange hashpartitioning(_ord" not in plan(kept) and "SortMergeJoin" not in plan(kept)
    assert (caught.count(), kept.count()) == (100, 900)


def test_hot_values_are_found(spark, few_places):
    """One value on a third of all rows, and null among the entries."""
    made = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"v{i % 40}") for i in range(3000)]
    df = spark.createDataFrame(made, f"{ORD} bigint, value string")
    wanted = {"hot", None, "v7"}
    counts = df.groupBy("value").count().filter("value IN ('hot', 'v7') OR value IS NULL")
    entries = counts.select(*rows.digest_of(F.col("value")), F.col("count").alias("n")).cache()
    found = rows.listed(df, F.col("value"), entries, 3000)
    assert found.columns == df.columns
    assert sorted(r[ORD] for r in found.collect()) == [i for i, v in made if v in wanted]


def test_conflicts_of_a_hot_key(spark, few_places):
    made = [(i, 0 if i % 3 == 0 else i, float(i)) for i in range(600)] + [(600, 1, 5.0), (601, 1, 5.0), (602, 2, 2.0), (603, 2, 2.0)]
    df = spark.createDataFrame(made, f"{ORD} bigint, order_id bigint, amount double")
    with Inspection(df) as inspection:
        issues = detect(inspection)
        (label,) = [n for n, i in enumerate(issues) if i.issue_type == "duplicate_key"]
        found = flagged_rows(inspection, issues).filter(F.col("label") == label)
        keys = {}
        for i, k, a in made:
            keys.setdefault(k, []).append((i, a))
        wanted = sorted(i for k, members in keys.items() if len({a for _, a in members}) > 1 for i, _ in members)
        assert sorted(r[ORD] for r in found.collect()) == wanted


def test_sketches_merge(spark):
    df = spark.range(30_000).selectExpr(
        "id", "CAST(id % 5000 AS STRING) AS words", "CASE WHEN id % 10 > 0 THEN id / 100 END AS v", "CASE WHEN id < 0 THEN 'x' END AS none"
    )
    parts = [sketches.sketch(df.filter(f"id % 3 = {i}")) for i in range(3)]
    whole = {r["name"]: r for r in sketches.sketched_profile(sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))).collect()}
    assert whole["id"]["rows"] == 30_000 and whole["v"].null_count == 3_000 and whole["v"]["numbers"] == 27_000
    for name, exact in (("id", 30_000), ("words", 5_000), ("none", 0)):
        assert abs(whole[name].unique_count - exact) <= exact * sketches.DISTINCT_ERROR
    for share, value in zip((0.25, 0.5, 0.75), whole["id"].quartiles):
        assert abs(value / 30_000 - share) <= sketches.RANK_ERROR
    assert whole["none"].quartiles is None and whole["none"]["min"] is None and whole["none"]["mean"] is None
    assert whole["v"]["mean"] == pytest.approx(df.agg(F.avg("v")).first()[0])


def test_sketches_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b double")
    some = spark.createDataFrame([("x", 1.0)], "a string, b double")
    (a, b) = sketches.sketched_profile(sketches.sketch(empty)).orderBy("name").collect()
    assert (a["rows"], a.unique_count, b.quartiles) == (0, 0, None)
    both = sketches.merged(sketches.sketch(empty).unionByName(sketches.sketch(some)))
    (a, b) = sketches.sketched_profile(both).orderBy("name").collect()
    assert (a.unique_count, b.quartiles) == (1, [1.0, 1.0, 1.0])


def test_sketching_builds_no_value_table(spark):
    df = spark.range(10).selectExpr("CAST(id AS STRING) AS word", "id AS n")
    text = plan(sketches.sketch(df))
    assert "hashpartitioning" not in text and text.count("Exchange SinglePartition") == 1


def test_runs_under_approximate_rules_keep_sketches(spark, tmp_path):
    gate = Gate(spark, str(tmp_path / "gate"), Rules(approximate=True))
    for name, start in (("one", 0), ("two", 500)):
        gate.run_table(spark.range(start, start + 600).selectExpr("id AS amount"), Source("parquet", name), run_id=name, detail=False)
    (row,) = gate.sketched_profile("one", "two").collect()
    assert (row["rows"], row["min"], row["max"]) == (1200, 0.0, 1099.0)
    assert abs(row.unique_count - 1100) <= 1100 * sketches.DISTINCT_ERROR


@pytest.mark.parametrize("step", [1, 1000, 10**6])
def test_preview_reads_the_front(spark, tmp_path, step):
    df = spark.range(5000).selectExpr(f"id * {step} + 3 AS {ORD}", "id")
    df.write.parquet(str(tmp_path / "rows"))
    shown = preview(spark.read.parquet(str(tmp_path / "rows")), 10)
    assert [r.id for r in shown.collect()] == list(range(10))
    if step < 10**6:
        assert "LessThan(_ord" in plan(shown)
    assert preview(spark.read.parquet(str(tmp_path / "rows")).filter("id > 4995"), 10).count() == 4
    assert preview(df.limit(0), 10).count() == 0
