"""What must not grow faster than the table: how often rows are made again, what one task reads, how code is compiled."""

from __future__ import annotations

import pytest

from queries import edge_queries, profile_queries, repair_queries
from queries.lens import lens
from sluice import Inspection, Rules
from sluice.functions.cells import ORD, cells_of
from sluice.operators import inspection, profile, repairs, spellings
from sluice.operators.repairs import Repair, apply
from sluice.plans.gate import Gate
from sluice.workspace import short_methods

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.codegen.hugeMethodLimit"
PLAN = [Repair("trim_whitespace", "a"), Repair("coerce_dates", "d"), Repair("drop_exact_duplicates")]


@pytest.fixture
def extract(frame):
    return frame("a string, d string", (" x", "1/2/2024"), ("x", "2024-01-02"), (None, "no"), ("y ", None), (" x", "1/2/2024"))


def seen_labels(monkeypatch, module) -> list[str]:
    labels, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df, label, path=None: labels.append(label) or plain(df, label, path))
    return labels


def test_repaired_cells_of_a_large_table_are_made_once(extract, monkeypatch):
    small, counted = apply(extract, PLAN)
    labels = seen_labels(monkeypatch, repairs)
    large, done = apply(extract, PLAN, rules=Rules(broadcast_rows=0))
    assert labels == ["cells", "rows"] and done == counted
    assert sorted(map(str, large.collect())) == sorted(map(str, small.select(*large.columns).collect()))
    assert {(r.strategy, r.rows_affected) for r in done} == {("trim_whitespace", 3), ("coerce_dates", 3), ("drop_exact_duplicates", 2)}


def test_repaired_cells_alone_are_counted_while_they_are_written(extract, monkeypatch):
    labels = seen_labels(monkeypatch, repairs)
    rows, done = apply(extract, PLAN[:2], write=True)
    assert labels == ["repaired"] and [r.rows_affected for r in done] == [3, 3]
    assert rows.columns == extract.columns and rows.count() == 5


def test_a_large_derived_table_is_written_before_it_is_inspected(spark, monkeypatch):
    labels = seen_labels(monkeypatch, inspection)
    events = spark.read.parquet(f"{SF}/events.parquet")
    for df, expected in ((lens(spark, SF), ["inspected"]), (events, []), (events.select(events.event_id.alias("k")), [])):
        labels.clear()
        Inspection(df, Rules(small_table_bytes=0))
        assert labels == expected


def test_the_method_limit_comes_back(spark, extract):
    before = spark.conf.get(LIMIT)
    with Inspection(extract), short_methods(spark):
        assert spark.conf.get(LIMIT) == "8000"
    assert spark.conf.get(LIMIT) == before
    spark.conf.set(LIMIT, "4000")
    try:
        with Inspection(extract):
            assert spark.conf.get(LIMIT) == "4000"
        assert spark.conf.get(LIMIT) == "4000"
    finally:
        spark.conf.set(LIMIT, before)


def test_examples_are_the_first_present_values_wherever_they_lie(spark, monkeypatch):
    df = spark.range(40).selectExpr(f"id AS {ORD}", "concat('v', id) AS early", "if(id > 30, concat('w', id), null) AS late", "CAST(null AS STRING) AS never")
    monkeypatch.setattr(profile, "NEAR", 8)
    with Inspection(df) as whole:
        assert profile.examples(whole) == {"early": ["v0", "v1", "v2"], "late": ["w31", "w32", "w33"], "never": []}


def test_no_row_is_shuffled_once_for_each_column(spark):
    plan = profile_queries.merged_sketches(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_files_of_a_large_extract_are_many(spark, monkeypatch):
    monkeypatch.setattr(edge_queries, "_FILE_ROWS", 200)
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {tuple(row) for row in edge_queries.refused_headers(spark, SF).collect()} == {("equal", orders), ("in another order", None)}
    batches, plain = [], Gate.run_table
    monkeypatch.setattr(Gate, "run_table", lambda self, df, *more: batches.append(df.count()) or plain(self, df, *more))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(row.rows for row in edge_queries.stream_publishes(spark, SF).collect()) == sum(batches) == lines
    assert len(batches) == 2


def test_numbers_in_texts_are_read_once(frame, monkeypatch):
    """Quartiles and outliers of a text column come from its counted spellings, with their frequencies."""
    values = [("$10", 4)] * 5 + [("10.5", 1)] * 3 + [("12", None)] * 4 + [("1,300", 9), ("n/a", 2), ("x", 7), (None, 3)]
    read, plain = [], Inspection.facts
    monkeypatch.setattr(Inspection, "facts", lambda self, cells: read.extend(c.name for c in cells) or plain(self, cells))
    with Inspection(frame("a string, b int", *values), Rules(quantile_rows_per_task=2, number_share=0.5)) as found:
        assert found.quartiles == {"a": [10.0, 10.5, 12.0], "b": [1.75, 4.0, 4.0]}
        assert (found.outliers["a"].outliers, found.outliers["a"].unit_scale) == (1, True)
        assert sum(found.histograms["a"].buckets) == 13 and sum(found.histograms["b"].buckets) == 12
    assert set(read) == {"b"}


def test_tokens_are_hashed_not_sorted(frame):
    df = frame("a string, country string", *[(" X", "USA"), ("x", "usa"), ("X", "United States"), ("y", "Peru"), (None, "peru"), ("-", "peru")])
    with Inspection(df) as found:
        found.measure()
        plans = [spellings.measured_tokens(found._measured, [cell], found.rules) for cell in found.worded]
        sorts = ["SortAggregate" in plan._jdf.queryExecution().executedPlan().toString() for plan in plans]
        words = found._found["words"]
    assert sorts == [False, True]  # only the few aliases of countries
    assert (words[0]["rewrite"], words[0]["variants"], words[0]["tokens"]) == (1, 1, 2)
    assert (words[1]["rewrite"], words[1]["aliases"], words[1]["countries"]) == (3, 2, [("United States", 3)])


def test_rows_without_a_long_text_are_ruled_out_first(frame):
    df = frame("a string, b string", ("x" * 201, "y"), ("x", None), (None, "ü" * 101), ("x" * 200, "y"))
    long = spellings.only_long(df, cells_of(df))
    assert sorted(long.collect()) == [(0, "x" * 201), (1, "ü" * 101)]
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Filter")  # the innermost operator stands last


def test_rows_affected_are_counted_on_the_inspected_table(spark, monkeypatch):
    seen, plain = [], repair_queries.apply
    monkeypatch.setattr(repair_queries, "apply", lambda *a, **more: seen.append(more.get("inspected")) or plain(*a, **more))
    repair_queries.affected(spark, SF)
    assert [type(one) for one in seen] == [Inspection]
