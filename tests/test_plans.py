"""The shape of plans: JVM-side rules, pruned scans, no all-pairs joins."""

from __future__ import annotations

import pytest

from queries.lens import lens
from sluice import Inspection
from sluice.functions.cells import cells_of, with_facts
from sluice.operators import rows, spellings
from sluice.operators.repairs import Repair, repair_cells
from sluice.operators.spellings import case_map

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def frames(spark):
    orders, events = lens(spark, SF), spark.read.parquet(f"{SF}/events.parquet")
    cells = cells_of(orders)
    return {
        "facts": with_facts(orders, cells),
        "tokens": Inspection(orders).tokens,
        "case_map": case_map(orders, "status"),
        "copies": rows.row_groups(orders, cells),
        "conflicts": rows.key_conflicts(events, "user_id"),
        "repair": repair_cells(orders, [Repair("coerce_dates", "order_date")]),
        "keep_first": rows.keep_first(events, "user_id"),
    }


def test_no_python_and_no_pairs(frames):
    for name, df in frames.items():
        text = plan(df)
        for bad in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


def test_scan_reads_one_column(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (cell,) = cells_of(events, ["value"])
    text = plan(with_facts(events, [cell]).select(cell.number))
    assert "ReadSchema: struct<value:double>" in text


def test_filter_is_pushed_down(spark):
    from sluice.operators.ask import ask

    events = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(ask(events, "count", where=("user_id", 3)))
    assert "EqualTo(user_id,3)" in text and "ReadSchema: struct<user_id:bigint>" in text


def test_fingerprints_are_what_is_shuffled(frames):
    exchange = next(line for line in plan(frames["copies"]).splitlines() if "Exchange hashpartitioning" in line)
    assert "f1" in exchange and "customer" not in exchange


def test_near_unique_texts_are_not_shuffled(spark):
    """Top values of texts that hardly repeat shuffle digests and heads, never the texts."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    counts = spellings.digest_counts(documents, cells_of(documents))
    (exchange,) = [line for line in plan(counts).splitlines() if "Exchange" in line]
    assert "digest" in exchange and "text" not in exchange and "bare" not in exchange


def test_flagged_rows_and_measures_are_single_actions(spark, monkeypatch):
    """An inspection for decisions counts everything in one aggregate."""
    with Inspection(lens(spark, SF)) as inspection:
        inspection.measure()
        done = dict(inspection._found)
        assert inspection.copies[1] > 0 and inspection.counts and inspection.categories and inspection.distinct_words
        assert inspection._found == done
