"""Repairs, whole runs, reviews, questions, sources and a stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sluice import Gate, GateError, Inspection, Rules, Source, audit, read
from sluice.operators import history
from sluice.operators.ask import ask
from sluice.operators.issues import detect
from sluice.operators.repairs import Repair, apply, canonicalize_case, plan_auto, repair_cells
from sluice.sources.positions import parquet_with_positions, with_positions
from sluice.sources.readers import jdbc_options, payload_records, read_csv, read_json, read_sql
from sluice.sources.shape import flatten, renamed, unwrap
from sluice.streaming.gated import gate_stream
from test_measures import messy


def values(df, column="v"):
    return [row[column] for row in df.orderBy("_ord").collect()]


# -- repairs ------------------------------------------------------------------------------


def test_cell_repairs(frame):
    df = frame("v string", ("$1,200",), (" 7 ",), ("N/A",), ("odd",), (None,), ("3.50",))
    assert values(repair_cells(df, [Repair("coerce_numeric", "v", target_type="float")])) == [
        1200.0, 7.0, None, None, None, 3.5,
    ]
    assert values(repair_cells(df, [Repair("trim_whitespace", "v")]))[1] == "7"
    assert values(repair_cells(df, [Repair("replace_sentinels", "v")]))[2] is None
    assert values(repair_cells(df, [Repair("impute_median", "v")])) == [1200.0, 7.0, 7.0, 7.0, 7.0, 3.5]
    big = frame("v string", ("9007199254740993",), ("-0",))
    assert values(repair_cells(big, [Repair("coerce_numeric", "v", target_type="integer")])) == [9007199254740993, 0]


def test_booleans_with_leftovers_stay_text(frame):
    clean = frame("v string", ("yes",), ("NO",), (None,), ("n/a",))
    assert values(repair_cells(clean, [Repair("coerce_booleans", "v")])) == [True, False, None, None]
    mixed = frame("v string", ("yes",), ("maybe",))
    assert values(repair_cells(mixed, [Repair("coerce_booleans", "v")])) == ["True", "maybe"]


@pytest.mark.parametrize("spellings", [3, 200])
def test_case_ties(frame, spellings):
    """Ties go to the longest, then the first spelling; long lists are joined, not inlined."""
    extra = [(f"W{i:03d}x",) for i in range(spellings)] + [(f"w{i:03d}X",) for i in range(spellings)]
    df = frame("v string", ("UK",), ("Uk",), ("uk",), ("us a",), ("US A",), ("US A",), *extra)
    found = values(canonicalize_case(df, [Repair("canonicalize_case", "v")], Rules(broadcast_rows=50)))
    assert found[:6] == ["UK", "UK", "UK", "US A", "US A", "US A"]
    assert found[6:] == [f"W{i:03d}x" for i in range(spellings)] * 2


def test_auto_repairs_are_idempotent(frame):
    df = messy(frame)
    with Inspection(df) as inspection:
        plan = plan_auto(inspection, detect(inspection))
    once, done = apply(df, plan)
    twice, _ = apply(once, plan, count=False)
    order = sorted(once.columns)
    assert sorted(map(str, once.select(order).collect())) == sorted(map(str, twice.select(order).collect()))
    changed = {(r.strategy, r.column): r.rows_affected for r in done}
    assert changed["drop_exact_duplicates", None] == 1
    assert changed["normalize_country", "country"] == 2 and changed["coerce_dates", "due_date"] == 2
    with Inspection(once) as inspection:
        left = {issue.issue_type for issue in detect(inspection)}
    assert not left & {"whitespace", "sentinel_values", "numeric_format", "exact_duplicates", "date_format"}


def test_suggestions_never_run(frame):
    df = frame("v string", ("1",), (None,))
    out, (done,) = apply(df, [Repair("impute_median", "v", "suggested")], include_review=True)
    assert not done.applied and values(out) == ["1", None]


# -- runs ---------------------------------------------------------------------------------

ORDERS = """Order ID,Email,Country,Amount,Status,Order Date,Note
1,ann@x.org,usa,$10.50,open,2024-03-01,
2, bob@x.org ,USA,"1,9.00", Open ,03/02/2024,
2, bob@x.org ,USA,"1,9.00", Open ,03/02/2024,
3,cat@x.org,Peru,20.00,open,2024-03-03,gift
4,dan@x.org,Peru,21.00,shut,2024-03-04,
5,eve@x.org,Peru,22.00,shut,2024-03-05,
6,fay@x.org,UK,23.00,open,2024-03-06,
7,gus@x.org,Peru,24.00,open,2024-03-07,
8,hal@x.org,Peru,19.00,open,2024-03-08,
9,ian@x.org,Peru,18.00,open,2024-03-09,
"""
LEDGER = """invoice_id,amount,day
A1,10,2024-01-01
A1,25,2024-01-02
A2,8,2024-01-03
A3,TBD,2024-01-04
A4,n/a,2024-01-05
A5,-4,2024-01-06
A6,12,2024-01-07
A7,later,2024-01-08
"""


@pytest.fixture
def extract(tmp_path):
    def make(text, name="extract.csv"):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return make


@pytest.fixture
def gate(spark, tmp_path):
    return Gate(spark, str(tmp_path / "store"))


def test_passing_run_is_published(gate, extract):
    outcome = gate.run(Source("csv", extract("﻿" + ORDERS, "orders.csv")))
    assert (outcome.status, outcome.decision, outcome.rows_after) == ("pass", "store", 9)
    found = [(i.column, i.issue_type) for i in outcome.audit.issues]
    assert found == [
        (None, "exact_duplicates"), ("email", "whitespace"), ("country", "inconsistent_categories"),
        ("amount", "numeric_format"), ("status", "inconsistent_categories"),
        ("status", "whitespace"), ("order_date", "date_format"),
    ]
    assert len(outcome.audit.causes) == len(found)
    table = gate.store.dataset(outcome.dataset_id)
    assert dict(table.dtypes)["order_id"] == "bigint" and dict(table.dtypes)["amount"] == "double"
    assert {r.country for r in table.select("country").collect()} == {"United States", "Peru", "United Kingdom"}
    answer = gate.ask(mentioned="total amount of orders", agg="sum", group="country").collect()
    assert [(r.country, r.sum_amount) for r in answer] == [
        ("Peru", 124.0), ("United States", 29.5), ("United Kingdom", 23.0),
    ]
    with pytest.raises(GateError):
        gate.ask(outcome.dataset_id, agg="sum", measure="nothing")
    assert gate.preview(outcome.dataset_id, 3).count() == 3


def test_failing_run_waits_for_review(gate, extract):
    path = extract(LEDGER, "ledger.csv")
    held = gate.run(Source("csv", path))
    assert (held.status, held.decision, held.dataset_id) == ("fail", "rollback", None)
    assert gate.store.records("datasets").count() == 0
    review = [(r.strategy, r.column) for r in held.repairs if r.disposition == "review"]
    assert review == [("dedupe_key", "invoice_id"), ("drop_incomplete_rows", "amount"), ("absolute_value", "amount")]
    assert gate.store.staged(held.review_id).count() == 8

    approved = gate.approve(held.review_id)
    assert (approved.status, approved.rows_after, approved.validation.score_after) == ("pass", 4, 100)
    assert sorted(r.amount for r in gate.store.dataset(approved.dataset_id).collect()) == [4.0, 8.0, 10.0, 12.0]
    with pytest.raises(GateError, match="already approved"):
        gate.reject(held.review_id)

    again = gate.run(Source("csv", path))
    assert gate.reject(again.review_id).status == "rejected"
    with pytest.raises(GateError, match="already rejected"):
        gate.approve(again.review_id)
    store = gate.store
    assert history.totals(store.records("datasets"), store.records("review_events")).first().asDict() == {
        "datasets": 1,
        "pending_reviews": 0,
    }
    runs = history.recent_runs(store.records("runs")).collect()
    assert [r.status for r in runs] == ["fail", "pass", "fail"]
    queue = history.review_queue(*[store.records(k) for k in ("review_events", "runs", "issues", "repairs")]).collect()
    assert [r.status for r in queue] == ["rejected", "approved"]
    assert {i.issue_type for i in queue[0].residual_issues} == {"duplicate_key", "missing_values", "negative_values"}


def test_approval_that_still_fails_changes_nothing(gate, frame):
    rows = [(None if i % 2 else "k", float(i)) for i in range(10)]
    held = gate.run_table(frame("row_id string, v double", *rows), Source("sql", name="t"))
    outcome = gate.approve(held.review_id)
    assert outcome.status == "fail" and outcome.dataset_id is None
    assert gate.store.review(held.review_id).status == "pending"


def test_replayed_run_is_published_once(gate, frame):
    df = frame("a string, b int", ("x", 1), ("y", 2))
    first = gate.run_table(df, Source("sql", name="t"), run_id="same")
    second = gate.run_table(df, Source("sql", name="t"), run_id="same")
    assert first.dataset_id == second.dataset_id
    assert gate.store.records("datasets").count() == 1


def test_an_audit_takes_few_jobs(spark, tmp_path):
    """Counted with everything that the engine runs as a job of its own, each shuffle among them."""
    from queries.lens import lens

    context = spark.sparkContext
    context.setJobGroup("few", "an audit")
    try:
        found = audit(lens(spark, "/root/testdata/sf0.001"), detail=False)
    finally:
        context.setJobGroup("others", "after the audit")
    assert found.repairs
    assert len(context.statusTracker().getJobIdsForGroup("few")) <= 42  # two inspections and a repair; 83 before


def test_source_that_changes_is_not_published(spark, gate, tmp_path, monkeypatch):
    path = f"{tmp_path}/source"
    spark.range(20).selectExpr("id AS k", "id * 2 AS v").write.parquet(path)
    assert gate.run(Source("parquet", path)).status == "pass"
    import sluice.plans.gate as module

    inspect = module.audit

    def meddling(*args, **options):
        found = inspect(*args, **options)
        spark.range(3).selectExpr("id AS k", "id AS v").write.mode("append").parquet(path)
        return found

    monkeypatch.setattr(module, "audit", meddling)
    with pytest.raises(GateError, match="changed during the run"):
        gate.run(Source("parquet", path), run_id="late")
    assert gate.store.records("datasets").filter("id = 'late'").isEmpty()


def test_rows_are_written_once(gate, extract, monkeypatch):
    """Repaired rows go straight to where they are published; what fails leaves nothing there."""
    import sluice.plans.store as module

    copies = []
    monkeypatch.setattr(module.Store, "write_rows", lambda self, df, path: copies.append(path))
    outcome = gate.run(Source("csv", extract(ORDERS, "orders.csv")))
    assert outcome.status == "pass" and not copies
    assert gate.store.dataset(outcome.dataset_id).count() == 9
    held = gate.run(Source("csv", extract(LEDGER, "ledger.csv")))
    assert held.status == "fail"
    system, at = gate.store._folder(gate.store.published(held.run_id))
    assert not system.exists(at)


def test_compaction_and_replay(gate, frame):
    df = frame("a string, b int", ("x", 1), ("y", 2))
    held = gate.run_table(frame("row_id string, v double", *[(None, 1.0)] * 4), Source("sql", name="t"), run_id="bad")
    gate.reject(held.review_id)
    gate.run_table(df, Source("sql", name="t"), run_id="one")
    before = {kind: gate.store.records(kind).count() for kind in ("runs", "issues", "columns", "datasets", "review_events")}
    assert gate.store.compact() > 0 and gate.store.compact() > 0
    assert {kind: gate.store.records(kind).count() for kind in before} == before
    gate.run_table(df, Source("sql", name="t"), run_id="one")
    gate.run_table(frame("row_id string, v double", *[(None, 1.0)] * 4), Source("sql", name="t"), run_id="bad")
    assert {kind: gate.store.records(kind).count() for kind in before} == before
    with pytest.raises(GateError, match="already rejected"):
        gate.approve(held.review_id)


def test_alias_tables(spark, gate, frame):
    aliases = spark.createDataFrame([(" DE ", "Germany"), ("brd", "Germany"), ("de", "Zz"), (None, "x"), ("y", " ")], "alias string, name string")
    version = gate.save_aliases(aliases)
    assert version == gate.save_aliases(aliases.orderBy("alias"))
    df = frame("land string, v int", ("de", 1), (" BRD ", 2), ("France", 3), (None, 4))
    outcome = gate.run_table(df, Source("sql", name="t"), aliases={"land": version})
    (named,) = [r for r in gate.store.records("repairs").collect() if r.strategy == "alias_table"]
    assert named.rows_affected == 2 and version in named.description
    assert values(outcome.audit.repaired, "land") == ["Germany", "Germany", "France", None]


def test_own_position_columns(spark, extract, tmp_path):
    df = read_csv(spark, extract("_ord,ord,v\n7,1,a\n7,2,b\n", "own.csv"))
    assert sorted(df.columns) == ["_ord", "ord", "ord_", "v"] and values(df, "ord_") == [7, 7]
    path = f"{tmp_path}/own"
    spark.createDataFrame([(7, "a"), (7, "b")], "_ord int, v string").coalesce(1).write.parquet(path)
    found = parquet_with_positions(spark, path)
    assert sorted((r.ord, r._ord) for r in found.collect()) == [(7, 0), (7, 1)]


def test_empty_source_is_refused(gate, extract, spark):
    with pytest.raises(GateError):
        gate.run(Source("csv", extract("a,b\n")))
    with pytest.raises(GateError):
        gate.run_table(spark.createDataFrame([], "a int"), Source("sql"))


def test_audit_of_a_clean_table(frame):
    found = audit(frame("name string, score double", ("ann", 1.0), ("bob", 2.5)))
    assert found.issues == [] and found.validation.passed and found.validation.score_after == 100


def test_stream(spark, gate, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "v": "x"}\n{"k": 2, "v": "y"}\n')
    stream = spark.readStream.schema("k bigint, v string").json(str(tmp_path / "in"))
    for _ in range(2):  # nothing new the second time
        query = gate_stream(stream, gate, "feed", str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination()
    (run,) = [r.run_id for r in gate.store.records("runs").collect()]
    assert run.startswith("feed-") and run.endswith("-000000000")
    # another stream of that name is another stream, though its batches have the same numbers
    gate_stream(stream, gate, "feed", str(tmp_path / "other"), availableNow=True).awaitTermination()
    assert gate.store.records("runs").count() == gate.store.records("datasets").count() == 2
    assert gate.store.dataset(run).count() == 2


# -- sources ------------------------------------------------------------------------------


def test_csv_shapes(spark, extract):
    df = read_csv(spark, extract('a,a,,n,flag\n1,"x\ny",,007,True\n2\n', "odd.csv"))
    assert [c for c in df.columns if c != "_ord"] == ["a", "a.1", "Unnamed: 2", "n", "flag"]
    assert values(df, "a") == [1, 2] and values(df, "n") == ["007", None]
    assert values(renamed(df), "a_1") == ["x\ny", None]
    with pytest.raises(GateError, match="more than 2"):
        read_csv(spark, extract("a,b\n1,2\n1,2,3\n", "long.csv"))
    with pytest.raises(GateError, match="empty"):
        read_csv(spark, extract("", "none.csv"))
    with pytest.raises(GateError):
        read(spark, Source("csv", "/nowhere/at/all.csv"))
    with pytest.raises(GateError):
        read(spark, Source("xml", "x"))


def test_csv_native_types(spark, extract):
    text = "i,f,e,b,t,d\n1,1.5,1e5,True,x,2024-01-01\n02,.5,2,False,1,2024-01-02\n"
    df = read_csv(spark, extract(text, "typed.csv"))
    assert [t for n, t in df.dtypes if n != "_ord"] == ["bigint", "double", "double", "boolean", "string", "string"]


def test_json_shapes(spark, extract):
    records = [{"id": 1, "who": {"name": "ann", "at": {"city": "x"}}}, {"id": 2, "extra": "N/A"}]
    listed = read_json(spark, extract(json.dumps(records), "list.json"))
    wrapped = read_json(spark, extract(json.dumps({"page": 1, "items": records}), "wrapped.json"))
    for df in (listed, wrapped):
        assert [c for c in renamed(df).columns if c != "_ord"] == ["id", "who_at_city", "who_name", "extra"]
        assert values(df, "id") == [1, 2]
    with pytest.raises(GateError):
        read_json(spark, extract("[1, 2", "broken.json"))
    with pytest.raises(GateError):
        read_json(spark, extract('{"nothing": 1}', "object.json"))
    with pytest.raises(GateError):
        read_json(spark, extract('{"data": [1, 2]}', "numbers.json"))


def test_payloads(spark):
    rows = [('{"data": [{"a": 1}, {"a": 2, "b": {"c": "x"}}]}',), ('{"data": []}',)]
    df = payload_records(spark.createDataFrame(rows, "payload string"))
    assert sorted((r.a, r["b.c"]) for r in df.collect()) == sorted([(1, None), (2, "x")], key=str)
    bare = payload_records(spark.createDataFrame([('[{"a": 1}]',)], "payload string"))
    assert bare.columns == ["a"]
    with pytest.raises(GateError):
        payload_records(spark.createDataFrame([("nope",)], "payload string"))
    with pytest.raises(GateError):
        payload_records(spark.createDataFrame([('{"x": 1}',)], "payload string"))


def test_unwrap_and_flatten(spark):
    df = spark.sql("SELECT 1 AS page, array(named_struct('k', 1), named_struct('k', 2)) AS rows")
    assert [r.k for r in unwrap(df).collect()] == [1, 2]
    with pytest.raises(GateError):
        unwrap(spark.sql("SELECT 1 AS page"))
    assert flatten(spark.sql("SELECT named_struct('x', named_struct('y', 1)) AS a")).columns == ["a.x.y"]


def test_database_options(spark):
    source = Source("postgres", "postgres://host:1/db", "SELECT 1;")
    assert jdbc_options(source) == {
        "url": "jdbc:postgresql://host:1/db", "query": "SELECT 1", "driver": "org.postgresql.Driver",
    }
    assert jdbc_options(Source("sqlite", "/a.db", "SELECT 1"))["url"] == "jdbc:sqlite:/a.db"
    for bad in (Source("postgres", "", "SELECT 1"), Source("sqlite", "/a.db")):
        with pytest.raises(GateError):
            read(spark, bad)


def test_select_over_tables(spark, frame):
    df = read_sql(spark, {"t": frame("a int", (1,), (2,))}, "SELECT sum(a) AS s FROM t WHERE a >= :low", {"low": 2})
    assert df.first().s == 2


def test_positions(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(0, 1000, numPartitions=4).write.parquet(path)
    df = parquet_with_positions(spark, path)
    assert sorted(r._ord for r in df.collect()) == list(range(1000))
    again = {r.id: r._ord for r in parquet_with_positions(spark, path).repartition(3).collect()}
    assert again == {r.id: r._ord for r in df.collect()}
    ordered = with_positions(spark.range(100).repartition(5), F.desc("id"))
    assert all(r._ord == 99 - r.id for r in ordered.collect())


# -- questions ----------------------------------------------------------------------------


def test_questions(frame):
    df = frame("g string, x double", ("a", 1.0), ("B", 2.0), ("b", None), ("a", 2.0))
    assert ask(df, "count").first()["count"] == 4
    assert [tuple(r) for r in ask(df, group="g").collect()] == [("a", 2), ("B", 1), ("b", 1)]
    assert [tuple(r) for r in ask(df, "sum", "x", "g").collect()] == [("a", 3.0), ("B", 2.0), ("b", None)]
    assert [tuple(r) for r in ask(df, "top", "x", limit=2).collect()] == [("B", 2.0), ("a", 2.0)]
    assert ask(df, "count", where=("g", "b")).first()["count"] == 2
    assert ask(df, "count", where=("x", "$2")).first()["count"] == 2
    assert ask(df, "show", limit=1).collect()[0].g == "a"
    for bad in ({}, {"agg": "sum"}, {"agg": "top"}, {"agg": "median"}, {"agg": "sum", "measure": "y"}):
        with pytest.raises(GateError):
            ask(df, **bad)
