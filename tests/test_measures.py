"""Quantiles, histograms, whole-row operators and detectors on small tables."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice import Inspection, Rules
from sluice.functions.cells import cells_of
from sluice.operators import rows, spellings
from sluice.operators.issues import detect
from sluice.operators.profile import column_histogram, profile_rows
from sluice.operators.quantiles import Numbers, exact_quantiles
from sluice.operators.spellings import top_values

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("rows_per_task", [1, 40, 10**6])
@pytest.mark.parametrize("kind", ["even", "skewed", "constant", "hot"])
def test_quantiles_match_numpy(spark, kind, rows_per_task):
    rng = np.random.default_rng(7)
    values = {
        "even": rng.uniform(-5, 5, 3000),
        "skewed": np.concatenate([rng.exponential(1, 2000), [1e12, -1e9]]),
        "constant": np.full(50, 3.25),
        "hot": np.concatenate([np.zeros(1000), rng.normal(0, 1, 2000)]),  # a third of the rows are one value
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    numbers = {"x": Numbers(F.col("x"), len(values), float(values.min()), float(values.max()))}
    found = exact_quantiles(df, numbers, SHARES, rows_per_task)["x"]
    assert found == pytest.approx(list(np.quantile(values, SHARES)), rel=1e-12, abs=1e-12)


def test_histogram_matches_numpy(spark):
    values = [0.1 * i for i in range(80)] + [7.9] * 5
    with Inspection(spark.createDataFrame([(v,) for v in values], "x double")) as inspection:
        found = column_histogram(inspection, inspection.cells[0])
    counts, edges = np.histogram(values, bins=8)
    assert [bucket["count"] for bucket in found] == list(counts)
    assert [bucket["lo"] for bucket in found] == [round(float(edge), 4) for edge in edges[:-1]]


def test_histogram_of_few_values(spark):
    with Inspection(spark.createDataFrame([(1,), (1,), (5,)], "x int")) as inspection:
        found = column_histogram(inspection, inspection.cells[0])
    assert [bucket["count"] for bucket in found] == [2, 1]
    with Inspection(spark.createDataFrame([(4,), (4,)], "x int")) as inspection:
        assert column_histogram(inspection, inspection.cells[0]) == [{"lo": 4.0, "hi": 4.0, "count": 2}]


def test_profile_of_mixed_types(frame):
    df = frame(
        "a string, b double, c boolean, d array<int>, e string",
        ("1", 1.5, True, [1], None),
        ("$2", float("nan"), None, [1], ""),
        ("x", 2.0, False, None, "n/a"),
        ("3", 2.0, False, [2], None),
        ("4.0", 2.0, False, [2], None),
    )
    with Inspection(df) as inspection:
        a, b, c, d, e = profile_rows(inspection)
    assert (a["inferred_type"], a["unique_count"], a["examples"]) == ("integer", 5, ["1", "$2", "x"])
    assert a["stats"]["mean"] == 2.5 and a["stats"]["stdev"] == pytest.approx(1.291, abs=1e-4)
    assert (b["inferred_type"], b["null_count"], b["unique_count"]) == ("float", 1, 2)
    assert (c["inferred_type"], c["top_values"]) == (
        "boolean",
        [{"value": "False", "count": 3}, {"value": "True", "count": 1}],
    )
    assert (d["null_count"], d["unique_count"], d["top_values"][0]["value"]) == (1, 2, "[1]")
    assert (e["inferred_type"], e["null_count"], e["sentinel_count"]) == ("unknown", 4, 1)


def test_top_values_of_long_texts(spark):
    """Texts that share a long head are told apart and ranked by their whole length."""
    head = "z" * 300
    texts = [head + tail for tail in "dcbaabc"] + ["short"] * 2 + ["A" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    inspection = Inspection(df)
    found = top_values(inspection.df, inspection.cells, inspection.tokens, 4).orderBy("place").collect()
    assert [(r.value[-1], r.n) for r in found] == [("t", 2), ("a", 2), ("b", 2), ("c", 2)]
    assert inspection.distinct["t"] == 6


def test_conflicts_need_an_exact_repeat(frame):
    df = frame("id string, v int", ("A", 1), (" A ", 2), ("B", 1), ("B", 1))
    assert rows.key_conflicts(df, "id").count() == 0
    df = frame("id string, v int", ("A", 1), ("A", 2), (" A ", 3), ("B", 1), ("B", 1), (None, 1), (None, 2))
    found = {row.token: (row.rows, row.variants) for row in rows.key_conflicts(df, "id").collect()}
    assert found == {"A": (2, 2), "": (2, 2)}
    blanks = frame("id string, v int", (None, 1), (None, 2), ("B", 1))
    assert rows.key_conflicts(blanks, "id").count() == 0


def test_fingerprint_tells_nulls_apart(spark):
    df = spark.sql("SELECT * FROM VALUES (1, null), (null, 1), (1, null) AS t(a, b)")
    groups = rows.row_groups(df, cells_of(df))
    assert sorted(row.n for row in groups.collect()) == [1, 2]


@pytest.mark.parametrize("broadcast_rows", [0, 1, 100])
def test_drop_copies_keeps_first(frame, broadcast_rows):
    df = frame("a string, b int", ("x", 1), ("y", None), ("x", 1), ("y", None), ("y", 2), ("x", 1))
    found = rows.drop_copies(df, Rules(broadcast_rows=broadcast_rows))
    assert sorted(row._ord for row in found.collect()) == [0, 1, 4]


@pytest.mark.parametrize(("collapse", "kept"), [(False, [0, 1, 3, 5]), (True, [0, 1, 3])])
@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_keep_first(frame, collapse, kept, broadcast_rows):
    df = frame("k string, v int", ("a", 1), ("b", 2), ("a", 3), (None, 4), ("b", 5), (None, 6))
    rules = Rules(collapse_null_keys=collapse, broadcast_rows=broadcast_rows)
    assert sorted(row._ord for row in rows.keep_first(df, "k", rules).collect()) == kept


@pytest.mark.parametrize("total", [2000, 200_000])
def test_first_rows(spark, total):
    df = spark.range(total).selectExpr("id AS _ord", "CAST(id % 3 AS INT) AS label", "CAST(id AS STRING) AS value")
    df = df.filter("label < 2 OR _ord > 1900")
    found = rows.first_rows(df.repartition(7), 3, total).collect()
    assert sorted((r.label, r._ord) for r in found) == [
        (0, 0), (0, 3), (0, 6), (1, 1), (1, 4), (1, 7), (2, 1901), (2, 1904), (2, 1907),
    ]


def messy(frame):
    return frame(
        "invoice_id string, amount string, country string, state string, due_date string, email string, memo string",
        ("I1", "10", "usa", " open ", "2024-01-01", "a@x.co", None),
        ("I1", "12", "USA", "open", "2/1/2024", "b@x.co", None),
        ("I2", "$11", "Peru", "Open", "2024-01-03", "c@x", None),
        ("I3", "n/a", "Peru", "open", "soon", "d@x.co", "x"),
        ("I4", "-9", "Peru", "open", "2024-01-05", "e@x.co", "x"),
        ("I4", "-9", "Peru", "open", "2024-01-05", "e@x.co", "x"),
        ("I5", "9", "Peru", "shut", "2024-01-06", "f@x.co", "x"),
        ("I6", "10", "Peru", "shut", "2024-01-07", "g@x.co", "x"),
        ("I7", "11", "Peru", "shut", "2024-01-08", "h@x.co", "x"),
        ("I8", "90000", "Peru", "shut", "2024-01-09", "i@x.co", None),
    )


EXPECTED = [
    (None, "exact_duplicates", "high", [4, 5]),
    ("invoice_id", "duplicate_key", "high", [0, 1]),
    ("amount", "sentinel_values", "medium", [3]),
    ("amount", "numeric_format", "medium", [2]),
    ("amount", "negative_values", "high", [4, 5]),
    ("amount", "outliers", "high", [9]),
    ("country", "inconsistent_categories", "medium", [0, 1]),
    ("state", "inconsistent_categories", "medium", [2]),
    ("state", "whitespace", "low", [0]),
    ("due_date", "invalid_datetime", "medium", [3]),
    ("due_date", "date_format", "low", [1]),
    ("email", "invalid_email", "medium", [2]),
]


@pytest.mark.parametrize("parts", [1, 7])
def test_detect(frame, parts):
    with Inspection(messy(frame).repartition(parts)) as inspection:
        found = detect(inspection)
    assert [(i.column, i.issue_type, i.severity, i.positions) for i in found] == EXPECTED
    assert [i.id for i in found] == [f"Q{n:03d}" for n in range(1, len(EXPECTED) + 1)]
    by_type = {(i.column, i.issue_type): i for i in found}
    assert by_type["amount", "negative_values"].evidence["examples"] == ["-9", "-9"]
    assert by_type["amount", "outliers"].evidence["unit_scale"] is True
    assert by_type["amount", "outliers"].evidence["tail_ratio"] == 1.0
    assert by_type["country", "inconsistent_categories"].evidence["examples"] == ["USA", "usa"]
    assert by_type["amount", "sentinel_values"].evidence["tokens"] == ["n/a"]


def test_column_rules_can_be_changed(frame):
    df = frame("code string, v int", ("NA", 1), ("DE", 2), ("x", 3))
    with Inspection(df) as inspection:
        assert [i.issue_type for i in detect(inspection)] == ["sentinel_values"]
    with Inspection(df, Rules(column_sentinels={"code": ("x",)})) as inspection:
        (issue,) = detect(inspection)
    assert issue.evidence["tokens"] == ["x"]


def test_approximate_rules(frame):
    df = frame("v double, w string", *[(float(i), str(i % 5)) for i in range(200)])
    with Inspection(df, Rules(approximate=True)) as inspection:
        v, w = profile_rows(inspection)
    assert v["unique_count"] == pytest.approx(200, rel=0.1) and v["stats"]["median"] == pytest.approx(100, abs=2)
    assert w["unique_count"] == 5


def test_empty_table(spark):
    with Inspection(spark.createDataFrame([], "a string, b int")) as inspection:
        assert detect(inspection) == []
        assert [row["inferred_type"] for row in profile_rows(inspection)] == ["unknown", "unknown"]


@pytest.mark.parametrize("seed", range(4))
def test_ties_are_settled_by_beginnings(spark, monkeypatch, seed):
    """With few texts looked at whole, and heads much longer than what is compared at once."""
    monkeypatch.setattr(spellings, "OPEN", 2)
    monkeypatch.setattr(spellings, "STEP", 3)
    draw = random.Random(seed)
    heads = ["", "m" * 20, "z" * 70, "z" * 70 + "é" * 40]
    texts = {draw.choice(heads) + "".join(draw.choices("abé😀", k=draw.randint(1, 6))) for _ in range(150)}
    rows = [(t, f"{i % 7}{t}") for i, t in enumerate(sorted(texts)) for _ in range(draw.choice([1, 1, 1, 2, 2, 3]))]
    df = spark.createDataFrame(rows, "t string, u string").repartition(3)
    cells = cells_of(df)
    with Inspection(df) as inspection:
        for counts in (spellings.digest_counts(df, cells), inspection.tokens):
            found = top_values(df, cells, counts, 5).orderBy("column", "place").collect()
            for place, column in enumerate(("t", "u")):
                many = Counter(r[place] for r in rows)
                want = sorted(many.items(), key=lambda x: (-x[1], x[0].encode()))[:5]
                assert [(r.value, r.n) for r in found if r["column"] == cells[place].index] == want
