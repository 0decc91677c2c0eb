"""Truth tables of the cell rules and of the rules on names."""

from __future__ import annotations

import datetime

import pytest

from sluice.functions import fixed
from sluice.functions.cells import cells_of, country_of, fold, strip, with_facts
from sluice.functions.names import is_key_name, role_of, safe_name, safe_names
from sluice.functions.severity import score, severity

NUMBERS = {
    "$1,240.00": 1240.0, "$-5": -5.0, "1,2,3": 123.0, "$ 7": 7.0, "-,5": -5.0, "+3.10": 3.1, " 12\t": 12.0,
    "€9": 9.0, "£1.5": 1.5, "-$5": None, "(5)": None, "5%": None, "1e5": None, ".5": None, "5.": None, "5€": None,
    "$": None, "see-note": None, "N/A": None, "": None, "--": None, "1 2": None, "$$5": None, "9" * 400: None,
}
DAYS = {
    "2024-11-02": "2024-11-02", "2024/11/14": "2024-11-14", "20241101": "2024-11-01", "11/03/2024": "2024-11-03",
    "04/11/2024": "2024-04-11", "13/11/2024": "2024-11-13", "11-03-2024": "2024-11-03", "13.11.2024": "2024-11-13",
    "Nov 3, 2024": "2024-11-03", "3 Nov 2024": "2024-11-03", "November 3, 2024": "2024-11-03", "2024-11": "2024-11-01",
    "2024": "2024-01-01", "1/2/24": "2024-01-02", "1/2/70": "1970-01-02", "2024-01-05 10:30:00": "2024-01-05",
    "2024-01-05T10:30:00Z": "2024-01-05", "2024-02-30": None, "Q1 2024": None, "5": None, "12": None, "A-1": None,
    "May": None, "10:30": None, "today": None, "now": None, "2024-01-05 25:00": None, "Foo 3, 2024": None,
    "0001-01-01": None, "2024-11/02": None, "2024-01-05 and more": None,
}
WORDS = {
    "true": True, "T": True, " yes ": True, "Y": True, "FALSE": False, "f": False, "No": False, "n": False,
    "1": None, "0": None, "on": None, "": None, "n/a": None,
}
EMAILS = {"a@b.co": True, " a@b.co ": True, "a b@c.d": False, "a@b": False, "@b.co": False, "a@@b.co": False, "": False}


def facts(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    cell = cells_of(df)[0]
    rows = with_facts(df, [cell]).selectExpr("v", *[column(cell) for column in columns]).collect()
    return {row[0]: row[1:] if len(columns) > 1 else row[1] for row in rows}


def test_numbers(spark):
    assert facts(spark, NUMBERS, lambda c: c.number_sql) == NUMBERS


def test_days(spark):
    found = facts(spark, DAYS, lambda c: c.day_sql)
    assert {k: v and v.isoformat() for k, v in found.items()} == DAYS


def test_booleans(spark):
    assert facts(spark, WORDS, lambda c: c.truth_sql) == WORDS


def test_emails(spark):
    assert facts(spark, EMAILS, lambda c: c.ref("email")) == EMAILS


def test_blank_and_sentinel(spark):
    values = ["", " \t", "  ", "N/A", " tbd ", "-", "--", "?", "n.a.", "none", "0", "nope", None]
    found = facts(spark, values, lambda c: c.ref("blank"), lambda c: c.ref("sentinel"))
    assert [v for v in values if found[v][0]] == ["", " \t", "  ", None]
    assert [v for v in values if found[v][1]] == ["N/A", " tbd ", "-", "--", "?", "n.a.", "none"]


def test_strip_takes_what_python_takes(spark):
    every = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    assert sorted(every) == sorted(fixed.WHITESPACE)
    df = spark.createDataFrame([(f"{ch}a b{ch}",) for ch in every], "v string")
    assert {row[0] for row in df.selectExpr(strip("v")).collect()} == {"a b"}


def test_fold_and_country(spark):
    row = spark.sql("SELECT 'Straße' AS a, 'U.K.' AS b, 'Japan' AS c")
    row = row.selectExpr(fold("a"), country_of("b"), country_of("c")).first()
    assert tuple(row) == ("strasse", "United Kingdom", None)


def test_native_types(spark):
    df = spark.sql(
        "SELECT double('NaN') AS d, double('Infinity') AS i, 20241101 AS load_date, true AS b, "
        "timestamp_ntz'2024-01-05 10:00:00' AS t, array(1) AS a"
    )
    cells = cells_of(df)
    made = [c.flag_sql("blank") for c in cells] + [cells[1].number_sql, cells[2].day_sql, cells[4].day_sql]
    row = tuple(with_facts(df, cells).selectExpr(*made).first())
    assert row[:6] == (True, False, False, False, False, False)
    assert row[6:] == (None, datetime.date(2024, 11, 1), datetime.date(2024, 1, 5))


def test_names():
    assert safe_names(["Order ID", "order-id", "order_id", "", "1st", "__x__", "Größe"]) == [
        "order_id", "order_id_2", "order_id_3", "column", "c_1st", "x", "größe",
    ]
    assert safe_name("---") == "column"
    assert [n for n in ("id", "uuid", "user_id", "USER_UUID", "valid", "idea", "l_orderkey") if is_key_name(n)] == [
        "id", "uuid", "user_id", "USER_UUID",
    ]


@pytest.mark.parametrize(
    ("name", "inferred", "role"),
    [
        ("user_id", "integer", "key"), ("coffee", "string", "money"), ("qty", "integer", "quantity"),
        ("contact", "email", "email"), ("email_opt_in", "boolean", "email"), ("updated_by", "string", "date"),
        ("created_at", "string", "date"), ("seen", "datetime", "date"), ("memo", "string", "free_text"),
        ("c_nationkey", "integer", "country"), ("country_note", "string", "free_text"), ("city", "string", "default"),
    ],
)
def test_roles(name, inferred, role):
    assert role_of(name, inferred) == role


def test_severity_and_score():
    bands = fixed.MISSING_BANDS["money"]
    assert [severity(r, bands) for r in (0, 0.01, 0.02, 0.15, 0.5, 1)] == [
        None, "low", "medium", "high", "critical", "critical",
    ]
    assert severity(0.5, ()) is None
    assert score([]) == 100
    assert score(["critical", "high", "medium", "low"]) == 49
    assert score(["critical"] * 9) == 0
