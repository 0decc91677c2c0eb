"""Detectors: flagged cells, whole-table findings, evidence and causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.lens import COLUMNS, LENS, lens
from queries.profile_queries import HITS
from queries.registry import query, table
from queries.rule_queries import COUNTRY_SQL, DAY_SQL, SENTINELS, case_map_sql, number_sql
from sluice.functions.cells import ORD
from sluice.operators import rows
from sluice.operators.causes import causes_frame, explain, with_causes
from sluice.operators.inspection import Inspection
from sluice.operators.issues import detect, flagged_rows, issues_frame, violations

PRESENT = f"coalesce(trim({{x}}) <> '' AND lower(trim({{x}})) NOT IN {SENTINELS}, false)"
_AMOUNT = number_sql("amount")

# SQL tests of the cell-level detectors, by (issue type, column).
TESTS = {
    ("missing_values", "age"): "coalesce(trim(age) = '', true)",
    ("missing_values", "note"): "coalesce(trim(note) = '', true)",
    ("sentinel_values", "amount"): f"lower(trim(amount)) IN {SENTINELS}",
    ("sentinel_values", "age"): f"lower(trim(age)) IN {SENTINELS}",
    ("numeric_format", "amount"): f"regexp_matches(amount, '[$€£,]') AND {_AMOUNT} IS NOT NULL",
    ("non_numeric", "amount"): f"{PRESENT.format(x='amount')} AND {_AMOUNT} IS NULL",
    ("negative_values", "amount"): f"{_AMOUNT} < 0",
    ("invalid_email", "email"): "NOT regexp_full_match(trim(email), '[^@ ]+@[^@ ]+[.][^@ ]+')",
    ("invalid_datetime", "order_date"): f"{DAY_SQL.format(x='trim(order_date)')} IS NULL",
    ("date_format", "order_date"): f"trim(order_date) <> strftime({DAY_SQL.format(x='trim(order_date)')}, '%Y-%m-%d')",
    ("whitespace", "status"): "status <> trim(status)",
    ("whitespace", "email"): "email <> trim(email)",
}


def _register_cell_detectors() -> None:
    names = {
        "missing_values": "Q02", "sentinel_values": "Q03", "numeric_format": "Q04", "non_numeric": "Q05",
        "negative_values": "Q06", "invalid_email": "Q08", "invalid_datetime": "Q09", "date_format": "Q10",
        "whitespace": "Q12",
    }
    for issue_type, number in names.items():
        columns = [column for kind, column in TESTS if kind == issue_type]
        sql = " UNION ALL ".join(
            f"""SELECT _ord, '{c}' AS "column", '{issue_type}' AS issue_type, {c} AS value FROM lens
            WHERE {TESTS[issue_type, c]}"""
            for c in columns
        )

        def flagged(spark, sf_dir, issue_type=issue_type, columns=columns):
            with Inspection(lens(spark, sf_dir).select(ORD, *columns)) as inspection:
                return violations(inspection, [issue_type], columns, keep=[ORD])

        query(f"{number}_{issue_type}", f"{LENS} {sql}")(flagged)


_register_cell_detectors()


@query(
    "Q01_exact_duplicates",
    f"""{LENS} SELECT {', '.join(COLUMNS)}, count(*) AS copies FROM lens GROUP BY ALL HAVING count(*) > 1""",
)
def exact_duplicates(spark, sf_dir):
    return rows.duplicate_rows(lens(spark, sf_dir))


@query("Q01_duplicate_documents", "SELECT text, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    return rows.duplicate_rows(table(spark, sf_dir, "documents").select("text"))


@query(
    "Q01_copy_counts",
    f"""{LENS}, g AS (SELECT count(*) AS n FROM lens GROUP BY {', '.join(COLUMNS)})
    SELECT 'lens' AS name, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS row_count, sum(n - 1)::BIGINT AS extra_rows
    FROM g UNION ALL
    SELECT 'lineitem', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, sum(n - 1)::BIGINT
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""".replace("GROUP BY ALL, ", "GROUP BY "),
)
def copy_counts(spark, sf_dir):
    found = []
    for name, df in (("lens", lens(spark, sf_dir)), ("lineitem", table(spark, sf_dir, "lineitem"))):
        with Inspection(df) as inspection:
            found.append((name, *inspection.copies))
    return spark.createDataFrame(found, "name string, row_count bigint, extra_rows bigint")


def outlier_sql(column: str, source: str, keep: str) -> str:
    return f"""WITH q AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS q2,
      quantile_cont({column}, 0.75) AS q3 FROM {source})
    SELECT {keep}, {column} AS value, q2 <> 0 AND abs({column}) > greatest(20 * abs(q2), 1) AS unit_scale
    FROM {source}, q WHERE q3 <> q1 AND {column} NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)
      AND abs({column}) > CASE WHEN q2 = 0 THEN 1000 ELSE greatest(10 * abs(q2), 1) END"""


def _outliers(df, column, keep):
    with Inspection(df.select(keep, column)) as inspection:
        cell = inspection.cell(column)
        median = abs(inspection.quartiles[column][1])
        unit = F.abs(F.col(column)) > max(20 * median, 1) if median else F.lit(False)
        flagged = inspection.facts([cell]).filter(inspection.outlier_sql(cell))
        return flagged.select(keep, cell.raw.alias("value"), unit.alias("unit_scale"))


@query("Q07_outliers_events", outlier_sql("value", "events", "event_id"))
def outliers_events(spark, sf_dir):
    return _outliers(table(spark, sf_dir, "events"), "value", "event_id")


@query("Q07_outliers_documents", outlier_sql("n_chars", "documents", "doc_id"))
def outliers_documents(spark, sf_dir):
    return _outliers(table(spark, sf_dir, "documents"), "n_chars", "doc_id")


_CATEGORY_SQL = f"""{LENS}, m_status AS ({case_map_sql('status')}), m_country AS ({case_map_sql('country')})
    SELECT _ord, 'status' AS "column", status AS value FROM lens WHERE trim(status) IN (SELECT spelling FROM m_status)
    UNION ALL SELECT _ord, 'country', country FROM lens
    WHERE trim(country) IN (SELECT spelling FROM m_country) OR {COUNTRY_SQL.format(x='country')} <> trim(country)"""


@query("Q11_inconsistent_categories", _CATEGORY_SQL)
def inconsistent(spark, sf_dir):
    with Inspection(lens(spark, sf_dir).select(ORD, "status", "country")) as inspection:
        issues = [i for i in detect(inspection, evidence=False) if i.issue_type == "inconsistent_categories"]
        names = F.expr("CASE label " + " ".join(f"WHEN {n} THEN '{i.column}'" for n, i in enumerate(issues)) + " END")
        return flagged_rows(inspection, issues).select(ORD, names.alias("column"), "value")


def conflict_sql(key: str, source: str) -> str:
    """Keys shared by different rows, for a key column of present, stripped values."""
    return f"""SELECT token, rows, variants FROM (
      SELECT {key} AS token, sum(n)::BIGINT AS rows, count(*) AS variants
      FROM (SELECT {key}, count(*) AS n FROM (SELECT {key}, r FROM (SELECT {key}, to_json(t) AS r FROM {source} t))
            GROUP BY {key}, r) GROUP BY 1) WHERE variants > 1"""


@query("Q13_key_conflicts_conversations", conflict_sql("conv_id", "conversations"))
def conflicts_conversations(spark, sf_dir):
    return rows.key_conflicts(table(spark, sf_dir, "conversations"), "conv_id")


@query("Q13_key_conflicts_events", conflict_sql("user_id", "events"))
def conflicts_events(spark, sf_dir):
    return rows.key_conflicts(table(spark, sf_dir, "events"), "user_id")


@query("Q13_key_conflicts_labels", conflict_sql("doc_id", "labels"))
def conflicts_labels(spark, sf_dir):
    return rows.key_conflicts(table(spark, sf_dir, "labels"), "doc_id")


@query(
    "Q13_key_conflicts_lens",
    f"""{LENS}, body AS (SELECT {', '.join(COLUMNS)} FROM lens) {conflict_sql('order_id', 'body')}""",
)
def conflicts_lens(spark, sf_dir):
    return rows.key_conflicts(lens(spark, sf_dir), "order_id")


# -- the whole list of issues of the lens -----------------------------------------------------

_BANDS = """CASE role WHEN 'key' THEN CASE WHEN r >= 0.1 THEN 'critical' ELSE 'high' END
    WHEN 'money' THEN CASE WHEN r >= 0.5 THEN 'critical' WHEN r >= 0.15 THEN 'high' WHEN r >= 0.02 THEN 'medium' ELSE 'low' END
    WHEN 'quantity' THEN CASE WHEN r >= 0.5 THEN 'critical' WHEN r >= 0.15 THEN 'high' WHEN r >= 0.02 THEN 'medium' ELSE 'low' END
    WHEN 'date' THEN CASE WHEN r >= 0.5 THEN 'critical' WHEN r >= 0.25 THEN 'high' WHEN r >= 0.05 THEN 'medium' ELSE 'low' END
    WHEN 'email' THEN CASE WHEN r >= 0.6 THEN 'critical' WHEN r >= 0.3 THEN 'high' WHEN r >= 0.08 THEN 'medium' ELSE 'low' END
    WHEN 'free_text' THEN NULL
    ELSE CASE WHEN r >= 0.6 THEN 'critical' WHEN r >= 0.35 THEN 'high' WHEN r >= 0.1 THEN 'medium' ELSE 'low' END END"""

_BODY = ", ".join(COLUMNS)
_FENCE = "SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM nums"


def issues_sql(head: str = HITS) -> str:
    """CTEs ending in ``issues``: ``place, step, column, severity, issue_type, row_count, tail, unit``."""

    def flagged(test: str) -> str:
        return f"count(*) FILTER ({test}) AS k, avg(CASE WHEN _ord >= 0.8 * total THEN 1.0 ELSE 0.0 END) FILTER ({test}) AS tail"

    parts = []

    def part(step: int, column: str, kind: str, test: str, level: str, when: str = "true") -> None:
        place = COLUMNS.index(column)
        parts.append(
            f"""SELECT {place} AS place, {step} AS step, '{column}' AS "column", {level} AS severity,
            '{kind}' AS issue_type, k AS row_count, tail, false AS unit
            FROM (SELECT k, tail, k / CAST(total AS DOUBLE) AS r, role FROM (SELECT {flagged(test)}, any_value(total) AS total
              FROM lens, size), roles WHERE name = '{column}' AND {when}) WHERE k > 0"""
        )

    for column in COLUMNS:
        present = PRESENT.format(x=column) if column not in ("order_id", "quantity") else "true"
        text = column not in ("order_id", "quantity")
        if text:
            part(1, column, "missing_values", f"coalesce(trim({column}) = '', true)", _BANDS)
            part(2, column, "sentinel_values", f"lower(trim({column})) IN {SENTINELS}",
                 "CASE WHEN r >= 0.05 THEN 'medium' ELSE 'low' END")
            numeric = "inferred_type IN ('integer', 'float')"
            x = number_sql(column)
            part(3, column, "numeric_format", f"regexp_matches({column}, '[$€£,]') AND {x} IS NOT NULL", "'medium'", numeric)
            part(4, column, "non_numeric", f"{present} AND {x} IS NULL",
                 "CASE WHEN r >= 0.3 THEN 'critical' WHEN r >= 0.05 THEN 'high' ELSE 'medium' END", numeric)
            part(5, column, "negative_values", f"{x} < 0",
                 "CASE WHEN role IN ('money', 'quantity') THEN 'high' ELSE 'medium' END", numeric)
            part(7, column, "invalid_email", f"{present} AND NOT regexp_full_match(trim({column}), '[^@ ]+@[^@ ]+[.][^@ ]+')",
                 "CASE WHEN r >= 0.15 THEN 'high' ELSE 'medium' END", "(inferred_type = 'email' OR role = 'email')")
            day = DAY_SQL.format(x=f"trim({column})")
            is_date = "(inferred_type = 'datetime' OR role = 'date')"
            part(8, column, "invalid_datetime", f"{present} AND {day} IS NULL",
                 "CASE WHEN r >= 0.4 THEN 'critical' WHEN r >= 0.15 THEN 'high' ELSE 'medium' END", is_date)
            part(9, column, "date_format", f"{present} AND trim({column}) <> strftime({day}, '%Y-%m-%d')", "'low'", is_date)
            part(11, column, "whitespace", f"trim({column}) <> '' AND {column} <> trim({column})", "'low'")
    for column, extra in (("status", "false"), ("country", f"{COUNTRY_SQL.format(x='country')} <> trim(country)")):
        part(10, column, "inconsistent_categories",
             f"trim({column}) IN (SELECT spelling FROM m_{column}) OR coalesce({extra}, false)", "'medium'")
    return f"""{head}, size AS (SELECT count(*) AS total FROM lens),
    m_status AS ({case_map_sql('status')}), m_country AS ({case_map_sql('country')}),
    body AS (SELECT {_BODY} FROM lens),
    conflicts AS ({conflict_sql('order_id', 'body')}),
    nums AS (SELECT _ord, CASE WHEN {PRESENT.format(x='amount')} THEN {number_sql('amount')} END AS x FROM lens),
    fence AS ({_FENCE}),
    far AS (SELECT _ord, abs(x) > greatest(20 * abs(q2), 1) AS slip FROM nums, fence
      WHERE x NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) AND abs(x) > greatest(10 * abs(q2), 1)),
    doubled AS (SELECT {_BODY}, count(*) AS n FROM lens GROUP BY ALL HAVING count(*) > 1),
    copied AS (SELECT _ord FROM lens SEMI JOIN doubled USING (order_id, customer, email, country, amount, quantity,
      status, order_date, age, active)),
    found AS (
      SELECT -1 AS place, 0 AS step, NULL AS "column",
        CASE WHEN (SELECT sum(n - 1) FROM doubled) > 0.25 * any_value(total) THEN 'critical' ELSE 'high' END AS severity,
        'exact_duplicates' AS issue_type, (SELECT sum(n) FROM doubled)::BIGINT AS row_count,
        avg(CASE WHEN _ord >= 0.8 * total THEN 1.0 ELSE 0.0 END) AS tail, false AS unit FROM copied, size HAVING count(*) > 0
      UNION ALL SELECT 4, 6, 'amount', CASE WHEN bool_or(slip) THEN 'high' ELSE 'medium' END, 'outliers', count(*),
        avg(CASE WHEN _ord >= 0.8 * total THEN 1.0 ELSE 0.0 END), bool_or(slip) FROM far, size HAVING count(*) > 0
      UNION ALL SELECT 0, 12, 'order_id', CASE WHEN count(*) > 0.2 * any_value(total) THEN 'critical' ELSE 'high' END,
        'duplicate_key', count(*), avg(CASE WHEN _ord >= 0.8 * total THEN 1.0 ELSE 0.0 END), false
        FROM lens, size WHERE order_id IN (SELECT token FROM conflicts) HAVING count(*) > 0
      UNION ALL {' UNION ALL '.join(parts)}),
    issues AS (SELECT *, 'Q' || lpad(CAST(row_number() OVER (ORDER BY place, step) AS VARCHAR), 3, '0') AS id
      FROM found WHERE severity IS NOT NULL)"""


ISSUES = issues_sql()


@query(
    "Q00_issues_lens",
    f"""{ISSUES} SELECT id, "column", severity, issue_type, row_count FROM issues""",
)
def issues_lens(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        found = issues_frame(inspection, detect(inspection, evidence=False))
    return found.select("id", "column", "severity", "issue_type", "row_count")


@query(
    "Q14_tail_ratios",
    f"""{ISSUES} SELECT id, "column", issue_type, row_count, round(tail, 4) AS tail_ratio FROM issues""",
)
def tail_ratios(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        found = issues_frame(inspection, detect(inspection))
    return found.select("id", "column", "issue_type", "row_count", F.col("evidence.tail_ratio").alias("tail_ratio"))


_POSITION_TESTS = {
    ("amount", "negative_values"): f"{_AMOUNT} < 0",
    ("status", "whitespace"): "status <> trim(status)",
    ("age", "missing_values"): "coalesce(trim(age) = '', true)",
}


def _positions(spark, sf_dir):
    with Inspection(lens(spark, sf_dir).select(ORD, "amount", "status", "age")) as inspection:
        found = issues_frame(inspection, detect(inspection))
    wanted = F.concat_ws("/", "column", "issue_type").isin(["/".join(key) for key in _POSITION_TESTS])
    return found.filter(wanted)


@query(
    "Q14_first_positions",
    f"{LENS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS issue_type, CAST(_ord AS BIGINT) AS position
        FROM (SELECT _ord FROM lens WHERE {test} ORDER BY _ord LIMIT 40)"""
        for (c, t), test in _POSITION_TESTS.items()
    ),
)
def first_positions(spark, sf_dir):
    return _positions(spark, sf_dir).select("column", "issue_type", F.explode("positions").alias("position"))


@query(
    "Q15_numeric_examples",
    f"""{LENS} SELECT 'negative_values' AS issue_type, left(amount, 60) AS example FROM (
      SELECT amount FROM lens WHERE {_AMOUNT} < 0 ORDER BY _ord LIMIT 5)
    UNION ALL SELECT 'non_numeric', left(amount, 60) FROM (
      SELECT amount FROM lens WHERE {TESTS['non_numeric', 'amount']} ORDER BY _ord LIMIT 5)""",
)
def numeric_examples(spark, sf_dir):
    with Inspection(lens(spark, sf_dir).select(ORD, "amount")) as inspection:
        found = issues_frame(inspection, detect(inspection))
    kept = found.filter("issue_type IN ('negative_values', 'non_numeric')")
    return kept.select("issue_type", F.explode("evidence.examples").alias("example"))


_CAUSES = """(VALUES ('sentinel_values', 'sentinel_encoding', 0.9), ('numeric_format', 'display_formatting', 0.92),
    ('non_numeric', 'invalid_entry', 0.74), ('exact_duplicates', 'ingestion_replay', 0.86),
    ('duplicate_key', 'conflicting_keys', 0.82), ('whitespace', 'export_formatting', 0.84),
    ('inconsistent_categories', 'inconsistent_entry', 0.8), ('invalid_datetime', 'mixed_date_formats', 0.8),
    ('date_format', 'mixed_date_formats', 0.77), ('negative_values', 'sign_convention', 0.7),
    ('missing_values', 'missingness', 0.58), ('outliers', 'outlier', 0.48), ('invalid_email', 'invalid_entry', 0.8)
    ) AS c(issue_type, category, confidence)"""
_CAUSE_SQL = f"""{ISSUES} SELECT id AS issue_id, "column",
    CASE WHEN i.issue_type = 'missing_values' AND tail >= 0.7 THEN 'truncated_extract' WHEN unit THEN 'unit_error'
      ELSE coalesce(category, 'unspecified') END AS category,
    CAST(CASE WHEN i.issue_type = 'missing_values' AND tail >= 0.7 THEN 0.72 WHEN unit THEN 0.74
      ELSE coalesce(confidence, 0.4) END AS DOUBLE) AS confidence
    FROM issues i LEFT JOIN {_CAUSES} ON c.issue_type = i.issue_type"""


@query("X01_causes_lens", _CAUSE_SQL)
def causes(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        found = explain(detect(inspection))
    return causes_frame(spark, found).select("issue_id", "column", "category", "confidence")


@query("X02_X03_X04_causes_of_stored_issues", _CAUSE_SQL)
def causes_of_stored(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        stored = issues_frame(inspection, detect(inspection))
    return with_causes(stored).select(F.col("id").alias("issue_id"), "column", "category", "confidence")


_TRUNCATED = """SELECT CAST(event_id AS BIGINT) AS _ord, event_id,
    CASE WHEN event_id >= 0.9 * (SELECT count(*) FROM events) THEN NULL ELSE event_type END AS event_type FROM events"""


@query(
    "X02_truncated_extract",
    f"""WITH e AS ({_TRUNCATED}) SELECT 'event_type' AS "column", count(*) AS row_count,
    round(avg(CASE WHEN _ord >= 0.8 * (SELECT count(*) FROM events) THEN 1.0 ELSE 0.0 END), 4) AS tail_ratio,
    'truncated_extract' AS category FROM e WHERE event_type IS NULL""",
)
def truncated(spark, sf_dir):
    text = _TRUNCATED.replace("FROM events", "FROM {events}")
    with Inspection(spark.sql(text, events=table(spark, sf_dir, "events"))) as inspection:
        issues = detect(inspection)
    rows_ = [
        (issue.column, issue.row_count, issue.evidence["tail_ratio"], cause.category)
        for issue, cause in zip(issues, explain(issues))
        if issue.issue_type == "missing_values"
    ]
    return spark.createDataFrame(rows_, "column string, row_count bigint, tail_ratio double, category string")
