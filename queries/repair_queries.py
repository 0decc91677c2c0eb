"""Repair strategies and plans, over the dirty lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.issue_queries import ISSUES, PRESENT
from queries.lens import COLUMNS, LENS, lens
from queries.registry import query, table
from queries.rule_queries import COUNTRY_SQL, DAY_SQL, SENTINELS, case_map_sql, number_sql
from sluice.functions.cells import ORD
from sluice.operators.inspection import Inspection
from sluice.operators.issues import detect
from sluice.operators.repairs import (
    Repair,
    apply,
    canonicalize_case,
    drop_incomplete,
    drop_outliers,
    plan_auto,
    plan_review,
    repair_cells,
)
from sluice.operators.rows import drop_copies, keep_first

_AMOUNT = f"CASE WHEN {PRESENT.format(x='amount')} THEN {number_sql('amount')} END"


def _cell_repair(name, strategy, column, sql, target=None):
    @query(name, f'{LENS} SELECT _ord, {sql} AS "{column}" FROM lens')
    def repaired(spark, sf_dir):
        df = lens(spark, sf_dir).select(ORD, column)
        return repair_cells(df, [Repair(strategy, column, target_type=target)])


_cell_repair("R01_trim_whitespace", "trim_whitespace", "email", "CASE WHEN trim(email) = '' THEN email ELSE trim(email) END")
_cell_repair("R02_replace_sentinels", "replace_sentinels", "age", f"CASE WHEN lower(trim(age)) IN {SENTINELS} THEN NULL ELSE age END")
_cell_repair("R03_coerce_numeric_integer", "coerce_numeric", "amount", f"CAST({_AMOUNT} AS BIGINT)", "integer")
_cell_repair("R03_coerce_numeric_float", "coerce_numeric", "amount", _AMOUNT, "float")
_cell_repair("R04_normalize_country", "normalize_country", "country", f"coalesce({COUNTRY_SQL.format(x='country')}, trim(country))")
_cell_repair("R06_coerce_dates", "coerce_dates", "order_date", f"strftime({DAY_SQL.format(x='trim(order_date)')}, '%Y-%m-%d')")
_cell_repair("R07_coerce_booleans", "coerce_booleans", "active", "lower(trim(active)) IN ('true', 't', 'yes', 'y')")
_cell_repair("R09_absolute_value", "absolute_value", "amount", f"abs({_AMOUNT})")
_cell_repair(
    "R10_impute_median", "impute_median", "amount",
    f"coalesce({_AMOUNT}, (SELECT quantile_cont({_AMOUNT}, 0.5) FROM lens))",
)


@query(
    "R05_canonicalize_case",
    f"""{LENS}, m AS ({case_map_sql('status')})
    SELECT _ord, coalesce(winner, trim(status)) AS status FROM lens LEFT JOIN m ON m.spelling = trim(status)""",
)
def case_repair(spark, sf_dir):
    return canonicalize_case(lens(spark, sf_dir).select(ORD, "status"), [Repair("canonicalize_case", "status")])


@query(
    "R08_drop_exact_duplicates",
    f"{LENS} SELECT {', '.join(COLUMNS)}, min(_ord) AS _ord FROM lens GROUP BY ALL",
)
def drop_duplicates(spark, sf_dir):
    return drop_copies(lens(spark, sf_dir))


@query("R08_drop_duplicate_documents", "SELECT min(doc_id) AS _ord, text, lang, source, n_chars FROM documents GROUP BY text, lang, source, n_chars")
def drop_duplicate_documents(spark, sf_dir):
    return drop_copies(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", ORD))


@query(
    "R11_drop_incomplete_rows",
    f"""{LENS} SELECT _ord, amount FROM lens WHERE {_AMOUNT} IS NOT NULL""",
)
def incomplete(spark, sf_dir):
    df = lens(spark, sf_dir).select(ORD, "amount")
    return drop_incomplete(df, Repair("drop_incomplete_rows", "amount", target_type="float"))


def _drop_outlier_sql(column: str, keep: str, source: str) -> str:
    return f"""WITH q AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})
    SELECT {keep}, {column} FROM {source}, q
    WHERE q1 = q3 OR {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


@query("R12_drop_outlier_rows_events", _drop_outlier_sql("value", "event_id", "events"))
def outlier_rows_events(spark, sf_dir):
    return drop_outliers(table(spark, sf_dir, "events").select("event_id", "value"), Repair("drop_outlier_rows", "value"))


@query("R12_drop_outlier_rows_documents", _drop_outlier_sql("n_chars", "doc_id", "documents"))
def outlier_rows_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return drop_outliers(df, Repair("drop_outlier_rows", "n_chars"))


@query(
    "R13_dedupe_key_events",
    """SELECT min(event_id) AS _ord, arg_min(event_id, event_id) AS event_id, user_id,
    arg_min(ts, event_id) AS ts, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value,
    arg_min(props, event_id) AS props FROM events GROUP BY user_id""",
)
def dedupe_events(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "events").withColumn(ORD, F.col("event_id")), "user_id")


@query(
    "R13_dedupe_key_lens",
    f"""{LENS}, first AS (SELECT min(_ord) AS _ord FROM lens GROUP BY order_id)
    SELECT lens.* FROM lens JOIN first USING (_ord)""",
)
def dedupe_lens(spark, sf_dir):
    return keep_first(lens(spark, sf_dir), "order_id")


@query(
    "C15_trim_text_only",
    """SELECT o_orderkey, o_custkey, trim(' ' || o_orderstatus || '  ') AS o_orderstatus, o_totalprice, o_orderdate,
    trim(chr(9) || o_orderpriority, chr(9) || ' ') AS o_orderpriority FROM orders""",
)
def trim_all(spark, sf_dir):
    """Every column is to be trimmed; what is no text keeps its type and values."""
    padded = {"o_orderstatus": F.concat(F.lit(" "), "o_orderstatus", F.lit("  ")), "o_orderpriority": F.concat(F.lit("\t"), "o_orderpriority")}
    df = table(spark, sf_dir, "orders").withColumns(padded)
    return repair_cells(df, [Repair("trim_whitespace", name) for name in df.columns])


# -- plans and whole runs ---------------------------------------------------------------------

_AUTO_SQL = """SELECT DISTINCT strategy, "column" FROM (
    SELECT CASE issue_type WHEN 'whitespace' THEN 'trim_whitespace' WHEN 'sentinel_values' THEN 'replace_sentinels'
      WHEN 'numeric_format' THEN 'coerce_numeric' WHEN 'non_numeric' THEN 'coerce_numeric'
      WHEN 'inconsistent_categories' THEN 'canonicalize_case' WHEN 'invalid_datetime' THEN 'coerce_dates'
      WHEN 'date_format' THEN 'coerce_dates' WHEN 'exact_duplicates' THEN 'drop_exact_duplicates' END AS strategy, "column"
    FROM issues
    UNION ALL SELECT 'normalize_country', "column" FROM issues
      WHERE issue_type = 'inconsistent_categories' AND "column" LIKE '%country%'
    UNION ALL SELECT 'coerce_booleans', name FROM typed WHERE inferred_type = 'boolean') WHERE strategy IS NOT NULL"""


@query("L01_plan_auto", f"{ISSUES} {_AUTO_SQL}")
def auto_plan(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        plan = plan_auto(inspection, detect(inspection, evidence=False))
    return spark.createDataFrame([(r.strategy, r.column) for r in plan], "strategy string, column string")


def repaired_sql(head: str = LENS, name: str = "lens", mapped: str = "mapped") -> str:
    """CTEs ending in ``fixed``: the lens after every automatic repair."""
    age = f"CASE WHEN trim(age) <> '' AND lower(trim(age)) NOT IN {SENTINELS} THEN trim(age) END"
    return f"""{head}, {mapped} AS ({case_map_sql('status')}),
    cells AS (SELECT _ord, order_id, customer, trim(email) AS email,
      coalesce({COUNTRY_SQL.format(x='country')}, trim(country)) AS country, CAST({_AMOUNT} AS BIGINT) AS amount, quantity,
      coalesce(winner, trim(status)) AS status, strftime({DAY_SQL.format(x='trim(order_date)')}, '%Y-%m-%d') AS order_date,
      coalesce({age}, CASE WHEN trim(age) = '' THEN age END) AS age,
      lower(trim(active)) IN ('true', 't', 'yes', 'y') AS active, note
      FROM lens LEFT JOIN {mapped} ON spelling = trim(status)),
    fixed AS (SELECT min(_ord) AS _ord, {', '.join(COLUMNS)} FROM cells GROUP BY ALL)"""


def _plan(spark, df):
    with Inspection(df) as inspection:
        return plan_auto(inspection, detect(inspection, evidence=False))


@query("L03_apply_auto", f"{repaired_sql()} SELECT * FROM fixed")
def apply_auto(spark, sf_dir):
    """Every automatic repair of the lens in the fixed order."""
    df = lens(spark, sf_dir)
    return apply(df, _plan(spark, df), count=False)[0]


@query(
    "L03_rows_affected",
    f"""{LENS}, m AS ({case_map_sql('status')}) SELECT * FROM (
      SELECT 'drop_exact_duplicates' AS strategy, NULL AS "column",
        (SELECT count(*) FROM lens) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(COLUMNS)} FROM lens)) AS rows_affected
      UNION ALL SELECT 'trim_whitespace', 'email', count(*) FROM lens WHERE email <> trim(email)
      UNION ALL SELECT 'trim_whitespace', 'status', count(*) FROM lens WHERE status <> trim(status)
      UNION ALL SELECT 'replace_sentinels', 'age', count(*) FROM lens WHERE lower(trim(age)) IN {SENTINELS}
      UNION ALL SELECT 'replace_sentinels', 'amount', count(*) FROM lens WHERE lower(trim(amount)) IN {SENTINELS}
      UNION ALL SELECT 'normalize_country', 'country', count(*) FROM lens WHERE {COUNTRY_SQL.format(x='country')} <> country
      UNION ALL SELECT 'canonicalize_case', 'status', count(*) FROM lens WHERE trim(status) IN (SELECT spelling FROM m)
      UNION ALL SELECT 'canonicalize_case', 'country', 0
      UNION ALL SELECT 'coerce_booleans', 'active', count(*) FROM lens
      UNION ALL SELECT 'coerce_numeric', 'amount', count(*) FROM lens WHERE {PRESENT.format(x='amount')}
        AND ({number_sql('amount')} IS NULL OR NOT regexp_full_match(amount, '-?(0|[1-9][0-9]*)'))
      UNION ALL SELECT 'coerce_dates', 'order_date', count(*) FROM lens
        WHERE coalesce(strftime({DAY_SQL.format(x='trim(order_date)')}, '%Y-%m-%d') <> order_date, true))""",
)
def affected(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        plan = plan_auto(inspection, detect(inspection, evidence=False))
        done = apply(inspection.df, plan, rows=inspection.rows, inspected=inspection)[1]
    rows = [(r.strategy, r.column, r.rows_affected) for r in done]
    return spark.createDataFrame(rows, "strategy string, column string, rows_affected bigint")


@query(
    "L02_plan_review",
    f"""{repaired_sql()},
    far AS (SELECT amount AS x FROM fixed), q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
      quantile_cont(x, 0.75) AS q3 FROM far),
    conflict AS (SELECT order_id FROM fixed GROUP BY 1 HAVING count(*) > 1),
    n AS (SELECT count(*) AS total, count(*) FILTER (amount IS NULL) AS no_amount,
      count(*) FILTER (coalesce(trim(age) = '', true)) AS no_age FROM fixed)
    SELECT strategy, "column", disposition FROM (
      SELECT 'dedupe_key' AS strategy, 'order_id' AS "column", 'review' AS disposition WHERE (SELECT count(*) FROM conflict) > 0
      UNION ALL SELECT 'absolute_value', 'amount', 'review' WHERE (SELECT count(*) FROM fixed WHERE amount < 0) > 0
      UNION ALL SELECT 'drop_outlier_rows', 'amount', 'review' WHERE (SELECT count(*) FROM far, q
        WHERE x NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) AND abs(x) > 20 * abs(q2)) > 0
      UNION ALL SELECT CASE WHEN no_amount >= 0.15 * total THEN 'drop_incomplete_rows' ELSE 'impute_median' END, 'amount',
        CASE WHEN no_amount >= 0.15 * total THEN 'review' ELSE 'suggested' END FROM n WHERE no_amount > 0
      UNION ALL SELECT 'impute_median', 'age', 'suggested' FROM n WHERE no_age > 0 AND no_age < 0.2 * total)""",
)
def review_plan(spark, sf_dir):
    df = lens(spark, sf_dir)
    with Inspection(apply(df, _plan(spark, df), count=False, write=True)[0]) as after:
        plan = plan_review(after, detect(after, evidence=False))
    rows = [(r.strategy, r.column, r.disposition) for r in plan]
    return spark.createDataFrame(rows, "strategy string, column string, disposition string")


