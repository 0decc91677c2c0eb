"""Scores, checks, whole gate runs, reviews, history and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.issue_queries import ISSUES, conflict_sql
from queries.lens import CLEAN, COLUMNS, LENS, lens
from queries.registry import query, table
from queries.repair_queries import repaired_sql
from sluice import Gate, Source, audit
from sluice.functions.severity import score_column
from sluice.operators import history
from sluice.operators.inspection import Inspection
from sluice.operators.issues import detect, issues_frame
from sluice.operators.validation import checks_by_run
from sluice.plans.store import new_id
from sluice.workspace import workspace


def _gate(spark: SparkSession) -> Gate:
    return Gate(spark, f"{workspace(spark)}/gate-{new_id()}")


@query(
    "V01_score",
    f"""{ISSUES} SELECT greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 15 WHEN 'medium' THEN 5
    ELSE 1 END))::BIGINT AS score FROM issues""",
)
def score(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        found = issues_frame(inspection, detect(inspection, evidence=False))
    return found.agg(score_column(F.col("severity")).alias("score"))


def _checks(spark, sf_dir, clean):
    found = audit(lens(spark, sf_dir, clean), detail=False)
    rows = [(check.name, check.passed) for check in found.validation.checks]
    rows.append(("passed", found.validation.passed))
    return spark.createDataFrame(rows, "check_name string, passed boolean")


_RESIDUAL = """, n AS (SELECT count(*) AS total, (SELECT count(*) FROM lens) AS before FROM fixed),
    q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2, quantile_cont(amount, 0.75) AS q3
      FROM fixed),
    conflict AS (SELECT coalesce(sum(k), 0) AS k FROM (SELECT count(*) AS k FROM fixed GROUP BY order_id HAVING count(*) > 1)),
    share AS (SELECT count(*) FILTER (amount IS NULL) / CAST(count(*) AS DOUBLE) AS amount,
      count(*) FILTER (order_date IS NULL) / CAST(count(*) AS DOUBLE) AS day,
      count(*) FILTER (coalesce(trim(age) = '', true)) / CAST(count(*) AS DOUBLE) AS age,
      count(*) FILTER (NOT regexp_full_match(email, '[^@ ]+@[^@ ]+[.][^@ ]+')) / CAST(count(*) AS DOUBLE) AS email,
      count(*) FILTER (amount < 0) AS negative FROM fixed),
    far AS (SELECT count(*) AS k, coalesce(bool_or(abs(amount) > greatest(20 * abs(q2), 1)), false) AS slip FROM fixed, q
      WHERE amount NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) AND abs(amount) > greatest(10 * abs(q2), 1)),
    residual AS (
      SELECT CASE WHEN k > 0.2 * total THEN 'critical' ELSE 'high' END AS severity FROM conflict, n WHERE k > 0
      UNION ALL SELECT CASE WHEN amount >= 0.5 THEN 'critical' WHEN amount >= 0.15 THEN 'high' WHEN amount >= 0.02
        THEN 'medium' ELSE 'low' END FROM share WHERE amount > 0
      UNION ALL SELECT 'high' FROM share WHERE negative > 0
      UNION ALL SELECT CASE WHEN slip THEN 'high' ELSE 'medium' END FROM far WHERE k > 0
      UNION ALL SELECT CASE WHEN email >= 0.15 THEN 'high' ELSE 'medium' END FROM share WHERE email > 0
      UNION ALL SELECT CASE WHEN day >= 0.5 THEN 'critical' WHEN day >= 0.25 THEN 'high' WHEN day >= 0.05 THEN 'medium'
        ELSE 'low' END FROM share WHERE day > 0
      UNION ALL SELECT CASE WHEN age >= 0.6 THEN 'critical' WHEN age >= 0.35 THEN 'high' WHEN age >= 0.1 THEN 'medium'
        ELSE 'low' END FROM share WHERE age > 0),
    scored AS (SELECT greatest(0, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 15
        WHEN 'medium' THEN 5 ELSE 1 END), 0)) AS score,
      count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM residual),
    checks AS (SELECT 'non_empty' AS check_name, total > 0 AS passed FROM n
      UNION ALL SELECT 'rows_retained', total >= 0.5 * before FROM n
      UNION ALL SELECT 'no_critical_issues', critical = 0 FROM scored
      UNION ALL SELECT 'no_high_issues', high = 0 FROM scored
      UNION ALL SELECT 'quality_score', score >= 70 FROM scored)"""
_CHECKS_SQL = "SELECT * FROM checks UNION ALL SELECT 'passed', bool_and(passed) FROM checks"


@query("V02_V07_checks_dirty", f"{repaired_sql()}{_RESIDUAL} {_CHECKS_SQL}")
def checks_dirty(spark, sf_dir):
    return _checks(spark, sf_dir, clean=False)


@query("V02_V07_checks_clean", f"{repaired_sql(CLEAN)}{_RESIDUAL} {_CHECKS_SQL}")
def checks_clean(spark, sf_dir):
    return _checks(spark, sf_dir, clean=True)


@query(
    "V08_gate_decisions",
    f"""WITH conv AS ({conflict_sql('conv_id', 'conversations')}), ev AS ({conflict_sql('user_id', 'events')}),
    doc AS (SELECT bool_or(abs(n_chars) > 20 * q2) AS slip FROM documents, (SELECT quantile_cont(n_chars, 0.25) AS q1,
      quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
      WHERE n_chars > q3 + 3 * (q3 - q1))
    SELECT 'conversations' AS name, (SELECT count(*) FROM conv) = 0 AS passed
    UNION ALL SELECT 'events', (SELECT count(*) FROM ev) = 0
    UNION ALL SELECT 'documents', NOT coalesce((SELECT slip FROM doc), false)
    UNION ALL SELECT 'labels', count(*) = count(DISTINCT doc_id) FROM labels
    UNION ALL SELECT 'lineitem', (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) = count(*) FROM lineitem""",
)
def decisions(spark, sf_dir):
    rows = []
    for name in ("conversations", "events", "documents", "labels", "lineitem"):
        rows.append((name, audit(table(spark, sf_dir, name), detail=False).validation.passed))
    return spark.createDataFrame(rows, "name string, passed boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = _gate(spark)
    outcome = gate.run(Source("parquet", f"{sf_dir}/lineitem.parquet"), detail=False)
    return gate.ask(outcome.dataset_id, agg="sum", measure="l_quantity", group="l_returnflag")


@query(
    "V08_gate_publish_ask_lineitem",
    "SELECT l_returnflag, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1",
)
def publish_and_ask(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(
    "K01_published_rows",
    f"""{repaired_sql(CLEAN)} SELECT {', '.join(COLUMNS)} FROM fixed""",
)
def published(spark, sf_dir):
    gate = _gate(spark)
    outcome = gate.run_table(lens(spark, sf_dir, clean=True), Source("sql", name="orders"), detail=False)
    return gate.store.dataset(outcome.dataset_id).drop("_ord")


@query("K02_K03_staged_rows", f"{LENS} SELECT * FROM lens")
def staged(spark, sf_dir):
    """A failing extract is held exactly as it came."""
    gate = _gate(spark)
    outcome = gate.run_table(lens(spark, sf_dir), Source("sql", name="orders"), detail=False)
    return gate.store.staged(outcome.review_id)


_APPROVED = f"""{repaired_sql()},
    signless AS (SELECT _ord, {', '.join('abs(amount) AS amount' if c == 'amount' else c for c in COLUMNS)} FROM fixed),
    q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM signless),
    near AS (SELECT signless.* FROM signless, q
      WHERE amount IS NULL OR amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    first AS (SELECT min(_ord) AS _ord FROM near GROUP BY order_id)
    SELECT near.* FROM near JOIN first USING (_ord)"""


@query("V09_approved_rows", _APPROVED)
def approved(spark, sf_dir):
    """The lens after a person approved the review repairs."""
    gate = _gate(spark)
    held = gate.run_table(lens(spark, sf_dir), Source("sql", name="orders"), detail=False)
    outcome = gate.approve(held.review_id)
    return gate.store.dataset(outcome.dataset_id)


def _history(spark, sf_dir) -> Gate:
    """A store after a few runs over the given tables: some pass, some are held, one is rejected."""
    gate = _gate(spark)
    for name in ("supplier", "customer", "labels", "conversations", "events"):
        outcome = gate.run_table(table(spark, sf_dir, name), Source("parquet", name=name), run_id=name, detail=False)
        if name == "conversations" and outcome.review_id:
            gate.reject(outcome.review_id)
    return gate


# What the runs of ``_history`` find, computed from the tables: keys that conflict, signs, outliers.
_FOUND = f"""WITH conv AS ({conflict_sql('conv_id', 'conversations')}), ev AS ({conflict_sql('user_id', 'events')}),
    q AS (SELECT quantile_cont(value, 0.25) AS q1, abs(quantile_cont(value, 0.5)) AS q2, quantile_cont(value, 0.75) AS q3 FROM events),
    far AS (SELECT count(*) AS n, coalesce(bool_or(abs(value) > greatest(20 * q2, 1)), false) AS slip FROM events, q
      WHERE value NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) AND abs(value) > greatest(10 * q2, 1)),
    sizes AS (SELECT (SELECT count(*) FROM conversations) AS conversations, (SELECT count(*) FROM events) AS events),
    issues AS (
      SELECT 'conversations' AS run_id, 1 AS place, 'conv_id' AS "column", 'duplicate_key' AS issue_type, coalesce(sum(rows), 0)::BIGINT AS row_count,
        CASE WHEN sum(rows) > 0.2 * any_value(sizes.conversations) THEN 'critical' ELSE 'high' END AS severity, 'conflicting_keys' AS category, 0.82 AS confidence FROM conv, sizes
      UNION ALL SELECT 'events', 1, 'user_id', 'duplicate_key', coalesce(sum(rows), 0)::BIGINT,
        CASE WHEN sum(rows) > 0.2 * any_value(sizes.events) THEN 'critical' ELSE 'high' END, 'conflicting_keys', 0.82 FROM ev, sizes
      UNION ALL SELECT 'events', 2, 'value', 'outliers', n, CASE WHEN slip THEN 'high' ELSE 'medium' END,
        CASE WHEN slip THEN 'unit_mismatch' ELSE 'outlier' END, CASE WHEN slip THEN 0.74 ELSE 0.48 END FROM far
      UNION ALL SELECT 'customer', 1, 'c_acctbal', 'negative_values', count(*), 'medium', 'sign_convention', 0.7 FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT 'supplier', 1, 's_acctbal', 'negative_values', count(*), 'medium', 'sign_convention', 0.7 FROM supplier WHERE s_acctbal < 0),
    found AS (SELECT * REPLACE ('Q' || lpad(CAST(row_number() OVER (PARTITION BY run_id ORDER BY place) AS VARCHAR), 3, '0') AS place) FROM issues WHERE row_count > 0),
    tables AS (
      SELECT 'supplier' AS run_id, count(*) AS n, 4 AS k FROM supplier UNION ALL SELECT 'customer', count(*), 5 FROM customer
      UNION ALL SELECT 'labels', count(*), 3 FROM labels UNION ALL SELECT 'conversations', count(*), 4 FROM conversations
      UNION ALL SELECT 'events', count(*), 6 FROM events),
    scored AS (SELECT run_id, n, k, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 END), 0))::BIGINT AS score,
      count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high
      FROM tables LEFT JOIN found USING (run_id) GROUP BY ALL),
    decided AS (SELECT *, critical = 0 AND high = 0 AND score >= 70 AS passed FROM scored)"""


_RUN_TABLES = ("customer", "supplier", "part", "labels", "conversations", "events", "documents", "orders")


@query(
    "V07_checks_of_many_runs",
    f"""{_FOUND}, dq AS (SELECT quantile_cont(n_chars, 0.25) AS q1, abs(quantile_cont(n_chars, 0.5)) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
    doc AS (SELECT count(*) AS n, coalesce(bool_or(abs(n_chars) > greatest(20 * q2, 1)), false) AS slip FROM documents, dq
      WHERE n_chars NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) AND abs(n_chars) > greatest(10 * q2, 1)),
    more AS (
      SELECT run_id, n, k, score, critical, high FROM scored
      UNION ALL SELECT 'part', count(*), 6, 100, 0, 0 FROM part UNION ALL SELECT 'orders', count(*), 6, 100, 0, 0 FROM orders
      UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), 5, CASE WHEN n = 0 THEN 100 WHEN slip THEN 85 ELSE 95 END, 0, CASE WHEN n > 0 AND slip THEN 1 ELSE 0 END FROM doc)
    SELECT run_id, n AS rows_before, n AS rows_after, k::INTEGER AS columns, score::BIGINT AS score_after, critical, high, n > 0 AND k > 0 AS non_empty, true AS rows_retained,
      critical = 0 AS no_critical_issues, high = 0 AS no_high_issues, score >= 70 AS quality_score, n > 0 AND critical = 0 AND high = 0 AND score >= 70 AS passed FROM more""",
)
def checks_of_runs(spark, sf_dir):
    """All five checks for a history of runs in one job."""
    issues, runs = [], []
    for name in _RUN_TABLES:
        with Inspection(table(spark, sf_dir, name)) as inspection:
            issues += [(name, issue.severity) for issue in detect(inspection, evidence=False)]
            runs.append((name, inspection.rows, inspection.rows, len(inspection.cells)))
    return checks_by_run(
        spark.createDataFrame(issues, "run_id string, severity string"),
        spark.createDataFrame(runs, "run_id string, rows_before bigint, rows_after bigint, columns int"),
    )


@query(
    "H01_H02_datasets",
    f"{_FOUND} SELECT run_id AS id, run_id AS display_name, n AS row_count, k::BIGINT AS column_count, score AS quality_score FROM decided WHERE passed",
)
def datasets(spark, sf_dir):
    found = history.newest_datasets(_history(spark, sf_dir).store.records("datasets"))
    return found.select("id", "display_name", "row_count", "column_count", "quality_score")


@query(
    "H03_H04_runs_and_reviews",
    f"""{_FOUND} SELECT run_id, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status, run_id AS display_name, CASE WHEN passed THEN 'store' ELSE 'rollback' END AS decision,
    score AS score_after, CASE WHEN passed THEN run_id END AS dataset_id, CASE WHEN NOT passed THEN 'r' || run_id END AS review_id,
    CASE WHEN passed THEN NULL WHEN run_id = 'conversations' THEN 'rejected' ELSE 'pending' END AS review_status,
    CASE WHEN NOT passed THEN (SELECT count(*) FROM found WHERE found.run_id = decided.run_id) END AS residual_issues FROM decided""",
)
def runs_and_reviews(spark, sf_dir):
    store = _history(spark, sf_dir).store
    runs = history.recent_runs(store.records("runs")).drop("created_at")
    queue = history.review_queue(*[store.records(k) for k in ("review_events", "runs", "issues", "repairs")])
    queue = queue.select("run_id", F.col("status").alias("review_status"), F.size("residual_issues").cast("bigint").alias("residual_issues"))
    return runs.join(queue, "run_id", "left")


@query(
    "H05_totals",
    f"{_FOUND} SELECT count(*) FILTER (passed) AS datasets, count(*) FILTER (NOT passed AND run_id <> 'conversations') AS pending_reviews FROM decided",
)
def totals(spark, sf_dir):
    store = _history(spark, sf_dir).store
    return history.totals(store.records("datasets"), store.records("review_events"))


@query(
    "K04_recorded_issues",
    f"""{_FOUND} SELECT run_id, place AS id, "column", issue_type, severity, row_count, category, confidence::DOUBLE AS confidence FROM found""",
)
def recorded(spark, sf_dir):
    """Issues, causes and repairs as the store recorded them."""
    store = _history(spark, sf_dir).store
    causes = store.records("causes").select("run_id", F.col("issue_id").alias("id"), "category", "confidence")
    issues = store.records("issues").filter("stage = 'before'")
    return issues.join(causes, ["run_id", "id"], "left").select(
        "run_id", "id", "column", "issue_type", "severity", "row_count", "category", "confidence"
    )
