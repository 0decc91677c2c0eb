"""A deterministic dirty view of ``orders``, one SQL text for Spark and for the check.

Integers and string literals only, so that the text is byte-equal in both engines.
``_ord`` is the row position: the base rows in key order, then their exact copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queries.registry import table


def _lens(order_id: str, negative: str, huge: str) -> str:
    return f"""
    SELECT _ord, {order_id} AS order_id,
      concat('Customer ', CAST(c AS STRING)) AS customer,
      CASE WHEN k % 50 = 0 THEN 'no address'
           WHEN k % 20 = 1 THEN concat('  u', CAST(c AS STRING), '@example.com ')
           ELSE concat('u', CAST(c AS STRING), '@example.com') END AS email,
      CASE k % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'usa' WHEN 2 THEN 'United States'
                 WHEN 3 THEN 'UK' WHEN 4 THEN 'u.k.' ELSE 'Canada' END AS country,
      CASE WHEN k % 17 = 0 THEN 'N/A' WHEN k % 97 = 1 THEN 'see-note'
           {negative}
           WHEN k % 11 = 3 THEN concat('$', CAST(b AS STRING))
           WHEN k % 13 = 4 THEN concat('1,', lpad(CAST(c % 1000 AS STRING), 3, '0'))
           {huge}
           ELSE CAST(b AS STRING) END AS amount,
      1 + k % 7 AS quantity,
      CASE WHEN k % 10 = 0 THEN concat(' ', CASE WHEN k % 9 = 0 THEN upper(w) ELSE w END, ' ')
           WHEN k % 9 = 0 THEN upper(w) ELSE w END AS status,
      CASE WHEN k % 29 = 0 THEN 'not-a-date'
           WHEN k % 6 = 1 THEN concat(CAST(month(d) AS STRING), '/', CAST(day(d) AS STRING), '/', CAST(year(d) AS STRING))
           ELSE CAST(d AS STRING) END AS order_date,
      CASE WHEN k % 23 = 0 THEN '' WHEN k % 37 = 0 THEN 'tbd' ELSE CAST(18 + k % 60 AS STRING) END AS age,
      CASE k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'True' ELSE 'f' END AS active,
      CASE WHEN k % 2 = 0 THEN NULL ELSE 'call back' END AS note
    FROM placed"""


_PLACED = """
  base AS (
    SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_custkey * 7 + 100 AS b,
      CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'delivered' ELSE 'pending' END AS w
    FROM orders),
  placed AS (
    SELECT base.*, k AS _ord FROM base
    UNION ALL
    SELECT base.*, (SELECT count(*) FROM orders) + CAST(floor((k - 3) / 100.0) AS BIGINT) AS _ord
    FROM base WHERE k % 100 = 3)"""

_DIRTY = _lens(
    "CASE WHEN k % 40 = 7 THEN k - 1 ELSE k END",
    "WHEN k % 31 = 2 THEN concat('-', CAST(b AS STRING))",
    "WHEN k % 501 = 5 THEN concat(CAST(b AS STRING), '000000')",
)
_CLEAN = _lens("k", "", "")

# WITH clause up to and including the view, to be followed by a SELECT.
LENS = f"WITH {_PLACED}, lens AS ({_DIRTY})"
CLEAN = f"WITH {_PLACED}, lens AS ({_CLEAN})"
COLUMNS = (
    "order_id", "customer", "email", "country", "amount", "quantity",
    "status", "order_date", "age", "active", "note",
)


def lens(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    text = (CLEAN if clean else LENS).replace("FROM orders", "FROM {orders}")
    return spark.sql(f"{text} SELECT * FROM lens", orders=table(spark, sf_dir, "orders"))
