"""Cell rules over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.lens import LENS, lens
from queries.registry import query, table
from sluice.functions.cells import cells_of, country_of, parse_day, strip, with_facts
from sluice.functions.dates import iso
from sluice.functions.severity import severity_column
from sluice.functions import fixed
from sluice.operators.spellings import case_map, whole_spellings

SENTINELS = "('n/a','na','null','none','-','--','nan','?','tbd','undefined','nil','n.a.')"


def number_sql(x: str) -> str:
    """The number rule for the lens, whose only currency sign is the dollar."""
    bare = f"replace(CASE WHEN left(trim({x}), 1) = '$' THEN trim(substr(trim({x}), 2)) ELSE trim({x}) END, ',', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[-+]?[0-9]+([.][0-9]+)?') THEN CAST({bare} AS DOUBLE) END"


def _facts(spark, sf_dir, column):
    df = lens(spark, sf_dir)
    (cell,) = cells_of(df, [column])
    return with_facts(df, [cell]), cell


@query(
    "C01_blank_sentinel_present",
    f"""{LENS} SELECT _ord, coalesce(trim(age) = '', true) AS blank,
    coalesce(lower(trim(age)) IN {SENTINELS}, false) AS sentinel,
    coalesce(trim(age) <> '' AND lower(trim(age)) NOT IN {SENTINELS}, false) AS present FROM lens""",
)
def blank_sentinel_present(spark, sf_dir):
    facts, cell = _facts(spark, sf_dir, "age")
    return facts.select("_ord", cell.blank.alias("blank"), cell.sentinel.alias("sentinel"), cell.present.alias("present"))


@query("C04_parse_number", f"{LENS} SELECT _ord, amount, {number_sql('amount')} AS number FROM lens")
def numbers(spark, sf_dir):
    facts, cell = _facts(spark, sf_dir, "amount")
    return facts.select("_ord", "amount", cell.number.alias("number"))


@query(
    "C05_numeric_decoration",
    f"""{LENS} SELECT _ord, regexp_matches(amount, '[$€£,]') AND {number_sql('amount')} IS NOT NULL AS decorated
    FROM lens""",
)
def decoration(spark, sf_dir):
    facts, cell = _facts(spark, sf_dir, "amount")
    return facts.select("_ord", cell.flag("decorated").alias("decorated"))


@query(
    "C06_parse_bool",
    f"""{LENS} SELECT _ord, active, CASE WHEN lower(trim(active)) IN ('true','t','yes','y') THEN true
    WHEN lower(trim(active)) IN ('false','f','no','n') THEN false END AS truth FROM lens""",
)
def booleans(spark, sf_dir):
    facts, cell = _facts(spark, sf_dir, "active")
    return facts.select("_ord", "active", cell.truth.alias("truth"))


@query(
    "C07_looks_like_email",
    f"""{LENS} SELECT _ord, regexp_full_match(trim(email), '[^@ ]+@[^@ ]+[.][^@ ]+') AS looks_like_email FROM lens""",
)
def emails(spark, sf_dir):
    facts, cell = _facts(spark, sf_dir, "email")
    return facts.select("_ord", F.col(cell.ref("email")).alias("looks_like_email"))


COUNTRY_SQL = """CASE
    WHEN lower(trim({x})) IN ('usa','us','u.s.','u.s.a.','united states','united states of america') THEN 'United States'
    WHEN lower(trim({x})) IN ('uk','u.k.','great britain','britain','united kingdom') THEN 'United Kingdom'
    WHEN lower(trim({x})) IN ('uae','u.a.e.','united arab emirates') THEN 'United Arab Emirates' END"""


@query(
    "C10_country_canonical",
    f"""{LENS} SELECT country, {COUNTRY_SQL.format(x='country')} AS canonical, count(*) AS n FROM lens GROUP BY 1, 2""",
)
def countries(spark, sf_dir):
    df = lens(spark, sf_dir).withColumn("bare", F.expr(strip("country")))
    canonical = F.expr(country_of("bare")).alias("canonical")
    return df.groupBy("country", canonical).agg(F.count(F.lit(1)).alias("n"))


DAY_SQL = """coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%m/%d/%Y'), try_strptime({x}, '%d/%m/%Y'))"""
ISO_SQL = f"strftime({DAY_SQL}, '%Y-%m-%d')"


@query("C11_parse_dates", f"{LENS} SELECT _ord, order_date, {ISO_SQL.format(x='order_date')} AS day FROM lens")
def dates(spark, sf_dir):
    facts, cell = _facts(spark, sf_dir, "order_date")
    return facts.select("_ord", "order_date", F.expr(iso(cell.day_sql)).alias("day"))


# Every order date written in one of ten ways; the check says which day each must mean.
_SHAPES = """
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, month(o_orderdate) AS m,
    day(o_orderdate) AS dd, o_orderkey % 10 AS shape,
    CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
      WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September'
      WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS name
  FROM orders"""
_WRITTEN = """
  SELECT o_orderkey, d, y, m, dd, shape, CASE shape
    WHEN 0 THEN concat(CAST(d AS STRING), 'T10:20:30Z')
    WHEN 1 THEN replace(CAST(d AS STRING), '-', '/')
    WHEN 2 THEN replace(CAST(d AS STRING), '-', '')
    WHEN 3 THEN concat(CAST(m AS STRING), '-', CAST(dd AS STRING), '-', CAST(y AS STRING))
    WHEN 4 THEN concat(name, ' ', CAST(dd AS STRING), ', ', CAST(y AS STRING))
    WHEN 5 THEN concat(CAST(dd AS STRING), ' ', left(name, 3), ' ', CAST(y AS STRING))
    WHEN 6 THEN concat(CAST(dd AS STRING), '.', CAST(m AS STRING), '.', CAST(y AS STRING))
    WHEN 7 THEN left(CAST(d AS STRING), 7)
    WHEN 8 THEN concat(CAST(m AS STRING), '/', CAST(dd AS STRING), '/', right(CAST(y AS STRING), 2), ' 9:05 PM')
    ELSE concat(CAST(y AS STRING), '-', lpad(CAST(dd + 12 AS STRING), 2, '0'), '-05') END AS written
  FROM shaped"""


@query(
    "C11_date_shapes",
    f"""WITH shaped AS ({_SHAPES}), written AS ({_WRITTEN})
    SELECT o_orderkey, written, CAST(CASE
      WHEN shape = 6 AND dd <= 12 THEN make_date(y, dd, m)
      WHEN shape = 7 THEN make_date(y, m, 1)
      WHEN shape = 9 THEN NULL
      ELSE d END AS STRING) AS day FROM written""",
)
def date_shapes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = f"WITH shaped AS ({_SHAPES.replace('FROM orders', 'FROM {orders}')}), written AS ({_WRITTEN})"
    df = spark.sql(f"{text} SELECT o_orderkey, written FROM written", orders=orders)
    return df.selectExpr("o_orderkey", "written", f"{iso(parse_day('written'))} AS day")


@query(
    "C13_severity_for_ratio",
    """WITH r AS (SELECT c_nationkey, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS ratio
      FROM customer GROUP BY 1)
    SELECT c_nationkey, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.5 THEN 'critical' WHEN ratio >= 0.15 THEN 'high'
      WHEN ratio >= 0.02 THEN 'medium' WHEN ratio > 0 THEN 'low' END AS severity FROM r""",
)
def severities(spark, sf_dir):
    ratio = F.avg(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0)).alias("ratio")
    ratios = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(ratio)
    level = severity_column(F.col("ratio"), fixed.MONEY_BANDS)
    return ratios.select("c_nationkey", F.round("ratio", 6).alias("ratio"), level.alias("severity"))


@query(
    "C14_group_tokens",
    f"""{LENS} SELECT lower(trim(status)) AS folded, trim(status) AS spelling, count(*) AS n FROM lens GROUP BY 1, 2""",
)
def tokens(spark, sf_dir):
    df = lens(spark, sf_dir)
    return whole_spellings(df, cells_of(df, ["status"])).drop("column")


def case_map_sql(column: str, source: str = "lens") -> str:
    return f"""
    SELECT spelling, winner, n FROM (
      SELECT spelling, n, count(*) OVER (PARTITION BY folded) AS forms,
        first_value(spelling) OVER (PARTITION BY folded ORDER BY n DESC, length(spelling) DESC, spelling) AS winner
      FROM (SELECT lower(trim({column})) AS folded, trim({column}) AS spelling, count(*) AS n
            FROM {source} WHERE trim({column}) <> '' AND lower(trim({column})) NOT IN {SENTINELS} GROUP BY 1, 2))
    WHERE spelling <> winner"""


@query("C17_case_map_status", f"{LENS} {case_map_sql('status')}")
def case_map_status(spark, sf_dir):
    return case_map(lens(spark, sf_dir), "status")


@query("C17_case_map_country", f"{LENS} {case_map_sql('country')}")
def case_map_country(spark, sf_dir):
    return case_map(lens(spark, sf_dir), "country")
