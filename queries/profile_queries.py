"""Profiles of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.lens import COLUMNS, LENS, lens
from queries.registry import query, table
from queries.rule_queries import SENTINELS, number_sql
from sluice.functions.cells import cells_of
from sluice.operators import sketches
from sluice.operators.inspection import Inspection
from sluice.operators.profile import profile, profile_rows, table_profile
from sluice.operators.spellings import digest_counts, top_values

# Every cell of the lens as (place, name, _ord, raw text).
LONG = f"{LENS}, long AS (" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{name}' AS name, _ord, CAST({name} AS STRING) AS raw FROM lens"
    for i, name in enumerate(COLUMNS)
) + f"""), cells AS (SELECT place, name, _ord, raw, coalesce(trim(raw) = '', true) AS blank,
    coalesce(lower(trim(raw)) IN {SENTINELS}, false) AS sentinel FROM long)"""
# Hits per column, enough to infer its type.
HITS = f"""{LONG}, hits AS (SELECT place, name, count(*) AS n, count(*) FILTER (blank) AS blank,
    count(*) FILTER (sentinel) AS sentinel, count(*) FILTER (NOT blank AND NOT sentinel) AS present,
    count(*) FILTER (NOT sentinel AND {number_sql('raw')} IS NOT NULL) AS numbers,
    count(*) FILTER (NOT sentinel AND {number_sql('raw')} <> floor({number_sql('raw')})) AS fractional,
    count(*) FILTER (lower(trim(raw)) IN ('true','t','yes','y','false','f','no','n')) AS truths,
    count(*) FILTER (regexp_full_match(trim(raw), '[^@ ]+@[^@ ]+[.][^@ ]+')) AS emails,
    count(*) FILTER (try_strptime(trim(raw), ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y']) IS NOT NULL) AS days,
    count(DISTINCT lower(trim(raw))) FILTER (NOT blank AND NOT sentinel) AS tokens
    FROM cells GROUP BY 1, 2),
  typed AS (SELECT *, CASE WHEN present = 0 THEN 'unknown'
    WHEN numbers >= 0.8 * present THEN CASE WHEN fractional = 0 THEN 'integer' ELSE 'float' END
    WHEN truths >= 0.9 * present THEN 'boolean'
    WHEN emails >= (CASE WHEN name LIKE '%email%' THEN 0.3 ELSE 0.8 END) * present THEN 'email'
    WHEN days >= 0.8 * present THEN 'datetime'
    WHEN tokens <= 12 AND tokens <= 0.5 * present THEN 'categorical' ELSE 'string' END AS inferred_type FROM hits),
  roles AS (SELECT *, CASE WHEN name = 'id' OR name LIKE '%\\_id' ESCAPE '\\' THEN 'key'
    WHEN name LIKE '%amount%' THEN 'money' WHEN name LIKE '%quantity%' THEN 'quantity'
    WHEN inferred_type = 'email' OR name LIKE '%email%' THEN 'email'
    WHEN inferred_type = 'datetime' OR name LIKE '%date%' THEN 'date' WHEN name LIKE '%note%' THEN 'free_text'
    WHEN name LIKE '%country%' THEN 'country' ELSE 'default' END AS role FROM typed)"""


@query(
    "P01_P02_table_profile",
    f"""{LENS} SELECT count(*) AS row_count, {len(COLUMNS)} AS column_count,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(COLUMNS)} FROM lens)) AS duplicate_row_count
    FROM lens""",
)
def table_level(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        row = table_profile(inspection)
    return spark.createDataFrame([row], "row_count bigint, column_count int, duplicate_row_count bigint")


@query(
    "P03_P04_nulls_and_sentinels",
    f"""{HITS} SELECT name, blank AS null_count, round(blank / CAST(n AS DOUBLE), 4) AS null_pct,
    sentinel AS sentinel_count, round(sentinel / CAST(n AS DOUBLE), 4) AS sentinel_pct FROM hits""",
)
def nulls(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        rows = profile_rows(inspection, detail=False)
    return spark.createDataFrame(
        [{k: row[k] for k in ("name", "null_count", "null_pct", "sentinel_count", "sentinel_pct")} for row in rows],
        "name string, null_count bigint, null_pct double, sentinel_count bigint, sentinel_pct double",
    )


@query("P05_unique_counts", f"{HITS} SELECT name, tokens AS unique_count FROM hits")
def unique(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        rows = list(inspection.distinct.items())
    return spark.createDataFrame(rows, "name string, unique_count bigint")


@query(
    "P05_unique_counts_lineitem",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(DISTINCT {c}) AS unique_count FROM lineitem"
        for c in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        )
    ),
)
def unique_lineitem(spark, sf_dir):
    with Inspection(table(spark, sf_dir, "lineitem")) as inspection:
        rows = list(inspection.distinct.items())
    return spark.createDataFrame(rows, "name string, unique_count bigint")


@query(
    "P06_examples",
    f"""{LONG} SELECT name, place AS example_place, value FROM (
      SELECT name, left(raw, 80) AS value, row_number() OVER (PARTITION BY name ORDER BY _ord) AS place
      FROM cells WHERE NOT blank AND NOT sentinel) WHERE place <= 3""",
)
def first_examples(spark, sf_dir):
    from sluice.operators.profile import examples

    with Inspection(lens(spark, sf_dir)) as inspection:
        shown = examples(inspection)
    rows = [(name, place, value) for name, values in shown.items() for place, value in enumerate(values, start=1)]
    return spark.createDataFrame(rows, "name string, example_place bigint, value string")


@query("P07_P08_types_and_roles", f"{HITS} SELECT name, inferred_type, role FROM roles")
def types_and_roles(spark, sf_dir):
    with Inspection(lens(spark, sf_dir)) as inspection:
        rows = inspection.schema
    return spark.createDataFrame(rows, "name string, inferred_type string, role string")


def round4(x: str) -> str:
    """Four decimals of the exact binary value, as Python rounds."""
    return f"CAST(printf('%.4f', {x}) AS DOUBLE)"


def _stats_sql(column: str, source: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    stats = {
        "min": f"min({x})",
        "max": f"max({x})",
        "mean": f"avg({x})",
        "median": f"quantile_cont({x}, 0.5)",
        "stdev": f"coalesce(stddev_samp({x}), 0)",
        "p25": f"quantile_cont({x}, 0.25)",
        "p75": f"quantile_cont({x}, 0.75)",
    }
    columns = ", ".join(f"{round4(sql)} AS {name}" for name, sql in stats.items())
    return f"SELECT '{column}' AS name, {columns} FROM {source}"


_STATS = ("min", "max", "mean", "median", "stdev", "p25", "p75")


def _stats(spark, df, columns):
    with Inspection(df.select(*columns)) as inspection:
        from sluice.operators.profile import column_stats

        rows = [column_stats(inspection, cell) | {"name": cell.name} for cell in inspection.cells]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{s} double" for s in _STATS))


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey")


@query("P09_numeric_stats_lineitem", " UNION ALL ".join(_stats_sql(c, "lineitem") for c in _MEASURES))
def stats_lineitem(spark, sf_dir):
    return _stats(spark, table(spark, sf_dir, "lineitem"), _MEASURES)


@query("P09_numeric_stats_events", _stats_sql("value", "events"))
def stats_events(spark, sf_dir):
    return _stats(spark, table(spark, sf_dir, "events"), ["value"])


@query(
    "P09_numeric_stats_text",
    f"""{LENS}, parsed AS (SELECT CASE WHEN lower(trim(amount)) NOT IN {SENTINELS} THEN {number_sql('amount')} END
    AS amount FROM lens) {_stats_sql('amount', 'parsed')}""",
)
def stats_text(spark, sf_dir):
    return _stats(spark, lens(spark, sf_dir), ["amount"])


def _histogram_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS name, bucket, {round4("low + bucket * step")} AS lo,
      {round4("CASE WHEN bucket = buckets - 1 THEN high ELSE low + (bucket + 1) * step END")} AS hi,
      (SELECT count(*) FROM {source} WHERE {column} >= low + bucket * step AND (bucket = buckets - 1 OR
        {column} < low + (bucket + 1) * step)) AS n
    FROM (SELECT *, (high - low) / buckets AS step, unnest(range(buckets)) AS bucket
      FROM (SELECT CAST(min({column}) AS DOUBLE) AS low, CAST(max({column}) AS DOUBLE) AS high,
        least(8, count(DISTINCT {column})) AS buckets FROM {source}))"""


def _histogram(spark, df, column):
    from sluice.operators.profile import column_histogram

    with Inspection(df.select(column)) as inspection:
        buckets = column_histogram(inspection, inspection.cells[0])
    rows = [(column, i, b["lo"], b["hi"], b["count"]) for i, b in enumerate(buckets)]
    return spark.createDataFrame(rows, "name string, bucket bigint, lo double, hi double, n bigint")


for _table, _column in (
    ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_linenumber"),
    ("part", "p_size"), ("events", "value"), ("customer", "c_acctbal"),
):
    query(f"P10_histogram_{_column}", _histogram_sql(_column, _table))(
        lambda spark, sf_dir, t=_table, c=_column: _histogram(spark, table(spark, sf_dir, t), c)
    )

# What Python's strip removes, as far as the texts hold any of it.
STRIPPED = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))"


def _top_sql(column: str, source: str, bare: str | None = None) -> str:
    bare = bare or f"trim({column})"
    return f"""SELECT place, value, n FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place
      FROM (SELECT {bare} AS value, count(*) AS n FROM {source}
            WHERE {bare} <> '' AND lower({bare}) NOT IN {SENTINELS} GROUP BY 1)) WHERE place <= 8"""


def _top(df, column):
    with Inspection(df.select(column)) as inspection:
        ranked = top_values(inspection.df, inspection.cells, inspection.tokens)
        return ranked.select(F.col("place").cast("bigint").alias("place"), "value", "n")


@query("P11_top_values_status", f"{LENS} {_top_sql('status', 'lens')}")
def top_status(spark, sf_dir):
    return _top(lens(spark, sf_dir), "status")


@query("P11_top_values_customer", f"{LENS} {_top_sql('customer', 'lens')}")
def top_customer(spark, sf_dir):
    return _top(lens(spark, sf_dir), "customer")


@query("P11_top_values_event_type", _top_sql("event_type", "events"))
def top_event_type(spark, sf_dir):
    return _top(table(spark, sf_dir, "events"), "event_type")


@query("P11_top_values_documents", _top_sql("text", "documents", STRIPPED.format(x="text")))
def top_documents(spark, sf_dir):
    """Texts of up to 20,000 words: counted by digest, ranked whole."""
    return _top(table(spark, sf_dir, "documents"), "text")


_UNIQUE = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN repeat('z', 100) || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
    WHEN o_orderkey % 3 = 1 THEN 'order ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE repeat('m', 40) || o_clerk_note END AS note
    FROM (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ' ' || CAST(o_orderkey AS VARCHAR) AS o_clerk_note FROM orders)"""


@query("P11_top_values_near_unique", f"WITH t AS ({_UNIQUE}) {_top_sql('note', 't')}")
def top_near_unique(spark, sf_dir):
    """A column that never repeats, a third of it under one long head: only digests and short heads are shuffled."""
    notes = spark.sql(_UNIQUE.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    cells = cells_of(notes)
    return top_values(notes, cells, digest_counts(notes, cells)).select(F.col("place").cast("bigint").alias("place"), "value", "n")


@query("P11_top_values_tied_late", f"WITH t AS ({_UNIQUE.replace('CASE WHEN o_orderkey % 3 = 0', 'CASE WHEN true')}) {_top_sql('note', 't')}")
def top_tied_late(spark, sf_dir):
    """All under one head of 100 characters, so that the first values are told apart only after it."""
    sql = _UNIQUE.replace("CASE WHEN o_orderkey % 3 = 0", "CASE WHEN true")
    notes = spark.sql(sql.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    cells = cells_of(notes)
    return top_values(notes, cells, digest_counts(notes, cells)).select(F.col("place").cast("bigint").alias("place"), "value", "n")


@query(
    "P12_boolean_top_values",
    f"""{LENS} SELECT CASE WHEN lower(trim(active)) IN ('true','t','yes','y') THEN 'True' ELSE 'False' END AS value,
    count(*) AS n FROM lens GROUP BY 1""",
)
def top_booleans(spark, sf_dir):
    with Inspection(lens(spark, sf_dir).select("active")) as inspection:
        return inspection.truth_counts(inspection.cells[0])


@query("P00_full_profile_lineitem")
def full_profile(spark, sf_dir):
    with Inspection(table(spark, sf_dir, "lineitem")) as inspection:
        return profile(inspection)


_LINEITEM = {
    "l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": True,
    "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False, "l_shipdate": False,
}


@query(
    "P05_P09_merged_sketches",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS name, count(*) AS row_count, count(*) - count({name}) AS null_count,
        {f'min({name})::DOUBLE' if number else 'NULL::DOUBLE'} AS low, {f'max({name})::DOUBLE' if number else 'NULL::DOUBLE'} AS high,
        true AS distinct_within, {'true' if number else 'NULL::BOOLEAN'} AS quartiles_within FROM lineitem"""
        for name, number in _LINEITEM.items()
    ),
)
def merged_sketches(spark, sf_dir):
    """Two extracts sketched apart and merged; distinct counts and ranks within the stated errors of the exact ones."""
    lines = table(spark, sf_dir, "lineitem")
    parts = [sketches.sketch(lines.filter(F.col("l_partkey") % 3 == 0)), sketches.sketch(lines.filter("l_partkey % 3 <> 0 OR l_partkey IS NULL"))]
    found = sketches.sketched_profile(sketches.merged(parts[0].unionByName(parts[1])))
    quartiles = {row["name"]: row.quartiles for row in found.select("name", "quartiles").collect()}
    exact, counts = [], None
    for name, values in quartiles.items():
        for share, value in zip((0.25, 0.5, 0.75), values or ()):
            margin = F.count(name) * sketches.RANK_ERROR
            below, upto = F.count_if(F.col(name) < value), F.count_if(F.col(name) <= value)
            near = (below - margin <= share * F.count(name)) & (upto + margin >= share * F.count(name))
            exact.append(near.alias(f"near_{name}_{int(share * 100)}"))
    truth = []
    for name in _LINEITEM:  # one column at a time, so that a row is not shuffled once for each
        count = lines.select(name).distinct().agg(F.lit(name).alias("name"), F.count(name).alias("distinct"))
        counts = count if counts is None else counts.unionByName(count)
    for name, values in quartiles.items():
        near = " AND ".join(f"near_{name}_{p}" for p in (25, 50, 75)) if values else "CAST(NULL AS BOOLEAN)"
        truth.append(f"struct('{name}' AS name, {near} AS quartiles_within)")
    checked = lines.agg(*exact).selectExpr(f"inline(array({', '.join(truth)}))").join(counts, "name")
    off = F.abs(F.col("unique_count") - F.col("distinct"))
    return found.join(checked, "name").select(
        "name", F.col("rows").alias("row_count"), "null_count", F.col("min").alias("low"), F.col("max").alias("high"),
        (off <= F.col("distinct") * sketches.DISTINCT_ERROR).alias("distinct_within"), "quartiles_within",
    )
