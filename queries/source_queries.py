"""Sources: every reader, over data that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries.registry import query, table
from sluice.sources.positions import parquet_with_positions, with_positions
from sluice.sources.readers import payload_records, read_csv, read_json, read_sql
from sluice.sources.shape import SCHEMA_REPORT, flatten, renamed, schema_report, unwrap
from sluice.workspace import workspace


def _scratch(spark, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S01_csv",
    "SELECT * REPLACE (CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate) FROM orders",
)
def csv(spark, sf_dir):
    """Written as text with a header and read back, numeric columns typed again."""
    path = _scratch(spark, "csv")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
    orders.write.csv(path, header=True)
    return read_csv(spark, path, multiline=False).drop("_ord")


@query("S01_csv_quoted_text", "SELECT conv_id, turn, role, text FROM conversations")
def csv_text(spark, sf_dir):
    """Line breaks, quotes and commas inside cells survive."""
    path = _scratch(spark, "csv")
    conversations = table(spark, sf_dir, "conversations")
    conversations.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return read_csv(spark, path).drop("_ord")


_TEXT_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _texts(events):
    """Times as text, as JSON has no other."""
    return events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("S02_json_lines", f"SELECT * REPLACE ({_TEXT_TIME}) FROM events")
def json_lines(spark, sf_dir):
    path = _scratch(spark, "json")
    _texts(table(spark, sf_dir, "events")).write.json(path)
    return read_json(spark, path, lines=True).drop("_ord")


@query("S02_json_folder", f"SELECT * REPLACE ({_TEXT_TIME}), event_id - (SELECT min(event_id) FROM events) AS _ord FROM events")
def json_folder(spark, sf_dir):
    """Files of very different sizes: records come in order of file name and place."""
    path, events = _scratch(spark, "json"), _texts(table(spark, sf_dir, "events"))
    least = events.agg(F.min("event_id")).first()[0]
    events.filter(F.col("event_id") < least + 3).coalesce(1).sortWithinPartitions("event_id").write.json(f"{path}/a")
    rest = events.filter(F.col("event_id") >= least + 3)
    rest.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").write.json(f"{path}/b")
    return read_json(spark, f"{path}/*", lines=True)


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("S03_unwrap_envelope", f"SELECT event_id, {_K} AS k FROM events UNION ALL SELECT event_id, {_K} + 1 AS k FROM events")
def envelope(spark, sf_dir):
    records = F.expr("array(struct(CAST(get_json_object(props, '$.k') AS BIGINT) AS k), "
                     "struct(CAST(get_json_object(props, '$.k') AS BIGINT) + 1 AS k)) AS items")  # fmt: skip
    return unwrap(table(spark, sf_dir, "events").select("event_id", F.lit(200).alias("status"), records), "event_id")


@query(
    "S04_flatten_objects",
    """SELECT o_orderkey AS "id", o_custkey AS "buyer_key", o_totalprice AS "money_total", o_orderpriority AS "money_rank_name"
    FROM orders""",
)
def nested(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "struct(o_custkey AS key) AS buyer",
        "struct(o_totalprice AS total, struct(o_orderpriority AS name) AS rank) AS money",
    )
    return renamed(flatten(df))


@query(
    "S05_payload_records",
    f"SELECT event_id, {_K} AS k, CAST(event_type AS STRING) AS kind_name FROM events",
)
def payloads(spark, sf_dir):
    """Raw responses in a text column: schema found over all of them, then unwrapped and flattened."""
    payload = F.concat(
        F.lit('{"ok": true, "results": [{"k": '), F.get_json_object("props", "$.k"),
        F.lit(', "kind": {"name": "'), "event_type", F.lit('"}}]}'),
    )
    df = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return renamed(payload_records(df, keep=("event_id",)))


_JOINED = """SELECT r_name, c_mktsegment, count(*) AS customers, max(c_acctbal) AS best,
      rank() OVER (PARTITION BY r_name ORDER BY count(*) DESC, c_mktsegment) AS place
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_acctbal > {at_least} GROUP BY r_name, c_mktsegment"""


@query("S07_select_over_tables", _JOINED.format(at_least="100"))
def select(spark, sf_dir):
    names = ("customer", "nation", "region")
    tables = {name: table(spark, sf_dir, name) for name in names}
    return read_sql(spark, tables, _JOINED.format(at_least=":at_least"), {"at_least": 100}).withColumn(
        "place", F.col("place").cast("bigint")
    )


@query(
    "S09_safe_names",
    """SELECT s_suppkey AS supp_key, s_name AS supp_key_2, s_nationkey AS c_1st_nation, s_acctbal AS "column" FROM supplier""",
)
def safe_names(spark, sf_dir):
    return renamed(table(spark, sf_dir, "supplier").toDF(" Supp-Key ", "supp key", "1st Nation", "--"))


_REPORTED = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    "S10_schema_report",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, '{c.replace("_", " ", 1)}' AS original_name,
        (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3))
        AS examples, true AS renamed"""
        for c in _REPORTED
    ),
)
def report(spark, sf_dir):
    named = [f"{c} AS `{c.replace('_', ' ', 1)}`" for c in _REPORTED]
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS _ord", *named)
    shown = F.concat_ws("|", "examples").alias("examples")
    return spark.createDataFrame(schema_report(df), SCHEMA_REPORT).select("name", "original_name", shown, "renamed")


@query("S11_parquet_positions", "SELECT o_orderkey, o_orderkey AS _ord FROM orders")
def positions(spark, sf_dir):
    return parquet_with_positions(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "_ord")


@query(
    "S11_positions_by_order",
    "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS _ord FROM events",
)
def positions_by_order(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return with_positions(df, F.desc("value"), "event_id").select("event_id", "_ord")
