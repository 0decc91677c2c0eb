"""The fixed questions, over given tables."""

from __future__ import annotations

from queries.registry import query, table
from sluice.operators.ask import ask, preview, short_preview


@query("A01_count", "SELECT count(*) AS count FROM lineitem")
def count(spark, sf_dir):
    return ask(table(spark, sf_dir, "lineitem"), "count")


@query("A02_count_by_group", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def count_by(spark, sf_dir):
    return ask(table(spark, sf_dir, "customer"), "count", group="c_mktsegment")


@query("A02_count_by_many_groups", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def count_by_many(spark, sf_dir):
    return ask(table(spark, sf_dir, "events"), group="user_id")


for _agg, _word in (("avg", "average"), ("sum", "sum"), ("min", "minimum"), ("max", "maximum")):
    query(f"A03_{_agg}", f"SELECT {_agg}(l_quantity) AS {_word}_l_quantity FROM lineitem")(
        lambda spark, sf_dir, a=_agg: ask(table(spark, sf_dir, "lineitem"), a, "l_quantity")
    )
    query(
        f"A04_{_agg}_by_group",
        f"""SELECT l_suppkey, {_agg}(l_quantity) AS {_word}_l_quantity FROM lineitem GROUP BY 1
        ORDER BY 2 DESC NULLS LAST, 1 LIMIT 100""",
    )(lambda spark, sf_dir, a=_agg: ask(table(spark, sf_dir, "lineitem"), a, "l_quantity", "l_suppkey"))


@query("A05_top_orders", "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5")
def top(spark, sf_dir):
    return ask(table(spark, sf_dir, "orders"), "top", "o_totalprice", tie_break=["o_orderkey"])


@query("A05_top_25_events", "SELECT * FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
def top_events(spark, sf_dir):
    return ask(table(spark, sf_dir, "events"), "top", "value", limit=25, tie_break=["event_id"])


@query("A06_show", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50")
def show(spark, sf_dir):
    return ask(table(spark, sf_dir, "customer"), "show", tie_break=["c_custkey"])


@query(
    "A07_filter_text",
    "SELECT l_linestatus, count(*) AS count FROM lineitem WHERE lower(l_returnflag) = 'a' GROUP BY 1",
)
def filter_text(spark, sf_dir):
    return ask(table(spark, sf_dir, "lineitem"), "count", group="l_linestatus", where=("l_returnflag", "a"))


@query("A07_filter_number", "SELECT max(l_extendedprice) AS maximum_l_extendedprice FROM lineitem WHERE l_quantity = 17")
def filter_number(spark, sf_dir):
    return ask(table(spark, sf_dir, "lineitem"), "max", "l_extendedprice", where=("l_quantity", "17"))


_SUPPLIER = [
    {"name": "s_suppkey", "inferred_type": "integer", "role": "key"},
    {"name": "s_name", "inferred_type": "string", "role": "default"},
    {"name": "s_acctbal", "inferred_type": "float", "role": "default"},
]


@query("A08_default_measure", "SELECT max(s_acctbal) AS maximum_s_acctbal FROM supplier")
def default_measure(spark, sf_dir):
    return ask(table(spark, sf_dir, "supplier").drop("s_nationkey"), "max", schema=_SUPPLIER)


@query("A11_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200")
def first_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS _ord", "*")
    return preview(df, 10_000)


@query(
    "A12_short_preview",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, '') AS event_type
    FROM events ORDER BY events.event_id LIMIT 8""",
)
def short(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id AS _ord", "event_id", "CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type"
    )
    return short_preview(df)
