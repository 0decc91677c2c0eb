"""Cases at the edge of the rules, made from the given tables: precision, ties, positions, replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.gate_queries import _gate
from queries.registry import query, table
from queries.source_queries import _scratch
from sluice import Source
from sluice.errors import GateError
from sluice.operators import history
from sluice.operators.ask import ask, where_equals
from sluice.operators.inspection import Inspection
from sluice.operators.spellings import top_values
from sluice.sources.readers import read_csv, read_json
from sluice.streaming.gated import gate_stream
from sluice.streaming.keys import count_keys, repeated_keys

_WIDE = "12345678901234567"  # more digits than a double has
_FILE_ROWS = 1_000_000  # rows of one written file, which a task may have to read whole


@query(
    "P05_unique_decimal",
    f"SELECT count(DISTINCT CAST({_WIDE} AS DECIMAL(25, 2)) + CAST(o_totalprice AS DECIMAL(25, 2))) AS unique_count FROM orders",
)
def unique_decimal(spark, sf_dir):
    price = (F.lit(_WIDE).cast("decimal(25,2)") + F.col("o_totalprice").cast("decimal(25,2)")).alias("amount")
    with Inspection(table(spark, sf_dir, "orders").select(price)) as inspection:
        return spark.createDataFrame([(inspection.distinct["amount"],)], "unique_count bigint")


@query("P09_quartiles_tiny_range", "SELECT 0::DOUBLE AS q1, 0::DOUBLE AS q2, 4.9E-324::DOUBLE AS q3, count(*) AS n FROM lineitem")
def tiny_range(spark, sf_dir):
    """Three numbers in ten are the smallest double there is, the others zero."""
    x = F.when(F.col("l_orderkey") % 10 < 3, F.lit(5e-324)).otherwise(F.lit(0.0)).alias("x")
    rows = table(spark, sf_dir, "lineitem").select(x)
    with Inspection(rows) as inspection:
        q1, q2, q3 = inspection.quartiles["x"]
        return spark.createDataFrame([(q1, q2, q3, inspection.rows)], "q1 double, q2 double, q3 double, n bigint")


@query(
    "P10_histogram_long_numbers",
    """WITH x AS (SELECT o_custkey % 19 AS x FROM orders), r AS (SELECT min(x) AS low, max(x) AS high FROM x)
    SELECT least(cast(floor((x - low) / ((high - low) / 8.0)) AS BIGINT), 7) AS bucket, count(*) AS n FROM x, r GROUP BY 1""",
)
def long_numbers(spark, sf_dir):
    """Numbers written with 250 zeros before them."""
    text = F.concat(F.repeat(F.lit("0"), 250), (F.col("o_custkey") % 19).cast("string")).alias("x")
    with Inspection(table(spark, sf_dir, "orders").select(text)) as inspection:
        buckets = list(enumerate(inspection.histograms["x"].buckets))
    return spark.createDataFrame(buckets, "bucket bigint, n bigint").filter("n > 0")


@query(
    "P11_top_values_common_head",
    """WITH v AS (SELECT CASE WHEN page_id % 2 = 0 THEN repeat('z', 300) || (page_id % 7) ELSE repeat('z', 64) || 'a' || (page_id % 5) END AS value FROM pages)
    SELECT place, value, n FROM (SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) AS place FROM v GROUP BY value) WHERE place <= 8""",
)
def common_head(spark, sf_dir):
    """Long and short texts that begin alike: whole texts decide."""
    z = lambda n: F.repeat(F.lit("z"), n)
    even = F.concat(z(300), (F.col("page_id") % 7).cast("string"))
    odd = F.concat(z(64), F.lit("a"), (F.col("page_id") % 5).cast("string"))
    df = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, even).otherwise(odd).alias("value"))
    with Inspection(df) as inspection:
        rows = top_values(inspection.df, inspection.cells, inspection.tokens).select("place", "value", "n").collect()
    return spark.createDataFrame([(r.place, r.value, r.n) for r in rows], "place bigint, value string, n bigint")


@query("A07_filter_bigint", "SELECT count(*) AS n FROM events WHERE user_id + 9007199254740992 = (SELECT min(user_id) + 9007199254740992 FROM events)")
def filter_bigint(spark, sf_dir):
    """Ids beyond the precision of a double."""
    df = table(spark, sf_dir, "events").select((F.col("user_id") + F.lit(9007199254740992)).alias("id"))
    least = df.agg(F.min("id")).first()[0]
    return where_equals(df, "id", str(least)).agg(F.count(F.lit(1)).alias("n"))


@query("A02_count_by_all_groups", "SELECT user_id, count(*) AS count FROM events GROUP BY 1")
def all_groups(spark, sf_dir):
    return ask(table(spark, sf_dir, "events"), "count", group="user_id", limit="all")


@query("A04_sum_by_all_groups", "SELECT l_partkey, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1")
def all_sums(spark, sf_dir):
    return ask(table(spark, sf_dir, "lineitem"), "sum", "l_quantity", group="l_partkey", limit="all")


@query(
    "A13_refusals",
    """SELECT * FROM (VALUES ('nothing asked', NULL), ('unknown column', NULL), ('no measure', NULL)) AS t(question, answer)
    UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE) FROM orders UNION ALL SELECT 'total', sum(o_totalprice) FROM orders""",
)
def refusals(spark, sf_dir):
    """Questions without an answer are refused; the others are answered."""
    orders, answers = table(spark, sf_dir, "orders"), []
    asked = {
        "nothing asked": {}, "unknown column": {"agg": "count", "group": "nowhere"}, "no measure": {"agg": "sum"},
        "rows": {"agg": "count"}, "total": {"agg": "sum", "measure": "o_totalprice"},
    }
    for name, question in asked.items():
        try:
            answers.append((name, float(ask(orders, **question).first()[0])))
        except GateError:
            answers.append((name, None))
    return spark.createDataFrame(answers, "question string, answer double")


def _cut_off(spark, sf_dir):
    """Orders whose last tenth has no price, as a plain frame."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    price = F.when(F.col("o_orderkey") <= last * 0.9, F.col("o_totalprice")).alias("o_totalprice")
    return orders.select("o_orderkey", price).orderBy("o_orderkey")


_CUT_OFF = """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey <= (SELECT max(o_orderkey) FROM orders) * 0.9 THEN o_totalprice END AS price,
      row_number() OVER (ORDER BY o_orderkey) - 1 AS _ord FROM orders)"""


@query(
    "Q14_positions_plain_frame",
    f"{_CUT_OFF} SELECT _ord AS place FROM t WHERE price IS NULL ORDER BY 1 LIMIT 40",
)
def positions_of_a_plain_frame(spark, sf_dir):
    outcome = _gate(spark).run_table(_cut_off(spark, sf_dir), Source("sql", name="orders"))
    (missing,) = [issue for issue in outcome.audit.issues if issue.issue_type == "missing_values"]
    return spark.createDataFrame([(place,) for place in missing.positions], "place bigint")


@query(
    "X02_truncated_plain_frame",
    f"""{_CUT_OFF} SELECT round(avg(CASE WHEN _ord >= 0.8 * (SELECT count(*) FROM t) THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS tail_ratio,
    'truncated_extract' AS category FROM t WHERE price IS NULL""",
)
def truncated_plain_frame(spark, sf_dir):
    outcome = _gate(spark).run_table(_cut_off(spark, sf_dir), Source("sql", name="orders"))
    (missing,) = [issue for issue in outcome.audit.issues if issue.issue_type == "missing_values"]
    (cause,) = [cause for cause in outcome.audit.causes if cause.issue_id == missing.id]
    return spark.createDataFrame([(missing.evidence["tail_ratio"], cause.category)], "tail_ratio double, category string")


@query(
    "Q14_residual_tail",
    """WITH t AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _ord, c_custkey FROM customer), n AS (SELECT count(*) AS n FROM t)
    SELECT round(avg(CASE WHEN _ord >= 0.8 * 2 * n THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS tail_ratio FROM t, n WHERE c_custkey % 7 = 0""",
)
def residual_tail(spark, sf_dir):
    """Every customer twice, one copy after the other; what is missing lies in the first half of the extract."""
    once = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"))
    twice = once.withColumn("half", F.lit(0)).unionByName(once.withColumn("half", F.lit(1)))
    outcome = _gate(spark).run_table(twice.orderBy("half", "c_custkey").drop("half"), Source("sql", name="customer"))
    (missing,) = [issue for issue in outcome.audit.residual if issue.issue_type == "missing_values"]
    return spark.createDataFrame([(missing.evidence["tail_ratio"],)], "tail_ratio double")


@query(
    "K02_V09_run_decide_run_again",
    "SELECT 'pending' AS status, 1::BIGINT AS events, 1::BIGINT AS runs FROM nation GROUP BY 1 UNION ALL SELECT 'rejected', 1, 1 FROM nation GROUP BY 1",
)
def decide_and_replay(spark, sf_dir):
    """A decided review stays decided, and a run is recorded once, when the run is repeated under its id."""
    gate, extract = _gate(spark), table(spark, sf_dir, "events")
    held = gate.run_table(extract, Source("sql", name="events"), "r1", detail=False)
    gate.reject(held.review_id)
    gate.run_table(extract, Source("sql", name="events"), "r1", detail=False)
    runs = gate.store.records("runs").count()
    events = gate.store.records("review_events").groupBy("status").agg(F.count(F.lit(1)).alias("events"))
    return events.withColumn("runs", F.lit(runs).cast("bigint"))


@query(
    "H02_A10_chosen_dataset",
    """SELECT 'by id' AS choice, 'supplier' AS display_name, count(*) AS row_count FROM supplier UNION ALL
    SELECT 'mentioned', 'labels', count(*) FROM labels UNION ALL SELECT 'newest', 'labels', count(*) FROM labels""",
)
def chosen_dataset(spark, sf_dir):
    gate = _gate(spark)
    for name in ("supplier", "labels"):
        gate.run_table(table(spark, sf_dir, name), Source("parquet", name=name), name, detail=False)
    datasets = gate.store.records("datasets")
    chosen = {
        "by id": history.by_id(datasets, "supplier"),
        "mentioned": history.choose_dataset(datasets, "how many labels are there"),
        "newest": history.choose_dataset(datasets),
    }
    rows = [(choice, row.display_name, row.row_count) for choice, found in chosen.items() for row in found.collect()]
    return spark.createDataFrame(rows, "choice string, display_name string, row_count bigint")


@query("S01_csv_directory", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _ord, * FROM supplier")
def csv_directory(spark, sf_dir):
    """Files of very different sizes: rows come in order of file name and place."""
    path, suppliers = _scratch(spark, "csv"), table(spark, sf_dir, "supplier").orderBy("s_suppkey")
    suppliers.filter("s_suppkey <= 3").write.csv(f"{path}/a", header=True)
    suppliers.filter("s_suppkey > 3").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey").write.csv(f"{path}/b", header=True)
    return read_csv(spark, f"{path}/*", multiline=False).withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


@query(
    "S08_refused_headers",
    "SELECT 'equal' AS headers, count(*) AS rows FROM orders UNION ALL SELECT 'in another order', NULL",
)
def refused_headers(spark, sf_dir):
    """Files with the same columns in another order are not read by place."""
    orders, found = table(spark, sf_dir, "orders"), []
    even, odd = orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1")
    for headers, rest in (("equal", odd), ("in another order", odd.select(*reversed(odd.columns)))):
        path = _scratch(spark, "csv")
        for name, part in (("a", even), ("b", rest)):  # one task reads a file, however large
            part.write.option("maxRecordsPerFile", _FILE_ROWS).csv(f"{path}/{name}", header=True)
        try:
            found.append((headers, read_csv(spark, f"{path}/*").count()))
        except GateError:
            found.append((headers, None))
    return spark.createDataFrame(found, "headers string, rows bigint")


@query(
    "S08_empty_sources",
    """WITH s(o_orderstatus) AS (VALUES ('F'), ('O'), ('P'), ('none'), ('no columns'))
    SELECT o_orderstatus AS extract, nullif(count(o_orderkey), 0) AS rows FROM s LEFT JOIN orders USING (o_orderstatus) GROUP BY 1""",
)
def empty_sources(spark, sf_dir):
    """Extracts without a row or a column are refused, the others go through the gate."""
    gate, orders, found = _gate(spark), table(spark, sf_dir, "orders"), []
    extracts = {status: orders.filter(F.col("o_orderstatus") == status) for status in ("F", "O", "P", "none")}
    for name, extract in (extracts | {"no columns": orders.select()}).items():
        try:
            found.append((name, gate.run_table(extract, Source("sql", name=name), detail=False).audit.rows_before))
        except GateError:
            found.append((name, None))
    return spark.createDataFrame(found, "extract string, rows bigint")


@query("S02_json_document", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def json_document(spark, sf_dir):
    """Envelopes: a document for each nation, with the list of its customers."""
    path = _scratch(spark, "json")
    customers = table(spark, sf_dir, "customer").select("c_nationkey", F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment").alias("x"))
    whole = customers.groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit(200).alias("status"), F.collect_list("x").alias("items"))).alias("value"))
    whole.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return read_json(spark, f"{path}/*").drop("_ord")


@query(
    "S10_stored_columns",
    " UNION ALL ".join(
        f"""SELECT '{safe}' AS name, '{name}' AS original_name, '{kind}' AS source_type, {str(safe != name).lower()} AS renamed,
        (SELECT string_agg(x, '|' ORDER BY k) FROM (SELECT o_orderkey AS k, {shown} AS x FROM orders ORDER BY o_orderkey LIMIT 3)) AS examples"""
        for safe, name, kind, shown in (
            ("order_key", "Order Key", "bigint", "CAST(o_orderkey AS VARCHAR)"),
            ("o_custkey", "o_custkey", "bigint", "CAST(o_custkey AS VARCHAR)"),
            ("o_orderstatus", "o_orderstatus", "string", "o_orderstatus"),
            ("o_totalprice", "o_totalprice", "double", "CAST(o_totalprice AS VARCHAR)"),
            ("o_orderdate", "o_orderdate", "date", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
            ("order_priority", "Order-Priority", "string", "o_orderpriority"),
        )
    ),
)
def stored_columns(spark, sf_dir):
    """Original names, types and first values of every column stay with the run."""
    gate = _gate(spark)
    df = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    df = df.withColumn("_ord", F.col("o_orderkey")).withColumnsRenamed({"o_orderkey": "Order Key", "o_orderpriority": "Order-Priority"})
    gate.run_table(df, Source("sql", name="orders"), "r1")
    shown = F.concat_ws("|", "examples").alias("examples")
    return gate.store.records("columns").select("name", "original_name", "source_type", "renamed", shown)


@query(
    "E01_stream_publishes_batches",
    "SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
)
def stream_publishes(spark, sf_dir):
    """A folder of files as a stream: each of two micro-batches is an extract, and what is published adds up to the table."""
    gate, path = _gate(spark), _scratch(spark, "stream")
    lines = table(spark, sf_dir, "lineitem")
    files = 2 * (lines.count() // (2 * _FILE_ROWS) + 1)
    lines.repartitionByRange(files, "l_orderkey").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{path}/in")
    for _ in range(2):  # the second time there is nothing new
        gate_stream(stream, gate, "lines", f"{path}/checkpoint", detail=False, availableNow=True).awaitTermination()
    whole = None
    for row in gate.store.records("datasets").collect():  # one row a batch
        rows = gate.store.dataset(row.id)
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("E01_stream_repeated_keys", "SELECT user_id AS key, count(*) AS rows FROM events GROUP BY 1 HAVING count(*) > 1")
def stream_repeated_keys(spark, sf_dir):
    """Keys that come again, whichever micro-batches their rows are in, from state that a restart goes on with."""
    path, events = _scratch(spark, "stream"), table(spark, sf_dir, "events")
    events.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for _ in range(2):
        count_keys(stream, "user_id", path, availableNow=True).awaitTermination()
    return repeated_keys(spark, path).select("key", "rows")


@query(
    "E02_alias_table",
    """SELECT c_custkey, c_name, n_name AS nation, c_acctbal, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def alias_table(spark, sf_dir):
    """Nations written in three ways get their names back by an alias table made from ``nation``, kept with the run."""
    gate, nation = _gate(spark), table(spark, sf_dir, "nation")
    code = F.concat(F.lit("N-"), F.col("n_nationkey").cast("string"))
    version = gate.save_aliases(nation.select(code.alias("alias"), F.col("n_name").alias("name")).union(nation.select("n_name", "n_name")))
    written_as = F.when(F.col("c_custkey") % 3 == 0, F.lower(code)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.col("n_name"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.select("c_custkey", "c_name", written_as.alias("nation"), "c_acctbal", "c_mktsegment")
    outcome = gate.run_table(customers, Source("sql", name="customers"), detail=False, aliases={"nation": version})
    return gate.store.dataset(outcome.dataset_id).drop("_ord")


@query(
    "K04_compacted_log",
    """SELECT 'issues' AS kind, count(DISTINCT user_id) * 0 + 2 AS records FROM events UNION ALL
    SELECT 'runs', 2 FROM events GROUP BY 1 UNION ALL SELECT 'rows', count(*) FROM events UNION ALL SELECT 'again', count(*) FROM events""",
)
def compacted(spark, sf_dir):
    """The log says the same after it is put together, and a run that is repeated then replaces what it said."""
    gate, events = _gate(spark), table(spark, sf_dir, "events").select("event_id", "user_id")
    for name in ("first", "second"):
        gate.run_table(events, Source("sql", name=name), name, detail=False)
    gate.store.compact()
    gate.run_table(events, Source("sql", name="second"), "second", detail=False)
    runs = gate.store.records("runs")
    issues = gate.store.records("issues").filter("stage = 'before'").count()
    before = {row.run_id: row.rows_before for row in runs.collect()}
    rows = [("issues", issues), ("runs", runs.count()), ("rows", before["first"]), ("again", before["second"])]
    return spark.createDataFrame(rows, "kind string, records bigint")
