from __future__ import annotations

import os
import subprocess
import sys

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from check import rows_of
from sluice.llm import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_queries_match_their_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        cursor = db.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{place}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        assert rows
        if name == "best-fit packing":
            break
        assert docs.columns == COLUMNS
        assert {r.doc_id for r in rows} <= before.keys()
        if name == "quality classifier":
            left = {r.doc_id for r in rows}
            clean = {i for i, x in labels.items() if x.quality == 1 and x.toxic == 0}
            assert len(left & clean) >= 0.97 * len(clean)
            assert len(left & {i for i, x in labels.items() if x.quality == 0}) <= 2
        elif name == "line dedup":
            assert all(set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n")) and r.n_chars == len(r.text) for r in rows)
        elif name == "simhash near-dedup":
            assert len({r.doc_id for r in rows}) == len(rows)
        if name != "source mixing":
            before = {r.doc_id: r for r in rows}
    assert sum(r.piece == 0 for r in rows) >= len(before) / 2


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, labelled ones too, repeated rows, null ids and clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").orderBy("doc_id").limit(3).collect()]
    odd = F.when(F.col("doc_id") == known[0], F.lit(None)).when(F.col("doc_id") == known[1], "").when(F.col("doc_id") == known[2], "... !!!").otherwise(F.col("text"))
    docs = docs.withColumn("text", odd.cast("string"))
    more = docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(20)).union(docs.limit(1).withColumn("text", F.repeat(F.lit("long text. "), 100_000)))
    names = ["lines", "_lines", "removed", "_removed", "__host", "site", "row", "copies", "h", "key", "place", "id"]
    docs = docs.union(more).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for case, rows in (("odd", docs), ("empty", docs.limit(0))):
        kept = rows
        for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{case}-{place}"
            stage(spark, kept, SF).write.parquet(path)
            before, kept = kept, spark.read.parquet(path)
            if name != "best-fit packing":
                assert kept.columns == docs.columns
                ids = {r.doc_id for r in kept.select("doc_id").distinct().collect()}
                assert ids <= {r.doc_id for r in before.select("doc_id").distinct().collect()}
        assert (kept.count() > 0) == (case == "odd")


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline the entry still has all other queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    hide = "import sys; sys.modules['corpus_pipeline'] = sys.modules['sluice.llm'] = None; import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", hide], cwd=root, capture_output=True, text=True)
    assert said.stdout.strip() == "0 False", said.stderr
