from __future__ import annotations

import pytest

from queries import QUERIES, edge_queries
from queries.edge_queries import _cut_off

SF = "/root/testdata/sf0.01"
SPREAD = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def spread(spark):
    for key, value in SPREAD.items():
        spark.conf.set(key, value)
    yield spark
    for key in SPREAD:
        spark.conf.unset(key)


def test_plain_frames_have_many_partitions(spread, monkeypatch):
    assert _cut_off(spread, SF).rdd.getNumPartitions() > 1
    seen = []

    class Stopped(Exception):
        pass

    class Gate:
        def run_table(self, df, *_):
            seen.append(df.rdd.getNumPartitions())
            raise Stopped

    monkeypatch.setattr(edge_queries, "_gate", lambda spark: Gate())
    with pytest.raises(Stopped):
        QUERIES["Q14_residual_tail"](spread, SF)
    assert seen[0] > 1


def test_csv_folder_has_many_files(spark, monkeypatch):
    paths = []
    read = edge_queries.read_csv
    monkeypatch.setattr(edge_queries, "read_csv", lambda spark, path, **more: paths.append(path) or read(spark, path, **more))
    rows = QUERIES["S01_csv_directory"](spark, SF).orderBy("_ord").collect()
    assert len(spark.read.format("binaryFile").load(f"{paths[0]}/*.csv").select("path").collect()) > 2
    assert [int(r.s_suppkey) for r in rows] == sorted(int(r.s_suppkey) for r in rows)
