"""Run registered queries beside their SQL and compare: check.py [sf_dir] [name part ...]."""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

import queries as registered


def normal(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(normal(row[i]) for i in order) for row in rows], key=repr)


def main(sf_dir="/root/testdata/sf0.01", *parts):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name, function in registered.QUERIES.items():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            mine = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in registered.ORACLES:
                print(f"rows  {name} {len(mine)} {took:.1f}s", flush=True)
                continue
            cursor = db.execute(registered.ORACLES[name])
            names = [d[0] for d in cursor.description]
            theirs = rows_of(names, cursor.fetchall())
            same = sorted(names) == sorted(df.columns) and mine == theirs
            print(f"{'ok   ' if same else 'DIFF '} {name} {len(mine)} {took:.1f}s", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(df.columns), sorted(names), len(mine), len(theirs))
                print("   only spark", [r for r in mine if r not in theirs[:5000]][:6])
                print("   only sql  ", [r for r in theirs if r not in mine[:5000]][:6])
        except Exception:
            bad += 1
            print(f"ERROR {name}\n{traceback.format_exc()[-1800:]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
