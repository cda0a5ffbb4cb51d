"""Compare registered queries with their SQL: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if value is not None and hasattr(value, "isoformat"):
        return str(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, directory, names=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    oracle, failures = contract.oracle_sql(), []
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = query(spark, directory)
            got = df.collect()
            spent = time.time() - started
            if name not in oracle:
                print(f"ROWS {name} {len(got)} {spent:.1f}s", flush=True)
                continue
            started = time.time()
            result = con.execute(oracle[name])
            columns = [d[0] for d in result.description]
            want = result.fetchall()
            wanted = time.time() - started
            a, b = rows(df.columns, got), rows(columns, want)
            same = sorted(df.columns) == sorted(columns) and a == b
            print(f"{'ok  ' if same else 'FAIL'} {name} {len(got)}/{len(want)} spark {spent:.1f}s sql {wanted:.1f}s", flush=True)
            if not same:
                failures.append(name)
                print("   columns", sorted(df.columns), sorted(columns))
                print("   only spark", list((a - b).items())[:3])
                print("   only sql  ", list((b - a).items())[:3])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            failures.append(name)
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    return failures


if __name__ == "__main__":
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    failed = compare(session, f"/root/testdata/sf{scale}", sys.argv[2:])
    print("failures:", failed)
    sys.exit(bool(failed))
