"""Compare queries with their SQL in DuckDB: python tests/oracle.py [--sf DIR] [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "" if value is None else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple((v is None, canon(v)) for v in (r[i] for i in order)) for r in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{name}: {len(got[1])} and {len(want[1])} rows; only Spark {list(a - b)[:3]}; only SQL {list(b - a)[:3]}"
    return None if got[1] else f"{name}: no rows"


def main(args):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name, query in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        sql = e.oracle_sql().get(name)
        try:
            why = compare(spark, con, sf, name, query, sql) if sql else f"(no SQL) {query(spark, sf).count()} rows"
        except Exception as x:  # report and go on
            why = f"{name}: {type(x).__name__} {str(x)[:600]}"
        bad += bool(why and sql)
        print(f"{name}: {'ok' if why is None else why} {time.time() - t:.1f}s", flush=True)
    print("differing:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
