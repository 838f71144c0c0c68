"""Compares queries with their SQL twins the way the driver does.

Usage: python tests/check.py [name-prefix ...]   (CHECK_SF selects the scale factor)
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def oracle(con, sql):
    cur = con.execute(sql)
    return normal_rows([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return normal_rows(df.columns, [tuple(r) for r in df.collect()])


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main(prefixes):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{os.environ.get('CHECK_SF', '0.01')}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            names, rows = spark_rows(build(spark, folder))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:600]}")
            continue
        took = time.time() - start
        if name not in sqls:
            print(f"ROWS {name}: {len(rows)} rows {took:.2f}s")
            continue
        try:
            onames, orows = oracle(con, sqls[name])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: sql {str(e)[:600]}")
            continue
        if names != onames:
            bad += 1
            print(f"FAIL {name}: columns {names} vs {onames}")
        elif rows != orows:
            bad += 1
            diff = [r for r in rows if r not in set(orows)][:2], [r for r in orows if r not in set(rows)][:2]
            print(f"FAIL {name}: {len(rows)} vs {len(orows)} rows; spark {diff[0]} sql {diff[1]}")
        else:
            print(f"{'ok  ' if rows else 'EMPTY'} {name}: {len(rows)} rows {took:.2f}s")
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
