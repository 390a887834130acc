"""Compare registered queries with their SQL on one data folder: python tests/oracle.py SF NAME..."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def run_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def differences(spark, name, query, sql, sf_dir):
    """None if both give the same columns and rows, else a short account."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = run_sql(sql, sf_dir)
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"{len(mine[1])} rows against {len(theirs[1])}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    known, sqls = entry.queries(), entry.oracle_sql()
    for name in names or known:
        t = time.time()
        try:
            if name in sqls:
                said = differences(spark, name, known[name], sqls[name], f"/root/testdata/{sf}") or "equal"
            else:
                said = f"no SQL, {known[name](spark, f'/root/testdata/{sf}').count()} rows"
        except Exception as e:
            said = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
