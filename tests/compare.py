"""Run registered queries and their SQL twins over the same tables and compare them as multisets."""

import math
import os
import sys
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def same_type(spark_type, sql_type):
    return SAME.get(spark_type, sql_type) == sql_type


def compare(spark, sf_dir, con, name, build, sql):
    """None if equal, else a description of the difference."""
    df = build(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} vs {sorted(cols)}"
    kinds = {d[0]: str(d[1]).upper() for d in cur.description}
    odd = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in df.schema if not same_type(f.dataType.simpleString(), kinds[f.name])}
    if odd:
        return f"types {odd}"
    a, b = as_bag(got_cols, got), as_bag(cols, want)
    if a != b:
        return f"{len(got)} vs {len(want)} rows; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"
    return None if got else "no rows"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    names = sys.argv[2:] or list(e.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            diff = compare(spark, sf, con, n, e.queries()[n], e.oracle_sql().get(n))
        except Exception as x:
            diff = f"{type(x).__name__}: {str(x)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {n} {time.time() - t:.1f}s{' (no sql)' if n not in e.oracle_sql() else ''} {diff or ''}", flush=True)
    print("failed:", bad, "of", len(names))
