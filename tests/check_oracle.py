"""Run registered queries against their oracle SQL: python tests/check_oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(norm(r[k]) for k in order) for r in rows], key=repr), sorted(names)


def compare(spark, con, folder, name, build, sql):
    """None when equal, else a description of the first difference."""
    df = build(spark, folder)
    got, names = as_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, onames = as_rows([d[0] for d in cur.description], cur.fetchall())
    if names != onames:
        return f"columns {names} vs {onames}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first only-spark {next((g for g in got if g not in set(want)), None)!r:.600}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g!r:.600}\n    vs {w!r:.600}"
        if [type(x) for x in g if x is not None] != [type(x) for x in w if x is not None]:
            return f"types {g!r:.300} vs {w!r:.300}"
    return None


def main():
    from pyspark.sql import SparkSession
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, build in E.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        sql = E.oracle_sql().get(name)
        try:
            if sql is None:
                n = build(spark, folder).count()
                res, note = None, f"rows only: {n}"
            else:
                res, note = compare(spark, con, folder, name, build, sql), ""
        except Exception as e:  # report and go on
            res, note = f"{type(e).__name__}: {str(e)[:900]}", ""
        bad += res is not None
        print(f"{'ok ' if res is None else 'BAD'} {name} {time.time() - t:.1f}s {note} {res or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
