"""Runs a Spark query and its oracle SQL on the same tables and compares them.

Also a script: python tests/oracle_check.py sf0.01 [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, dict(df.dtypes), sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    cols = [rel.columns[i] for i in order]
    types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    return cols, types, sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())


SAME = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def differences(df, con, sql) -> list[str]:
    """Empty when columns, types and rows agree."""
    sc, st, sr = spark_rows(df)
    dc, dt, dr = duck_rows(con, sql)
    if sc != dc:
        return [f"columns {sc} vs {dc}"]
    out = [f"type of {c}: {st[c]} vs {dt[c]}" for c in sc if SAME.get(st[c]) != dt[c]]
    if len(sr) != len(dr):
        out.append(f"rows {len(sr)} vs {len(dr)}")
    if sr != dr:
        a, b = set(sr), set(dr)
        out.append(f"{len(a - b)} rows only in Spark, {len(b - a)} only in SQL; columns {sc}")
        out += [f"  spark {x}" for x in sorted(a - b)[:3]] + [f"  sql   {x}" for x in sorted(b - a)[:3]]
    return out


def session(app: str = "tierwise-check"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.codegen.cache.maxEntries", "5000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.files.openCostInBytes", "1048576")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "67108864")
        .getOrCreate()
    )


def main() -> None:
    import __spark_entry__ as e

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    queries, oracle = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            n = df.count() if name not in oracle else None
            t1 = time.time() - t
            problems = [] if name not in oracle else differences(df, con, oracle[name])
        except Exception as ex:  # report and go on
            t1, n, problems = 0, None, [f"{type(ex).__name__}: {str(ex)[:1500]}"]
        bad += bool(problems)
        state = "BAD " if problems else ("ok  " if name in oracle else f"rows {n}")
        print(f"{state} {name} {time.time() - t:.1f}s", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
