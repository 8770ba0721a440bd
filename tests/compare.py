"""Run named queries and their SQL side by side: `python tests/compare.py [folder] [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]",
    "date": "DATE", "array<float>": "FLOAT[]", "smallint": "SMALLINT",
}


def compare(df, con, sql):
    """None when rows and schema agree, else what differs."""
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    theirs = normal(result.columns, result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_types = {n: str(t) for n, t in zip(result.columns, result.types)}
    if spark_types != duck_types:
        return f"types {[(n, spark_types[n], duck_types[n]) for n in spark_types if spark_types[n] != duck_types[n]]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}: {ours[1][:2]} / {theirs[1][:2]}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from lakekit.session import get_spark

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_spark(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            df = query(spark, folder)
            problem = compare(df, con, sql[name]) if name in sql else None
            count = df.count() if name not in sql else ""
        except Exception as error:
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - began:.1f}s {'' if name in sql else f'no sql, rows {count}'} {problem or ''}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
