"""Compare registered queries with their SQL on the second engine.

Usage: python tests/oracle_check.py [sf] [name ...]
"""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, decimal.Decimal)) and value == int(value):
        return str(int(value))
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return "NaN"
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
         "timestamp": "TIMESTAMP", "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]"}


def compare(spark, con, folder, name, queries, oracles):
    start = time.time()
    frame = queries[name](spark, folder)
    rows = frame.collect()
    seconds = time.time() - start
    got = canonical(frame.columns, [tuple(r) for r in rows])
    if name not in oracles:
        return seconds, len(rows), None, "rows only"
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = canonical(columns, result.fetchall())
    note = ""
    odd = {f: (t, types.get(f)) for f, t in frame.dtypes if KINDS.get(t, t) != types.get(f)}
    if odd:
        note = f" types {odd}"
    if got[0] != want[0]:
        return seconds, len(rows), False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        missing = [r for r in want[1] if r not in set(got[1])][:2]
        return seconds, len(rows), False, f"rows {len(got[1])} vs {len(want[1])}; spark {extra}; sql {missing}{note}"
    return seconds, len(rows), True, note


def session(cpus=8, partitions=8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry
    folder = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con = session(), connect(folder)
    if os.environ.get("ROWS_PER_BUCKET"):       # force the bucketed paths on small data
        spark.conf.set("gaugeframe.rowsPerBucket", os.environ["ROWS_PER_BUCKET"])
    bad = 0
    for name in names:
        try:
            seconds, rows, same, note = compare(spark, con, folder, name, queries, oracles)
        except Exception as error:
            seconds, rows, same, note = 0, 0, False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += same is False
        print(f"{'ok  ' if same else 'rows' if same is None else 'BAD '} {name:28s} {seconds:6.2f}s {rows:6d} {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
