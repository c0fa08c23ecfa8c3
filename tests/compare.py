"""Run queries against their SQL twins: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    """Rows as sorted tuples with the columns in name order."""
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in place) for r in rows), key=repr)


def compare(spark, con, folder, query, oracle):
    """None when both agree, else a short report."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} <> {len(want)} rows\n    spark: {only_got}\n    sql:   {only_want}"
    return None if got else "no rows"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from callytics.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            report = compare(spark, con, folder, query, oracles[name]) if name in oracles else "no oracle"
        except Exception as error:  # noqa: BLE001
            report = f"{type(error).__name__}: {str(error)[:700]}"
        bad += report is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {report or 'ok'}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
