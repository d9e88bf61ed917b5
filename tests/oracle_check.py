"""Run registered queries next to their SQL in DuckDB and compare the results.

``python tests/oracle_check.py [sf] [name ...]``
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if value != value else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, sf_dir):
    import __spark_entry__ as entry

    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - start
    text = entry.oracle_sql().get(name)
    if text is None:
        return True, f"rows={len(got[1])} spark={spark_s:.2f}s no SQL"
    start = time.time()
    cursor = con.execute(text)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    duck_s = time.time() - start
    note = f"rows={len(got[1])}/{len(want[1])} spark={spark_s:.2f}s duck={duck_s:.2f}s"
    if got[0] != want[0]:
        return False, f"{note} columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return False, (f"{note} differ: {len(extra)} extra, {len(missing)} missing\n"
                       f"   spark {sorted(extra, key=repr)[:3]}\n   duck  {sorted(missing, key=repr)[:3]}"[:1800])
    return True, note


def main():
    from corrag.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), []
    for name in sys.argv[2:] or entry.queries():
        try:
            good, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report every query, then fail at the end
            good, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("OK  " if good else "FAIL", name, note, flush=True)
        if not good:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
