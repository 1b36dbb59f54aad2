"""Run named queries beside their SQL: `python tests/side_by_side.py [folder] [prefix ...]`."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value.normalize()))
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def order_key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    return names, sorted((tuple(plain(v) for v in r) for r in rows), key=order_key)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=order_key)


def differences(left, right):
    (ln, lr), (rn, rr) = left, right
    if ln != rn:
        return f"columns {ln} != {rn}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} != {len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(lr)} rows differ, first {bad[0][0]} != {bad[0][1]}"
    return None


def main():
    from ledgerloom import plans
    from ledgerloom.plans import registry
    from ledgerloom.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    plans.load()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, fn in registry.QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, folder))
            took = time.time() - start
            if name in registry.ORACLES:
                problem = differences(got, sql_rows(con, registry.ORACLES[name]))
            else:
                problem = None if got[1] else "no rows"
        except Exception as error:  # the report goes on with the next query
            took = time.time() - start
            got = ([], [])
            problem = "ERROR " + str(error)[:1500]
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(got[1])} {took:.1f}s {'' if name in registry.ORACLES else '(rows only)'} {problem or ''}", flush=True)
    print(f"failed: {failed}")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
