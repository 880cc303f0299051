"""Compare registered queries with their DuckDB SQL: python tests/oracle_check.py [sf] [name-part ...]"""

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import datetime as dt
import decimal

import duckdb

import __spark_entry__ as entry
from tarnwatch.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6f}" if v != 0 else f"{0.0:.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return "rows-only", took, f"{len(got[1])} rows"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for tbl in TABLES:
        con.execute(f"CREATE VIEW {tbl} AS SELECT * FROM '{sf_dir}/{tbl}.parquet'")
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "SCHEMA", took, f"{got[0]} vs {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return "DIFF", took, (f"{len(got[1])} vs {len(want[1])} rows\n     cols  {got[0]}\n"
                              f"     spark {sorted(a - b)[:3]}\n     duck  {sorted(b - a)[:3]}")
    if not got[1]:
        return "EMPTY", took, ""
    return "ok", took, f"{len(got[1])} rows"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    spark = build_session("oracle", master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                          "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            status, took, note = compare(spark, f"/root/testdata/sf{sf}", name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            status, took, note = "ERROR", 0.0, str(e)[:1500]
        if status not in ("ok", "rows-only"):
            bad.append(name)
        print(f"{status:10s} {took:6.1f}s {name}: {note}", flush=True)
    print("extra oracle keys:", sorted(set(oracle) - set(queries)))
    print("BAD:", bad)


if __name__ == "__main__":
    main()
