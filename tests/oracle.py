"""Compare queries with their SQL statements: ``python tests/oracle.py [sf] [name part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        number = float(value)
        return str(int(number)) if number.is_integer() else repr(round(number, 9))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return [columns[n] for n in order], sorted(tuple(canonical(r[n]) for n in order) for r in data)


def compare(spark, con, folder, name, job, sql):
    started = time.time()
    df = job(spark, folder)
    spark_rows = rows(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, f"{len(spark_rows[1])} rows, no SQL", took
    result = con.execute(sql)
    sql_rows = rows([c[0] for c in result.description], result.fetchall())
    if spark_rows == sql_rows:
        return True, f"{len(sql_rows[1])} rows", took
    missing = sorted(set(sql_rows[1]) - set(spark_rows[1]))[:3]
    extra = sorted(set(spark_rows[1]) - set(sql_rows[1]))[:3]
    return False, (f"spark {len(spark_rows[1])} rows {spark_rows[0]} / sql {len(sql_rows[1])} rows {sql_rows[0]}; "
                   f"only sql {missing}; only spark {extra}"), took


def main():
    from corpus_audit import plans
    from corpus_audit.session import local_session
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    queries, oracle = plans.load()
    wanted = [n for n in queries if not sys.argv[2:] or any(part in n for part in sys.argv[2:])]
    spark, con = local_session(), connect(folder)
    failed = []
    for name in wanted:
        try:
            ok, text, took = compare(spark, con, folder, name, queries[name], oracle.get(name))
        except Exception as error:  # noqa: BLE001
            ok, text, took = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
