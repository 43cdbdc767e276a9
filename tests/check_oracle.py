"""Run registered queries next to their SQL: python tests/check_oracle.py [folder] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from adlake.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return canonical(names, cursor.fetchall())


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name, folder):
    start = time.time()
    got = spark_rows(contract.queries()[name](spark, folder))
    took = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "no sql", len(got[1]), took, None
    want = sql_rows(con, sql)
    if got == want:
        return "ok", len(got[1]), took, None
    left, right = set(map(repr, got[1])), set(map(repr, want[1]))
    detail = (got[0], want[0], len(got[1]), len(want[1]), sorted(left - right)[:3], sorted(right - left)[:3])
    return "DIFFERENT", len(got[1]), took, detail


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark, con = local_session("8", **{"spark.ui.showConsoleProgress":"false"}), connect(folder)
    bad = 0
    for name in names:
        try:
            state, rows, took, detail = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            state, rows, took, detail = "ERROR", 0, 0.0, str(error)[:700]
        bad += state not in ("ok", "no sql")
        print(f"{state:10} {name:28} rows={rows:<8} {took:6.2f}s", detail or "", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
