"""Run registered queries on Spark and their statements on DuckDB and compare the rows.

usage: python -m checks.compare SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracle, registry


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(normal(r[i]) for i in order) for r in cur.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, con, sf_dir, name, build, sql) -> bool:
    began = time.time()
    names, rows = spark_rows(build(spark, sf_dir))
    took = time.time() - began
    began = time.time()
    want_names, want = duck_rows(con, sql)
    ok = names == want_names and rows == want
    print(f"{'ok  ' if ok else 'DIFF'} {name:32s} rows={len(rows):7d} spark={took:6.2f}s sql={time.time() - began:6.2f}s",
          flush=True)
    if not ok:
        print("   columns", names, want_names)
        got_set, want_set = set(rows), set(want)
        print("   sql rows", len(want))
        for label, extra in (("spark only", got_set - want_set), ("sql only", want_set - got_set)):
            for row in sorted(extra, key=repr)[:3]:
                print("  ", label, row)
    return ok


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, statements = registry.queries(), oracle.sql()
    assert set(statements) <= set(queries), set(statements) - set(queries)
    bad = []
    for name in wanted or queries:
        if name in statements:
            try:
                if not compare(spark, con, sf_dir, name, queries[name], statements[name]):
                    bad.append(name)
            except Exception as error:  # noqa: BLE001
                print(f"FAIL {name}: {str(error)[:600]}", flush=True)
                bad.append(name)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
