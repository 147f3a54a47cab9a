"""Runs registered queries against their SQL and reports differences.

    python compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from docpipe.fixtures import TABLES
from docpipe.registry import all_queries, all_sql


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, name: str, query, sql: str | None, sf_dir: str) -> str | None:
    """None if equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if got == want:
        return None if got else "both empty"
    extra, missing = got - want, want - got
    show = lambda c: [str(r)[:600] for r in list(c)[:2]]
    return f"{sum(got.values())} rows vs {sum(want.values())}; extra {show(extra)}; missing {show(missing)}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from docpipe.session import build_session

    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, found = connect(sf_dir), all_sql(), all_queries()
    names = sys.argv[2:] or list(found)
    failures = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, found[name], sqls.get(name), sf_dir)
        except Exception as error:  # a broken query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failures += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failures}/{len(names)} ok")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
