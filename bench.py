"""Times the headline queries and prints one JSON line. The tables are copied
into more files first, outside the timing.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, median after one warm-up), BENCH_ALL=1 for every query,
BENCH_QUERIES for a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from docpipe.fixtures import TABLES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "convert_corpus", "convert_corpus_markdown", "convert_ledger", "render_text", "render_markdown",
    "render_json", "count_tokens_whitespace", "count_tokens_bpe", "rate_limit_fixed", "rate_limit_sliding",
    "rate_limit_headroom", "fold_job_state", "request_metrics", "list_jobs", "job_access", "result_outcome",
    "visible_jobs_granted", "upsert_blobs", "table_markdown", "usage_with_identity",
)
#: Row counts behind the throughput figures.
UNITS = {
    "convert_corpus": "documents", "convert_corpus_markdown": "documents", "render_text": "documents",
    "render_markdown": "documents", "render_json": "documents", "count_tokens_bpe": "documents",
    "rate_limit_fixed": "events", "rate_limit_sliding": "events", "fold_job_state": "events",
}


def split_tables(spark) -> str:
    """A copy of the tables in as many files as keep all cores busy: a test
    table may be one row group, which is one task on one core."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        rows.repartition(2 * int(CPUS)).write.parquet(f"{folder}/{name}.parquet")
    return folder


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def skewed(name: str):
    """The same query with half of all events on a single key."""
    from docpipe.fixtures import Inputs
    from docpipe.operators import ledger, ratelimit
    from pyspark.sql import functions as F

    def query(spark, sf_dir):
        x = Inputs(spark, sf_dir)
        key = "job_id" if name == "fold_job_state" else "token_id"
        rows = x("fx_job_events" if name == "fold_job_state" else "fx_usage")
        order = "seq" if name == "fold_job_state" else "id"
        hot = rows.withColumn(key, F.when(F.col(order) % 2 == 0, F.lit(1)).otherwise(F.col(key)).cast("bigint"))
        if name == "fold_job_state":
            return ledger.fold_job_state(hot)
        limit = getattr(ratelimit, name)
        return limit(hot, 2, 86_400)

    return query


def main() -> None:
    from docpipe.registry import all_queries
    from docpipe.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    names = list(found) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in found]
    work = {name: found[name] for name in names}
    for name in ("rate_limit_fixed", "rate_limit_sliding", "fold_job_state"):
        work[f"{name}_half_on_one_key"] = skewed(name)
    chosen = os.environ.get("BENCH_QUERIES")
    if chosen:
        work = {name: query for name, query in work.items() if name in chosen.split(",")}
    times, sf_dir = {}, split_tables(spark)
    for name, query in work.items():
        try:
            run(spark, query, sf_dir)
            times[name] = round(statistics.median(run(spark, query, sf_dir) for _ in range(RUNS)), 4)
        except Exception as error:
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
    shutil.rmtree(sf_dir)
    rows = {
        table: spark.read.parquet(f"{SF_DIR}/{table}.parquet").count() for table in ("documents", "events")
    }
    throughput = {
        f"{name}_per_sec": round(rows[unit] / times[name]) for name, unit in UNITS.items() if name in times
    }
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS),
        "rows": rows, "throughput": throughput,
    }))


if __name__ == "__main__":
    main()
