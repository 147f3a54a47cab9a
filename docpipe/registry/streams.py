"""Streaming queries, run over the files present and then stopped."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.fixtures import view_text
from docpipe.functions.scalars import map_as_text
from docpipe.registry import query
from docpipe.registry.conversion import CONVERTED_SQL
from docpipe.registry.jobs import FOLD_SQL
from docpipe.registry.limits import FIXED, MAX, SLIDING, WINDOW
from docpipe.registry.text import MAX_MB
from docpipe.session import scratch_path
from docpipe.sources import blobs
from docpipe.streaming.jobs import latest_job_state, stream_convert, stream_files, stream_job_state
from docpipe.streaming.limits import latest_decisions, stream_rate_fixed, stream_rate_sliding
from docpipe.streaming.sink import read_batches, write_batches
from docpipe.streaming.usage import stream_usage_metrics


#: Covers all disorder of the replayed tables.
DELAY = "36500 days"
#: Bytes of a table that one file of a replay holds, about.
DEALT_BYTES = 1 << 24


def stream_view(x, view: str, table: str, shuffled_by: str | None = None, files: int = 3, path: str | None = None):
    """A fixture view over a stream of one table, one file a micro-batch; with
    ``shuffled_by``, of its rows dealt by that column over ``files``
    micro-batches, each of as many files as its size asks; with ``path``, of the
    files that are there, all in one micro-batch."""
    # A glob, as a stream source takes a folder or a pattern, not one file.
    reader = x.spark.readStream.schema(x.table(table).schema)
    if path is None:
        path = f"{x.sf_dir}/{table}.parque[t]"
        reader = reader.option("maxFilesPerTrigger", 1)
    if shuffled_by:
        path, rows = scratch_path(x.spark, table), x.table(table)
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        each = max(1, -(-size // (files * DEALT_BYTES)))
        reader = reader.option("maxFilesPerTrigger", each)
        rows.repartition(files * each, F.xxhash64(shuffled_by)).write.parquet(path)
    source = reader.parquet(path)
    source.createOrReplaceTempView(f"stream_{table}")
    text = view_text(view, "spark").replace(f"FROM {table}", f"FROM stream_{table}")
    return x.spark.sql(text)


def finish(stream_query):
    stream_query.awaitTermination()


def run(x, stream, label: str, output_mode: str = "append"):
    path = scratch_path(x.spark, label)
    finish(write_batches(stream, f"{path}/out", f"{path}/checkpoint", output_mode))
    return f"{path}/out"


@query("stream_convert", CONVERTED_SQL)
def convert(x):
    view = stream_view(x, "fx_files", "documents", "doc_id")
    files = view.selectExpr(
        "doc_id", "path", "CAST(octet_length(body) AS BIGINT) AS size", "modified", "encode(body, 'UTF-8') AS content"
    )
    path = scratch_path(x.spark, "convert")
    finish(stream_convert(
        files, f"{path}/out", f"{path}/checkpoint", output_format="text",
        counters={"whitespace": "whitespace"}, lines_per_page=5, max_size_mb=MAX_MB,
    ))
    return read_batches(x.spark, f"{path}/out").select(
        "doc_id", "path", "status", "error_message", "source_hash", "page_count",
        map_as_text(F.col("tokens")).alias("tokens"), "content",
    )


@query("stream_rate_fixed", f"SELECT id, token_id, request_rank <= {MAX} AS allowed FROM ({FIXED})")
def rate_fixed(x):
    usage = stream_view(x, "fx_usage", "events", "event_id")
    path = run(x, stream_rate_fixed(usage, MAX, WINDOW, delay=DELAY), "fixed")
    return latest_decisions(x.spark, path).select("id", "token_id", "allowed")


@query("stream_rate_sliding", SLIDING)
def rate_sliding(x):
    usage = stream_view(x, "fx_usage", "events", "event_id")
    path = run(x, stream_rate_sliding(usage, MAX, WINDOW, delay=DELAY), "sliding")
    return latest_decisions(x.spark, path).select("token_id", "id", "allowed")


@query("stream_job_state", FOLD_SQL)
def job_state(x):
    events = stream_view(x, "fx_job_events", "events", "event_id")
    path = run(x, stream_job_state(events), "jobs", "update")
    return latest_job_state(x.spark, path).drop("late_events")


#: Rows of the stream arrive up to a day out of order.
DISORDER = 86_400


@query("stream_usage_metrics", f"""
SELECT date_trunc('hour', timestamp) AS bucket, endpoint, count(*) AS requests,
  round(avg(response_time_ms), 6) AS avg_ms, round(quantile_cont(response_time_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(response_time_ms, 0.95), 6) AS p95_ms, max(response_time_ms) AS max_ms,
  round(count(*) FILTER (WHERE status_code >= 400) / count(*), 6) AS error_rate
FROM fx_usage
WHERE date_trunc('hour', timestamp) + INTERVAL '1' HOUR <=
  (SELECT max(timestamp) - INTERVAL '1' DAY FROM fx_usage) GROUP BY ALL""")
def usage_metrics(x):
    path, parts = scratch_path(x.spark, "usage"), 3
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(DISORDER * 1_000_000))
    rows = x.table("events").withColumn("arrival", arrival)
    cuts = rows.agg(F.percentile_approx("arrival", [i / parts for i in range(1, parts)])).first()[0]
    part = sum(((F.col("arrival") > cut).cast("int") for cut in cuts), F.lit(0))
    for step in range(parts):
        rows.where(part == step).drop("arrival").write.mode("append").parquet(f"{path}/in")
        usage = stream_view(x, "fx_usage", "events", path=f"{path}/in")
        finish(stream_usage_metrics(usage, f"{path}/out", f"{path}/checkpoint", delay=f"{DISORDER} seconds"))
    found = read_batches(x.spark, f"{path}/out").drop("batch")
    return found.withColumns({c: F.round(c, 6) for c in ("avg_ms", "p50_ms", "p95_ms", "error_rate")})


@query("stream_convert_files", CONVERTED_SQL.replace("doc_id, path, ", "doc_id, "))
def convert_files(x):
    """Files of a folder that fills in three steps, each followed by a poll; the
    last step delivers a third of the files again."""
    path = scratch_path(x.spark, "inbox")
    bodies = x("fx_files").select(F.col("doc_id").alias("job_id"), F.col("body").alias("content"))
    name = blobs.result_path(f"{path}/in", F.col("job_id"))
    for step in range(3):
        dropped = bodies.where(f"job_id % 3 = {step}")
        blobs.write_results(dropped, f"{path}/in", layout="files")
        listed = (bodies.where("job_id % 3 <> 1") if step == 2 else dropped).select(
            name.alias("path"), F.octet_length("content").cast("bigint").alias("size"), F.lit(None).cast("timestamp_ntz").alias("modified"))
        listed.write.mode("append").parquet(f"{path}/manifests")
        files = stream_files(x.spark, f"{path}/in", f"{path}/manifests", glob="*.md")
        finish(stream_convert(
            files, f"{path}/out", f"{path}/checkpoint", output_format="text", counters={"whitespace": "whitespace"},
            lines_per_page=5, max_size_mb=MAX_MB,
        ))
    doc_id = F.regexp_extract("path", "([^/]+)[.]md$", 1).cast("bigint")
    return read_batches(x.spark, f"{path}/out").select(
        doc_id.alias("doc_id"), "status", "error_message", "source_hash", "page_count",
        map_as_text(F.col("tokens")).alias("tokens"), "content",
    )
