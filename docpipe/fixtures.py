"""Input views over the test tables, one SQL text per view for both engines.

``{TS}`` stands for the naive timestamp type of the engine. A view that needs a
text per engine has a dict.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docpipe.session import set_sizes

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str | dict[str, str]] = {
    "fx_files": """
SELECT doc_id,
  concat('inbox/', source, '/', lang, '/', CAST(doc_id AS STRING),
         CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.pdf' END) AS path,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 7 = 0 THEN text
       ELSE concat('%PDF-1.4', chr(10), text) END AS body,
  {TS} '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS modified
FROM documents""",
    "fx_pages": {
        "spark": r"""
SELECT doc_id, CAST(p + 1 AS INT) AS page_number,
  CASE WHEN (doc_id + p + 1) % 9 = 0 THEN '  ' ELSE page END AS text
FROM (SELECT doc_id, transform(sequence(0, (size(lines) - 1) DIV 5),
                               i -> array_join(slice(lines, CAST(i * 5 + 1 AS INT), 5), chr(10))) AS parts
      FROM (SELECT doc_id, split(text, chr(10)) AS lines FROM documents))
LATERAL VIEW OUTER posexplode(parts) t AS p, page""",
        "duckdb": """
SELECT doc_id, page_number,
  CASE WHEN (doc_id + page_number) % 9 = 0 THEN '  '
       ELSE string_agg(line, chr(10) ORDER BY pos) END AS text
FROM (SELECT doc_id, pos, CAST(pos // 5 + 1 AS INT) AS page_number, line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
            FROM documents))
GROUP BY doc_id, page_number""",
    },
    "fx_docs": """
SELECT doc_id, concat(CAST(doc_id AS STRING), '.pdf') AS source_file,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('md5:', md5(text)) END AS source_hash,
  CASE WHEN doc_id % 3 <> 0 THEN concat('Report: ', source, ' #', CAST(doc_id AS STRING)) END AS title,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS author,
  {TS} '2024-01-01 00:00:00' + doc_id * INTERVAL '1' SECOND AS creation_date,
  CAST(doc_id % 7 + 1 AS INT) AS page_count, doc_id % 2 = 0 AS encrypted, n_chars AS file_size_bytes,
  'utf8' AS extraction_method, CAST(doc_id % 1000 AS DOUBLE) / 1000 AS extraction_time_seconds,
  CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml' WHEN 3 THEN 'text'
       ELSE 'markdown' END AS output_format
FROM documents""",
    "fx_jobs": """
SELECT job_id, owner_user_id, pdf_path, status, throttled, throttled_by, options, created_at,
  CASE WHEN status <> 'PENDING' THEN created_at + (job_id % 97) * INTERVAL '1' SECOND END AS started_at,
  CASE WHEN status IN ('COMPLETED','FAILED','CANCELLED')
       THEN created_at + (job_id % 97 + job_id % 613) * INTERVAL '1' SECOND END AS completed_at,
  CASE WHEN status = 'COMPLETED' AND job_id % 17 <> 0
       THEN concat('results/', CAST(job_id AS STRING), '.md') END AS result_path,
  CASE WHEN status = 'FAILED' THEN 'PDF validation failed: File is empty' END AS error_message
FROM (SELECT o_orderkey AS job_id, o_custkey AS owner_user_id,
        concat('inbox/', CAST(o_orderkey AS STRING), '.pdf') AS pdf_path,
        CASE WHEN o_orderkey % 10 = 9 THEN 'CANCELLED' WHEN o_orderkey % 10 = 8 THEN 'FAILED'
             WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' THEN 'RUNNING'
             ELSE 'PENDING' END AS status,
        o_orderkey % 7 = 0 AS throttled,
        CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 100 END AS throttled_by,
        CASE o_orderkey % 4 WHEN 0 THEN '{"output_format":"markdown"}'
             WHEN 1 THEN '{"output_format":"json","extractor":"pymupdf"}'
             WHEN 2 THEN '{"output_format":"yaml","include_metadata":false}' ELSE '{}' END AS options,
        o_orderdate AS created_at FROM orders) j""",
    "fx_job_events": """
SELECT user_id AS job_id, event_id AS seq, ts AS event_time,
  CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'RUNNING'
       WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'CANCEL' END AS event,
  CASE WHEN event_type = 'purchase' THEN concat('results/', CAST(event_id AS STRING), '.md') END AS result_path,
  CASE WHEN event_type = 'error' THEN concat('failure ', CAST(event_id AS STRING)) END AS error_message
FROM events""",
    "fx_grants": """
SELECT l_orderkey AS job_id, l_suppkey AS granted_to_user_id,
       min(o_custkey) AS granted_by_user_id, min(l_shipdate) AS granted_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_orderkey, l_suppkey""",
    "fx_requests": """
SELECT l_orderkey * 8 + l_linenumber AS request_id,
  CASE WHEN l_partkey % 23 = 0 THEN -l_orderkey ELSE l_orderkey END AS job_id,
  CASE WHEN l_partkey % 3 = 0 THEN o_custkey ELSE l_suppkey END AS user_id,
  CASE l_partkey % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'job_manager' WHEN 2 THEN 'job_reader'
       WHEN 3 THEN 'job_reader' WHEN 9 THEN 'guest' ELSE 'job_writer' END AS role,
  l_linenumber % 2 = 0 AS throttled, l_suppkey % 100 AS grantee
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_tokens": """
SELECT c_custkey AS token_id, c_custkey AS user_id,
  CASE WHEN c_custkey % 20 = 0 THEN 'admin' WHEN c_custkey % 20 < 3 THEN 'job_manager'
       WHEN c_custkey % 20 < 14 THEN 'job_writer' ELSE 'job_reader' END AS role,
  {TS} '2023-06-01 00:00:00' + (c_custkey % 200) * INTERVAL '1' DAY AS created_at,
  CASE WHEN c_custkey % 3 = 0
       THEN {TS} '2024-01-01 00:00:00' + (c_custkey % 60) * INTERVAL '1' DAY END AS expires_at,
  c_custkey % 10 <> 3 AS is_active,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_custkey % 5 + 1 AS INT) END AS rate_limit,
  CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_custkey - c_custkey % 20 END AS created_by
FROM customer""",
    "fx_usage": """
SELECT event_id AS id, user_id AS token_id, ts AS timestamp,
  CASE event_type WHEN 'signup' THEN '/v1/convert' WHEN 'view' THEN '/v1/jobs'
       WHEN 'click' THEN '/v1/jobs/{id}' WHEN 'purchase' THEN '/v1/jobs/{id}/result'
       ELSE '/health' END AS endpoint,
  CASE event_type WHEN 'signup' THEN 'POST' WHEN 'click' THEN 'OPTIONS' ELSE 'GET' END AS method,
  CAST(NULL AS INT) AS request_size_bytes,
  CAST(floor(value) AS INT) AS response_time_ms,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 19 = 0 THEN 403 ELSE 200 END AS status_code
FROM events""",
    "fx_cells": """
SELECT l_orderkey AS doc_id, 1 AS page_number, 1 AS table_index, l_linenumber AS row_index,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag,
  CAST(l_partkey AS STRING) AS part,
  CASE WHEN l_linenumber % 2 = 0 THEN concat(l_linestatus, ',', l_returnflag)
       ELSE concat('say "', l_linestatus, '"') END AS note
FROM lineitem""",
    "fx_images": """
SELECT l_orderkey AS doc_id, CAST(l_linenumber % 3 + 1 AS INT) AS page_number,
       l_linenumber AS seq, l_quantity AS width, l_discount * 1000 + 0.25 AS height
FROM lineitem""",
    "fx_sidecars": """
SELECT doc_id, concat(path, '.meta') AS name,
  concat('content_type=application/pdf', chr(10), 'query=a=b', chr(10), 'noequals', chr(10),
         'owner=first', CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), 'owner=second') ELSE '' END) AS meta
FROM fx_files WHERE doc_id % 5 <> 0""",
    "fx_pdf_dates": """
SELECT event_id AS id,
  CASE event_id % 6 WHEN 0 THEN 'D:20231225120000Z' WHEN 1 THEN 'D:20231225120000+02''00'
       WHEN 2 THEN '20240229235959' WHEN 3 THEN 'D:20231225' WHEN 4 THEN 'D:20231399120000'
       ELSE NULL END AS raw
FROM events""",
    "fx_uploads": """
SELECT o_orderkey AS request_id, o_custkey AS user_id,
  CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'scan.PDF' WHEN 2 THEN 'notes.txt'
       ELSE concat(CAST(o_orderkey AS STRING), '.pdf') END AS filename,
  CASE o_orderkey % 8 WHEN 0 THEN 'docx' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml' WHEN 3 THEN 'text'
       ELSE 'markdown' END AS output_format,
  CASE o_orderkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'pymupdf' ELSE 'pdfplumber' END AS extractor,
  CASE o_orderkey % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'superuser' WHEN 2 THEN 'job_manager'
       WHEN 3 THEN 'job_reader' ELSE 'job_writer' END AS requested_role
FROM orders""",
}

_NAME = re.compile(r"\bfx_\w+\b")


def view_text(name: str, engine: str) -> str:
    text = VIEWS[name]
    if isinstance(text, dict):
        text = text[engine]
    return text.strip().replace("{TS}", "TIMESTAMP_NTZ" if engine == "spark" else "TIMESTAMP")


def _needed(sql: str, engine: str) -> list[str]:
    """Views the text mentions, each after the ones it depends on."""
    found: list[str] = []
    for name in dict.fromkeys(_NAME.findall(sql)):
        if name in VIEWS:
            for inner in [*_needed(view_text(name, engine), engine), name]:
                if inner not in found:
                    found.append(inner)
    return found


def with_views(sql: str, engine: str) -> str:
    """The query with the definitions of its views put in front."""
    sql = sql.strip()
    views = ",\n".join(f"{n} AS (\n{view_text(n, engine)})" for n in _needed(sql, engine))
    if not views:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views},\n{sql[len(start):]}"
    return f"WITH {views}\n{sql}"


class Inputs:
    """The tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        set_sizes(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A query over tables and views."""
        full = with_views(text, "spark")
        for table in TABLES:
            if re.search(rf"\b{table}\b", full):
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(full)

    def __call__(self, view: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {view}")

    def files(self) -> DataFrame:
        """fx_files as a file table."""
        return self.sql(
            "SELECT doc_id, path, CAST(octet_length(body) AS BIGINT) AS size, modified, "
            "encode(body, 'UTF-8') AS content FROM fx_files"
        )

    def manifest(self) -> DataFrame:
        """fx_files as a blob manifest, the file's time as both times."""
        return self.sql(
            "SELECT path AS name, CAST(octet_length(body) AS BIGINT) AS size, modified AS created, modified, "
            "CAST(map() AS MAP<STRING, STRING>) AS metadata FROM fx_files"
        )
