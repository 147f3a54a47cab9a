"""Extraction, corpus conversion and job submission."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.functions.scalars import map_as_text
from docpipe.operators.extract import Page, extract_pages, extract_with_fallback, page_rows
from docpipe.plans.convert import (
    assign_job_ids, conversion_ledger, convert_corpus, submit_jobs, upload_outcome,
)
from docpipe.registry import query
from docpipe.registry.text import AS_OF, MAX_MB, file_error, hash_id, page_list, shown_text, words


@query("extract_pages", f"""
SELECT doc_id, CAST(i AS INT) AS page_number, p[i] AS text
FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
      FROM (SELECT doc_id, {page_list('body')} AS p FROM fx_files))""")
def extract(x):
    found = extract_pages(x.files(), "utf8", lines_per_page=5)
    return page_rows(found, "doc_id").select("doc_id", "page_number", "text")


class HeaderBackend:
    """User back end: refuses files without the signature, fails on blank pages."""

    name = "header"

    def extract(self, content: bytes):
        head, _, rest = content.decode("utf-8").partition("\n")
        if not head.startswith("%PDF-"):
            raise ValueError("no header")
        lines = rest.split("\n")
        pages = [Page("\n".join(lines[i:i + 5])) for i in range(0, len(lines), 5)]
        return {"title": lines[0][:20]}, pages


@query("extract_custom_backend", f"""
SELECT doc_id, CASE WHEN left(body, 5) = '%PDF-' THEN 'header' ELSE 'latin1' END AS method,
  CASE WHEN left(body, 5) = '%PDF-' THEN '' ELSE
    'Primary extractor (header) failed, using fallback (latin1)' END AS warnings,
  CAST(CASE WHEN left(body, 5) = '%PDF-' THEN len({page_list('substr(body, 10)')}) ELSE 1 END AS INT) AS page_count,
  CASE WHEN left(body, 5) = '%PDF-' THEN substr(string_split(body, chr(10))[2], 1, 20) END AS title
FROM fx_files""")
def extract_custom_backend(x):
    found = extract_with_fallback(x.files(), [HeaderBackend(), "latin1"])
    return found.select(
        "doc_id", "method", F.array_join("warnings", ";").alias("warnings"),
        "metadata.page_count", "metadata.title",
    )


@query("extract_with_fallback", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'latin1' ELSE 'utf8' END AS method,
  CASE WHEN doc_id % 4 = 0 THEN 'Primary extractor (utf8) failed, using fallback (latin1)' ELSE '' END AS warnings,
  CAST(1 AS INT) AS page_count,
  CAST(CASE WHEN doc_id % 4 = 0 THEN strlen(body) + 1 ELSE length(body) END AS INT) AS n_chars
FROM fx_files""")
def extract_fallback(x):
    # Every fourth file ends in a byte that is not UTF-8.
    broken = F.concat(F.col("content"), F.lit(b"\xe9"))
    files = x.files().withColumn("content", F.when(F.col("doc_id") % 4 == 0, broken).otherwise(F.col("content")))
    found = extract_with_fallback(files, ["utf8", "latin1"])
    return found.select(
        "doc_id", "method", F.array_join("warnings", ";").alias("warnings"),
        F.col("metadata.page_count"), F.length(F.col("pages")[0]["text"]).alias("n_chars"),
    )


CONVERTED_SQL = f"""
SELECT doc_id, path, CASE WHEN error = '' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  CASE WHEN error <> '' THEN concat('PDF validation failed: ', error) END AS error_message,
  CASE WHEN error = '' THEN concat('sha256:', sha256(body)) END AS source_hash,
  CASE WHEN error = '' THEN CAST(len({page_list('body')}) AS INT) END AS page_count,
  CASE WHEN error = '' THEN concat('whitespace=', {words('body')}) ELSE '' END AS tokens,
  CASE WHEN error = '' THEN {shown_text(page_list('body'))} END AS content
FROM (SELECT *, {file_error()} AS error FROM fx_files)"""


def converted(x, output_format="text", **options):
    return convert_corpus(
        x.files(), output_format, counters={"whitespace": "whitespace"}, lines_per_page=5,
        max_size_mb=MAX_MB, converted_at="2024-01-15T00:00:00+00:00", **options,
    )


@query("convert_corpus", CONVERTED_SQL)
def convert_text(x):
    return converted(x).select(
        "doc_id", "path", "status", "error_message", "source_hash", "page_count",
        map_as_text(F.col("tokens")).alias("tokens"), "content",
    )


@query("convert_ledger", CONVERTED_SQL.replace(
    f",\n  CASE WHEN error = '' THEN {shown_text(page_list('body'))} END AS content", ""))
def convert_ledger(x):
    return conversion_ledger(converted(x), "doc_id").withColumn("tokens", map_as_text(F.col("tokens")))


@query("convert_corpus_markdown", CONVERTED_SQL.replace(
    f"{shown_text(page_list('body'))} END AS content",
    f"""concat('---', chr(10), 'source_file: ', string_split(path, '/')[-1], chr(10),
    'source_hash: sha256:', sha256(body), chr(10), 'converted_at: ''2024-01-15T00:00:00+00:00''', chr(10),
    'converter_version: 1.0.0', chr(10), 'pages: ', len({page_list('body')}), chr(10),
    'tokens:', chr(10), '  whitespace: ', {words('body')}, chr(10), 'extraction_method: utf8', chr(10),
    'extraction_time_seconds: 0.0', chr(10), '---', chr(10), chr(10),
    replace({shown_text(page_list('body'))}, '\x00', ''), chr(10)) END AS content"""))
def convert_markdown(x):
    return converted(x, "markdown").select(
        "doc_id", "path", "status", "error_message", "source_hash", "page_count",
        map_as_text(F.col("tokens")).alias("tokens"), "content",
    )


IDS_SQL = f"SELECT request_id, {hash_id('request_id', 'user_id', '0')} AS job_id FROM fx_uploads"


@query("assign_job_ids", IDS_SQL)
def assign_ids(x):
    ids = assign_job_ids(x("fx_uploads"), ["request_id", "user_id"])
    return ids.select("request_id", "job_id")


@query("submit_jobs", f"""
SELECT request_id, {hash_id('request_id', 'pdf_path', 'user_id', f"'{AS_OF}'", '0')} AS job_id,
  user_id AS owner_user_id, pdf_path, 'PENDING' AS status, TIMESTAMP '{AS_OF}' AS created_at,
  FALSE AS throttled,
  concat('{{"output_format": "', output_format, '", "extractor": "', extractor, '", "include_metadata": true}}') AS options
FROM (SELECT u.*, concat('data/uploads/', CAST(u.user_id AS VARCHAR), '_', filename) AS pdf_path
      FROM fx_uploads u JOIN fx_tokens t ON t.user_id = u.user_id
      WHERE t.role IN ('admin','job_manager','job_writer') AND ends_with(filename, '.pdf')
        AND output_format IN ('markdown','json','yaml','text') AND extractor IN ('pdfplumber','pymupdf'))""")
def submit(x):
    requests = x("fx_uploads").join(x("fx_tokens").select("user_id", "role"), "user_id")
    return submit_jobs(requests, AS_OF).select(
        "request_id", "job_id", "owner_user_id", "pdf_path", "status", "created_at", "throttled", "options"
    )


@query("upload_outcome", """
SELECT request_id, CASE WHEN role NOT IN ('admin','job_manager','job_writer') THEN 403
    WHEN detail = '' THEN 200 ELSE 400 END AS status_code,
  CASE WHEN role NOT IN ('admin','job_manager','job_writer')
    THEN concat('Role \'\'', role, '\'\' does not have permission to create jobs') ELSE detail END AS detail
FROM (SELECT u.request_id, t.role, CASE WHEN filename = '' THEN 'File name is required'
  WHEN NOT ends_with(filename, '.pdf') THEN 'Only PDF files are supported'
  WHEN output_format NOT IN ('markdown','json','yaml','text')
    THEN 'Invalid output format. Must be one of: markdown, json, yaml, text'
  WHEN extractor NOT IN ('pdfplumber','pymupdf')
    THEN 'Invalid extractor. Must be one of: pdfplumber, pymupdf' ELSE '' END AS detail
  FROM fx_uploads u JOIN fx_tokens t ON t.user_id = u.user_id)""")
def uploads(x):
    requests = x("fx_uploads").join(x("fx_tokens").select("user_id", "role"), "user_id")
    return upload_outcome(requests).select("request_id", "status_code", "detail")
