"""Files, blobs, validation and scalar functions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from docpipe.functions import scalars
from docpipe.operators import validate
from docpipe.registry import query
from docpipe.registry.text import MAX_MB, file_error, iso, strip
from docpipe.session import scratch_path
from docpipe.sources import blobs


# Spark's reader returns no empty files: those come from the manifest, which
# has the files' own times. Any time of the others is one of this run.
@query("scan_files", """
SELECT doc_id, strlen(body) AS size, CASE WHEN body <> '' THEN sha256(body) END AS sha256,
  concat('files/', CAST(doc_id AS VARCHAR), '.md') AS path, CASE WHEN body = '' THEN modified END AS modified, body <> '' AS fresh
FROM fx_files""")
def scan_files(x):
    folder = scratch_path(x.spark, "files")
    start = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    bodies = x("fx_files").select(F.col("doc_id").alias("job_id"), F.col("body").alias("content"), "modified")
    blobs.write_results(bodies.drop("modified"), folder, layout="files")
    manifest = bodies.select(
        blobs.result_path(folder, F.col("job_id")).alias("path"), F.octet_length("content").cast("bigint").alias("size"), "modified")
    files = blobs.scan_files(x.spark, folder, glob="*.md", manifest=manifest)
    home = blobs.qualified_path(x.spark, F.lit(f"{folder}/"))
    doc_id = F.regexp_extract("path", "([^/]+)[.]md$", 1).cast("bigint")
    fresh = F.col("modified") >= F.lit(start)
    return files.select(
        doc_id.alias("doc_id"), "size", F.sha2("content", 256).alias("sha256"),
        F.concat(F.lit("files/"), F.when(F.col("path").startswith(home), F.substr("path", F.length(home) + 1))).alias("path"),
        F.when(~fresh, F.col("modified")).alias("modified"), fresh.alias("fresh"))


@query("list_blobs", """
SELECT path AS name, strlen(body) AS size, modified AS created, modified FROM fx_files
WHERE starts_with(path, 'inbox/') ORDER BY path LIMIT 1000""")
def list_blobs(x):
    return blobs.list_blobs(x.manifest(), prefix="inbox/").drop("metadata")


WANTED = "SELECT CASE WHEN doc_id % 4 = 0 THEN concat(path, '.gone') ELSE path END AS name FROM fx_files"


@query("fetch_blobs", f"""
WITH wanted AS ({WANTED})
SELECT name, CASE WHEN f.path IS NULL THEN 'not_found' ELSE 'ok' END AS outcome, sha256(f.body) AS sha256
FROM wanted LEFT JOIN fx_files f ON f.path = name""")
def fetch_blobs(x):
    stored = x.files().withColumnRenamed("path", "name")
    fetched = blobs.fetch_blobs(x.sql(WANTED), stored)
    return fetched.select("name", "outcome", F.sha2("content", 256).alias("sha256"))


@query("blob_exists", f"""
WITH wanted AS ({WANTED})
SELECT name, f.path IS NOT NULL AS exists FROM wanted LEFT JOIN fx_files f ON f.path = name""")
def blob_exists(x):
    return blobs.blob_exists(x.sql(WANTED), x.manifest())


# Two uploads per file: one overwrites the blob or adds a new name, the second
# sets a user key that hides the built-in content type.
INCOMING = """
SELECT CASE WHEN doc_id % 3 = 0 THEN path ELSE concat(path, '.v2') END AS name,
  n AS seq, octet_length({body}) + n AS size, modified + n * INTERVAL '1' HOUR AS uploaded_at,
  CASE WHEN (doc_id + n) % 2 = 0 THEN 'content_type' ELSE 'owner' END AS user_key,
  concat('u', CAST(doc_id % 5 AS STRING)) AS user_value
FROM (SELECT *, 1 AS n FROM fx_files UNION ALL SELECT *, 2 AS n FROM fx_files) v"""


@query("upsert_blobs", f"""
WITH incoming AS ({INCOMING.replace('{body}', 'encode(body)')}),
latest AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY uploaded_at DESC, seq DESC) AS rn FROM incoming),
up AS (SELECT * FROM latest WHERE rn = 1)
SELECT name, CAST(size AS BIGINT) AS size, uploaded_at AS created, uploaded_at AS modified,
  CASE WHEN user_key = 'content_type'
       THEN concat('content_type=', user_value, ';created=', {iso('uploaded_at')})
       ELSE concat('content_type=application/pdf;created=', {iso('uploaded_at')}, ';owner=', user_value) END AS metadata,
  concat('file:///blobs/', name) AS url FROM up
UNION ALL
SELECT path, strlen(body), modified, modified, '', NULL FROM fx_files WHERE path NOT IN (SELECT name FROM up)""")
def upsert_blobs(x):
    incoming = x.sql(INCOMING.replace("{body}", "body")).select(
        "name", "seq", F.col("size").cast("bigint").alias("size"), "uploaded_at",
        F.lit("application/pdf").alias("content_type"),
        F.create_map("user_key", "user_value").alias("metadata"),
    )
    after = blobs.upsert_blobs(x.manifest(), incoming, "file", base="/blobs")
    return after.withColumn("metadata", scalars.map_as_text(F.col("metadata")))


@query("remove_blobs", f"""
WITH wanted AS ({WANTED})
SELECT path AS name, strlen(body) AS size, modified FROM fx_files WHERE path NOT IN (SELECT name FROM wanted)""")
def remove_blobs(x):
    rest, _ = blobs.remove_blobs(x.manifest(), x.sql(WANTED))
    return rest.select("name", "size", "modified")


@query("remove_blobs_outcomes", f"""
WITH wanted AS ({WANTED})
SELECT name, name IN (SELECT path FROM fx_files) AS deleted FROM wanted""")
def remove_blobs_outcomes(x):
    return blobs.remove_blobs(x.manifest(), x.sql(WANTED))[1]


@query("blob_with_metadata", """
SELECT f.path AS name, strlen(f.body) AS size,
  CASE WHEN s.name IS NULL THEN '' ELSE concat('content_type=application/pdf;owner=',
       CASE WHEN f.doc_id % 2 = 0 THEN 'second' ELSE 'first' END, ';query=a=b') END AS metadata
FROM fx_files f LEFT JOIN fx_sidecars s ON s.name = concat(f.path, '.meta')""")
def blob_with_metadata(x):
    joined = blobs.blob_with_metadata(x.manifest(), x("fx_sidecars"))
    return joined.select("name", "size", scalars.map_as_text(F.col("metadata")).alias("metadata"))


@query("parse_sidecar", """
SELECT doc_id, n.k AS key, n.v AS value
FROM (SELECT doc_id, unnest([
    {'k': 'content_type', 'v': 'application/pdf'}, {'k': 'query', 'v': 'a=b'},
    {'k': 'owner', 'v': CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END}]) AS n FROM fx_sidecars)""")
def parse_sidecar(x):
    return x("fx_sidecars").select("doc_id", F.explode_outer(scalars.parse_sidecar(F.col("meta"))))


@query("render_sidecar", """
SELECT doc_id, concat('content_type=application/pdf', chr(10), 'query=a=b', chr(10), 'owner=',
  CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END) AS meta FROM fx_sidecars""")
def render_sidecar(x):
    parsed = scalars.parse_sidecar(F.col("meta"))
    return x("fx_sidecars").select("doc_id", scalars.render_sidecar(parsed).alias("meta"))


@query("set_blob_metadata", f"""
WITH wanted AS ({WANTED}),
written AS (SELECT concat(name, '.meta') AS name, 'reviewed=yes' AS meta FROM wanted
            WHERE name IN (SELECT path FROM fx_files))
SELECT name, meta FROM written
UNION ALL SELECT name, meta FROM fx_sidecars WHERE name NOT IN (SELECT name FROM written)""")
def set_blob_metadata(x):
    changes = x.sql(WANTED).withColumn("metadata", F.create_map(F.lit("reviewed"), F.lit("yes")))
    return blobs.set_blob_metadata(x("fx_sidecars"), changes, x.manifest())[0]


@query("blob_url", """
SELECT doc_id, concat('file:///data/', path) AS file_url,
  concat('https://docs.s3.us-east-1.amazonaws.com/', path) AS s3_url FROM fx_files""")
def blob_url(x):
    path = F.col("path")
    return x("fx_files").select(
        "doc_id",
        scalars.blob_url(path, "file", base="/data").alias("file_url"),
        scalars.blob_url(path, "s3", bucket="docs", region="us-east-1").alias("s3_url"),
    )


@query("validate_files", f"""
SELECT doc_id, {file_error()} = '' AS is_valid, {file_error()} AS error FROM fx_files""")
def validate_files(x):
    return validate.validate_files(x.files(), MAX_MB).select("doc_id", "is_valid", "error")


@query("check_upload", """
SELECT request_id, CASE WHEN detail = '' THEN 200 ELSE 400 END AS status_code, detail FROM (
SELECT request_id, CASE WHEN filename = '' THEN 'File name is required'
  WHEN NOT ends_with(filename, '.pdf') THEN 'Only PDF files are supported'
  WHEN output_format NOT IN ('markdown','json','yaml','text')
    THEN 'Invalid output format. Must be one of: markdown, json, yaml, text'
  WHEN extractor NOT IN ('pdfplumber','pymupdf')
    THEN 'Invalid extractor. Must be one of: pdfplumber, pymupdf' ELSE '' END AS detail FROM fx_uploads)""")
def check_upload(x):
    return validate.check_upload(x("fx_uploads")).select("request_id", "status_code", "detail")


@query("file_info", """
SELECT doc_id, path, strlen(body) AS size_bytes, strlen(body) / 1048576.0::DOUBLE AS size_mb, modified,
  TRUE AS is_readable, sha256(body) AS sha256 FROM fx_files""")
def file_info(x):
    return validate.file_info(x.files())


@query("content_hash", """
SELECT doc_id, concat('sha256:', sha256(body)) AS sha256, concat('md5:', md5(body)) AS md5,
  concat('sha1:', sha1(body)) AS sha1 FROM fx_files""")
def content_hash(x):
    content = F.col("content")
    return x.files().select(
        "doc_id",
        *[
            F.concat(F.lit(f"{a}:"), validate.hash_column(content, a)).alias(a)
            for a in ("sha256", "md5", "sha1")
        ],
    )


@query("validation_report", f"""
WITH checked AS (SELECT *, {file_error()} AS error FROM fx_files),
rows_of AS (SELECT doc_id, CASE WHEN error <> '' THEN [
    {{'c': 'File Validation', 'r': concat('FAIL: ', error)}}] ELSE [
    {{'c': 'File Validation', 'r': 'PASS'}},
    {{'c': 'File Size', 'r': concat(printf('%.2f', CAST(round_even(strlen(body) / 1048576.0, 2) AS DOUBLE)),
        ' MB (', format('{{:,}}', strlen(body)), ' bytes)')}},
    {{'c': 'SHA256 Hash', 'r': sha256(body)}},
    {{'c': 'utf8', 'r': 'Can extract'}}, {{'c': 'latin1', 'r': 'Can extract'}},
    {{'c': 'Metadata Extraction', 'r': 'Success'}},
    {{'c': 'Page Count', 'r': CAST(len(string_split(body, chr(10))) AS VARCHAR)}},
    {{'c': 'Encrypted', 'r': 'No'}}] END AS entries FROM checked)
SELECT doc_id, CAST(i - 1 AS INT) AS position, entries[i].c AS "check", entries[i].r AS result
FROM (SELECT doc_id, entries, unnest(range(1, len(entries) + 1)) AS i FROM rows_of)""")
def validation_report(x):
    return validate.validation_report(x.files(), ("utf8", "latin1"), max_size_mb=MAX_MB, lines_per_page=1)


class TitleBackend:
    """User back end that tells a document's title from its first lines; asked
    for pages, it fails."""

    name = "title"

    def metadata(self, content: bytes):
        lines = content.split(b"\n")
        if len(lines) % 2:
            raise ValueError("odd number of lines")
        return {"title": lines[1].decode()[:20], "page_count": len(lines), "encrypted": len(lines) % 4 == 0}

    def can_read(self, content: bytes):
        return content.count(b"\n") % 2 == 1

    def extract(self, content: bytes):
        raise AssertionError("pages were asked for")


LINES = "len(string_split(body, chr(10)))"


@query("validation_report_backend", f"""
WITH checked AS (SELECT *, {file_error()} AS error, {LINES} AS n FROM fx_files),
rows_of AS (SELECT doc_id, CASE WHEN error <> '' THEN [{{'c': 'File Validation', 'r': concat('FAIL: ', error)}}] ELSE [
    {{'c': 'title', 'r': CASE n % 2 WHEN 0 THEN 'Can extract' ELSE 'Cannot extract' END}}, {{'c': 'utf8', 'r': 'Can extract'}},
    {{'c': 'Metadata Extraction', 'r': 'Success'}}, {{'c': 'Page Count', 'r': CASE n % 2 WHEN 0 THEN CAST(n AS VARCHAR) ELSE '1' END}},
    {{'c': 'Encrypted', 'r': CASE n % 4 WHEN 0 THEN 'Yes' ELSE 'No' END}}] END AS entries FROM checked)
SELECT doc_id, e.c AS "check", e.r AS result FROM (SELECT doc_id, unnest(entries) AS e FROM rows_of)""")
def validation_report_backend(x):
    report = validate.validation_report(x.files(), [TitleBackend(), "utf8"], max_size_mb=MAX_MB)
    shown = report.where("check NOT IN ('File Size', 'SHA256 Hash') AND NOT (check = 'File Validation' AND result = 'PASS')")
    return shown.select("doc_id", "check", "result")


INFO = (
    "file struct<path:string,size_bytes:bigint,size_mb:double,modified:string,is_readable:boolean,sha256:string>, "
    "pdf struct<title:string,author:string,creation_date:string,page_count:int,encrypted:boolean>"
)
FILE_INFO = f"""path, strlen(body) AS size_bytes, strlen(body) / 1048576.0::DOUBLE AS size_mb, {iso('f.modified')} AS modified,
  TRUE AS is_readable, sha256(body) AS sha256"""


@query("doc_info", f"""
SELECT f.doc_id, {FILE_INFO}, d.title, d.author, {iso('d.creation_date')} AS creation_date, d.page_count, d.encrypted
FROM fx_files f JOIN fx_docs d ON d.doc_id = f.doc_id WHERE {file_error().replace('path', 'f.path')} = ''""")
def doc_info(x):
    docs = x("fx_docs")
    for name in ("subject", "creator", "producer"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    docs = docs.withColumn("modification_date", F.lit(None).cast("timestamp_ntz"))
    info = validate.doc_info(x.files(), docs, max_size_mb=MAX_MB)
    parsed = info.select("doc_id", F.from_json("info", INFO).alias("i"))
    return parsed.select("doc_id", "i.file.*", "i.pdf.*")


@query("doc_info_backend", f"""
SELECT f.doc_id, {FILE_INFO}, CASE {LINES} % 2 WHEN 0 THEN left(string_split(body, chr(10))[2], 20) END AS title,
  CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS creation_date,
  CAST(CASE {LINES} % 2 WHEN 0 THEN {LINES} ELSE 1 END AS INT) AS page_count, {LINES} % 4 = 0 AS encrypted
FROM fx_files f WHERE {file_error()} = ''""")
def doc_info_backend(x):
    info = validate.doc_info(x.files(), max_size_mb=MAX_MB, extractors=[TitleBackend(), "utf8"])
    parsed = info.select("doc_id", F.from_json("info", INFO).alias("i"))
    return parsed.select("doc_id", "i.file.*", "i.pdf.*")


@query("parse_pdf_date", """
SELECT id, CASE WHEN strlen(d) >= 14 THEN try_strptime(left(d, 14), '%Y%m%d%H%M%S') END AS parsed
FROM (SELECT id, regexp_replace(raw, '^D:', '') AS d FROM fx_pdf_dates)""")
def parse_pdf_date(x):
    return x("fx_pdf_dates").select("id", scalars.parse_pdf_date(F.col("raw")).alias("parsed"))


@query("iso_format", f"SELECT id, {iso('timestamp')} AS iso FROM fx_usage")
def iso_format(x):
    return x("fx_usage").select("id", scalars.iso_format(F.col("timestamp")).alias("iso"))


@query("strip_text", f"SELECT doc_id, page_number, {strip('text')} AS text FROM fx_pages")
def strip_text(x):
    return x("fx_pages").select("doc_id", "page_number", scalars.strip_text(F.col("text")).alias("text"))


@query("parse_job_options", """
SELECT job_id, coalesce(json_extract_string(options, '$.output_format'), 'markdown') AS output_format,
  coalesce(json_extract_string(options, '$.extractor'), 'pdfplumber') AS extractor,
  coalesce(CAST(json_extract_string(options, '$.include_metadata') AS BOOLEAN), TRUE) AS include_metadata
FROM fx_jobs""")
def parse_job_options(x):
    return x("fx_jobs").select("job_id", scalars.parse_job_options(F.col("options")).alias("o")).select(
        "job_id", "o.*"
    )


@query("write_results", """
SELECT doc_id AS job_id, text AS content, concat('results/', CAST(doc_id AS VARCHAR), '.md') AS result_path
FROM documents""")
def write_results(x):
    path = scratch_path(x.spark, "results")
    results = x.table("documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("content"))
    blobs.write_results(results, path)
    written = x.spark.read.parquet(path)
    return written.withColumn("result_path", F.concat(F.lit("results/"), F.element_at(F.split("result_path", "/"), -1)))


@query("append_rows", """
SELECT job_id, granted_to_user_id, granted_by_user_id, granted_at FROM fx_grants""")
def append_rows(x):
    path = scratch_path(x.spark, "grants")
    blobs.append_rows(x("fx_grants"), path, "job_access_grants")
    return x.spark.read.parquet(path)


@query("load_ledger", """
SELECT job_id, status, created_at, throttled FROM fx_jobs""")
def load_ledger(x):
    base = scratch_path(x.spark, "ledger")
    as_stored = [F.col(c).cast("string").alias(c) for c in ("job_id", "owner_user_id", "throttled_by")]
    jobs = x("fx_jobs")
    rest = [c for c in jobs.columns if c not in ("job_id", "owner_user_id", "throttled_by")]
    blobs.append_rows(jobs.select(*as_stored, *rest), f"{base}/jobs", "jobs")
    jobs = blobs.load_ledger(x.spark, base)["jobs"]
    return jobs.select(F.col("job_id").cast("bigint").alias("job_id"), "status", "created_at", "throttled")
