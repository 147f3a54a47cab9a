"""Table schemas, enumerations and fixed limits."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B, _N = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType(),
)


def _table(*columns) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in columns])


TOKENS = _table(
    ("token_id", _S, False), ("token_hash", _S, False), ("user_id", _S, False),
    ("role", _S, False), ("created_at", _N, False), ("expires_at", _N, True),
    ("is_active", _B, False), ("rate_limit", _I, False), ("scopes", _S, True),
    ("created_by", _S, True),
)
TOKEN_USAGE = _table(
    ("id", _L, False), ("token_id", _S, False), ("timestamp", _N, False),
    ("endpoint", _S, False), ("method", _S, False), ("request_size_bytes", _I, True),
    ("response_time_ms", _I, True), ("status_code", _I, True),
)
JOBS = _table(
    ("job_id", _S, False), ("owner_user_id", _S, False), ("pdf_path", _S, False),
    ("status", _S, False), ("result_path", _S, True), ("error_message", _S, True),
    ("created_at", _N, False), ("started_at", _N, True), ("completed_at", _N, True),
    ("throttled", _B, True), ("throttled_by", _S, True), ("options", _S, True),
)
JOB_ACCESS_GRANTS = _table(
    ("job_id", _S, False), ("granted_to_user_id", _S, False),
    ("granted_by_user_id", _S, False), ("granted_at", _N, False),
)

LEDGER = {
    "tokens": TOKENS,
    "token_usage": TOKEN_USAGE,
    "jobs": JOBS,
    "job_access_grants": JOB_ACCESS_GRANTS,
}
PRIMARY_KEYS = {
    "tokens": ["token_id"],
    "token_usage": ["id"],
    "jobs": ["job_id"],
    "job_access_grants": ["job_id", "granted_to_user_id"],
}

# Names, permissions and limits that results must agree on.
ROLES = ("admin", "job_manager", "job_writer", "job_reader")
STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED")
TERMINAL_STATUSES = ("COMPLETED", "FAILED", "CANCELLED")
CANCELLABLE_STATUSES = ("PENDING", "RUNNING")
OUTPUT_FORMATS = ("markdown", "json", "yaml", "text")
EXTRACTORS = ("pdfplumber", "pymupdf")
PUBLIC_PATHS = ("/health", "/ready", "/docs", "/openapi.json")
DEFAULT_RATE_LIMITS = {"admin": 1000, "job_manager": 500, "job_writer": 100, "job_reader": 50}
PERMISSIONS = (
    "create_job", "view_own_jobs", "view_all_jobs", "stop_own_jobs", "stop_all_jobs",
    "throttle_jobs", "grant_job_access", "create_token", "create_admin_token",
    "view_tokens", "revoke_token", "modify_token", "view_token_usage",
)
ROLE_PERMISSIONS = {
    "admin": PERMISSIONS,
    "job_manager": (
        "create_job", "view_own_jobs", "view_all_jobs", "stop_own_jobs", "stop_all_jobs",
        "throttle_jobs",
    ),
    "job_writer": ("create_job", "view_own_jobs", "stop_own_jobs", "grant_job_access"),
    "job_reader": ("view_own_jobs",),
}
CONVERTER_VERSION = "1.0.0"

PAGE_FIELDS = (
    "struct<page_number:int,text:string,"
    "images:array<struct<x0:double,y0:double,x1:double,y1:double,width:double,height:double>>,"
    "tables:array<struct<data:array<array<string>>>>,width:double,height:double>"
)
EMPTY_IMAGES = "array<struct<x0:double,y0:double,x1:double,y1:double,width:double,height:double>>"
EMPTY_TABLES = "array<struct<data:array<array<string>>>>"
PDF_FIELDS = (
    ("title", "string"), ("author", "string"), ("subject", "string"), ("creator", "string"),
    ("producer", "string"), ("creation_date", "timestamp_ntz"),
    ("modification_date", "timestamp_ntz"), ("page_count", "int"), ("encrypted", "boolean"),
    ("file_size_bytes", "bigint"),
)
