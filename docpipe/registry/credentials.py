"""Tokens, permissions, usage and request outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.operators import access, checks, credentials, metrics
from docpipe.registry import query
from docpipe.registry.text import AS_OF, hash_id, iso
from docpipe.schemas import PERMISSIONS, ROLE_PERMISSIONS, ROLES, STATUSES

STATE = f"""CASE WHEN NOT is_active THEN 'disabled' WHEN TIMESTAMP '{AS_OF}' > expires_at THEN 'expired'
  ELSE 'valid' END"""


def holders(permission: str) -> str:
    return "(" + ",".join(f"'{r}'" for r, p in ROLE_PERMISSIONS.items() if permission in p) + ")"


@query("token_state", f"""
SELECT token_id, CASE WHEN user_id % 15 = 0 THEN 'invalid_format' ELSE {STATE} END AS state FROM fx_tokens""")
def token_state(x):
    tokens = x("fx_tokens").withColumn(
        "secret", F.when(F.col("user_id") % 15 == 0, F.lit("bad")).otherwise(F.lit("tok_abc"))
    )
    return credentials.token_state(tokens, AS_OF, "secret").select("token_id", "state")


LIMIT = """coalesce(rate_limit, CASE role WHEN 'admin' THEN 1000 WHEN 'job_manager' THEN 500
  WHEN 'job_writer' THEN 100 ELSE 50 END)"""


@query("default_rate_limit", f"SELECT token_id, role, CAST({LIMIT} AS INT) AS rate_limit FROM fx_tokens")
def default_rate_limit(x):
    return credentials.default_rate_limit(x("fx_tokens")).select("token_id", "role", "rate_limit")


@query("token_expiry", """
SELECT token_id, CASE WHEN token_id % 4 <> 3
  THEN created_at + CAST((token_id % 4) * 30 AS INT) * INTERVAL '1' DAY END AS expires_at FROM fx_tokens""")
def token_expiry(x):
    days = F.when(F.col("token_id") % 4 != 3, ((F.col("token_id") % 4) * 30).cast("int"))
    return credentials.token_expiry(x("fx_tokens").withColumn("expires_days", days)).select("token_id", "expires_at")


@query("token_summary", """
SELECT token_id, user_id, role, created_at, expires_at, is_active, rate_limit, created_by
FROM fx_tokens ORDER BY created_at DESC, token_id""")
def token_summary(x):
    return credentials.token_summary(x("fx_tokens"))


@query("list_tokens", "SELECT * FROM fx_tokens ORDER BY created_at DESC, token_id")
def list_tokens(x):
    return credentials.list_tokens(x("fx_tokens"))


@query("mask_token", f"""
SELECT concat(left(CAST(token_id AS VARCHAR), 8), '...') AS token, user_id, role,
  CASE WHEN is_active THEN '✓' ELSE '✗' END AS active, CAST(rate_limit AS VARCHAR) AS rate_limit,
  coalesce({iso('expires_at')}, 'Never') AS expires FROM fx_tokens""")
def mask_token(x):
    return credentials.mask_tokens(x("fx_tokens"))


USED = "SELECT DISTINCT token_id FROM fx_usage"


@query("get_tokens", f"""
SELECT u.token_id, t.user_id, t.role, t.created_at FROM ({USED}) u LEFT JOIN fx_tokens t ON t.token_id = u.token_id""")
def get_tokens(x):
    return credentials.get_tokens(x("fx_tokens"), x.sql(USED)).select("token_id", "user_id", "role", "created_at")


# Tokens with server errors are switched off, the others on; the limit follows
# the worst status.
CHANGES = """
SELECT token_id, max(status_code) < 500 AS is_active,
  CASE WHEN max(status_code) <> 403 THEN CAST(max(status_code) AS INT) END AS rate_limit FROM fx_usage GROUP BY token_id"""


@query("set_token_active", f"""
SELECT t.token_id, coalesce(c.is_active, t.is_active) AS is_active
FROM fx_tokens t LEFT JOIN ({CHANGES}) c ON c.token_id = t.token_id""")
def set_token_active(x):
    return credentials.set_token_active(x("fx_tokens"), x.sql(CHANGES)).select("token_id", "is_active")


@query("set_rate_limit", f"""
SELECT t.token_id, coalesce(c.is_active, t.is_active) AS is_active, coalesce(c.rate_limit, t.rate_limit) AS rate_limit
FROM fx_tokens t LEFT JOIN ({CHANGES}) c ON c.token_id = t.token_id""")
def set_rate_limit(x):
    changed = credentials.set_rate_limit(x("fx_tokens"), x.sql(CHANGES))
    return changed.select("token_id", "is_active", "rate_limit")


@query("token_change_outcomes", f"""
SELECT token_id, token_id IN (SELECT token_id FROM fx_tokens) AS found FROM ({USED})""")
def token_change_outcomes(x):
    return credentials.change_outcomes(x("fx_tokens"), x.sql(USED))


@query("revoke_tokens", f"SELECT token_id, user_id, role FROM fx_tokens WHERE token_id NOT IN ({USED})")
def revoke_tokens(x):
    return credentials.revoke_tokens(x("fx_tokens"), x.sql(USED)).select("token_id", "user_id", "role")


@query("orphan_usage", """
SELECT u.id, u.token_id FROM fx_usage u WHERE u.token_id NOT IN (SELECT token_id FROM fx_tokens WHERE is_active)""")
def orphan_usage(x):
    return checks.orphan_usage(x("fx_usage"), x("fx_tokens").filter("is_active")).select("id", "token_id")


ISSUE = """
SELECT request_id, u.user_id, requested_role, CASE WHEN request_id % 4 <> 0 THEN CAST(request_id % 90 AS INT) END AS expires_days,
  CASE WHEN request_id % 3 = 0 THEN CAST(request_id % 50 AS INT) END AS rate_limit,
  t.role AS creator_role, t.token_id AS created_by
FROM fx_uploads u JOIN fx_tokens t ON t.user_id = u.user_id"""


@query("issue_tokens", f"""
SELECT {hash_id('request_id', 'user_id')} AS token_id, user_id, requested_role AS role,
  TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' + expires_days * INTERVAL '1' DAY AS expires_at,
  TRUE AS is_active, CAST({LIMIT.replace('role', 'requested_role')} AS INT) AS rate_limit, created_by
FROM ({ISSUE}) WHERE creator_role = 'admin' AND requested_role IN ('job_manager','job_writer','job_reader')""")
def issue_tokens(x):
    issued = credentials.issue_tokens(x.sql(ISSUE), AS_OF, ["request_id", "user_id"])
    return issued.drop("token_hash", "scopes")


@query("usage_window", f"""
SELECT u.* FROM fx_usage u WHERE token_id IN (SELECT token_id FROM fx_tokens)
  AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY ORDER BY timestamp DESC, id""")
def usage_window(x):
    return credentials.usage_window(x("fx_usage"), x("fx_tokens"), AS_OF, 7)


REQUESTS = """
SELECT id, endpoint AS path, method, token_id,
  CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Basic abc' WHEN 2 THEN 'Bearer other' ELSE 'Bearer tok_abc' END AS authorization
FROM fx_usage"""


@query("classify_requests", f"""
SELECT r.id, CASE WHEN path IN ('/health','/ready','/docs','/openapi.json') OR method = 'OPTIONS' THEN 'exempt'
  WHEN NOT starts_with(coalesce("authorization", ''), 'Bearer ') THEN 'anonymous'
  WHEN NOT starts_with("authorization", 'Bearer tok_') OR coalesce(s.state, '') <> 'valid' THEN 'invalid'
  ELSE 'limited' END AS request_class
FROM ({REQUESTS.replace('AS authorization', 'AS "authorization"')}) r
LEFT JOIN (SELECT token_id, {STATE} AS state FROM fx_tokens) s ON s.token_id = r.token_id""")
def classify_requests(x):
    requests = x.sql(REQUESTS.replace("AS authorization", "AS `authorization`"))
    return credentials.classify_requests(requests, x("fx_tokens"), AS_OF).select("id", "request_class")


@query("usage_with_identity", f"""
SELECT id, user_id, role, {iso('timestamp')} AS timestamp, method, endpoint,
  CAST(status_code AS VARCHAR) AS status,
  CASE WHEN coalesce(response_time_ms, 0) <> 0 THEN concat(response_time_ms, 'ms') ELSE 'N/A' END AS response_time
FROM fx_usage u JOIN fx_tokens t ON t.token_id = u.token_id""")
def usage_with_identity(x):
    return credentials.usage_with_identity(x("fx_usage"), x("fx_tokens"))


MATRIX = "(VALUES " + ", ".join(
    f"('{r}', '{p}', {str(p in ROLE_PERMISSIONS[r]).upper()})" for r in ROLES for p in PERMISSIONS
) + ") AS m(role, permission, granted)"


@query("permission_matrix", f"""
SELECT m.role, permission, granted, count(token_id) AS tokens
FROM {MATRIX} LEFT JOIN fx_tokens t ON t.role = m.role GROUP BY m.role, permission, granted""")
def permission_matrix(x):
    # Tokens per role are counted first: the matrix meets four rows, not tokens.
    holders_of = x("fx_tokens").groupBy("role").agg(F.count(F.lit(1)).alias("tokens"))
    matrix = access.permission_matrix(x.spark)
    return matrix.join(holders_of, "role", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


ASKED = f"""
SELECT request_id, role, CASE request_id % 5 WHEN 0 THEN 'create_job' WHEN 1 THEN 'view_all_jobs'
  WHEN 2 THEN 'grant_job_access' WHEN 3 THEN 'view_tokens' ELSE 'fly' END AS permission FROM fx_requests"""


@query("check_permissions", f"""
SELECT a.request_id, a.role, a.permission, coalesce(m.granted, FALSE) AS granted
FROM ({ASKED}) a LEFT JOIN {MATRIX} ON m.role = a.role AND m.permission = a.permission""")
def check_permissions(x):
    return access.check_permissions(x.sql(ASKED))


CREATE = """
SELECT u.request_id, t.role, u.requested_role FROM fx_uploads u JOIN fx_tokens t ON t.user_id = u.user_id"""


@query("create_token_outcome", f"""
SELECT request_id, CASE WHEN role <> 'admin' THEN 403
    WHEN requested_role NOT IN ('admin','job_manager','job_writer','job_reader') THEN 400
    WHEN requested_role = 'admin' THEN 403 ELSE 200 END AS status_code,
  CASE WHEN role <> 'admin' THEN concat('Role ''', role, ''' cannot create tokens')
    WHEN requested_role NOT IN ('admin','job_manager','job_writer','job_reader') THEN concat('Invalid role: ', requested_role)
    WHEN requested_role = 'admin' THEN 'Admin tokens can only be created via CLI' ELSE 'Token created' END AS detail
FROM ({CREATE})""")
def create_token_outcome(x):
    return access.create_token_outcome(x.sql(CREATE)).select("request_id", "status_code", "detail")


@query("usage_total", f"""
SELECT token_id, count(*) AS requests FROM fx_usage
WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY GROUP BY token_id""")
def usage_total(x):
    return metrics.usage_total(x("fx_usage"), AS_OF, 7)


@query("last_used", """
SELECT t.token_id, max(u.timestamp) AS last_used_at FROM fx_tokens t LEFT JOIN fx_usage u ON u.token_id = t.token_id
GROUP BY t.token_id""")
def last_used(x):
    return metrics.last_used(x("fx_tokens"), x("fx_usage"))


@query("request_metrics", """
SELECT date_trunc('hour', timestamp) AS bucket, endpoint, count(*) AS requests,
  round(avg(response_time_ms), 6) AS avg_ms, round(quantile_cont(response_time_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(response_time_ms, 0.95), 6) AS p95_ms, max(response_time_ms) AS max_ms,
  round(count(*) FILTER (WHERE status_code >= 400) / count(*), 6) AS error_rate
FROM fx_usage GROUP BY ALL""")
def request_metrics(x):
    found = metrics.request_metrics(x("fx_usage"), "1 hour")
    rounded = ("avg_ms", "p50_ms", "p95_ms", "error_rate")
    return found.withColumns({c: F.round(c, 6) for c in rounded})


@query("check_primary_key", """
SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def check_primary_key(x):
    return checks.check_primary_key(x.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_enum_role", """
SELECT request_id, role FROM fx_requests WHERE role NOT IN ('admin','job_manager','job_writer','job_reader')""")
def check_enum_role(x):
    return checks.check_enum(x("fx_requests"), "role", ROLES).select("request_id", "role")


@query("check_enum_status", """
SELECT job_id, seq, event FROM fx_job_events
WHERE event NOT IN ('PENDING','RUNNING','COMPLETED','FAILED','CANCELLED')""")
def check_enum_status(x):
    return checks.check_enum(x("fx_job_events"), "event", STATUSES).select("job_id", "seq", "event")


@query("check_foreign_key", """
SELECT request_id, job_id FROM fx_requests WHERE job_id NOT IN (SELECT job_id FROM fx_jobs)""")
def check_foreign_key(x):
    return checks.check_foreign_key(x("fx_requests"), x("fx_jobs"), "job_id").select("request_id", "job_id")


@query("check_not_null", """
SELECT * FROM (SELECT 'started_at' AS "column", count(*) - count(started_at) AS nulls FROM fx_jobs
UNION ALL SELECT 'result_path', count(*) - count(result_path) FROM fx_jobs
UNION ALL SELECT 'throttled_by', count(*) - count(throttled_by) FROM fx_jobs) WHERE nulls > 0""")
def check_not_null(x):
    columns = ["job_id", "status", "created_at", "started_at", "result_path", "throttled_by"]
    return checks.check_not_null(x("fx_jobs"), columns)
