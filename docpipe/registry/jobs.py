"""Job ledger: lists, access, outcomes, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.operators import access, ledger, metrics
from docpipe.registry import query
from docpipe.registry.credentials import holders
from docpipe.registry.text import AS_OF, iso

PAGE = "SELECT job_id, owner_user_id, status, created_at, throttled FROM fx_jobs"
PAGE_COLUMNS = ("job_id", "owner_user_id", "status", "created_at", "throttled")


@query("list_jobs", f"{PAGE} WHERE status = 'COMPLETED' ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 25")
def list_jobs(x):
    return ledger.list_jobs(x("fx_jobs"), "COMPLETED", offset=25).select(*PAGE_COLUMNS)


@query("list_jobs_owner", f"{PAGE} WHERE owner_user_id = 7 ORDER BY created_at DESC, job_id LIMIT 50")
def list_jobs_owner(x):
    return ledger.list_jobs(x("fx_jobs"), owner=7).select(*PAGE_COLUMNS)


@query("list_jobs_after", f"""{PAGE} WHERE status = 'COMPLETED' AND (created_at < TIMESTAMP '1998-03-01'
  OR (created_at = TIMESTAMP '1998-03-01' AND job_id > 100)) ORDER BY created_at DESC, job_id LIMIT 50""")
def list_jobs_after(x):
    jobs = ledger.list_jobs(x("fx_jobs"), "COMPLETED", after=("1998-03-01 00:00:00", 100))
    return jobs.select(*PAGE_COLUMNS)


@query("count_jobs", "SELECT count(*) AS total FROM fx_jobs WHERE status = 'COMPLETED'")
def count_jobs(x):
    return ledger.count_jobs(x("fx_jobs"), "COMPLETED")


@query("next_pending", """
SELECT job_id, created_at FROM (SELECT * FROM fx_jobs WHERE status = 'PENDING'
  ORDER BY created_at DESC, job_id LIMIT 20) WHERE NOT throttled""")
def next_pending(x):
    return ledger.next_pending(x("fx_jobs"), n=20).select("job_id", "created_at")


@query("next_pending_fifo", """
SELECT job_id, created_at FROM fx_jobs WHERE status = 'PENDING' AND NOT throttled ORDER BY created_at, job_id LIMIT 20""")
def next_pending_fifo(x):
    return ledger.next_pending(x("fx_jobs"), "fifo", 20).select("job_id", "created_at")


@query("get_jobs", """
SELECT r.job_id, j.status, j.owner_user_id, j.created_at
FROM (SELECT DISTINCT job_id FROM fx_requests) r LEFT JOIN fx_jobs j ON j.job_id = r.job_id""")
def get_jobs(x):
    found = ledger.get_jobs(x("fx_jobs"), x.sql("SELECT DISTINCT job_id FROM fx_requests"))
    return found.select("job_id", "status", "owner_user_id", "created_at")


@query("visible_jobs", "SELECT job_id, owner_user_id, status FROM fx_jobs WHERE owner_user_id = 7")
def visible_jobs(x):
    return access.visible_jobs(x("fx_jobs"), 7, "job_reader").select("job_id", "owner_user_id", "status")


@query("visible_jobs_granted", """
SELECT job_id, owner_user_id, status FROM fx_jobs
WHERE owner_user_id = 7 OR job_id IN (SELECT job_id FROM fx_grants WHERE granted_to_user_id = 7)""")
def visible_jobs_granted(x):
    seen = access.visible_jobs(x("fx_jobs"), 7, "job_writer", x("fx_grants"), include_granted=True)
    return seen.select("job_id", "owner_user_id", "status")


@query("visible_jobs_manager", "SELECT job_id, owner_user_id, status FROM fx_jobs")
def visible_jobs_manager(x):
    return access.visible_jobs(x("fx_jobs"), 7, "job_manager").select("job_id", "owner_user_id", "status")


VIEW = f"""job_id, owner_user_id, status, pdf_path, result_path, error_message, {iso('created_at')} AS created_at,
  {iso('started_at')} AS started_at, {iso('completed_at')} AS completed_at, throttled, throttled_by"""


@query("job_view", f"SELECT {VIEW} FROM fx_jobs")
def job_view(x):
    return access.job_view(x("fx_jobs"))


JOINED = """
FROM fx_requests r LEFT JOIN fx_jobs j ON j.job_id = r.job_id
LEFT JOIN fx_grants g ON g.job_id = r.job_id AND g.granted_to_user_id = r.user_id"""
OWNS = "coalesce(j.owner_user_id = r.user_id, FALSE)"
ACCESS = f"({OWNS} OR g.job_id IS NOT NULL)"
SEES = f"(r.role IN {holders('view_all_jobs')} OR {ACCESS})"


def outcome(rules: list[tuple[str, int, str]], ok: str) -> str:
    code = " ".join(f"WHEN {c} THEN {s}" for c, s, _ in rules)
    detail = " ".join(f"WHEN {c} THEN {d}" for c, _, d in rules)
    return f"CASE {code} ELSE 200 END AS status_code, CASE {detail} ELSE {ok} END AS detail"


@query("job_access", f"SELECT r.request_id, r.job_id, r.user_id, {ACCESS} AS has_access {JOINED}")
def job_access(x):
    pairs = x("fx_requests").select("request_id", "job_id", "user_id")
    return access.job_access(pairs, x("fx_jobs"), x("fx_grants"))


DETAIL_RULES = [
    ("j.job_id IS NULL", 404, "'Job not found'"), (f"NOT {SEES}", 403, "'Access denied to this job'"),
]


@query("job_detail_outcome", f"""
SELECT request_id, status_code, detail, CASE WHEN status_code = 200 THEN status END AS job_status,
  CASE WHEN status_code = 200 THEN {iso('created_at')} END AS job_created_at,
  CASE WHEN status_code = 200 THEN owner_user_id END AS job_owner_user_id
FROM (SELECT r.request_id, j.status, j.created_at, j.owner_user_id, {outcome(DETAIL_RULES, "'OK'")} {JOINED})""")
def job_detail_outcome(x):
    decided = access.job_detail_outcome(x("fx_requests"), x("fx_jobs"), x("fx_grants"))
    return decided.select(
        "request_id", "status_code", "detail", "job_status", "job_created_at", "job_owner_user_id"
    )


RESULT_RULES = [
    *DETAIL_RULES,
    ("j.status <> 'COMPLETED'", 400, "concat('Job is not completed (status: ', j.status, ')')"),
    ("coalesce(j.result_path, '') = ''", 404, "'Result file not found'"),
    ("f.path IS NULL", 404, "'Result file not found on disk'"),
]
ON_DISK = """
SELECT CASE WHEN job_id % 5 = 0 THEN concat(result_path, '.gone') ELSE result_path END AS path
FROM fx_jobs WHERE result_path IS NOT NULL"""


@query("result_outcome", f"""
SELECT r.request_id, {outcome(RESULT_RULES, "'OK'")} {JOINED}
LEFT JOIN ({ON_DISK}) f ON f.path = j.result_path""")
def result_outcome(x):
    decided = access.result_outcome(x("fx_requests"), x("fx_jobs"), x("fx_grants"), x.sql(ON_DISK))
    return decided.select("request_id", "status_code", "detail")


CANCEL_RULES = [
    ("j.job_id IS NULL", 404, "'Job not found'"),
    (f"NOT (r.role IN {holders('stop_all_jobs')} OR {OWNS})", 403, "'You can only cancel your own jobs'"),
    ("j.status NOT IN ('PENDING','RUNNING')", 400, "'Job cannot be cancelled (already completed or failed)'"),
]
JOB_ONLY = "FROM fx_requests r LEFT JOIN fx_jobs j ON j.job_id = r.job_id"


@query("cancel_outcome", f"""SELECT r.request_id, {outcome(CANCEL_RULES, "'Job cancelled successfully'")} {JOB_ONLY}""")
def cancel_outcome(x):
    return access.cancel_outcome(x("fx_requests"), x("fx_jobs")).select("request_id", "status_code", "detail")


THROTTLE_RULES = [
    (f"r.role NOT IN {holders('throttle_jobs')}", 403, "concat('Role ''', r.role, ''' cannot throttle jobs')"),
    ("j.job_id IS NULL", 404, "'Job not found'"),
]
THROTTLED = "concat('Job ', CASE WHEN r.throttled THEN 'throttled' ELSE 'unthrottled' END, ' successfully')"


@query("throttle_outcome", f"SELECT r.request_id, {outcome(THROTTLE_RULES, THROTTLED)} {JOB_ONLY}")
def throttle_outcome(x):
    return access.throttle_outcome(x("fx_requests"), x("fx_jobs")).select("request_id", "status_code", "detail")


GRANT_RULES = [
    ("j.job_id IS NULL", 404, "'Job not found'"),
    (f"r.role NOT IN {holders('grant_job_access')}", 403, "concat('Role ''', r.role, ''' cannot grant job access')"),
    (f"r.role <> 'admin' AND NOT {OWNS}", 403, "'You can only grant access to your own jobs'"),
]


@query("grant_outcome", f"""
SELECT r.request_id, {outcome(GRANT_RULES, "concat('Access granted to user ''', r.grantee, '''')")} {JOB_ONLY}""")
def grant_outcome(x):
    return access.grant_outcome(x("fx_requests"), x("fx_jobs")).select("request_id", "status_code", "detail")


NEW_GRANTS = """
SELECT job_id, grantee AS granted_to_user_id, user_id AS granted_by_user_id,
  {TS} '2024-01-01 00:00:00' + (request_id % 1000) * INTERVAL '1' SECOND AS granted_at FROM fx_requests"""
NEW_GRANTS_SQL = NEW_GRANTS.replace("{TS}", "TIMESTAMP")


@query("new_grants", f"""
SELECT * FROM fx_grants UNION ALL
SELECT job_id, granted_to_user_id, granted_by_user_id, granted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, granted_to_user_id ORDER BY granted_at, granted_by_user_id) AS rn
  FROM ({NEW_GRANTS_SQL}) n
  WHERE job_id IN (SELECT job_id FROM fx_jobs)
    AND NOT EXISTS (SELECT 1 FROM fx_grants g WHERE g.job_id = n.job_id AND g.granted_to_user_id = n.granted_to_user_id)
) WHERE rn = 1""")
def new_grants(x):
    incoming = x.sql(NEW_GRANTS.replace("{TS}", "TIMESTAMP_NTZ"))
    return access.new_grants(x("fx_grants"), incoming, x("fx_jobs"))


THROTTLE_CHANGES = """
SELECT job_id, max(request_id) % 2 = 0 AS throttled, max(grantee) AS actor FROM fx_requests GROUP BY job_id"""


@query("set_job_throttle", f"""
SELECT j.job_id, CASE WHEN c.job_id IS NULL THEN j.throttled ELSE c.throttled END AS throttled,
  CASE WHEN c.job_id IS NULL THEN j.throttled_by WHEN c.throttled THEN c.actor END AS throttled_by
FROM fx_jobs j LEFT JOIN ({THROTTLE_CHANGES}) c ON c.job_id = j.job_id""")
def set_job_throttle(x):
    changed = ledger.set_job_throttle(x("fx_jobs"), x.sql(THROTTLE_CHANGES))
    return changed.select("job_id", "throttled", "throttled_by")


STATUS_CHANGES = """
SELECT job_id, CASE min(user_id) % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED'
    ELSE 'PENDING' END AS status,
  CASE WHEN min(user_id) % 4 = 1 THEN concat('results/new/', CAST(job_id AS STRING), '.md') END AS result_path,
  CASE WHEN min(user_id) % 4 = 2 THEN 'failed again' END AS error_message,
  max(grantee) % 5 = 0 AS cancel
FROM fx_requests GROUP BY job_id"""


@query("apply_status_changes", f"""
WITH c AS ({STATUS_CHANGES}),
e AS (SELECT j.*, CASE WHEN c.cancel THEN 'CANCELLED' ELSE c.status END AS s,
        CASE WHEN NOT c.cancel THEN c.result_path END AS r, CASE WHEN NOT c.cancel THEN c.error_message END AS m,
        c.job_id IS NOT NULL AND (NOT c.cancel OR j.status IN ('PENDING','RUNNING')) AS hit
      FROM fx_jobs j LEFT JOIN c ON c.job_id = j.job_id),
t AS (SELECT *, hit AND s IN ('COMPLETED','FAILED','CANCELLED') AS ended FROM e)
SELECT job_id, CASE WHEN hit THEN s ELSE status END AS status,
  CASE WHEN hit AND s = 'RUNNING' THEN TIMESTAMP '{AS_OF}' ELSE started_at END AS started_at,
  CASE WHEN ended THEN TIMESTAMP '{AS_OF}' ELSE completed_at END AS completed_at,
  CASE WHEN ended THEN r ELSE result_path END AS result_path,
  CASE WHEN ended THEN m ELSE error_message END AS error_message FROM t""")
def apply_status_changes(x):
    changed = ledger.apply_status_changes(x("fx_jobs"), x.sql(STATUS_CHANGES), AS_OF)
    return changed.select("job_id", "status", "started_at", "completed_at", "result_path", "error_message")


@query("status_change_outcomes", f"""
WITH c AS ({STATUS_CHANGES})
SELECT c.job_id, j.job_id IS NOT NULL AND (NOT c.cancel OR j.status IN ('PENDING','RUNNING')) AS updated
FROM c LEFT JOIN fx_jobs j ON j.job_id = c.job_id""")
def status_change_outcomes(x):
    return ledger.status_change_outcomes(x("fx_jobs"), x.sql(STATUS_CHANGES))


FOLD_SQL = """
WITH l AS (SELECT *, lag(event) OVER (PARTITION BY job_id ORDER BY event_time, seq) AS prev FROM fx_job_events),
k AS (SELECT *, CASE WHEN event = 'CANCEL' THEN 'CANCELLED' ELSE event END AS s
      FROM l WHERE event <> 'CANCEL' OR prev IN ('PENDING','RUNNING')),
t AS (SELECT job_id, arg_max(struct_pack(r := result_path, e := error_message), (event_time, seq)) AS x,
             max(event_time) AS completed_at
      FROM k WHERE s IN ('COMPLETED','FAILED','CANCELLED') GROUP BY job_id)
SELECT k.job_id, arg_max(s, (event_time, seq)) AS status,
       max(event_time) FILTER (WHERE s = 'RUNNING') AS started_at,
       any_value(t.completed_at) AS completed_at,
       any_value(t.x.r) AS result_path, any_value(t.x.e) AS error_message
FROM k LEFT JOIN t USING (job_id) GROUP BY k.job_id"""


@query("fold_job_state", FOLD_SQL)
def fold_job_state(x):
    return ledger.fold_job_state(x("fx_job_events"))


@query("job_metrics", """
SELECT status, count(*) AS jobs, count(*) FILTER (WHERE throttled) AS throttled,
  avg(epoch(started_at) - epoch(created_at)) AS avg_wait_s, max(epoch(started_at) - epoch(created_at)) AS max_wait_s,
  avg(epoch(completed_at) - epoch(started_at)) AS avg_run_s, max(epoch(completed_at) - epoch(started_at)) AS max_run_s
FROM fx_jobs GROUP BY status""")
def job_metrics(x):
    return metrics.job_metrics(x("fx_jobs"))
