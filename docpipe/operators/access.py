"""Permissions, job access and the outcomes of job requests.

Requests are tables ``job_id, user_id, role, …``; every function keeps one row
per request. Permission rules are a fixed matrix and become plain predicates;
jobs and grants are joined by key, so Spark decides from sizes whether to
broadcast and splits skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docpipe.functions.scalars import has_permission, iso_format
from docpipe.schemas import CANCELLABLE_STATUSES, PERMISSIONS, ROLE_PERMISSIONS, ROLES

Rule = tuple[Column, int, Column | str]


def permission_matrix(spark: SparkSession) -> DataFrame:
    """``role, permission, granted``: all 52 pairs as literals in the plan."""
    rows = [
        F.struct(
            F.lit(role).alias("role"), F.lit(permission).alias("permission"),
            F.lit(permission in ROLE_PERMISSIONS[role]).alias("granted"),
        )
        for role in ROLES
        for permission in PERMISSIONS
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def check_permissions(requests: DataFrame, role_col: str = "role", permission_col: str = "permission") -> DataFrame:
    """Adds ``granted`` for a role and permission named per row."""
    granted = F.lit(False)
    for role, permissions in ROLE_PERMISSIONS.items():
        granted = F.when(
            F.col(role_col) == role, F.coalesce(F.col(permission_col).isin(*permissions), F.lit(False))
        ).otherwise(granted)
    return requests.withColumn("granted", granted)


def decide(df: DataFrame, rules: list[Rule], ok: Column | str) -> DataFrame:
    """Adds ``status_code, detail`` of the first rule that applies, else 200."""
    code, detail = F.lit(200), ok if isinstance(ok, Column) else F.lit(ok)
    for condition, status, message in reversed(rules):
        message = message if isinstance(message, Column) else F.lit(message)
        code = F.when(condition, F.lit(status)).otherwise(code)
        detail = F.when(condition, message).otherwise(detail)
    return df.withColumns({"status_code": code, "detail": detail})


def _with_job(requests: DataFrame, jobs: DataFrame, *fields: str) -> DataFrame:
    """Adds ``__owner``, ``__found`` and the asked job fields as ``__name``."""
    job = jobs.select(
        "job_id", F.col("owner_user_id").alias("__owner"), F.lit(True).alias("__found"),
        *[F.col(f).alias(f"__{f}") for f in fields],
    )
    return requests.join(job, "job_id", "left").withColumn(
        "__found", F.coalesce("__found", F.lit(False))
    )


def _owns() -> Column:
    return F.coalesce(F.col("__owner") == F.col("user_id"), F.lit(False))


def _with_grant(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds ``__granted``: does a grant name this job and user."""
    granted = (
        grants.select("job_id", F.col("granted_to_user_id").alias("user_id"))
        .distinct()
        .withColumn("__granted", F.lit(True))
    )
    return requests.join(granted, ["job_id", "user_id"], "left").withColumn(
        "__granted", F.coalesce("__granted", F.lit(False))
    )


def _public(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("__")], *extra)


def _cannot(what: str) -> Column:
    return F.concat(F.lit("Role '"), F.coalesce("role", F.lit("None")), F.lit(f"' {what}"))


NOT_FOUND = "Job not found"
NO_ACCESS = "Access denied to this job"


def job_access(pairs: DataFrame, jobs: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds ``has_access``: the user owns the job or holds a grant for it."""
    joined = _with_grant(_with_job(pairs, jobs), grants)
    return _public(joined.withColumn("has_access", _owns() | F.col("__granted")))


def create_token_outcome(requests: DataFrame) -> DataFrame:
    """Outcome of token creation by ``role`` for ``requested_role``."""
    return decide(
        requests,
        [
            (~has_permission(F.col("role"), "create_token"), 403, _cannot("cannot create tokens")),
            (
                ~F.coalesce(F.col("requested_role").isin(*ROLES), F.lit(False)), 400,
                F.concat(F.lit("Invalid role: "), F.coalesce("requested_role", F.lit("None"))),
            ),
            (F.col("requested_role") == "admin", 403, "Admin tokens can only be created via CLI"),
        ],
        "Token created",
    )


def _may_see() -> Column:
    return has_permission(F.col("role"), "view_all_jobs") | _owns() | F.col("__granted")


def job_detail_outcome(requests: DataFrame, jobs: DataFrame, grants: DataFrame) -> DataFrame:
    """404, 403 or 200; accepted requests carry the job's view columns."""
    view = [c for c in VIEW_COLUMNS if c not in ("job_id", "owner_user_id")]
    joined = _with_grant(_with_job(requests, jobs, *view), grants)
    decided = decide(
        joined, [(~F.col("__found"), 404, NOT_FOUND), (~_may_see(), 403, NO_ACCESS)], "OK"
    )
    accepted = F.col("status_code") == 200
    shown = {
        f"job_{c}": F.when(accepted, _view_value(c, F.col(f"__{c}"))) for c in view
    }
    shown["job_owner_user_id"] = F.when(accepted, F.col("__owner"))
    return _public(decided.withColumns(shown))


def result_outcome(requests: DataFrame, jobs: DataFrame, grants: DataFrame, files: DataFrame) -> DataFrame:
    """Can the result be downloaded; ``files`` lists existing paths as ``path``."""
    # Whether a result exists is found for the jobs that have a path, and comes
    # with the job: requests are not joined by path, nor with the jobs twice.
    # Jobs without a path, which are many, stay out of the join by path.
    paths = files.select(F.col("path").alias("result_path")).distinct().withColumn("on_disk", F.lit(True))
    with_path = jobs.filter(F.col("result_path").isNotNull()).join(paths, "result_path", "left")
    without = jobs.filter(F.col("result_path").isNull()).withColumn("on_disk", F.lit(None).cast("boolean"))
    known = with_path.unionByName(without)
    joined = _with_grant(_with_job(requests, known, "status", "result_path", "on_disk"), grants)
    status = F.col("__status")
    decided = decide(
        joined,
        [
            (~F.col("__found"), 404, NOT_FOUND),
            (~_may_see(), 403, NO_ACCESS),
            (
                status != "COMPLETED", 400,
                F.concat(F.lit("Job is not completed (status: "), status, F.lit(")")),
            ),
            (F.coalesce("__result_path", F.lit("")) == "", 404, "Result file not found"),
            (F.col("__on_disk").isNull(), 404, "Result file not found on disk"),
        ],
        "OK",
    )
    path = F.when(F.col("status_code") == 200, F.col("__result_path"))
    return _public(decided.withColumn("result_path", path))


def cancel_rules() -> list[Rule]:
    return [
        (~F.col("__found"), 404, NOT_FOUND),
        (
            ~(has_permission(F.col("role"), "stop_all_jobs") | _owns()), 403,
            "You can only cancel your own jobs",
        ),
        (
            ~F.col("__status").isin(*CANCELLABLE_STATUSES), 400,
            "Job cannot be cancelled (already completed or failed)",
        ),
    ]


def cancel_outcome(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    return _public(decide(_with_job(requests, jobs, "status"), cancel_rules(), "Job cancelled successfully"))


def throttle_outcome(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """The permission is checked before the job is looked up."""
    done = F.concat(
        F.lit("Job "), F.when(F.col("throttled"), F.lit("throttled")).otherwise(F.lit("unthrottled")),
        F.lit(" successfully"),
    )
    rules = [
        (~has_permission(F.col("role"), "throttle_jobs"), 403, _cannot("cannot throttle jobs")),
        (~F.col("__found"), 404, NOT_FOUND),
    ]
    return _public(decide(_with_job(requests, jobs), rules, done))


def grant_outcome(requests: DataFrame, jobs: DataFrame, grantee: str = "grantee") -> DataFrame:
    rules = [
        (~F.col("__found"), 404, NOT_FOUND),
        (~has_permission(F.col("role"), "grant_job_access"), 403, _cannot("cannot grant job access")),
        (
            (F.col("role") != "admin") & ~_owns(), 403,
            "You can only grant access to your own jobs",
        ),
    ]
    done = F.concat(F.lit("Access granted to user '"), F.col(grantee).cast("string"), F.lit("'"))
    return _public(decide(_with_job(requests, jobs), rules, done))


VIEW_COLUMNS = (
    "job_id", "owner_user_id", "status", "pdf_path", "result_path", "error_message",
    "created_at", "started_at", "completed_at", "throttled", "throttled_by",
)


def _view_value(name: str, column: Column) -> Column:
    return iso_format(column) if name.endswith("_at") else column


def job_view(jobs: DataFrame) -> DataFrame:
    """The eleven columns a listing shows, times as ISO text."""
    return jobs.select(*[_view_value(c, F.col(c)).alias(c) for c in VIEW_COLUMNS])


def visible_jobs(
    jobs: DataFrame, user_id, role: str, grants: DataFrame | None = None, include_granted: bool = False
) -> DataFrame:
    """Jobs one user may list: all with view-all, else own ones, and with
    ``include_granted`` also those granted to them."""
    if role in ROLE_PERMISSIONS and "view_all_jobs" in ROLE_PERMISSIONS[role]:
        return jobs
    own = jobs.filter(F.col("owner_user_id") == F.lit(user_id))
    if not include_granted:
        return own
    if grants is None:
        raise ValueError("include_granted needs the grants table")
    mine = grants.filter(F.col("granted_to_user_id") == F.lit(user_id)).select("job_id")
    others = jobs.filter(~F.col("owner_user_id").eqNullSafe(F.lit(user_id)))
    return own.unionByName(others.join(mine, "job_id", "left_semi"))


def new_grants(grants: DataFrame, incoming: DataFrame, jobs: DataFrame) -> DataFrame:
    """Grants table after inserting ``incoming``: unknown jobs are ignored,
    and the first grant of a (job, user) pair stays."""
    pair = ["job_id", "granted_to_user_id"]
    first = incoming.groupBy(*pair).agg(
        F.min(F.struct("granted_at", "granted_by_user_id")).alias("__first")
    ).select(*pair, "__first.granted_by_user_id", "__first.granted_at")
    added = first.join(jobs.select("job_id"), "job_id", "left_semi").join(
        grants.select(*pair), pair, "left_anti"
    )
    return grants.select(*added.columns).unionByName(added)
