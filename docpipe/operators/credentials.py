"""Tokens and their usage: state, limits, changes, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.functions.scalars import as_timestamp, has_permission, iso_format, mask_token, role_limit
from docpipe.plans.ids import unique_ids
from docpipe.plans.lookup import lookup
from docpipe.schemas import PUBLIC_PATHS, ROLES

TOKEN_PREFIX = "tok_"


def state_column(as_of, token_text: Column | None = None, prefix: str = TOKEN_PREFIX) -> Column:
    """``invalid_format``, ``disabled``, ``expired`` or ``valid``. A token is
    still valid at the very instant of its expiry."""
    state = (
        F.when(~F.coalesce(F.col("is_active"), F.lit(False)), F.lit("disabled"))
        .when(as_timestamp(as_of) > F.col("expires_at"), F.lit("expired"))
        .otherwise(F.lit("valid"))
    )
    if token_text is None:
        return state
    well_formed = F.coalesce(token_text.startswith(prefix), F.lit(False))
    return F.when(~well_formed, F.lit("invalid_format")).otherwise(state)


def token_state(tokens: DataFrame, as_of, token_col: str | None = None, prefix: str = TOKEN_PREFIX) -> DataFrame:
    text = F.col(token_col) if token_col else None
    return tokens.withColumn("state", state_column(as_of, text, prefix))


def default_rate_limit(tokens: DataFrame) -> DataFrame:
    """Fills a missing ``rate_limit`` from the role."""
    return tokens.withColumn("rate_limit", F.coalesce("rate_limit", role_limit(F.col("role"))))


def expiry_column(created_at: Column, expires_days: Column) -> Column:
    return created_at + F.make_dt_interval(days=expires_days)


def token_expiry(tokens: DataFrame, days_col: str = "expires_days") -> DataFrame:
    """Adds ``expires_at``; no number of days means no expiry, 0 is a value."""
    return tokens.withColumn("expires_at", expiry_column(F.col("created_at"), F.col(days_col)))


def newest_first(tokens: DataFrame) -> DataFrame:
    return tokens.orderBy(F.col("created_at").desc(), F.col("token_id"))


def token_summary(tokens: DataFrame) -> DataFrame:
    """Listing without secrets, newest first."""
    return newest_first(tokens).select(
        "token_id", "user_id", "role", "created_at", "expires_at", "is_active", "rate_limit", "created_by"
    )


def list_tokens(tokens: DataFrame) -> DataFrame:
    return newest_first(tokens)


def mask_tokens(tokens: DataFrame) -> DataFrame:
    """Console listing: shortened id, tick or cross, ``Never`` for no expiry."""
    return tokens.select(
        mask_token(F.col("token_id")).alias("token"),
        "user_id",
        "role",
        F.when(F.col("is_active"), F.lit("✓")).otherwise(F.lit("✗")).alias("active"),
        F.col("rate_limit").cast("string").alias("rate_limit"),
        F.coalesce(iso_format(F.col("expires_at")), F.lit("Never")).alias("expires"),
    )


def get_tokens(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per wanted id with the token's columns, null if there is none."""
    return lookup(ids, tokens, "token_id")


def set_token_active(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies ``token_id, is_active``; one change per token."""
    new = changes.select("token_id", F.col("is_active").alias("__active"))
    return (
        tokens.join(new, "token_id", "left")
        .withColumn("is_active", F.coalesce("__active", "is_active"))
        .drop("__active")
    )


def set_rate_limit(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies ``token_id, is_active?, rate_limit?``: only non-null fields."""
    fields = [c for c in ("is_active", "rate_limit") if c in changes.columns]
    new = changes.select("token_id", *[F.col(c).alias(f"__{c}") for c in fields])
    joined = tokens.join(new, "token_id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).drop(*[f"__{c}" for c in fields])


def change_outcomes(tokens: DataFrame, ids: DataFrame, key: str = "token_id", flag: str = "found") -> DataFrame:
    """Whether each id of a change set exists."""
    known = tokens.select(key).distinct().withColumn("__known", F.lit(True))
    return ids.join(known, key, "left").withColumn(flag, F.coalesce("__known", F.lit(False))).drop("__known")


def revoke_tokens(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """Tokens that survive deleting ``ids``. Usage rows are kept and show up
    in `docpipe.operators.checks.orphan_usage`."""
    return tokens.join(ids.select("token_id"), "token_id", "left_anti")


def issue_tokens(requests: DataFrame, as_of, id_cols: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Token rows for accepted creation requests (see `create_token_outcome`).

    Needs ``user_id, requested_role, expires_days, rate_limit, creator_role,
    created_by``; the secret's hash is the caller's ``token_hash`` or null.
    Ids are hashes of ``id_cols``, unique among the requests and against the
    tokens in ``existing`` (see `unique_ids`).
    """
    accepted = requests.filter(
        has_permission(F.col("creator_role"), "create_token")
        & F.col("requested_role").isin(*ROLES)
        & (F.col("requested_role") != "admin")
    )
    created = as_timestamp(as_of)
    secret = F.col("token_hash") if "token_hash" in requests.columns else F.lit(None).cast("string")
    return unique_ids(accepted, id_cols, "token_id", existing, first_attempt=()).select(
        "token_id",
        secret.alias("token_hash"),
        "user_id",
        F.col("requested_role").alias("role"),
        created.alias("created_at"),
        expiry_column(created, F.col("expires_days")).alias("expires_at"),
        F.lit(True).alias("is_active"),
        F.coalesce("rate_limit", role_limit(F.col("requested_role"))).alias("rate_limit"),
        F.lit(None).cast("string").alias("scopes"),
        "created_by",
    )


def usage_window(usage: DataFrame, token_ids: DataFrame | None, as_of, days: int = 7) -> DataFrame:
    """Usage since ``as_of - days``, newest first. The time filter reaches the
    scan; with ``token_ids`` only those tokens are kept."""
    cutoff = as_timestamp(as_of) - F.make_dt_interval(days=F.lit(days))
    recent = usage.filter(F.col("timestamp") >= cutoff)
    if token_ids is not None:
        recent = recent.join(token_ids.select("token_id"), "token_id", "left_semi")
    return recent.orderBy(F.col("timestamp").desc(), F.col("id"))


def classify_requests(requests: DataFrame, tokens: DataFrame, as_of, prefix: str = TOKEN_PREFIX) -> DataFrame:
    """Adds ``request_class``: ``exempt``, ``anonymous``, ``invalid`` or
    ``limited``. ``authorization`` is the header, ``token_id`` the token it
    resolves to."""
    state = tokens.select("token_id", state_column(as_of).alias("__state"))
    header = F.coalesce(F.col("authorization"), F.lit(""))
    exempt = F.col("path").isin(*PUBLIC_PATHS) | (F.col("method") == "OPTIONS")
    bad_text = ~F.substring(header, 8, 2**31 - 1).startswith(prefix)
    request_class = (
        F.when(exempt, F.lit("exempt"))
        .when(~header.startswith("Bearer "), F.lit("anonymous"))
        .when(bad_text | F.col("__state").isNull() | (F.col("__state") != "valid"), F.lit("invalid"))
        .otherwise(F.lit("limited"))
    )
    return requests.join(state, "token_id", "left").withColumn("request_class", request_class).drop("__state")


def usage_with_identity(usage: DataFrame, tokens: DataFrame) -> DataFrame:
    """Usage report rows with user and role; a response time of 0 or null
    reads ``N/A``."""
    who = tokens.select("token_id", "user_id", "role")
    ms = F.col("response_time_ms")
    return usage.join(who, "token_id").select(
        "id",
        "user_id",
        "role",
        iso_format(F.col("timestamp")).alias("timestamp"),
        "method",
        "endpoint",
        F.col("status_code").cast("string").alias("status"),
        F.when(F.coalesce(ms, F.lit(0)) != 0, F.concat(ms.cast("string"), F.lit("ms")))
        .otherwise(F.lit("N/A"))
        .alias("response_time"),
    )
