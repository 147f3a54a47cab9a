"""Corpus conversion and job submission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.functions.scalars import as_timestamp, has_permission
from docpipe.functions.tokens import Counter, counts_map, token_columns
from docpipe.operators.assemble import DEFAULT_SEPARATOR, joined_text
from docpipe.operators.extract import extract_with_fallback
from docpipe.operators.render import documents_content, with_doc_fields
from docpipe.operators.validate import check_upload, content_hash, validate_files
from docpipe.plans.ids import unique_ids
from docpipe.schemas import OUTPUT_FORMATS

RESULT_COLUMNS = ("output_format", "content", "source_hash", "page_count", "tokens", "extraction_method", "warnings")
LEDGER_COLUMNS = ("path", "status", "error_message", "source_hash", "page_count", "tokens")


def convert_corpus(
    files: DataFrame,
    output_format: str | Column = "markdown",
    counters: dict[str, Counter] | None = None,
    estimate_from: str | None = None,
    extractors: Sequence = ("utf8", "latin1"),
    lines_per_page: int | None = None,
    max_size_mb: float = 100,
    include_frontmatter: bool | Column = True,
    page_separator: str = DEFAULT_SEPARATOR,
    converted_at: str | None = None,
    timeout_seconds: float | None = None,
) -> DataFrame:
    """One outcome row per input file: COMPLETED with its content, or FAILED
    with a message. No document can fail the job.

    Pages stay in the row of their document from extraction to rendering, so
    with the bundled extractors the whole plan is one pass without a shuffle.
    Select only ledger columns and Spark drops the rendering from the plan.
    ``converted_at`` is the time of the run unless given.
    """
    keys = [c for c in files.columns if c not in ("size", "modified", "content", "exists", "is_file")]
    if not isinstance(output_format, Column) and output_format not in OUTPUT_FORMATS:
        raise ValueError(f"Unsupported format: {output_format}")
    formats = OUTPUT_FORMATS if isinstance(output_format, Column) else (output_format,)
    chosen = output_format if isinstance(output_format, Column) else F.lit(output_format)

    checked = validate_files(files, max_size_mb).withColumnRenamed("error", "rule_error")
    checked = checked.withColumn("content", F.when(F.col("is_valid"), F.col("content")))
    hashed = content_hash(checked.withColumn("output_format", chosen))
    extracted = extract_with_fallback(hashed, extractors, lines_per_page, timeout_seconds)

    counts = token_columns(F.col("full_text"), counters or {}, estimate_from)
    source = F.element_at(F.split("path", "/"), -1)
    described = (
        extracted.withColumn("full_text", joined_text(F.col("pages")))
        .withColumn("tokens", counts_map(counts))
        .select(
            *[c for c in keys if c != "output_format"],
            "output_format",
            "is_valid",
            "rule_error",
            F.col("error").alias("extract_error"),
            "pages",
            "tokens",
            "warnings",
            "source_hash",
            source.alias("source_file"),
            F.col("method").alias("extraction_method"),
            F.coalesce("seconds", F.lit(0.0)).alias("extraction_time_seconds"),
            "metadata.*",
        )
    )
    content, format_error = documents_content(
        F.col("output_format"), F.col("pages"), include_frontmatter,
        page_separator=page_separator, formats=formats,
    )
    error = (
        F.when(~F.col("is_valid"), F.concat(F.lit("PDF validation failed: "), F.col("rule_error")))
        .when(F.col("extract_error").isNotNull(), F.col("extract_error"))
        .otherwise(format_error)
    )
    rendered = with_doc_fields(described, converted_at).withColumn("error_message", error)
    done = F.col("error_message").isNull()
    return rendered.select(
        *[c for c in keys if c != "output_format"],
        F.when(done, F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
        "error_message",
        "source_hash",
        "extraction_method",
        "page_count",
        "tokens",
        "warnings",
        "output_format",
        F.when(done, content).alias("content"),
    )


def conversion_results(converted: DataFrame, *keys: str) -> DataFrame:
    """The documents that were converted."""
    return converted.filter(F.col("status") == "COMPLETED").select(*keys, *RESULT_COLUMNS)


def conversion_ledger(converted: DataFrame, *keys: str) -> DataFrame:
    """One row per input, without content."""
    return converted.select(*keys, *LEDGER_COLUMNS)


def assign_job_ids(df: DataFrame, key_cols: Sequence[str], existing: DataFrame | None = None,
                   out: str = "job_id", length: int = 10) -> DataFrame:
    """Adds a 10-character id that is unique in the batch and not in
    ``existing`` (see `unique_ids`)."""
    return unique_ids(df, key_cols, out, existing, length=length)


def upload_outcome(requests: DataFrame) -> DataFrame:
    """Adds ``status_code, detail``: 403 without the right to create jobs, then
    the rules of `check_upload`."""
    checked = check_upload(requests)
    allowed = has_permission(F.col("role"), "create_job")
    refusal = F.concat(
        F.lit("Role '"), F.coalesce("role", F.lit("None")), F.lit("' does not have permission to create jobs")
    )
    return checked.withColumns(
        {
            "status_code": F.when(~allowed, F.lit(403)).otherwise(F.col("status_code")),
            "detail": F.when(~allowed, refusal).otherwise(F.col("detail")),
        }
    )


def submit_jobs(requests: DataFrame, as_of, key_cols: Sequence[str] = ("request_id",),
                existing: DataFrame | None = None, uploads_dir: str = "data/uploads") -> DataFrame:
    """PENDING job rows for accepted uploads ``user_id, role, filename,
    output_format, extractor[, include_metadata]``. Returns the job columns
    plus ``key_cols``."""
    accepted = upload_outcome(requests).filter(F.col("status_code") == 200)
    with_metadata = F.col("include_metadata") if "include_metadata" in requests.columns else F.lit(True)
    options = F.format_string(
        '{"output_format": "%s", "extractor": "%s", "include_metadata": %s}',
        F.col("output_format"), F.col("extractor"), with_metadata.cast("string"),
    )
    path = F.concat(
        F.lit(f"{uploads_dir}/"), F.col("user_id").cast("string"), F.lit("_"), F.col("filename")
    )
    none = F.lit(None)
    jobs = accepted.select(
        *key_cols,
        F.col("user_id").alias("owner_user_id"),
        path.alias("pdf_path"),
        F.lit("PENDING").alias("status"),
        none.cast("string").alias("result_path"),
        none.cast("string").alias("error_message"),
        as_timestamp(as_of).alias("created_at"),
        none.cast("timestamp_ntz").alias("started_at"),
        none.cast("timestamp_ntz").alias("completed_at"),
        F.lit(False).alias("throttled"),
        none.cast("string").alias("throttled_by"),
        options.alias("options"),
    )
    return assign_job_ids(jobs, [*key_cols, "pdf_path", "owner_user_id", "created_at"], existing)
