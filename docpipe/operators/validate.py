"""File and upload validation, hashes and file facts.

A *file table* has ``path, size, modified, content`` and optionally
``exists`` / ``is_file`` for manifests that list what was asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.functions.scalars import iso_format
from docpipe.operators.extract import Backend, probe, read_metadata
from docpipe.schemas import EXTRACTORS, OUTPUT_FORMATS, PDF_FIELDS

MEGABYTE = 1024 * 1024
PDF_SIGNATURE = b"%PDF-"
HASHES = {"sha256": lambda c: F.sha2(c, 256), "md5": F.md5, "sha1": F.sha1}


def file_error(files: DataFrame, max_size_mb: float = 100, signature: bytes = PDF_SIGNATURE) -> Column:
    """Message of the first rule a file breaks, ``''`` when it breaks none.

    The size rules come before the only one that looks at the bytes.
    """
    size, path = F.col("size"), F.col("path")
    present = F.col("exists") if "exists" in files.columns else size.isNotNull()
    regular = F.col("is_file") if "is_file" in files.columns else F.lit(True)
    limit = f"{max_size_mb:g}"
    size_text = F.format_string("%.1f", F.bround(size / F.lit(MEGABYTE), 1))
    head = F.substring(F.col("content"), 1, len(signature))
    return (
        F.when(~F.coalesce(present, F.lit(False)), F.concat(F.lit("File does not exist: "), path))
        .when(~regular, F.concat(F.lit("Path is not a file: "), path))
        .when(size == 0, F.lit("File is empty"))
        .when(
            size > F.lit(int(max_size_mb * MEGABYTE)),
            F.concat(F.lit("File too large: "), size_text, F.lit(f" MB (max: {limit} MB)")),
        )
        .when(F.col("content").isNull(), F.concat(F.lit("Failed to read file: "), path))
        .when(head != F.lit(signature), F.lit("File is not a valid PDF (invalid signature)"))
        .otherwise(F.lit(""))
    )


def validate_files(files: DataFrame, max_size_mb: float = 100, signature: bytes = PDF_SIGNATURE) -> DataFrame:
    """Adds ``is_valid`` and ``error``."""
    checked = files.withColumn("error", file_error(files, max_size_mb, signature))
    return checked.withColumn("is_valid", F.col("error") == "")


def hash_column(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm not in HASHES:
        raise ValueError(f"Unsupported hash algorithm: {algorithm}")
    return HASHES[algorithm](content)


def content_hash(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Adds ``content_hash`` (hex) and ``source_hash`` (``algorithm:hex``)."""
    digest = hash_column(F.col("content"), algorithm)
    return files.withColumn("content_hash", digest).withColumn(
        "source_hash", F.concat(F.lit(f"{algorithm}:"), F.col("content_hash"))
    )


def file_info(files: DataFrame) -> DataFrame:
    """Path, sizes, time, readability and SHA-256 of each file; key columns
    other than the file table's own are kept in front."""
    own = {"path", "size", "modified", "content", "exists", "is_file"}
    keys = [c for c in files.columns if c not in own]
    return files.select(
        *keys,
        "path",
        F.col("size").alias("size_bytes"),
        (F.col("size") / F.lit(float(MEGABYTE))).alias("size_mb"),
        F.col("modified").alias("modified"),
        F.col("content").isNotNull().alias("is_readable"),
        hash_column(F.col("content")).alias("sha256"),
    )


def doc_info(files: DataFrame, docs: DataFrame | None = None, key: str = "doc_id", max_size_mb: float = 100,
             extractors: Sequence[str | Backend] = ("utf8", "latin1"), lines_per_page: int | None = None,
             timeout_seconds: float | None = None) -> DataFrame:
    """``key, info``: nested JSON of file facts and document metadata, for
    valid files only. The metadata comes from the extractors, which are tried
    in order and make no pages; a file that none can read is left out. With
    ``docs`` it is taken from that table instead."""
    valid = validate_files(files, max_size_mb).filter("is_valid").drop("is_valid", "error")
    modified = iso_format(F.col("modified")).alias("modified")
    file_part = F.struct("path", "size_bytes", "size_mb", modified, "is_readable", "sha256")
    wanted = [name for name, _ in PDF_FIELDS if name != "file_size_bytes"]

    def pdf_part(of: str = "") -> Column:
        return F.struct(*[(iso_format(F.col(of + n)) if n.endswith("_date") else F.col(of + n)).alias(n) for n in wanted])

    info = F.to_json(F.struct(F.col("file"), F.col("pdf")), {"ignoreNullFields": "false"})
    if docs is not None:
        facts = file_info(valid).select(key, file_part.alias("file"))
        return facts.join(docs.select(key, pdf_part().alias("pdf")), key).select(key, info.alias("info"))
    known = read_metadata(valid, extractors, lines_per_page, timeout_seconds).filter(F.col("method").isNotNull())
    own = [c for c in valid.columns if c not in ("path", "size", "modified", "content", "exists", "is_file")]
    facts = known.select(*own, "metadata", "path", "size", "modified", "content")
    return file_info(facts).select(key, file_part.alias("file"), pdf_part("metadata.").alias("pdf")).select(key, info.alias("info"))


def validation_report(files: DataFrame, backends: dict[str, Column] | Sequence[str | Backend] = ("utf8", "latin1"),
                      key: str = "doc_id", max_size_mb: float = 100, page_count: Column | None = None,
                      lines_per_page: int | None = None, timeout_seconds: float | None = None) -> DataFrame:
    """Long form ``key, position, check, result``; a file that breaks a rule
    has that one row only. ``backends`` are asked whether they can read the
    content and then, in order, for its metadata; no page is made. Instead of
    them it may map names to boolean columns, with a ``page_count``."""
    if not isinstance(backends, dict):
        names = [b if isinstance(b, str) else b.name for b in backends]
        broken = file_error(files, max_size_mb) != ""
        # Files that break a rule are not shown to the back ends.
        shown = files.withColumn("__content", F.col("content")).withColumn("content", F.when(~broken, F.col("content")))
        asked = read_metadata(probe(shown, backends, timeout_seconds), backends, lines_per_page, timeout_seconds)
        files = asked.withColumn("content", F.col("__content")).drop("__content", "error")
        columns = {name: F.coalesce(F.col("readable")[name], F.lit(False)) for name in names}
        got = F.col("method").isNotNull()
        return _report(files, columns, key, max_size_mb, got, F.col("metadata.page_count"), F.col("metadata.encrypted"))
    readable = F.lit(False)
    for can_extract in backends.values():
        readable = readable | can_extract
    return _report(files, backends, key, max_size_mb, readable, page_count, F.lit(False))


def _report(files: DataFrame, backends: dict[str, Column], key: str, max_size_mb: float, readable: Column,
            page_count: Column | None, encrypted: Column) -> DataFrame:
    error = file_error(files, max_size_mb)
    size = F.col("size")
    size_text = F.concat(
        F.format_string("%.2f", F.bround(size / F.lit(MEGABYTE), 2)), F.lit(" MB ("),
        F.format_number(size, 0), F.lit(" bytes)"),
    )

    def row(check: str, result: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), result.alias("result"))

    pages = F.coalesce(page_count.cast("string"), F.lit("0")) if page_count is not None else F.lit("0")
    probes = [
        row(name, F.when(ok, F.lit("Can extract")).otherwise(F.lit("Cannot extract")))
        for name, ok in backends.items()
    ]
    facts = F.array(
        row("File Validation", F.lit("PASS")),
        row("File Size", size_text),
        row("SHA256 Hash", hash_column(F.col("content"))),
        *probes,
        row("Metadata Extraction", F.when(readable, F.lit("Success")).otherwise(F.lit("Failed"))),
    )
    locked = F.when(F.coalesce(encrypted, F.lit(False)), F.lit("Yes")).otherwise(F.lit("No"))
    metadata = F.when(
        readable, F.array(row("Page Count", pages), row("Encrypted", locked))
    ).otherwise(F.array().cast("array<struct<check:string,result:string>>"))
    failed = F.array(row("File Validation", F.concat(F.lit("FAIL: "), error)))
    report = F.when(error == "", F.concat(facts, metadata)).otherwise(failed)
    return files.select(key, F.posexplode_outer(report).alias("position", "entry")).select(
        key, F.col("position"), F.col("entry.check").alias("check"), F.col("entry.result").alias("result")
    )


def check_upload(requests: DataFrame) -> DataFrame:
    """Adds ``status_code`` (200 or 400) and ``detail`` of the first broken
    request rule. The file extension is case-sensitive."""
    filename = F.coalesce(F.col("filename"), F.lit(""))
    rules = [
        (filename == "", "File name is required"),
        (~filename.endswith(".pdf"), "Only PDF files are supported"),
        (
            ~F.coalesce(F.col("output_format").isin(*OUTPUT_FORMATS), F.lit(False)),
            f"Invalid output format. Must be one of: {', '.join(OUTPUT_FORMATS)}",
        ),
        (
            ~F.coalesce(F.col("extractor").isin(*EXTRACTORS), F.lit(False)),
            f"Invalid extractor. Must be one of: {', '.join(EXTRACTORS)}",
        ),
    ]
    detail = F.lit("")
    for broken, message in reversed(rules):
        detail = F.when(broken, F.lit(message)).otherwise(detail)
    return requests.withColumn("detail", detail).withColumn(
        "status_code", F.when(F.col("detail") == "", F.lit(200)).otherwise(F.lit(400))
    )
