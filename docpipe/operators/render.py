"""Rendering of documents as text, Markdown, JSON and YAML.

Column functions work on an array of page structs inside a document row, so a
row that already holds its pages is rendered without a shuffle. The operators
also accept page rows, which they first gather per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.functions.images import image_lines
from docpipe.functions.scalars import iso_format, none_if_empty, rstrip_text, strip_text
from docpipe.functions.tables import render_page_tables
from docpipe.functions.yaml_text import json_to_yaml
from docpipe.operators.assemble import DEFAULT_SEPARATOR, ordered_pages
from docpipe.schemas import (
    CONVERTER_VERSION, EMPTY_IMAGES, EMPTY_TABLES, OUTPUT_FORMATS, PDF_FIELDS,
)

#: Optional document columns and the type used for one that is missing.
DOC_FIELDS = {
    "source_file": "string", "source_hash": "string", "converted_at": "string",
    "tokens": "map<string,bigint>", "extraction_method": "string",
    "extraction_time_seconds": "double", "warnings": "array<string>", **dict(PDF_FIELDS),
}


def visible_texts(pages: Column) -> Column:
    """Stripped texts of the pages that are not blank."""
    texts = F.transform(pages, lambda p: strip_text(F.coalesce(p.text, F.lit(""))))
    return F.filter(texts, lambda t: t != "")


def text_content(pages: Column, page_separator: str = DEFAULT_SEPARATOR) -> Column:
    return F.coalesce(F.array_join(visible_texts(pages), page_separator), F.lit(""))


def markdown_content(pages: Column, frontmatter: Column | None = None) -> Column:
    """Each shown page followed by a blank line, after the optional frontmatter."""
    body = F.flatten(F.transform(visible_texts(pages), lambda t: F.array(t, F.lit(""))))
    body = F.coalesce(body, F.array().cast("array<string>"))
    if frontmatter is not None:
        body = F.concat(F.array(F.lit("---"), frontmatter, F.lit("---"), F.lit("")), body)
    return F.array_join(body, "\n")


def _seconds() -> Column:
    return F.bround("extraction_time_seconds", 3)


def frontmatter_json(include_tokens: bool = True) -> Column:
    """Frontmatter fields as JSON text; null and empty ones left out."""
    tokens = F.col("tokens") if include_tokens else F.lit(None).cast("map<string,bigint>")
    return F.to_json(
        F.struct(
            none_if_empty(F.col("source_file")).alias("source_file"),
            none_if_empty(F.col("source_hash")).alias("source_hash"),
            F.col("converted_at"),
            F.lit(CONVERTER_VERSION).alias("converter_version"),
            none_if_empty(F.col("title")).alias("title"),
            none_if_empty(F.col("author")).alias("author"),
            F.col("page_count").alias("pages"),
            F.when(F.size(tokens) > 0, tokens).alias("tokens"),
            F.col("extraction_method"),
            _seconds().alias("extraction_time_seconds"),
            F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"),
        )
    )


def document_json(pages: Column) -> Column:
    """Whole document as compact JSON; keys with null values are kept."""
    pdf = [
        (iso_format(F.col(name)) if name.endswith("_date") else F.col(name)).alias(name)
        for name, _ in PDF_FIELDS
    ]
    metadata = F.struct(
        none_if_empty(F.col("source_file")).alias("source_file"),
        none_if_empty(F.col("source_hash")).alias("source_hash"),
        F.col("converted_at"),
        F.lit(CONVERTER_VERSION).alias("converter_version"),
        F.struct(*pdf).alias("pdf"),
        F.when(F.size("tokens") > 0, F.col("tokens")).alias("tokens"),
        F.col("extraction_method"),
        _seconds().alias("extraction_time_seconds"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )
    return F.to_json(
        F.struct(metadata.alias("metadata"), pages.alias("pages")), {"ignoreNullFields": "false"}
    )


def now_text() -> Column:
    """The time the query started, as ISO 8601 with the session's offset."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def with_doc_fields(docs: DataFrame, converted_at: str | None = None) -> DataFrame:
    """Adds the document columns a table lacks, as nulls of the right type;
    ``converted_at`` is the time of the query if it is neither there nor given."""
    missing = {
        name: F.lit(None).cast(dtype) for name, dtype in DOC_FIELDS.items() if name not in docs.columns
    }
    if converted_at is not None:
        missing["converted_at"] = F.lit(converted_at)
    elif "converted_at" in missing:
        missing["converted_at"] = now_text()
    return docs.withColumns(missing) if missing else docs


def with_pages(docs: DataFrame, pages: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Documents with a full-width ``pages`` array. ``pages=None`` means the
    documents already carry one; documents without pages get an empty array."""
    if pages is None:
        return docs
    defaults = {
        "images": F.array().cast(EMPTY_IMAGES), "tables": F.array().cast(EMPTY_TABLES),
        "width": F.lit(0.0), "height": F.lit(0.0),
    }
    full = pages.select(
        key, "page_number", "text",
        *[(F.col(n) if n in pages.columns else d).alias(n) for n, d in defaults.items()],
    )
    gathered = ordered_pages(full, key)
    empty = F.array().cast(gathered.schema["pages"].dataType)
    return docs.join(gathered, key, "left").withColumn("pages", F.coalesce("pages", empty))


def _texts_only(docs: DataFrame, pages: DataFrame | None, key: str) -> DataFrame:
    """Like `with_pages`, but only page number and text cross the shuffle."""
    if pages is None:
        return docs
    gathered = ordered_pages(pages.select(key, "page_number", "text"), key)
    return docs.join(gathered, key, "left")


def render_text(docs: DataFrame, pages: DataFrame | None = None,
                page_separator: str = DEFAULT_SEPARATOR, key: str = "doc_id") -> DataFrame:
    joined = _texts_only(docs, pages, key)
    return joined.select(key, text_content(F.col("pages"), page_separator).alias("content"))


def render_markdown(docs: DataFrame, pages: DataFrame | None = None, include_frontmatter: bool = True,
                    include_tokens: bool = True, converted_at: str | None = None,
                    key: str = "doc_id") -> DataFrame:
    joined = with_doc_fields(_texts_only(docs, pages, key), converted_at)
    front = None
    if include_frontmatter:
        front = rstrip_text(json_to_yaml(frontmatter_json(include_tokens)))
    return joined.select(key, markdown_content(F.col("pages"), front).alias("content"))


def frontmatter(docs: DataFrame, include_tokens: bool = True, converted_at: str | None = None,
                key: str = "doc_id") -> DataFrame:
    full = with_doc_fields(docs, converted_at)
    return full.select(key, rstrip_text(json_to_yaml(frontmatter_json(include_tokens))).alias("frontmatter"))


def render_json(docs: DataFrame, pages: DataFrame | None = None, converted_at: str | None = None,
                key: str = "doc_id") -> DataFrame:
    joined = with_doc_fields(with_pages(docs, pages, key), converted_at)
    return joined.select(key, document_json(F.col("pages")).alias("content"))


def render_yaml(docs: DataFrame, pages: DataFrame | None = None, converted_at: str | None = None,
                key: str = "doc_id") -> DataFrame:
    joined = with_doc_fields(with_pages(docs, pages, key), converted_at)
    return joined.select(key, json_to_yaml(document_json(F.col("pages"))).alias("content"))


def documents_content(
    output_format: Column, pages: Column, include_frontmatter: Column | bool = True,
    include_tokens: bool = True, page_separator: str = DEFAULT_SEPARATOR, formats=OUTPUT_FORMATS,
) -> tuple[Column, Column]:
    """``(content, error)`` of rows that choose their own format.

    One Python pass serves both YAML uses, with null for rows that need none;
    formats that cannot occur are left out of the plan.
    """
    wants_front = include_frontmatter if isinstance(include_frontmatter, Column) else F.lit(include_frontmatter)
    yaml_source = F.lit(None).cast("string")
    if "yaml" in formats:
        yaml_source = F.when(output_format == "yaml", document_json(pages)).otherwise(yaml_source)
    if "markdown" in formats and include_frontmatter is not False:
        yaml_source = F.when(
            (output_format == "markdown") & wants_front, frontmatter_json(include_tokens)
        ).otherwise(yaml_source)
    needs_python = "yaml" in formats or ("markdown" in formats and include_frontmatter is not False)
    yaml_text = json_to_yaml(yaml_source) if needs_python else yaml_source
    content = F.lit(None).cast("string")
    if "yaml" in formats:
        content = F.when(output_format == "yaml", yaml_text).otherwise(content)
    if "json" in formats:
        content = F.when(output_format == "json", document_json(pages)).otherwise(content)
    if "text" in formats:
        content = F.when(output_format == "text", text_content(pages, page_separator)).otherwise(content)
    if "markdown" in formats:
        plain = F.when(output_format == "markdown", markdown_content(pages))
        content = plain.otherwise(content) if include_frontmatter is False else F.when(
            (output_format == "markdown") & wants_front, markdown_content(pages, rstrip_text(yaml_text))
        ).otherwise(plain.otherwise(content))
    known = F.coalesce(output_format.isin(*OUTPUT_FORMATS), F.lit(False))
    error = F.when(
        ~known, F.concat(F.lit("Unsupported format: "), F.coalesce(output_format, F.lit("None")))
    )
    return content, error


def render_documents(docs: DataFrame, pages: DataFrame | None = None, converted_at: str | None = None,
                     include_frontmatter: bool = True, formats=OUTPUT_FORMATS,
                     key: str = "doc_id") -> DataFrame:
    """``key, output_format, content, error``: each document in the format its
    row names; an unknown format is an error row."""
    joined = with_doc_fields(with_pages(docs, pages, key), converted_at)
    content, error = documents_content(
        F.col("output_format"), F.col("pages"), include_frontmatter, formats=formats
    )
    return joined.select(key, "output_format", content.alias("content"), error.alias("error"))


def render_tables(pages: DataFrame, fmt: str = "markdown", key: str = "doc_id") -> DataFrame:
    return pages.select(key, "page_number", render_page_tables(F.col("tables"), fmt).alias("content"))


def image_refs(pages: DataFrame, mode: str = "reference", output_dir: str | None = None,
               key: str = "doc_id") -> DataFrame:
    lines = image_lines(F.col("images"), F.col("page_number"), mode, output_dir)
    return pages.select(key, "page_number", lines.alias("content"))


def image_boxes(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    return image_refs(pages, "base64", key=key)
