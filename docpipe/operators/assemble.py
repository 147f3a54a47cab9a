"""Per-document aggregates over page rows.

All are hash aggregates with a partial step before the shuffle. The array of a
document's pages is the one value that is whole in a row, and the size rule of
`validate_files` bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_SEPARATOR = "\n\n"


def ordered_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, pages``: array of page structs in numeric page order."""
    fields = [c for c in pages.columns if c not in (key, "page_number")]
    page = F.struct("page_number", *fields)
    return pages.groupBy(key).agg(F.array_sort(F.collect_list(page), by_page_number).alias("pages"))


def by_page_number(a: Column, b: Column) -> Column:
    return F.when(a.page_number < b.page_number, -1).when(a.page_number > b.page_number, 1).otherwise(0)


def joined_text(pages: Column, sep: str = DEFAULT_SEPARATOR) -> Column:
    """Raw page texts joined, blank pages included: what tokenizers see."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p.text, F.lit(""))), sep)


def assemble_text(pages: DataFrame, sep: str = DEFAULT_SEPARATOR, key: str = "doc_id") -> DataFrame:
    slim = pages.select(key, "page_number", "text")
    return ordered_pages(slim, key).select(key, joined_text(F.col("pages"), sep).alias("text"))


def page_count(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"))


def collect_warnings(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, warnings`` from rows ``(key, kind, page_number, message, method,
    fallback)``: the fallback notice, then failed pages in page order."""
    message = F.when(
        F.col("kind") == "fallback",
        F.concat(
            F.lit("Primary extractor ("), F.col("method"), F.lit(") failed, using fallback ("),
            F.col("fallback"), F.lit(")"),
        ),
    ).otherwise(
        F.concat(
            F.lit("Page "), F.col("page_number").cast("string"), F.lit(" extraction failed: "), F.col("message")
        )
    )
    rank = F.when(F.col("kind") == "fallback", 0).otherwise(1)
    entry = F.struct(rank.alias("rank"), F.col("page_number"), message.alias("message"))
    return events.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.message).alias("warnings")
    )


def doc_result(docs: DataFrame, counts: DataFrame, warnings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: pages, token map, method, warnings. ``counts`` is
    ``(key, pages, tokens)``; a document without warnings gets an empty list."""
    return (
        docs.select(key, "extraction_method")
        .join(counts.select(key, "pages", "tokens"), key, "left")
        .join(warnings.select(key, "warnings"), key, "left")
        .select(
            key,
            F.coalesce("pages", F.lit(0)).alias("pages"),
            "tokens",
            "extraction_method",
            F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        )
    )
