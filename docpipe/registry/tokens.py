"""Token counters and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.functions import tokens
from docpipe.functions.scalars import map_as_text
from docpipe.functions.udfs import register_udfs
from docpipe.registry import query
from docpipe.registry.rendering import MARKDOWN_TABLE, grids
from docpipe.registry.text import strip, words


def rank_file_counter():
    """A public byte-level rank file if one is installed, else None."""
    try:
        import public_tokenizers
    except ImportError:
        return None
    return tokens.BpeCounter(
        "bpe", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        {"<|endoftext|>": 50256},
    )


@query("count_tokens_whitespace", f"SELECT doc_id, {words('text')} AS whitespace FROM documents")
def count_tokens_whitespace(x):
    return tokens.count_tokens(x.table("documents"), "whitespace").select("doc_id", "whitespace")


def split_words(text: str) -> int:
    return len(text.split())


def failing(text: str) -> int:
    return -1


@query("count_tokens_custom", f"""
SELECT doc_id, {words('text')} AS words, CAST(NULL AS BIGINT) AS failing FROM documents""")
def count_tokens_custom(x):
    counted = tokens.count_tokens(x.table("documents"), {"words": split_words, "failing": failing})
    return counted.select("doc_id", "words", "failing")


@query("count_tokens_bpe")
def count_tokens_bpe(x):
    counter = rank_file_counter()
    if counter is None:
        raise RuntimeError("no rank file is installed")
    return tokens.count_tokens(x.table("documents"), {"bpe": counter}).select("doc_id", "bpe")


@query("estimate_tokens", f"SELECT doc_id, n + n // 10 AS estimate FROM (SELECT doc_id, {words('text')} AS n FROM documents)")
def estimate_tokens(x):
    count = tokens.whitespace_tokens(F.col("text"))
    return x.table("documents").select("doc_id", tokens.estimate_tokens(count).alias("estimate"))


@query("token_map", f"""
SELECT doc_id, concat('claude_estimate=', n + n // 10, ';openai_cl100k=', n, ';words=', n) AS tokens
FROM (SELECT doc_id, CAST(sum({words('text')}) AS BIGINT) AS n FROM fx_pages GROUP BY doc_id)""")
def token_map(x):
    # The whitespace counter stands in for the standard encoding, so that SQL
    # can follow; the failing counter must be absent.
    counters = {"openai_cl100k": "whitespace", "words": split_words, "failing": failing}
    found = tokens.token_map(x("fx_pages"), counters, estimate_from="openai_cl100k")
    return found.withColumn("tokens", map_as_text(F.col("tokens")))


@query("register_udfs", f"""
SELECT doc_id, {strip('text')} AS stripped, {words('text')} AS n_words,
  {words('text')} + {words('text')} // 10 AS estimate FROM documents""")
def sql_functions(x):
    register_udfs(x.spark)
    x.table("documents").createOrReplaceTempView("documents")
    return x.spark.sql(
        "SELECT doc_id, strip_text(text) AS stripped, count_tokens_whitespace(text) AS n_words, "
        "estimate_tokens(count_tokens_whitespace(text)) AS estimate FROM documents"
    )


@query("register_udfs_tables", MARKDOWN_TABLE)
def sql_table_functions(x):
    register_udfs(x.spark)
    return grids(x).selectExpr("doc_id", "table_markdown(grid) AS content")
