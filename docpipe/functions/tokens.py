"""Token counters. The whitespace counter and the estimate are native; user
callables and BPE run as Arrow-batched Python over the distributed rows."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from docpipe.functions.scalars import WHITESPACE
from docpipe.operators.assemble import assemble_text, joined_text

# Output keys of the standard encodings.
ENCODING_KEYS = {
    "cl100k_base": "openai_cl100k",
    "p50k_base": "openai_p50k",
    "claude": "claude_estimate",
}
ESTIMATE_FACTOR = 1.1


def whitespace_tokens(text: Column) -> Column:
    """Number of words as ``len(text.split())`` counts them.

    All white space becomes a blank and each word one letter; what is left
    without the blanks is counted. No array of words is built, and the pattern
    stays a single-character class, which is several times faster than one of
    all white space.
    """
    blanked = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    marks = F.regexp_replace(blanked, "[^ ]++", "w")
    return F.length(F.replace(marks, F.lit(" "), F.lit(""))).cast("bigint")


def estimate_tokens(base: Column, factor: float = ESTIMATE_FACTOR) -> Column:
    return F.floor(base.cast("double") * F.lit(factor)).cast("bigint")


def checked_counter(counter: Callable[[str], int]) -> Callable[[str], int | None]:
    """A user callable that gives null where it raises or returns anything but
    a non-negative whole number."""
    if not callable(counter):
        raise ValueError("tokenizer_func must be callable")

    def count(text: str) -> int | None:
        try:
            value = counter(text)
        except Exception:
            return None
        return value if isinstance(value, int) and value >= 0 else None

    return count


def python_counts(text: Column, counters: dict[str, Counter]) -> dict[str, Column]:
    """A column for each counter that needs Python, all from one pass: a text
    goes to Python once, however many count it."""
    makers = [c.counting if isinstance(c, BpeCounter) else (lambda f=checked_counter(c): f) for c in counters.values()]

    @F.pandas_udf("array<bigint>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = [make() for make in makers]
        for texts in batches:
            yield pd.Series([None if t is None else [count(t) for count in ready] for t in texts], dtype="object")

    every = counts(text)
    return {name: F.get(every, F.lit(i)) for i, name in enumerate(counters)}


class BpeCounter:
    """Byte-pair counter over a rank file (``base64-token rank`` per line).

    Ship the file with ``SparkContext.addFile`` and pass its bare name, or pass
    a path every worker can open. A text that contains a special token has no
    count, as encoding it is an error.
    """

    def __init__(self, name: str, rank_file: str, pattern: str, special_tokens: dict[str, int] | None = None):
        self.name = name
        self.rank_file = rank_file
        self.pattern = pattern
        self.special_tokens = special_tokens or {}

    def encoder(self):
        import tiktoken

        path = self.rank_file
        if not os.path.exists(path):
            path = SparkFiles.get(os.path.basename(path))
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        return tiktoken.Encoding(
            self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=self.special_tokens
        )

    def counting(self) -> Callable[[str], int | None]:
        encoder = self.encoder()

        def count(text: str) -> int | None:
            try:
                return len(encoder.encode(text))
            except Exception:
                return None

        return count


Counter = str | BpeCounter | Callable[[str], int]


def counter_columns(text: Column, counters: dict[str, Counter]) -> dict[str, Column]:
    """A column for each counter, in their order."""
    for counter in counters.values():
        if isinstance(counter, str) and counter != "whitespace":
            raise ValueError(f"Unknown token counter: {counter}")
    asked = {name: c for name, c in counters.items() if not isinstance(c, str)}
    counted = python_counts(text, asked) if asked else {}
    return {name: counted[name] if name in counted else whitespace_tokens(text) for name in counters}


def count_tokens(df: DataFrame, counters: Counter | dict[str, Counter], text_col: str = "text") -> DataFrame:
    """Add one BIGINT column per counter (null = that counter failed)."""
    named = counters if isinstance(counters, dict) else {_default_name(counters): counters}
    return df.withColumns(counter_columns(F.col(text_col), named))


def _default_name(counter: Counter) -> str:
    if isinstance(counter, str):
        return counter
    return getattr(counter, "name", None) or getattr(counter, "__name__", "custom")


def token_columns(text: Column, counters: dict[str, Counter], estimate_from: str | None = None) -> dict[str, Column]:
    """Columns for all counters, each text tokenised once; the estimate reuses
    the count it is based on."""
    columns = counter_columns(text, counters)
    if estimate_from is not None:
        columns[ENCODING_KEYS["claude"]] = estimate_tokens(columns[estimate_from])
    return columns


def counts_map(counts: dict[str, Column]) -> Column:
    """Map of the counters that succeeded."""
    if not counts:
        return F.create_map().cast("map<string,bigint>")
    pairs = [part for name, count in counts.items() for part in (F.lit(name), count)]
    return F.map_filter(F.create_map(*pairs), lambda _, count: count.isNotNull())


def token_map(pages: DataFrame, counters: dict[str, Counter], estimate_from: str | None = None,
              key: str = "doc_id") -> DataFrame:
    """``key, tokens``: map of all counters that succeeded over the joined
    raw page texts of a document."""
    text = assemble_text(pages, key=key)
    columns = token_columns(F.col("text"), counters, estimate_from)
    return text.select(key, counts_map(columns).alias("tokens"))


def with_token_map(docs: DataFrame, counters: dict[str, Counter], estimate_from: str | None = None) -> DataFrame:
    """The same for documents that carry their ``pages``: no second gathering."""
    columns = token_columns(F.col("__text"), counters, estimate_from)
    joined = docs.withColumn("__text", joined_text(F.col("pages")))
    return joined.withColumn("tokens", counts_map(columns)).drop("__text")
