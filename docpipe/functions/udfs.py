"""SQL names for the scalar functions.

Native ones become temporary SQL functions, which Spark inlines into the plan;
user tokenizers are registered as Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from docpipe.functions.scalars import WHITESPACE
from docpipe.functions.tokens import ESTIMATE_FACTOR, BpeCounter

GRID = "ARRAY<ARRAY<STRING>>"


def _literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"


def _definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, body)."""
    spaces = _literal(WHITESPACE)
    digits = "substring(regexp_replace(raw, '^D:', ''), 1, 14)"
    field = (
        "CASE WHEN coalesce(c, '') RLIKE '[,\"\\r\\n]' "
        "THEN concat('\"', replace(c, '\"', '\"\"'), '\"') ELSE coalesce(c, '') END"
    )
    return {
        "strip_text": ("t STRING", "STRING", f"trim(BOTH {spaces} FROM t)"),
        "parse_pdf_date": (
            "raw STRING", "TIMESTAMP_NTZ",
            f"CASE WHEN {digits} RLIKE '^[0-9]{{14}}$' AND NOT startswith({digits}, '0000') THEN "
            f"try_cast(regexp_replace({digits}, '^(....)(..)(..)(..)(..)(..)$', '$1-$2-$3 $4:$5:$6') "
            "AS TIMESTAMP_NTZ) END",
        ),
        "count_tokens_whitespace": (
            "t STRING", "BIGINT",
            f"CAST(length(replace(regexp_replace(translate(t, {spaces}, "
            f"'{' ' * len(WHITESPACE)}'), '[^ ]++', 'w'), ' ', '')) AS BIGINT)",
        ),
        "estimate_tokens": (
            "base BIGINT", "BIGINT", f"CAST(floor(CAST(base AS DOUBLE) * {ESTIMATE_FACTOR}D) AS BIGINT)",
        ),
        "table_markdown": (
            f"g {GRID}", "STRING",
            "CASE WHEN size(get(g, 0)) > 0 THEN array_join(concat("
            "array(concat('| ', array_join(get(g, 0), ' | ', ''), ' |'), "
            "concat('| ', array_join(array_repeat('---', size(get(g, 0))), ' | '), ' |')), "
            "transform(slice(g, 2, greatest(size(g) - 1, 0)), r -> concat('| ', array_join(slice(concat(r, "
            "array_repeat('', greatest(size(get(g, 0)) - size(r), 0))), 1, size(get(g, 0))), ' | ', ''), ' |'))"
            "), '\\n') ELSE '' END",
        ),
        "table_html": (
            f"g {GRID}", "STRING",
            "CASE WHEN size(g) > 0 THEN array_join(concat(array('<table>', '  <thead>', '    <tr>'), "
            "transform(get(g, 0), c -> concat('      <th>', coalesce(c, ''), '</th>')), "
            "array('    </tr>', '  </thead>'), "
            "CASE WHEN size(g) > 1 THEN concat(array('  <tbody>'), flatten(transform(slice(g, 2, size(g) - 1), "
            "r -> concat(array('    <tr>'), transform(r, c -> concat('      <td>', coalesce(c, ''), '</td>')), "
            "array('    </tr>')))), array('  </tbody>')) ELSE CAST(array() AS ARRAY<STRING>) END, "
            "array('</table>')), '\\n') ELSE '' END",
        ),
        "table_code": (
            f"g {GRID}", "STRING",
            "CASE WHEN size(g) > 0 THEN array_join(concat(array('```'), "
            "transform(g, r -> array_join(r, '\\t', '')), array('```')), '\\n') ELSE '' END",
        ),
        "table_csv": (
            f"g {GRID}", "STRING",
            f"CASE WHEN size(g) > 0 THEN rtrim({spaces}, array_join(transform(g, r -> "
            "CASE WHEN size(r) = 1 AND coalesce(get(r, 0), '') = '' THEN '\"\"' "
            f"ELSE array_join(transform(r, c -> {field}), ',') END), '\\r\\n')) ELSE '' END",
        ),
    }


def register_udfs(
    spark: SparkSession, counters: dict[str, BpeCounter | Callable[[str], int]] | None = None
) -> list[str]:
    """Registers the functions and returns their names."""
    definitions = _definitions()
    for name, (parameters, returns, body) in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    names = list(definitions)
    for name, counter in (counters or {}).items():
        spark.udf.register(name, _counter_udf(counter))
        names.append(name)
    return names


def _counter_udf(counter):
    if not isinstance(counter, BpeCounter) and not callable(counter):
        raise ValueError("tokenizer_func must be callable")

    @F.pandas_udf("bigint")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = counter.encoder() if isinstance(counter, BpeCounter) else None

        def count(text: str | None) -> int | None:
            if text is None:
                return None
            try:
                value = len(encoder.encode(text)) if encoder else counter(text)
            except Exception:
                return None
            return value if isinstance(value, int) and value >= 0 else None

        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="Int64")

    return counts
