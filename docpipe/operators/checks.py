"""Table constraints as data checks: each returns the violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from docpipe.functions.scalars import any_of


def check_primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their ``rows``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def check_enum(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is not in the list (null is not)."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def check_foreign_key(df: DataFrame, parent: DataFrame, column: str, parent_column: str | None = None) -> DataFrame:
    """Rows that point at no parent row."""
    keys = parent.select(F.col(parent_column or column).alias(column))
    return df.join(keys, column, "left_anti")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``column, nulls`` per column that holds nulls, in one pass."""
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return totals.select(F.inline(pairs)).filter(F.col("nulls") > 0)


def orphan_usage(usage: DataFrame, tokens: DataFrame) -> DataFrame:
    return check_foreign_key(usage, tokens, "token_id")


def violating_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows behind `check_not_null`."""
    return df.filter(any_of([F.col(c).isNull() for c in columns]))
