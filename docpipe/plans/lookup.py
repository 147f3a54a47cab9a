"""Point lookups in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row per wanted key with the table's columns, null if missing.

    The table is first cut to the wanted keys. A short list is broadcast into
    that semi join, so only matching rows are shuffled; with a long one both
    joins use the same partitioning and the table still moves once.
    """
    keys = wanted.select(key)
    found = table.join(keys, key, "left_semi")
    return keys.join(found, key, "left")
