"""Ordered operations inside groups of any size.

A window over ``partitionBy(key)`` sends all rows of a key to one task. Where a
key may hold a large share of the table, the order column is cut into slices:
rows are ranked inside (key, slice), and the rows in earlier slices of the key
are added from a small pre-aggregated count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def sliced_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_id: Column, out: str
) -> DataFrame:
    """1-based position of each row in its group (BIGINT).

    ``slice_id`` must grow with ``order`` (rows of a lower slice come first).
    Null keys and slices are values like others; every row is kept. The sort work of a group is spread over
    its slices; only one count per (group, slice) meets in one task.
    """
    sliced = df.withColumn("__slice", slice_id)
    group = [*keys, "__slice"]
    counts = sliced.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    earlier = (
        Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(*group, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    named = offsets.select(*(F.col(c).alias(f"__of_{c}") for c in group), "__before")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group))
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        sliced.withColumn("__local", local)
        .join(named, same)
        .withColumn(out, F.col("__before") + F.col("__local"))
        .drop("__slice", "__local", "__before", *(f"__of_{c}" for c in group))
    )
