"""Vectors in tables: which take part, and as packed numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null or empty, no null, NaN or infinite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled with zeros."""
    lengths = np.array(pa.compute.list_value_length(column).to_pylist(), int)
    flat = np.asarray(column.flatten(), float)
    if len(lengths) == 0:
        return np.empty((0, 0))
    if (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), lengths.max()))
    out[np.arange(lengths.max()) < lengths[:, None]] = flat
    return out


def plain(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("array<double>"))
