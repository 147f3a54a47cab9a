"""Labelled documents: held-out rows and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folds by crc32 of the id; fold 0 is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """``labels`` (doc_id, target) -> doc_id, label of at most ``bound`` rows
    that are not held out, in the order of a hash of the id. Rows with a null
    id or label, or a label other than 0 and 1, are left out; of a repeated id
    the greatest label counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
