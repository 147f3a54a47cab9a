"""Generic document collections: a DataFrame per collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from docpipe.functions.scalars import all_of
from docpipe.plans.ids import unique_ids
from docpipe.plans.lookup import lookup


def collection_insert(coll: DataFrame, rows: DataFrame, id_col: str, key_cols: Sequence[str]) -> DataFrame:
    """Collection with ``rows`` added. Rows without an id get one hashed from
    ``key_cols`` that neither a stored nor another new row has (see
    `unique_ids`); given ids are kept. Columns either side lacks become null."""
    given = "__given" if id_col in rows.columns else None
    named = rows.withColumnRenamed(id_col, given) if given else rows
    added = unique_ids(named, key_cols, id_col, coll, given=given, first_attempt=())
    return coll.unionByName(added.drop("__given"), allowMissingColumns=True)


def collection_get(coll: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """One row per wanted id, nulls if missing."""
    return lookup(ids, coll, id_col)


def collection_update(coll: DataFrame, updates: DataFrame, fields: Sequence[str], id_col: str) -> DataFrame:
    """Collection with the listed fields replaced in matched rows; a null in
    an update is a value. One update per id."""
    new = updates.select(id_col, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__hit"))
    merged = {
        f: F.when(F.col("__hit"), F.col(f"__{f}")).otherwise(F.col(f) if f in coll.columns else F.lit(None))
        for f in fields
    }
    return coll.join(new, id_col, "left").withColumns(merged).drop("__hit", *[f"__{f}" for f in fields])


def collection_delete(coll: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return coll.join(ids.select(id_col), id_col, "left_anti")


def collection_flags(coll: DataFrame, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """Per id: did the update or delete meet a row."""
    known = coll.select(id_col).distinct().withColumn(flag, F.lit(True))
    return ids.select(id_col).join(known, id_col, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def collection_query(coll: DataFrame, filters: dict, id_col: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows equal to all filter values, in id order."""
    matched = coll.filter(all_of([F.col(k) == F.lit(v) for k, v in filters.items()]))
    return matched.orderBy(id_col).offset(offset).limit(limit)
