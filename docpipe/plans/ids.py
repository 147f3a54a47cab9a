"""Ids that are unique in a batch and against stored rows, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from docpipe.functions.scalars import hash_id

ID_ATTEMPTS = 10


def unique_ids(df: DataFrame, key_cols: Sequence[str], out: str, existing: DataFrame | None = None,
               given: str | None = None, first_attempt: tuple[int, ...] = (0,), length: int = 10) -> DataFrame:
    """Adds a base-62 id that no other row and no row of ``existing`` has.

    The id is a hash of ``key_cols`` and the attempt, so retried tasks agree on
    it. Rows with equal ids are ranked: the first keeps the id unless a stored
    row has it. Each other row tries hashes of its keys, its rank and the
    attempt; of those nobody has it takes the first, so two rows with equal keys
    get two ids. ``given`` names a column of ids that are kept where not null;
    ``first_attempt`` is what the first hash has after the keys.

    Nothing runs while the plan is built. Rows meet by id, so groups are single
    rows but for collisions, and only colliding rows are compared again; more
    than ``ID_ATTEMPTS`` collisions of a row fail the query that asks for it.
    Equal rows of one batch are told apart by rank only, so any of them may get
    either id."""
    keys = [F.col(c) for c in key_cols]
    first = hash_id(*keys, *map(F.lit, first_attempt), length=length)
    first = first if given is None else F.coalesce(F.col(given).cast("string"), first)
    fixed = F.lit(False) if given is None else F.col(given).isNotNull()
    rows = df.withColumns({"__id": first, "__new": ~fixed, "__key": F.sha2(F.to_json(F.struct(*keys)), 256)})
    if existing is not None:
        stored = existing.select(F.col(out).cast("string").alias("__id"), F.lit(False).alias("__new"), F.lit(True).alias("__stored"))
        rows = rows.withColumn("__stored", F.lit(False)).unionByName(stored, allowMissingColumns=True)
    else:
        rows = rows.withColumn("__stored", F.lit(False))
    place = Window.partitionBy("__id").orderBy("__new", "__key")
    ranked = rows.withColumn("__rank", F.row_number().over(place) - 1)
    clashing = F.col("__new") & (F.col("__rank") > 0)
    again = ranked.where(clashing).select("__id", "__rank", "__key", *key_cols)
    attempt = F.explode(F.sequence(F.lit(1), F.lit(ID_ATTEMPTS))).alias("__attempt")
    tried = again.select("*", attempt).withColumn("__try", hash_id(*keys, F.col("__rank"), F.col("__attempt"), length=length))
    # Of rows that try the same id one may have it; a taken one is nobody's.
    taken = rows.select(F.col("__id").alias("__try"), F.lit(True).alias("__taken")).distinct()
    free = tried.join(taken, "__try", "left").where("__taken IS NULL").withColumn(
        "__turn", F.row_number().over(Window.partitionBy("__try").orderBy("__attempt", "__key", "__rank"))).where("__turn = 1")
    chosen = free.groupBy("__id", "__rank").agg(F.min_by("__try", "__attempt").alias("__other"))
    kept = ranked.where(~F.col("__stored")).join(chosen, ["__id", "__rank"], "left")
    failed = F.raise_error(F.lit(f"Failed to generate unique ID after {ID_ATTEMPTS} attempts"))
    chosen_id = F.when(~clashing, F.col("__id")).when(F.col("__other").isNotNull(), F.col("__other")).otherwise(failed.cast("string"))
    return kept.withColumn("__id", chosen_id).select(*[c for c in df.columns if c != out], F.col("__id").alias(out))
