"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.shared import materialize

#: Weights given to the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so often; a target stops at so many sizes.
MOST = 3
#: A word of the size of a text.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and the seed: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place`` from 0 by source in code point order, null last. Ranges
    of sources are numbered side by side and shifted by the counts before."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = materialize(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").count().withColumn(
        "before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    return inside.join(before.select("part", "before"), "part").withColumn(
        "place", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long")).drop("part", "before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) -> source, source_size, target, rate.

    A source's share of all words follows its weight but stops at ``most``
    times its size; what is above is shared by weight among the others until
    none is above. Each round is one sum over the sources; its three numbers
    come to the driver. Rounds end when no source newly stops."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(ranked(sizes).withColumn("weight", weight.cast("long")), "targets")
    total, weights_left = (int(v or 0) for v in rows.agg(F.sum("source_size"), F.sum("weight")).first())
    held = (0, 0)

    def stopped(words_left: int, weight_left: int) -> Column:
        # words_left * weight / weight_left is above the limit, in integers.
        limit = F.col("source_size").cast("decimal(38,0)") * F.lit(most * weight_left)
        return F.lit(words_left).cast("decimal(38,0)") * F.col("weight") > limit

    while True:
        words_left, weight_left = total - held[0], weights_left - held[1]
        above = stopped(words_left, weight_left)
        new = rows.agg(F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(above, F.col("weight")))).first()
        new = (int(new[0] or 0), int(new[1] or 0))
        if new == held:
            break
        held = new
    shared = (F.lit(words_left) * F.col("weight")).cast("double") / F.lit(float(max(1, weight_left)))
    target = F.when(above, (F.col("source_size") * most).cast("double")).otherwise(shared)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return rows.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


#: What the plan adds to documents, under names that no column of theirs has.
ADDED = {"size": "__mix_size", "source_size": "__mix_source_size", "target": "__mix_target", "copies": "__mix_copies"}


def _planned(docs: DataFrame, weights: Sequence[int], most: int, seed: str) -> DataFrame:
    """``docs`` with all its columns and those of ``ADDED``."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sums = docs.select("source", words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = materialize(targets(sums, weights, most).select(
        key.alias("__mix_key"), F.col("source_size").alias(ADDED["source_size"]), F.col("target").alias(ADDED["target"]),
        F.col("rate").alias("__mix_rate")), "rates")
    sized = docs.withColumns({ADDED["size"]: words(F.col("text")), "__mix_key": key})
    joined = sized.join(rates, "__mix_key").drop("__mix_key")
    whole = F.floor("__mix_rate")
    extra = (unit(F.col("doc_id"), seed) < F.col("__mix_rate") - whole).cast("int")
    return joined.withColumn(ADDED["copies"], F.least(F.lit(most), whole + extra).cast("int")).drop("__mix_rate")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source; other columns stay) with size,
    source_size, target and ``copies``: the whole part of the source's rate,
    and one more with the rest as probability, drawn from doc_id and seed.
    Columns of ``docs`` with one of these four names are replaced.

    Null and blank texts have size 0 and the copies of their source's rate.
    A null source is a source of its own, the last. Repeated rows are drawn
    alike. Sources are summed before the shuffle and joined back by key, as a
    broadcast only where Spark knows the table to be small; Spark splits a hot
    source's part of the join. No rows give no rows."""
    planned = _planned(docs.drop(*ADDED), weights, most, seed)
    return planned.withColumnsRenamed({private: name for name, private in ADDED.items()})


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of the mix: each document as often as its copies, with all
    columns of ``docs`` as they are, whatever their names."""
    planned = _planned(docs, weights, most, seed).where(F.col(ADDED["copies"]) > 0)
    rows = planned.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col(ADDED["copies"]))))
    return rows.select(*docs.columns)


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted)."""
    plan = mix_plan(docs.select("doc_id", "text", "source"), **options)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same rows in SQL. Sources stop in the order of size by weight; ``stop``
#: counts them, and the last level that leaves the next source below its limit
#: holds.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, sum(source_size) OVER ()::HUGEINT AS total FROM r
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, place) AS n,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS held,
    sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS free
  FROM w
), l AS (
  SELECT total - held AS words, free AS weights, n FROM o WHERE (total - held) * weight <= 3 * source_size::HUGEINT * free ORDER BY n LIMIT 1
), t AS (
  SELECT o.source, source_size,
    CASE WHEN o.n < l.n THEN (3 * source_size)::DOUBLE ELSE (l.words * weight)::DOUBLE / l.weights::DOUBLE END AS target
  FROM o, l
), c AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * least(3, floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
