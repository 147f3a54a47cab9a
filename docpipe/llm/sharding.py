"""Shards of near equal bytes, cut from the ordered groups of equal texts.

Equal texts are one atomic group: copies always share a shard, so no shard is
trained on a text that another is tested on. Groups are ordered by the SHA-256
of their text, which deals documents of one source or day over all shards. The
order is cut into contiguous runs whose largest is as small as can be: the
capacity is searched between the even share and that share plus the largest
group, and a capacity is feasible if runs filled greedily to it reach the end.
DataFrame operations only.

A group above the even share of what is left can't be split and gets a shard of
its own, so that it doesn't leave others empty; the rest shares the other
shards. At most as many groups as shards can be that large.

Null and empty texts have no bytes and are one group. Repeated rows stay, each
with a slot. A null doc_id is a value like others, the first of its group. No
rows give no rows; fewer groups than shards leave the last shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.shared import discard, materialize

#: Capacities that one pass over the running sums tries at once, and the steps
#: in which a group finds the first of their limits that it keeps.
TRIES, STEP = 256, 16


def text_key(text: Column) -> Column:
    """The place of a text in the order of groups."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def ordered_parts(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and written, with the number of
    the range in ``__part``: rows of a part come before those of the next."""
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    return materialize(dealt, label)


def sums_before(parts: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Sum of ``value`` in the parts before, per part and ``keys``; one row per
    part and keys meets in a task."""
    sums = parts.groupBy("__part", *keys).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__part", *keys, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))


def running_sums(groups: DataFrame) -> DataFrame:
    """``groups`` (key, size) -> key, start, end: the group takes the units
    from ``start`` to ``end`` of the whole order."""
    parts = ordered_parts(groups, ["key"], "shard-groups")
    inside = Window.partitionBy("__part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("__upto", F.sum("size").over(inside)).join(sums_before(parts, F.col("size")), "__part")
    end = F.col("__before") + F.col("__upto")
    return materialize(placed.select("key", (end - F.col("size")).alias("start"), end.alias("end")), "shard-sums")


def furthest(sums: DataFrame, reach: list[tuple[int, int]]) -> list[int]:
    """For each (from, capacity), both ascending, the end of the last group
    that a run reaches. One count of the groups by the first limit they keep;
    the scan is cut to possible ends by the ranges that the files state."""
    limits = [a + c for a, c in reach]
    near = sums.where((F.col("end") > reach[0][0]) & (F.col("end") <= limits[-1]))
    above = lambda array: F.size(F.filter(array, lambda limit: limit < F.col("end")))
    step = above(F.lit(limits[STEP - 1 :: STEP] or limits[:1])) * STEP if len(limits) > STEP else F.lit(0)
    first = step + above(F.slice(F.lit(limits), step + 1, F.lit(STEP)))
    found = {r["first"]: int(r["end"]) for r in near.groupBy(first.alias("first")).agg(F.max("end").alias("end")).collect()}
    out, last = [], 0
    for i, (start, _) in enumerate(reach):
        last = max(last, found.get(i, 0))
        out.append(max(start, last))
    return out


def smallest_capacity(sums: DataFrame, total: int, largest: int, shards: int) -> int:
    """The least capacity to which ``shards`` greedy runs reach the end. Each
    pass tries ``TRIES`` capacities of the interval that is left."""
    low = max(largest, -(-total // shards)) - 1
    high = max(largest, -(-total // shards) + largest)
    while high - low > 1:
        tried = sorted({low + (high - low) * i // (TRIES + 1) for i in range(1, TRIES + 1)} - {low, high})
        ends = [0] * len(tried)
        for _ in range(shards):
            ends = furthest(sums, list(zip(ends, tried)))
        fits = [end >= total for end in ends]
        high = min([c for c, fit in zip(tried, fits) if fit], default=high)
        low = max([c for c, fit in zip(tried, fits) if not fit], default=low)
    return high


@dataclass
class ShardPlan:
    """Which shard a text belongs to: ``alone`` are keys of groups with a shard
    of their own (shards 0, 1, ...), ``cuts`` the last key of each following
    shard but the last. Both are no longer than the number of shards."""

    shards: int
    alone: list[str]
    cuts: list[str]
    capacity: int

    def shard(self, text: Column) -> Column:
        return self._of_key(text_key(text))

    def _of_key(self, key: Column) -> Column:
        place = F.lit(len(self.alone))
        for cut in self.cuts:
            place = place + (key > cut).cast("int")
        for i, own in reversed(list(enumerate(self.alone))):
            place = F.when(key == own, F.lit(i)).otherwise(place)
        return place.cast("int")


def _large_groups(groups: DataFrame, total: int, shards: int) -> tuple[list[str], int]:
    """Keys of groups that exceed the even share of what is left, largest
    first, and the sum of the rest."""
    alone, left = [], total
    for row in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if len(alone) + 1 >= shards or row["size"] * (shards - len(alone)) <= left:
            break
        alone.append(row["key"])
        left -= row["size"]
    return alone, left


def _plan(rows: DataFrame, shards: int) -> ShardPlan:
    """The plan for ``rows`` (key, size)."""
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-sizes")
    total = int(groups.agg(F.sum("size")).first()[0] or 0)
    if not total:
        return ShardPlan(shards, [], [], 0)
    alone, left = _large_groups(groups, total, shards)
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    largest = int(rest.agg(F.max("size")).first()[0] or 0)
    if not largest:
        return ShardPlan(shards, alone, [], 0)
    runs, sums = shards - len(alone), running_sums(rest)
    capacity = smallest_capacity(sums, left, largest, runs)
    ends, at = [], 0
    while at < left:
        at = furthest(sums, [(at, capacity)])[0]
        ends.append(at)
    cuts = [r["key"] for r in sums.where(F.col("end").isin(ends[:-1])).select("key").orderBy("key").collect()]
    discard(groups, sums)
    return ShardPlan(shards, alone, cuts, capacity)


def plan_shards(docs: DataFrame, shards: int = 8) -> ShardPlan:
    """The cuts for ``docs`` (text; other columns are not read). Sizes are
    summed per text before the shuffle, so a hot group is a few rows; the
    driver gets no more than a few numbers and keys for each shard. Save the
    plan to deal later documents to the same shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.col("text")
    return _plan(docs.select(text_key(text).alias("key"), text_size(text).alias("size")), shards)


def shard_slots(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document of ``docs``
    (doc_id, text): ``slot`` counts from 0 in a shard, by key and doc_id.

    Texts are read once, their keys and sizes written. Rows are dealt by ranges
    of (key, doc_id), so the copies of a text spread over tasks; each counts
    its rows and adds those of the ranges before."""
    text = F.col("text")
    slim = materialize(docs.select("doc_id", text_key(text).alias("key"), text_size(text).alias("size"), F.crc32(
        F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")), "shard-rows")
    plan = _plan(slim.select("key", "size"), shards)
    parts = ordered_parts(slim.withColumn("shard", plan._of_key(F.col("key"))), ["key", "doc_id"], "shard-parts")
    discard(slim)
    local = F.row_number().over(Window.partitionBy("__part", "shard").orderBy("key", "doc_id")) - 1
    placed = parts.withColumn("__local", local).join(sums_before(parts, F.lit(1), "shard"), ["__part", "shard"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("__before") + F.col("__local")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, plan: ShardPlan, files: int = 1) -> None:
    """Writes all columns of ``docs`` to ``path/shard=N``, in ``files`` files a
    shard, dealt by doc_id and text so that no task holds a whole shard. The
    column ``shard`` of ``docs``, if there is one, is replaced."""
    dealt = docs.withColumn("shard", plan.shard(F.col("text"))).withColumn("__file", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files)))
    dealt.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)


def bytes_law(docs: DataFrame, shards: int = 8) -> DataFrame:
    """`shard_slots` in the columns of the query."""
    return shard_slots(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                            F.lit(None).cast("int").alias("grown_shard"))


#: The same rows in SQL: the capacity by dynamic programming over all cuts
#: instead of a search, the checksum bit by bit.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), x AS (
  SELECT doc_id, strlen(text)::BIGINT + 1 AS size, sha256(text) AS key,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, bits
), g AS (
  SELECT key, sum(size)::BIGINT AS size FROM x GROUP BY key
), o AS (
  SELECT *, row_number() OVER (ORDER BY size DESC, key) - 1 AS n,
    sum(size) OVER (ORDER BY size DESC, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g
), m AS (
  SELECT coalesce(min(n), 8)::BIGINT AS alone FROM o WHERE n = 7 OR size * (8 - n) <= rest
), r AS (
  SELECT o.key, sum(size) OVER (ORDER BY key)::BIGINT AS e, row_number() OVER (ORDER BY key) AS i FROM o, m WHERE n >= alone
), z AS (
  SELECT 0::BIGINT AS e, 0::BIGINT AS i UNION ALL SELECT e, i FROM r
), best AS (
  SELECT 1::BIGINT AS k, i, e, e AS c FROM z
  UNION ALL
  SELECT k, i, e, c FROM (
    SELECT a.k + 1 AS k, b.i, b.e, min(greatest(a.c, b.e - a.e)) AS c FROM best a JOIN z b ON b.i >= a.i WHERE a.k < 8 GROUP BY ALL)
), cap AS (
  SELECT c FROM best, m WHERE k = 8 - alone ORDER BY e DESC LIMIT 1
), cut AS (
  SELECT 0::BIGINT AS s, 0::BIGINT AS e
  UNION ALL
  SELECT cut.s + 1, (SELECT max(z.e) FROM z, cap WHERE z.e <= cut.e + cap.c) FROM cut, m WHERE cut.s + 1 < 8 - alone
), place AS (
  SELECT key, n AS shard FROM o, m WHERE n < alone
  UNION ALL
  SELECT key, alone + (SELECT count(*) FROM cut WHERE cut.s > 0 AND cut.e < r.e) FROM r, m
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM x JOIN place USING (key)
"""
