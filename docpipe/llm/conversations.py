"""Repair of the structure of conversations by least-cost edits.

A conversation should read system (at most once, first), then user and
assistant in turn, ending with the assistant, or be empty: role initials
``(s?(ua)+)?``. Rows are kept (K, cost 0), given the role that is due (R, 3) or
deleted (D, 4); rows without text can be inserted (I, 3). Blank rows and rows
whose role and text came before must be deleted; a truncated row that stays
costs 3 more. Of the cheapest edits those whose letters, the audit, come first
in ASCII order are taken.

Method. Rows are dealt by ranges of (conversation, turn), so a conversation of
any length spreads over tasks, and cut into blocks of at most ``BLOCK`` rows. A
block is a table of 4 x 4 costs between the states before and after it; the
tables of a conversation are joined from its end, which gives each block the
cost of what follows for each state after it. Inside a block a cost DP over
(row, state) leaves the optimal arcs; their nodes are ranked by their least
audits of 1, 2, 4, ... letters with doubled pointers, the ranks choose the arcs,
and the doubled pointers spell the audit for each state before the block. Then
each conversation is read once in order. Only that last pass sees all rows of a
conversation in one task, as a stream: a digest of the repaired text can't be
made otherwise. It holds one block and the audit.

Nulls in role and text are one space. Rows are taken by turn, nulls first, then
role and text; repeated rows are rows of their own. A null conv_id is a
conversation. A role that is empty or has another initial can't be kept. Other
columns are not read. Turns are whole numbers. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docpipe.llm.shared import discard, materialize, slices

#: Rows of a block, and rows that numpy handles at once.
BLOCK, AT_ONCE = 1024, 1 << 15
SPACE = " \t\n\x0b\x0c\r"
#: Code of a row: its initial (s, u, a, other) and its fault (none, truncated,
#: blank, duplicate).
CODES = "suaxSUAX01234567"
KEEP, CHANGE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user, after an assistant.
#: The state after the role that is due, and after keeping each initial (-1: no).
DUE = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
FAR = 1 << 40
#: Cost of ending in each state, by inserting what is due.
ENDING = np.array([0, 2 * INSERT, INSERT, 0])
LETTERS = np.frombuffer(b"DIKR\0", np.uint8)


def damage(rows: DataFrame) -> DataFrame:
    """The faults that the query plants, by a checksum of conversation and turn."""
    place = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    known = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    kind = rows.select("conv_id", "turn", *known, (F.crc32(place.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their block, their place in it, and whether their
    turn is new in the conversation's rows of this part."""
    part = TaskContext.get().partitionId()
    last_conv, last_turn, before, seen = None, None, 0, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, turn = batch.column("conv_id"), batch.column("turn")
        code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.r_[not seen or conv[0].as_py() != last_conv, np.diff(code) != 0]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        place = np.arange(n) - start + np.where(np.cumsum(first) == 0, before, 0)
        known = np.asarray(turn.is_valid())
        value = turn.fill_null(0).to_numpy(zero_copy_only=False)
        same = np.r_[last_turn is not None and known[0] and value[0] == last_turn, known[:-1] & (np.diff(value) == 0)]
        fresh = known & ~(same & ~first)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place // BLOCK), pa.array((place % BLOCK).astype(np.int32)),
             pa.array(fresh.astype(np.int32))], names=[*batch.schema.names, "part", "block", "k", "fresh"])
        seen, last_conv, last_turn, before = True, conv[n - 1].as_py(), turn[n - 1].as_py(), int(place[-1]) + 1


def placed_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, part, block, k, fresh: all rows in the order
    (conv_id, part, block, k), written once."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    dealt = plain.withColumn("head", F.substring("text", 1, 16)).repartitionByRange("conv_id", "turn", "role", "head").drop("head")
    schema = StructType([*dealt.schema.fields, *StructType.fromDDL("part int, block long, k int, fresh int").fields])
    return materialize(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_in_blocks, schema), "conversation-rows")


def block_codes(placed: DataFrame) -> DataFrame:
    """conv_id, part, block, codes (a character a row), low, high, fresh of
    turns. What is needed of a text to find its repeats is a digest."""
    role, text = F.col("role"), F.col("text")
    initial = F.instr(F.lit("sua"), F.substring(role, 1, 1))
    initial = F.when((role == "") | (initial == 0), F.lit(3)).otherwise(initial - 1)
    end = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.octet_length(conv).cast("string"), conv, F.octet_length(role).cast("string"), role, text).cast("binary"))
    at = F.struct("part", "block", "k")
    slim = placed.select("conv_id", "part", "block", "k", "turn", "fresh", initial.alias("initial"), (end == "").alias("blank"),
                         end.isin(".", "!", "?").alias("whole"), F.when(end != "", digest).alias("digest"))
    repeated = slim.where("digest IS NOT NULL").groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1").select("digest", "first")
    fault = F.when(F.col("blank"), 2).when(F.coalesce(F.col("first") != at, F.lit(False)), 3).when(~F.col("whole"), 1).otherwise(0)
    code = F.substr(F.lit(CODES), F.col("initial") + fault * 4 + 1, F.lit(1))
    # Blank rows, which may be many, have no part in the join of the repeats.
    coded = slim.where("digest IS NOT NULL").join(repeated, "digest", "left").unionByName(
        slim.where("digest IS NULL").withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType)))
    return coded.select("conv_id", "part", "block", "k", "turn", "fresh", code.alias("code")).groupBy("conv_id", "part", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x.code), "").alias("codes"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("fresh").cast("long").alias("fresh"))


def _padded(codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Initials, costs of staying and starts of blocks, aligned at their ends."""
    longest = max(map(len, codes))
    text = np.frombuffer("".join(c.rjust(longest, "x") for c in codes).encode(), np.uint8).reshape(len(codes), longest)
    number = np.array([max(CODES.find(chr(b)), 0) for b in range(128)])[text]
    fault = number // 4
    return number % 4, np.where(fault >= 2, FAR, np.where(fault == 1, TRUNCATED, 0)), longest - np.array(list(map(len, codes)))


def _step(after: np.ndarray, initial: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Least costs before a row from those after it; (blocks, 4 states, ends)."""
    stay = stay[:, None, None]
    to = KEPT[:, initial].T
    kept = np.where((to >= 0)[:, :, None], np.take_along_axis(after, np.maximum(to, 0)[:, :, None], 1), FAR) + KEEP + stay
    cost = np.minimum(np.minimum(after + DELETE, after[:, DUE] + CHANGE + stay), kept)
    user, assistant = np.minimum(cost[:, 2], cost[:, 3] + INSERT), np.minimum(cost[:, 3], cost[:, 2] + INSERT)
    return np.minimum(np.stack([np.minimum(cost[:, 0], user + INSERT), np.minimum(cost[:, 1], user + INSERT), user, assistant], 1), FAR)


def block_costs(codes: list[str]) -> np.ndarray:
    """Least cost from each state before a block to each state after it."""
    initial, stay, start = _padded(codes)
    cost = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(codes), 4, 4))
    out = np.empty((len(codes), 4, 4), np.int64)
    for r in range(initial.shape[1] - 1, -1, -1):
        cost = _step(cost, initial[:, r], stay[:, r])
        out[start == r] = cost[start == r]
    return out


def least_audits(codes: list[str], after: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For each block and state before it: the least audit of the optimal arcs
    (up to the end of the block), and the state after it. ``after``: the cost
    of what follows by the state after the block."""
    initial, stay, start = _padded(codes)
    blocks, rows = initial.shape
    cost = np.empty((blocks, rows + 1, 4), np.int64)
    cost[:, rows] = after
    for r in range(rows - 1, -1, -1):
        cost[:, r] = _step(cost[:, r + 1, :, None], initial[:, r], stay[:, r])[:, :, 0]
    # Arcs by letter D, I, K, R of each node (block, row, state).
    node = np.arange(cost.size).reshape(cost.shape)
    state, here, nxt = np.arange(4), node[:, :-1] - np.arange(4), node[:, 1:] - np.arange(4)
    kept = KEPT[state[None, None, :], initial[:, :, None]]
    target = np.stack([nxt + state, here + DUE[state], nxt + np.maximum(kept, 0), nxt + DUE[state]], -1)
    price = np.stack([np.full(kept.shape, DELETE), np.full(kept.shape, INSERT), np.where(kept >= 0, KEEP, FAR) + stay[:, :, None],
                      np.broadcast_to(CHANGE + stay[:, :, None], kept.shape)], -1)
    flat = cost.reshape(-1)
    optimal = (price + flat[target] == cost[:, :-1, :, None]) & (price < FAR)
    # Rows before the start of a shorter block count for nothing.
    target[~optimal] = 0
    # Ranks by the first letter, then by 2, 4, ... letters. The end of a block,
    # where its audits end, is before all letters and leads to itself.
    letter = np.full(cost.shape, 4)
    pointer = node.copy()
    first = np.argmax(optimal, -1)
    some = optimal.any(-1)
    letter[:, :-1][some] = first[some]
    pointer[:, :-1][some] = np.take_along_axis(target, first[..., None], -1)[..., 0][some]
    rank, jump, starts = np.where(letter == 4, 0, letter + 1).reshape(-1), pointer.reshape(-1), (node[np.arange(blocks), start]).reshape(-1)
    stop = letter.reshape(-1) == 4
    while not stop[jump].all():
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1].reshape(-1)
        jump = jump[jump]
    # The arc of a node: its letter, then the rank of what follows.
    order = np.where(optimal, np.arange(4) * (rank.max() + 1) + rank[target], FAR)
    choice = np.argmin(order, -1)
    letter[:, :-1][some] = choice[some]
    pointer[:, :-1][some] = np.take_along_axis(target, choice[..., None], -1)[..., 0][some]
    doubled = [pointer.reshape(-1)]
    while not stop[doubled[-1][starts]].all():
        doubled.append(doubled[-1][doubled[-1]])
    path = starts[:, None]
    for jump in reversed(doubled):
        path = np.stack([path, jump[path]], -1).reshape(len(starts), -1)
    spelled = LETTERS[letter.reshape(-1)[path]]
    texts = [row.tobytes().rstrip(b"\0").decode() for row in spelled]
    return [texts[i : i + 4] for i in range(0, len(texts), 4)], (doubled[-1][starts] % 4).reshape(blocks, 4)


def _by_length(codes: list[str]) -> Iterator[np.ndarray]:
    """Places of blocks whose lengths are within a factor of two."""
    size = np.array([len(c).bit_length() for c in codes])
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    flat = values.reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _with_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "codes", AT_ONCE):
        codes = batch.column("codes").to_pylist()
        out = np.empty((len(codes), 16), np.int64)
        for at in _by_length(codes):
            out[at] = block_costs([codes[i] for i in at]).reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([*batch.columns, _lists(out, 16)], names=[*batch.schema.names, "costs"])


def _with_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its last: what follows each one costs."""
    seen, last, after = False, None, ENDING
    for batch in batches:
        convs = batch.column("conv_id").to_pylist()
        costs = batch.column("costs").flatten().to_numpy().reshape(-1, 4, 4)
        out = np.empty((len(convs), 4), np.int64)
        for i, conv in enumerate(convs):
            if not seen or conv != last:
                seen, last, after = True, conv, ENDING
            out[i] = after
            after = np.minimum((costs[i] + after).min(1), FAR)
        rest = [n for n in batch.schema.names if n != "costs"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), _lists(out, 4)], names=[*rest, "after"])


def _with_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "codes", AT_ONCE):
        codes = batch.column("codes").to_pylist()
        after = batch.column("after").flatten().to_numpy().reshape(-1, 4)
        audits, ends = [None] * len(codes), np.empty((len(codes), 4), np.int64)
        for at in _by_length(codes):
            found, end = least_audits([codes[i] for i in at], after[at])
            ends[at] = end
            for i, four in zip(at, found):
                audits[i] = four
        rest = [n for n in batch.schema.names if n != "after"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in rest), pa.array(audits, pa.list_(pa.string())), _lists(ends, 4)], names=[*rest, "audits", "ends"])


def planned_blocks(placed: DataFrame) -> DataFrame:
    """The blocks with ``audits`` and ``ends`` for each state before them."""
    blocks = block_codes(placed)

    def added(df: DataFrame, *fields: str) -> StructType:
        return StructType([*df.schema.fields, *(StructField(f.name, f.dataType) for f in StructType.fromDDL(", ".join(fields)).fields)])

    costed = blocks.mapInArrow(_with_costs, added(blocks, "costs array<long>"))
    costed = costed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    ended = costed.mapInArrow(_with_after, added(blocks, "after array<long>"))
    return ended.repartition("conv_id", "part", "block").mapInArrow(_with_audits, added(blocks, "audits array<string>", "ends array<long>"))


class _Repair:
    """One conversation, row after row: what the edits make of it."""

    def __init__(self, conv, texts: bool):
        self.conv, self.texts = conv, texts
        self.state = self.cost = self.illegal = self.distinct = self.count = 0
        self.faults, self.audit, self.rows = [0, 0, 0, 0], [], []
        self.low = self.high = None
        self.previous, self.codes, self.letters, self.at = "", "", "", 0
        self.digest = hashlib.sha256()

    def block(self, codes: str, audits: list[str], ends: list[int], low, high, fresh: int, opens: bool) -> None:
        self.codes, self.letters, self.at = codes, audits[self.state], 0
        self.audit.append(self.letters)
        if low is not None:
            # The rows of a part may go on with the last turn of the one before.
            self.distinct += fresh - (opens and self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        for i in map(CODES.index, codes):
            self.faults[i // 4] += 1
            role = "suax"[i % 4]
            self.illegal += bool(self.previous) and self.previous + role not in ("su", "ua", "au")
            self.previous = role

    def _put(self, edit: str, turn, role: bytes, text: bytes) -> None:
        self.digest.update(b"\n" * bool(self.count) + role + b":" + text)
        if self.texts:
            self.rows.append((self.conv, self.count, edit, turn, role.decode(), text.decode()))
        self.count += 1

    def _due(self) -> bytes:
        self.state = int(DUE[self.state])
        return b"user" if self.state == 2 else b"assistant"

    def insert(self) -> None:
        self.cost += INSERT
        self._put("I", None, self._due(), b"")

    def row(self, k: int, turn, role: bytes, text: bytes) -> None:
        while self.letters[self.at] == "I":
            self.insert()
            self.at += 1
        edit, self.at = self.letters[self.at], self.at + 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * (CODES.index(self.codes[k]) // 4 == 1)
        if edit == "R":
            self.cost += CHANGE
            self._put(edit, turn, self._due(), text)
        else:
            self.state = int(KEPT[self.state, CODES.index(self.codes[k]) % 4])
            self._put(edit, turn, role, text)

    def end(self) -> None:
        while self.state in (1, 2):
            self.insert()
            self.audit.append("I")

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, self.faults[2], self.faults[3], self.faults[1], self.illegal, self.cost, "".join(self.audit),
                self.digest.hexdigest())


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "place long, edit string, turn long, role string, text string"


def _repaired(texts: bool, schema: pa.Schema):
    """Reads conversations in order: first their mark, then each block before
    its rows. Gives a row a conversation, or its repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            names = ("conv_id", "part", "block", "k", "turn")
            columns = [batch.column(n).to_pylist() for n in names]
            columns += [batch.column(n).cast(pa.binary()).to_pylist() for n in ("role", "text")]
            plans = batch.column("plan")
            for i, (conv, part, block, k, turn, role, text) in enumerate(zip(*columns)):
                if part < 0:
                    if now is not None:
                        now.end()
                        out.extend(now.rows if texts else [now.report()])
                    now = _Repair(conv, texts)
                elif k < 0:
                    plan = plans[i].as_py()
                    now.block(plan["codes"], plan["audits"], plan["ends"], plan["low"], plan["high"], plan["fresh"], block == 0)
                else:
                    now.row(k, turn, role, text)
            if texts and now is not None:
                out.extend(now.rows)
                now.rows = []
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            now.end()
            out = now.rows if texts else [now.report()]
            if out:
                yield batch_of(out)

    return run


def _repair(rows: DataFrame, convs: DataFrame, texts: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    placed = placed_rows(rows)
    plan = F.struct("codes", "audits", "ends", "low", "high", "fresh")
    blocks = materialize(planned_blocks(placed).select("conv_id", "part", "block", plan.alias("plan")), "conversation-blocks")
    kind = blocks.schema["plan"].dataType
    none = F.lit(None)
    turns = placed.select("conv_id", "part", "block", "k", "turn", "role", "text", none.cast(kind).alias("plan"))
    empty = [none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text")]
    heads = blocks.select("conv_id", "part", "block", F.lit(-1).alias("k"), *empty, "plan")
    marks = convs.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("block"),
                                                      F.lit(-1).alias("k"), *empty, none.cast(kind).alias("plan"))
    ordered = turns.unionByName(heads).unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "k")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(ROWS if texts else REPORT).fields])
    return ordered.mapInArrow(_repaired(texts, to_arrow_schema(schema)), schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) -> the rows of the repaired
    conversations: conv_id, place from 0, edit (K, R or I), turn (null if
    inserted), role, text."""
    return _repair(rows, rows, True)


def repair_report(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``convs`` (of ``rows`` by default): the
    faults found, the cost and audit of the edits, and a digest of the repaired
    rows. A conversation without rows has zeros, an empty audit and the digest
    of nothing."""
    return _repair(rows, rows if convs is None else convs, False)


#: The same rows in SQL: the least (cost, audit) of each state, row by row.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(
        hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, bits
), x AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS time
  FROM d WHERE kind <> 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, left(role, 1) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM x
), f AS (
  SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
    WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM r
), ins AS (
  SELECT * FROM (VALUES (0, 0, 0, ''), (0, 1, 2, 'user'), (0, 2, 3, 'user assistant'), (1, 0, 1, ''), (1, 1, 2, 'user'), (1, 2, 3, 'user assistant'),
    (2, 0, 2, ''), (2, 1, 3, 'assistant'), (2, 2, 2, 'assistant user'), (3, 0, 3, ''), (3, 1, 2, 'user'), (3, 2, 3, 'user assistant')) v(s, n, s2, names)
), best AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'body': ''} AS b FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT * FROM (
    SELECT conv_id, k, s, min(b) AS b FROM (
      SELECT f.conv_id, f.k, CASE e.edit WHEN 'D' THEN ins.s2 WHEN 'K' THEN CASE f.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
          ELSE CASE ins.s2 WHEN 2 THEN 3 ELSE 2 END END AS s,
        {'cost': best.b.cost + 3 * ins.n + CASE e.edit WHEN 'D' THEN 4 ELSE CASE e.edit WHEN 'R' THEN 3 ELSE 0 END + CASE f.fault WHEN 't' THEN 3 ELSE 0 END END,
         'audit': best.b.audit || repeat('I', ins.n) || e.edit,
         'body': best.b.body || CASE ins.n WHEN 0 THEN '' ELSE chr(10) || replace(ins.names, ' ', ':' || chr(10)) || ':' END || CASE e.edit WHEN 'D' THEN ''
           ELSE chr(10) || CASE e.edit WHEN 'K' THEN f.role WHEN 'R' THEN CASE ins.s2 WHEN 2 THEN 'assistant' ELSE 'user' END END || ':' || f.text END} AS b
      FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.k = best.k + 1 JOIN ins ON ins.s = best.s,
        (VALUES ('D'), ('K'), ('R')) e(edit)
      WHERE e.edit = 'D' OR f.fault NOT IN ('b', 'd') AND (e.edit = 'R' OR f.i = 's' AND ins.s2 = 0 OR f.i = 'u' AND ins.s2 <> 2 OR f.i = 'a' AND ins.s2 = 2)
    ) GROUP BY conv_id, k, s)
), whole AS (
  SELECT best.conv_id, min({'cost': b.cost + 3 * n, 'audit': b.audit || repeat('I', n),
      'body': b.body || CASE n WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END}) AS b
  FROM best JOIN (SELECT conv_id, max(k) AS last FROM f GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM best.conv_id AND l.last = best.k
    JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) v(s, n) ON v.s = best.s GROUP BY best.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(whole.b.cost, 0)::BIGINT AS cost, coalesce(whole.b.audit, '') AS audit,
  sha256(coalesce(substr(whole.b.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM c.conv_id
"""
