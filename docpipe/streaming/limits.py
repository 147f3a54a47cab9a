"""Rate limits on a request stream.

Requests may arrive in any order. A request is decided when it arrives; one that
arrives out of order may change decisions on others, which are then written
again, so the last decision of a request counts (`latest_decisions`). While
nothing is late, the last decisions are those of the batch operators.

Each request gets a row. One behind the watermark is ``late``: what it would
have changed is closed, so ``allowed`` is null and it counts for nothing.
Without a time a request is allowed and counts for none; requests without a
token share one. State is dropped once the watermark has passed its window.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter, deque
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docpipe.functions.scalars import epoch_micros, floor_div
from docpipe.operators.ratelimit import _with_limit
from docpipe.streaming.sink import latest_rows, read_batches


def _decision_schema(requests: DataFrame) -> StructType:
    """Output rows keep the types of the key columns of the input."""
    return StructType(
        [
            requests.schema["token_id"], requests.schema["id"], StructField("us", LongType()),
            StructField("allowed", BooleanType()), StructField("late", BooleanType()),
        ]
    )


def _prepared(requests: DataFrame, limits: int | DataFrame, ts: str, delay: str) -> DataFrame:
    """The event time itself goes no further than the watermark: Spark would
    drop late rows from an operator that can see it."""
    slim = requests.select("token_id", "id", F.col(ts).alias("at"))
    return (
        _with_limit(slim, limits)
        .withColumn("us", epoch_micros(F.col("at")))
        .withColumn("event_time", F.col("at").cast("timestamp"))
        .withWatermark("event_time", delay)
        .select("token_id", "id", "us", "rate_limit")
    )


def _entry(row) -> tuple:
    """Place of a request in the order of its token; null ids come first."""
    return row.us, (row.id is not None, row.id)


#: Requests in one page of a log, about.
PAGE = 512
#: Windows after which a token's requests go on under another key.
PERIOD = 1 << 16


class _Log:
    """The requests of one key in slices of one window's length, many slices to
    a page. Of the state a batch reads and writes the pages it touches: a log
    with few requests is one page, whatever time it spans, and a long one is
    never read whole. A page is named by its first slice."""

    def __init__(self, handle: StatefulProcessorHandle, window_us: int, columns: str):
        self.window_us = window_us
        self.index = handle.getValueState("index", "first array<bigint>, last array<bigint>")
        self.slices = handle.getMapState("slices", "page bigint", columns)

    def open(self) -> _Log:
        found = self.index.get()
        self.pages = dict(zip(*found)) if found else {}
        self.first, self.known, self.read, self.changed = sorted(self.pages), {}, set(), set()
        return self

    def _page(self, number: int) -> int | None:
        """The page for a slice; those before the first page go there too."""
        return self.first[max(0, bisect_right(self.first, number) - 1)] if self.first else None

    def _load(self, page: int | None) -> None:
        if page is None or page in self.read:
            return
        self.read.add(page)
        stored = {}
        for us, name, *rest in zip(*self.slices.getValue((page,))):
            stored.setdefault(us // self.window_us, []).append((us, (name is not None, name), *rest))
        self.known = stored | self.known

    def get(self, number: int) -> list[tuple]:
        """Entries (us, place of the id, ...) of a slice, in order."""
        page = self._page(number)
        if number not in self.known and page is not None and page <= number <= self.pages[page]:
            self._load(page)
        return self.known.get(number, [])

    def put(self, number: int, entries: list[tuple]) -> None:
        self.known[number] = entries
        self.changed.add(number)

    def write(self) -> set[int]:
        """Writes the pages of changed slices, cut where they have grown;
        returns the last slices of those that are new."""
        touched = {self._page(n) for n in self.changed}
        for page in touched:
            self._load(page)
        parts, before = {}, dict(self.pages)
        for number in sorted(n for n, entries in self.known.items() if entries):
            if (page := self._page(number)) in touched:
                own = parts.setdefault(page, [[]])
                if sum(len(self.known[n]) for n in own[-1]) >= PAGE:
                    own.append([])
                own[-1].append(number)
        for page in touched - {None}:
            del self.pages[page]
        for numbers in (numbers for own in parts.values() for numbers in own):
            columns = list(zip(*(entry for n in numbers for entry in self.known[n])))
            columns[1] = [name for _, name in columns[1]]
            self.slices.updateValue((numbers[0],), tuple(map(list, columns)))
            self.pages[numbers[0]] = numbers[-1]
        self._close(before)
        return set(self.pages.values()) - set(before.values())

    def drop(self, passed: Callable[[int], bool]) -> None:
        """Drops the pages whose last slice has passed."""
        before = dict(self.open().pages)
        self.pages = {page: last for page, last in before.items() if not passed(last)}
        self._close(before)

    def _close(self, before: dict[int, int]) -> None:
        for page in before.keys() - self.pages.keys():
            self.slices.removeKey((page,))
        if not self.pages:
            self.index.clear()
        elif self.pages != before:
            self.index.update((list(self.pages), list(self.pages.values())))


class _FixedWindow(StatefulProcessor):
    """The first requests of each clock window of one token, at most its limit
    of them: those are allowed."""

    def __init__(self, window_us: int, id_type: str):
        self.window_us, self.id_type = window_us, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = _Log(handle, self.window_us, f"us array<bigint>, id array<{self.id_type}>")

    def _expiry(self, number: int) -> int:
        """Watermark (ms) from which on a window is closed."""
        return (number + 1) * self.window_us // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        token, mark_ms = key[0], timerValues.getCurrentWatermarkInMs()
        new = {}
        for r in rows:
            if r.us is None:
                yield Row(token_id=token, id=r.id, us=None, allowed=True, late=False)
            elif self._expiry(r.us // self.window_us) <= mark_ms:
                yield Row(token_id=token, id=r.id, us=r.us, allowed=None, late=True)
            else:
                new.setdefault(r.us // self.window_us, []).append((_entry(r), r.rate_limit))
        if not new:
            return
        log = self.log.open()
        for number, requests in new.items():
            before = log.get(number)
            first, added = list(before), Counter()
            for entry, limit in requests:
                insort(first, entry)
                added[entry] += 1
                while len(first) > limit:
                    out = first.pop()
                    added[out] -= 1
                    if added[out] <= 0:
                        del added[out]
                    yield Row(token_id=token, id=out[1][1], us=out[0], allowed=False, late=False)
            for us, (_, name) in added.elements():
                yield Row(token_id=token, id=name, us=us, allowed=True, late=False)
            if first != before:
                log.put(number, first)
        for last in log.write():
            self.handle.registerTimer(self._expiry(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.log.drop(lambda last: self._expiry(last) <= expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


class _SlidingLog(StatefulProcessor):
    """The decided requests of one token in slices of one window's length.

    A decision depends on allowed requests of its own slice and the one before,
    so requests that arrive are decided by replaying their slices, and the next
    one only where the allowed times of a slice changed. Of the state just the
    pages of those slices are read and written, however long the log is. A page
    goes once the watermark is a window past its last slice."""

    def __init__(self, window_us: int, id_type: str):
        self.window_us, self.id_type = window_us, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = _Log(
            handle, self.window_us, f"us array<bigint>, id array<{self.id_type}>, rate_limit array<int>, allowed array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        token, mark = key[0], timerValues.getCurrentWatermarkInMs() * 1000
        new = {}
        for r in rows:
            if r.us is None:
                yield Row(token_id=token, id=r.id, us=None, allowed=True, late=False)
            elif mark > 0 and r.us < mark:
                yield Row(token_id=token, id=r.id, us=r.us, allowed=None, late=True)
            else:
                new.setdefault(r.us // self.window_us, []).append((*_entry(r), r.rate_limit, None))
        if not new:
            return
        log, waiting = self.log.open(), sorted(new, reverse=True)
        while waiting:
            number = waiting.pop()
            before = log.get(number)
            entries = sorted([*before, *new.pop(number, [])], key=itemgetter(0, 1))
            history = deque(us for us, _, _, allowed in log.get(number - 1) if allowed)
            after = []
            for us, name, limit, was in entries:
                while history and history[0] <= us - self.window_us:
                    history.popleft()
                allowed = len(history) < limit
                if allowed:
                    history.append(us)
                if allowed is not was:
                    yield Row(token_id=token, id=name[1], us=us, allowed=allowed, late=False)
                after.append((us, name, limit, allowed))
            log.put(number, after)
            changed = [e[0] for e in before if e[3]] != [e[0] for e in after if e[3]]
            if changed and (not waiting or waiting[-1] != number + 1) and log.get(number + 1):
                waiting.append(number + 1)
        for last in log.write():
            self.handle.registerTimer(self._expiry(last))

    def _expiry(self, number: int) -> int:
        """Watermark (ms) from which on no request can come near a slice."""
        return (number + 2) * self.window_us // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.log.drop(lambda last: self._expiry(last) <= expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def _id_type(requests: DataFrame) -> str:
    return requests.schema["id"].dataType.simpleString()


def stream_rate_fixed(requests: DataFrame, limits: int | DataFrame, window_seconds: int = 60,
                      ts: str = "timestamp", delay: str = "1 minute") -> DataFrame:
    """``token_id, id, us, allowed, late`` per request or changed decision.
    State is keyed by token and a long period, so a hot token moves over the
    tasks as time goes on, and holds at most the limit's number of requests of
    each open window; a batch reads the pages of the windows that it touches."""
    window_us = window_seconds * 1_000_000
    prepared = _prepared(requests, limits, ts, delay)
    keyed = prepared.withColumn("period", floor_div(F.col("us"), window_us * PERIOD))
    return keyed.groupBy("token_id", "period").transformWithState(
        _FixedWindow(window_us, _id_type(requests)), _decision_schema(requests), "append", "eventTime"
    )


def stream_rate_sliding(requests: DataFrame, limits: int | DataFrame, window_seconds: int = 60,
                        ts: str = "timestamp", delay: str = "1 minute") -> DataFrame:
    """``token_id, id, us, allowed, late`` per request or changed decision, by
    the log of allowed ones. A token's state is its requests from two windows
    before the watermark on; a batch replays the windows that it touches."""
    prepared = _prepared(requests, limits, ts, delay)
    return prepared.groupBy("token_id").transformWithState(
        _SlidingLog(window_seconds * 1_000_000, _id_type(requests)), _decision_schema(requests),
        "append", "eventTime",
    )


def latest_decisions(spark, path: str) -> DataFrame:
    """The last written decision of each request; ids identify requests."""
    return latest_rows(read_batches(spark, path), ["token_id", "id"]).select("token_id", "id", "us", "allowed", "late")


def stream_window_counts(requests: DataFrame, window: str = "60 seconds", ts: str = "timestamp",
                         delay: str = "1 minute") -> DataFrame:
    """Requests per token and closed window."""
    timed = requests.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", window), "token_id").agg(F.count(F.lit(1)).alias("requests"))
