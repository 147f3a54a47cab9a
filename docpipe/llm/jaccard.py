"""Exact Jaccard join of documents on five-word shingles, size-aware.

1. A first prefix filter in hash order drops the documents that share too few
   shingles with any other text. Buckets get half of a hash, packed by place.
2. For the rest, equal sets collapse to one representative, the document
   frequency of every shingle is counted exactly, and shingles are ordered
   rare first. Two linked sets share their rarest shingles.
3. Small sets enumerate all 2-subsets of their prefix as keys and meet other
   small sets under these keys alone. Large sets scan the inverted lists of
   single shingles, in which small sets near the boundary also stand; there a
   pair counts only if one of the two is large. The boundary is the size with
   the least cost: keys enumerated and entries scanned.
4. Every entry of a list knows the largest partner that its set could have if
   the key were the first one that both share: only what comes after it in the
   common order can be shared too. Entries without a partner in reach are
   dropped. A linked pair passes at the first key it shares, so this loses none.
   Near copies share most of their keys, so most lists have the same entries:
   of equal lists one stays.
5. First, a few keys of each set, those of least hash, make lists, and their sets
   are compared with two centres of the list. Of the lists of all keys, those of
   one component then go, and the others hold some sets of each component. The
   sets outside a list's largest component are compared with two members of it,
   twice. Last, of every two components that still meet in a list, all sets are
   compared, in packs. So a large group of near copies costs its size, not its
   square, as long as it hangs together; no component is missed.
6. Links are counted at the end: both ends of a link are in one component and of
   nearly one size, so the sets of a component are dealt into tiles by size, and
   all pairs of tiles of equal or adjacent sizes are multiplied. A tile pair
   sends one number a set, so links are counted without being listed.

Frequencies are counted by blocks: a block of documents names a shingle once
with its count, however many of its documents hold it, so a shingle of a third
of all documents gives one entry a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.components import components
from docpipe.llm.shared import discard, filtered_joins, materialize, shuffle_width, slices
from docpipe.llm.shingles import mix, shingle_set

#: Keys that a task gathers before it counts and sends them.
BLOCK_KEYS = 1 << 18
#: Bytes of one bucket of the first filter and of the frequencies, about.
BUCKET_BYTES = 1 << 25
LOCAL = np.iinfo(np.int64).min
#: Bytes of a set's signature.
SIG = 16
#: The first filter asks for one shared shingle in this many of a set.
SLACK = 8


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least ``percent`` / 100, in exact integers."""

    percent: int = 75

    def overlap(self, n: int) -> int:
        """Shingles that any partner shares with a set of ``n``, at least."""
        return -(-n * self.percent // 100)

    def reach(self, shared, n):
        """Size of the largest partner of a set of ``n``, if the two share
        ``shared`` shingles at most."""
        return shared * (100 + self.percent) // self.percent - n

    def slack(self, n: int) -> int:
        """Shared shingles asked of the first filter's prefix: more of them
        tell near copies from texts that share one passage."""
        return max(1, min(n // SLACK, self.overlap(n)))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers by place: those that many numbers share, as the
    high ones of ids and of sorted keys, stand together and shrink when sent."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers of all rows of a column of ``_planes``."""
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(data, np.uint8).reshape(width, -1).T for data in column.to_pylist()]
    return np.concatenate(parts).reshape(-1).view(kind)


def _split(keys: np.ndarray, buckets: int):
    """Order by bucket and the bounds of each bucket that has keys."""
    bucket = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    return order, names, np.append(starts, len(order))


def _short(keys: np.ndarray) -> np.ndarray:
    """What a bucket tells keys apart by: the half that doesn't name it. Of a
    bucket of a million keys about one in 4,000 has the name of another. Such
    two count as one key in all sets alike: sets then pass a filter or meet that
    need not, and a shingle stands a little later in the common order. No link
    is lost, and links are verified on whole keys."""
    return (keys >> np.uint64(32)).astype(np.uint32)


def _first_filter(limit: Threshold, buckets: int):
    names = ("bucket", "keys", "docs", "own", "size", "hits", "sigs", "marks")
    schema = pa.schema([(c, pa.binary() if c != "bucket" else pa.int32()) for c in names])

    def block(ids, sizes, keys, sigs, marks) -> Iterator[pa.RecordBatch]:
        docs = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every, docs = every[order], docs[order]
        new = np.append(True, every[1:] != every[:-1]) if len(every) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(every)))
        crowded = np.repeat(count > 1, count)
        hits = np.bincount(docs[crowded], minlength=len(ids)).astype(np.int64)
        ids = np.array(ids, np.int64)
        sent, holder = every[starts], np.where(count > 1, LOCAL, ids[docs[starts]] if len(starts) else 0)
        order, names, bounds = _split(sent, buckets)
        sent, holder = sent[order], holder[order]
        rows = [(int(b), _planes(_short(sent[i:j])), _planes(holder[i:j]), b"", b"", b"", b"", b"")
                for b, i, j in zip(names, bounds[:-1], bounds[1:])]
        rows.append((int(ids[0] % buckets), b"", b"", ids.tobytes(), np.array(sizes, np.int64).tobytes(), hits.tobytes(),
                     b"".join(sigs), np.array(marks, np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def work(batches):
        ids, sizes, keys, sigs, marks, held = [], [], [], [], [], 0
        for batch in slices(batches):
            for doc, text, mark in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("mark").to_pylist()):
                found = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else None)
                n = len(found)
                prefix = n - limit.overlap(n) + limit.slack(n) if n else 0
                ids.append(doc)
                sizes.append(n)
                keys.append(found[:prefix].copy())
                sigs.append(hashlib.blake2b(found.tobytes(), digest_size=SIG).digest())
                marks.append(mark)
                held += prefix + 1
                if held >= BLOCK_KEYS:
                    yield from block(ids, sizes, keys, sigs, marks)
                    ids, sizes, keys, sigs, marks, held = [], [], [], [], [], 0
        if ids:
            yield from block(ids, sizes, keys, sigs, marks)

    return work, "bucket int, keys binary, docs binary, own binary, size binary, hits binary, sigs binary, marks binary"


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _count_hits(group: pa.Table) -> pa.Table:
    """Of one bucket: how many of each document's keys another holds too; and
    the documents named there, with the signature of their set if it has keys."""
    keys, docs = _unpacked(group["keys"], np.uint32), _unpacked(group["docs"], np.int64)
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    same = keys[1:] == keys[:-1]
    shared = np.zeros(len(keys), bool)
    shared[1:] |= same
    shared[:-1] |= same
    found, hits = np.unique(docs[shared & (docs != LOCAL)], return_counts=True)
    own, size, own_hits, marks = (_joined(group[c], np.int64) for c in ("own", "size", "hits", "marks"))
    sigs = b"".join(group["sigs"].to_pylist())
    sigs = [sigs[SIG * i : SIG * (i + 1)] if n else None for i, n in enumerate(size.tolist())]
    return pa.table({
        "doc_id": pa.array(np.concatenate((found, own)), pa.int64()),
        "size": pa.array(np.concatenate((np.full(len(found), -1), size)), pa.int64()),
        "hits": pa.array(np.concatenate((hits, own_hits)), pa.int64()),
        "sig": pa.array([None] * len(found) + sigs, pa.binary()),
        "mark": pa.array(np.concatenate((np.zeros(len(found), np.int64), marks)), pa.int64()),
    })


def _sets(batches):
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else None)
            if len(found):
                data = found.tobytes()
                yield doc, hashlib.blake2b(data, digest_size=SIG).digest(), len(found), data


def _blocks(batches):
    """Texts of representatives (doc_id, text) -> their sets in blocks, named by
    their first one. One step, so that a task has one Python worker."""
    def pack(reps, sigs, sizes, sets):
        return pa.RecordBatch.from_arrays([
            pa.array([reps[0]], pa.int64()), pa.array([np.array(reps, np.int64).tobytes()], pa.binary()),
            pa.array([b"".join(sigs)], pa.binary()), pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()),
            pa.array([b"".join(sets)], pa.binary())], ["block", "reps", "sigs", "sizes", "keys"])

    reps, sigs, sizes, sets, held = [], [], [], [], 0
    for rep, sig, n, keys in _sets(batches):
        reps.append(rep)
        sigs.append(sig)
        sizes.append(n)
        sets.append(keys)
        held += n
        if held >= BLOCK_KEYS:
            yield pack(reps, sigs, sizes, sets)
            reps, sigs, sizes, sets, held = [], [], [], [], 0
    if reps:
        yield pack(reps, sigs, sizes, sets)


def _block_counts(buckets: int):
    def work(batches):
        for batch in batches:
            for block, keys in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist()):
                keys, counts = np.unique(np.frombuffer(keys, np.uint64), return_counts=True)
                order, names, bounds = _split(keys, buckets)
                keys, counts = keys[order], counts[order].astype(np.int32)
                cut = [slice(i, j) for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int32()), pa.array([block] * len(names), pa.int64()),
                    pa.array([_planes(_short(keys[c])) for c in cut], pa.binary()),
                    pa.array([_planes(counts[c]) for c in cut], pa.binary())], ["bucket", "block", "keys", "counts"])

    return work


def _frequencies(group: pa.Table) -> pa.Table:
    """Of one bucket: for each block, in how many sets each of its keys is."""
    lengths = [len(k) // 4 for k in group["keys"].to_pylist()]
    keys, counts = _unpacked(group["keys"], np.uint32), _unpacked(group["counts"], np.int32)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    total = np.add.reduceat(counts[order].astype(np.int64), starts)
    df = np.empty(len(keys), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(starts, len(keys))))
    end = np.cumsum(lengths)
    return pa.table({
        "block": group["block"], "bucket": group["bucket"],
        "df": pa.array([_planes(df[j - n : j]) for n, j in zip(lengths, end)], pa.binary()),
    })


def _order(limit: Threshold, buckets: int):
    """Each set that can have a partner: its shared shingles, and the shared
    part of its prefix for 2-subsets, rarest first. ``scan``: entries it meets
    in the inverted lists of its prefix, at most."""
    def work(batches):
        for batch in batches:
            out = []
            for reps, sigs, sizes, keys, found in zip(*(batch.column(c).to_pylist() for c in ("reps", "sigs", "sizes", "keys", "found"))):
                keys, sizes = np.frombuffer(keys, np.uint64), np.frombuffer(sizes, np.int64)
                every, at = np.unique(keys, return_inverse=True)
                order, names, bounds = _split(every, buckets)
                df = np.empty(len(every), np.int64)
                for f in found:
                    k = np.searchsorted(names, f["bucket"])
                    df[order[bounds[k] : bounds[k + 1]]] = np.frombuffer(f["df"], np.uint8).reshape(8, -1).T.reshape(-1).view(np.int64)
                freq = df[at]
                shared = freq > 1
                end = np.cumsum(sizes)
                for k, (rep, n, stop) in enumerate(zip(np.frombuffer(reps, np.int64).tolist(), sizes.tolist(), end.tolist())):
                    own = shared[stop - n : stop]
                    mine, own_df = keys[stop - n : stop][own], freq[stop - n : stop][own]
                    need = limit.overlap(n)
                    if len(mine) >= need:
                        first = np.lexsort((mine, own_df))[: len(mine) - need + 2]
                        out.append((rep, sigs[SIG * k : SIG * (k + 1)], n, mine.tobytes(), mine[first].tobytes(), len(mine), len(first),
                                    int((own_df[first] - 1).sum())))
            columns = zip(*out) if out else [[]] * 8
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)],
                ["rep", "sig", "n", "keys", "prefix", "m", "p", "scan"])

    return work


#: Keys of each kind by which a set is first compared.
SEEDS = 6
#: Sets that stand for a component in a list, besides the least and the largest.
SOME = 6
#: Rounds with members of the largest component of each list.
OUTER_TURNS = 2
#: Steps of the cost table per doubling of the set size.
STEPS = 8


def boundary(sets: DataFrame) -> tuple[int, int]:
    """The largest size of a small set: the least total of 2-subsets that small
    sets enumerate and entries that large ones meet in their lists; and that
    total. The costs are summed by size class, ``STEPS`` per doubling."""
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS)
    rows = sets.groupBy(step.alias("step")).agg(
        F.max("n").alias("n"), F.sum(F.col("p") * (F.col("p") - 1) / 2).alias("subsets"), F.sum("scan").alias("scan"),
    ).orderBy("step").collect()
    best, at, cost = sum(r.scan for r in rows), 0, sum(r.scan for r in rows)
    for r in rows:
        cost += r.subsets - r.scan
        if cost < best:
            best, at = cost, r.n
    return at, int(best)


#: Kinds of keys: single shingles and 2-subsets.
MAIN, SUBSET = range(2)
#: Keys of one bucket, about; entries of one row of a list.
BUCKET_KEYS, LIST_ROW = 1 << 20, 1 << 12
#: Sets that are compared at once, on either side.
PACK = 256


def _postings(limit: Threshold, small: int, buckets: int, seeds: int | None = None):
    """Keys under which sets meet, in blocks by bucket: 2-subsets of small sets;
    single shingles of large sets and of small ones that a large one could
    match. A set too small to share two shingles with a partner has no 2-subset
    and counts as large. ``reach``, in steps of n / (2 percent) rounded up, is
    the size of the largest partner that shares nothing before the key. With
    ``seeds``, only that many keys of each kind, those of least hash, which near
    copies mostly share."""
    names = ["kind", "bucket", "keys", "reach", "reps", "sizes", "labels", "counts"]
    tiny = 100 // limit.percent

    def block(kind, held):
        reps, sizes, labels, keys, reaches = zip(*held)
        owner, every, reach = np.repeat(np.arange(len(reps)), [len(k) for k in keys]), np.concatenate(keys), np.concatenate(reaches)
        order, found, bounds = _split(every, buckets)
        owner, every, reach = owner[order], every[order], reach[order]
        reps, sizes, labels, rows = np.array(reps, np.int64), np.array(sizes, np.int64), np.array(labels, np.int64), []
        for name, i, j in zip(found, bounds[:-1], bounds[1:]):
            own, counts = np.unique(owner[i:j], return_counts=True)
            rows.append((kind, int(name), _planes(_short(every[i:j])), reach[i:j].tobytes(),
                         *(_planes(c) for c in (reps[own], sizes[own], labels[own], counts.astype(np.int32)))))
        kinds = (pa.int32(), pa.int32()) + (pa.binary(),) * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def work(batches):
        held, size = ([], []), [0, 0]
        for batch in batches:
            for rep, n, m, prefix, label in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "m", "prefix", "label"))):
                prefix = np.frombuffer(prefix, np.uint64)
                is_small = tiny < n <= small
                made = []
                if not is_small or n * 100 >= (small + 1) * limit.percent or n * limit.percent <= tiny * 100:
                    single = prefix[: m - limit.overlap(n) + 1]
                    made.append((MAIN, single, m - np.arange(len(single))))
                if is_small:
                    i, j = np.triu_indices(len(prefix), 1)
                    low, high = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
                    made.append((SUBSET, mix(low * np.uint64(3) + high), m - j + 1))
                for kind, keys, left in made:
                    if seeds is not None:
                        least = np.argsort(keys)[:seeds]
                        keys, left = keys[least], left[least]
                    reach = np.maximum(limit.reach(left, n), 0)
                    held[kind].append((rep, n, label, keys, (-(-reach * 2 * limit.percent // n)).astype(np.uint8)))
                    size[kind] += len(keys)
                    if size[kind] >= BLOCK_KEYS:
                        yield block(kind, held[kind])
                        held[kind].clear()
                        size[kind] = 0
        for kind in (MAIN, SUBSET):
            if size[kind]:
                yield block(kind, held[kind])

    return work, "kind int, bucket int, keys binary, reach binary, reps binary, sizes binary, labels binary, counts binary"


def _others(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry the greatest value of the other entries of its list."""
    group = np.repeat(np.arange(len(starts)), counts)
    top = np.maximum.reduceat(values, starts)
    hit = np.flatnonzero(values == top[group])
    first = hit[np.unique(group[hit], return_index=True)[1]]
    rest = values.copy()
    rest[first] = np.iinfo(np.int64).min
    out = top[group]
    out[first] = np.maximum.reduceat(rest, starts)
    return out


def _some_of_each(keys, reps, n, label) -> np.ndarray:
    """Entries, ordered by list and component, that stand for the component in
    the list: its least and its largest set, and ``SOME`` that the hash picks.
    Sets of one component stay in one, and what is asked of a list is which
    components meet in it, at which sizes; all their sets are compared then."""
    order = np.lexsort((mix(reps.view(np.uint64)), label, keys))
    keys, n, label = keys[order], n[order], label[order]
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (label[1:] != label[:-1])))
    counts = np.diff(np.append(starts, len(keys)))
    group = np.repeat(np.arange(len(starts)), counts)
    keep = np.arange(len(keys)) - starts[group] < SOME
    for values in (n, -n):
        hit = np.flatnonzero(values == np.minimum.reduceat(values, starts)[group])
        keep[hit[np.unique(group[hit], return_index=True)[1]]] = True
    return order[keep]


def _lists(limit: Threshold, small: int):
    """Of one bucket: the lists of several components, one of those with the
    same entries, in rows of bounded size. Entries without a partner go, and of
    each component some stay."""
    tiny = 100 // limit.percent
    schema = pa.schema([("list", pa.int64()), ("part", pa.int32()), ("main", pa.bool_()), *((c, pa.binary()) for c in ("reps", "sizes", "labels"))])

    def work(group: pa.Table) -> pa.Table:
        kind = group["kind"][0].as_py()
        keys, counts = _unpacked(group["keys"], np.uint32), _unpacked(group["counts"], np.int32)
        # Most keys are one set's only: nothing but their order is made of them.
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.append(False, same) | np.append(same, False)]
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
        keys, reach = keys[order], _joined(group["reach"], np.uint8)[order].astype(np.int64)
        reps, n, label = (_unpacked(group[c], np.int64)[owner] for c in ("reps", "sizes", "labels"))
        order = np.lexsort((reps, n, keys))
        entries = [c[order] for c in (keys, reps, n, label, reach * n // (2 * limit.percent))]

        def grouped():
            keys, starts = entries[0], np.empty(0, np.int64)
            if len(keys):
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return starts, np.diff(np.append(starts, len(keys)))

        def of_several_components() -> None:
            starts, counts = grouped()
            if len(starts):
                label = entries[3]
                several = np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)
                entries[:] = [c[np.repeat(several, counts)] for c in entries]

        of_several_components()
        starts, counts = grouped()
        if len(starts):
            _, _, n, _, reach = entries
            keep = (reach >= -_others(-n, starts, counts)) & (n <= _others(reach, starts, counts))
            if kind == MAIN:
                large = (n > small) | (n <= tiny)
                keep &= np.repeat(np.logical_or.reduceat(large, starts), counts)
            entries[:] = [c[keep] for c in entries]
            of_several_components()
            if len(entries[0]):
                some = _some_of_each(*entries[:4])
                entries[:] = [c[some] for c in entries]
            starts, counts = grouped()
        rows = []
        if len(starts):
            _, reps, n, label, _ = entries
            marks = mix(mix(reps.view(np.uint64) + np.uint64(kind + 1)) + n.astype(np.uint64))
            names = mix(np.add.reduceat(marks, starts) + counts.astype(np.uint64)).view(np.int64)
            _, first = np.unique(names, return_index=True)
            for k in first:
                for part, i in enumerate(range(starts[k], starts[k] + counts[k], LIST_ROW)):
                    j = min(i + LIST_ROW, starts[k] + counts[k])
                    rows.append((int(names[k]), part, kind == MAIN, *(_planes(c[i:j]) for c in (reps, n, label))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, schema.types)], schema=schema)

    return work, "list long, part int, main boolean, reps binary, sizes binary, labels binary"


def _entries(batches):
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for i in range(len(rows)):
            row = rows.slice(i, 1)
            reps, sizes, labels = (pa.array(_unpacked(row[c], np.int64)) for c in ("reps", "sizes", "labels"))
            key, main = ([row[c][0].as_py()] * len(reps) for c in ("list", "main"))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(main, pa.bool_()), reps, sizes, labels],
                                             ["key", "main", "rep", "n", "label"])


def _list_table(ordered: DataFrame, limit: Threshold, small: int, keys: int, seeds: int | None = None) -> DataFrame:
    """key, main, rep, n, label: the lists in which sets of several labels meet.
    ``keys``: how many keys there are, about."""
    work, schema = _postings(limit, small, max(1, -(-keys // BUCKET_KEYS)), seeds)
    made, kept = _lists(limit, small)
    lists = ordered.select("rep", "n", "m", "prefix", "label").mapInArrow(work, schema).groupBy("kind", "bucket").applyInArrow(made, kept)
    lists = lists.groupBy("list", "part").agg(*(F.first(c).alias(c) for c in ("main", "reps", "sizes", "labels")))
    return materialize(lists.mapInArrow(_entries, "key long, main boolean, rep long, n long, label long"), "lists")


def _verify(limit: Threshold):
    def work(batches):
        for batch in batches:
            keep, shared = [], []
            for n, m, left, right in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ka", "kb"))):
                both = len(np.intersect1d(np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64), assume_unique=True))
                keep.append(100 * both >= limit.percent * (n + m - both))
                shared.append(both)
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64())], ["a", "b", "shared"])
            yield found.filter(pa.array(keep, pa.bool_()))

    return work


def _links(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs that are links. Pairs are written first, so that Spark knows
    their size, and only sets that a pair names travel."""
    pairs = materialize(pairs, "pairs")
    keys = sets.select("rep", "keys", "n")
    left = keys.select(F.col("rep").alias("a"), F.col("keys").alias("ka"), F.col("n").alias("na"))
    right = keys.select(F.col("rep").alias("b"), F.col("keys").alias("kb"), F.col("n").alias("nb"))
    right = right.join(pairs.select("b"), "b", "left_semi")
    both = pairs.join(left, "a").join(right, "b")
    found = materialize(both.mapInArrow(_verify(limit), "a long, b long, shared long"), "links")
    discard(pairs)
    return found


def _fits(n: str, m: str, limit: Threshold):
    return F.least(n, m) * 100 >= F.greatest(n, m) * limit.percent


def _large(n, small: int, limit: Threshold):
    return (n > small) | (n <= 100 // limit.percent)


def _drawn(turn: int):
    """Two sets of a list. In the first turn the same ones for all lists that
    hold them, so that few different pairs come out; later, when few sets are
    left to compare, others for each list, so that those meet many."""
    def draw(seed: int):
        order = F.xxhash64("rep", F.lit(seed)) if turn == 0 else F.xxhash64("rep", "key", F.lit(seed))
        return F.min(F.struct(order.alias("o"), F.col("rep").alias("c"), F.col("n").alias("cn")))

    return F.array(draw(2 * turn), draw(2 * turn + 1)).alias("s")


def _pairs_with(met: DataFrame, limit: Threshold, small: int) -> DataFrame:
    met = met.select("main", "rep", "n", F.explode(F.array_distinct("s")).alias("s")).select("main", "rep", "n", "s.c", "s.cn")
    through = ~F.col("main") | _large(F.col("n"), small, limit) | _large(F.col("cn"), small, limit)
    met = met.where((F.col("rep") != F.col("c")) & _fits("n", "cn", limit) & through)
    return met.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()


def _central_pairs(lists: DataFrame, limit: Threshold, small: int) -> DataFrame:
    """Each set with two sets of each of its lists."""
    centres = lists.groupBy("key").agg(_drawn(0)).select("key", "s")
    return _pairs_with(lists.join(centres, "key"), limit, small)


def _labelled(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the component of their ``rep``: itself, if it has no link."""
    roots = roots.select(F.col("node").alias("rep"), "root")
    return sets.join(roots, "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that still hold several components."""
    named = _labelled(lists.drop("label"), roots).select("key", "main", "rep", "n", "label")
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return materialize(named.join(several, "key", "left_semi"), "open-lists")


def _outer_pairs(lists: DataFrame, turn: int, limit: Threshold, small: int) -> DataFrame:
    """The sets of a list that are not in its largest component, with two
    members of that component."""
    by_label = lists.groupBy("key", "label").agg(_drawn(turn), F.count("*").alias("sets"))
    most = by_label.groupBy("key").agg(F.max(F.struct("sets", "label", "s")).alias("m"))
    most = most.select("key", F.col("m.label").alias("major"), "m.s")
    return _pairs_with(lists.join(most, "key").where("label <> major"), limit, small)


def _pack(group: pa.Table) -> pa.Table:
    one = lambda values: pa.array([values], pa.binary())
    return pa.table({"label": group["label"][:1], "reps": one(np.asarray(group["rep"]).astype(np.int64).tobytes()),
                     "sizes": one(np.asarray(group["n"]).astype(np.int64).tobytes()),
                     "counts": one(np.array([len(k) // 8 for k in group["keys"].to_pylist()], np.int64).tobytes()),
                     "keys": one(b"".join(group["keys"].to_pylist()))})


def _verify_packs(limit: Threshold):
    """Every set of one pack with every set of the other."""
    def work(batches):
        for batch in batches:
            out = []
            names = ("reps", "sizes", "counts", "keys", "reps2", "sizes2", "counts2", "keys2")
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                reps, sizes, counts, reps2, sizes2, counts2 = (np.frombuffer(row[k], np.int64) for k in (0, 1, 2, 4, 5, 6))
                keys, keys2 = np.frombuffer(row[3], np.uint64), np.frombuffer(row[7], np.uint64)
                owner, end = np.repeat(np.arange(len(reps2)), counts2), np.cumsum(counts)
                for rep, n, count, stop in zip(reps.tolist(), sizes.tolist(), counts.tolist(), end.tolist()):
                    own = keys[stop - count : stop]
                    at = np.minimum(np.searchsorted(own, keys2), count - 1)
                    both = np.bincount(owner[own[at] == keys2], minlength=len(reps2))
                    hit = np.flatnonzero(100 * both >= limit.percent * (n + sizes2 - both))
                    out += [(min(rep, r), max(rep, r), int(k)) for r, k in zip(reps2[hit].tolist(), both[hit].tolist()) if r != rep]
            columns = [list(c) for c in zip(*out)] if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared"])

    return work


def _other_links(lists: DataFrame, sets: DataFrame, roots: DataFrame, limit: Threshold, small: int) -> DataFrame:
    """Links between components that meet in a list: all their sets."""
    largest = F.max(F.when(_large(F.col("n"), small, limit), F.col("n"))).alias("large")
    here = lists.groupBy("key", "main", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"), largest)
    there = here.select("key", *(F.col(c).alias(f"{c}2") for c in ("label", "low", "high", "large")))
    fits = (F.col("low2") * limit.percent <= F.col("high") * 100) & (F.col("low") * limit.percent <= F.col("high2") * 100)
    through = ~F.col("main") | F.col("large").isNotNull() | F.col("large2").isNotNull()
    pairs = materialize(here.join(there, "key").where((F.col("label") < F.col("label2")) & fits & through).select("label", "label2").distinct(), "meetings")
    asked = pairs.select("label").unionByName(pairs.select(F.col("label2").alias("label"))).distinct()
    asked = materialize(_labelled(sets.select("rep", "sig"), roots).join(asked, "label", "left_semi").select("label", "rep", "sig"), "meeting-names")
    # Keys travel only where names are asked for, which are written, so that Spark knows their size.
    named = materialize(sets.select("rep", "sig", "n", "keys").join(asked, ["rep", "sig"]).select("label", "rep", "n", "keys"), "meeting-sets")
    discard(asked)
    size = named.groupBy("label").agg(F.count("*").alias("size"))
    sized = pairs.join(size, "label").join(size.select(F.col("label").alias("label2"), F.col("size").alias("size2")), "label2")
    first = (F.col("size") > F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("label") < F.col("label2")))
    sized = materialize(sized.select(F.when(first, F.col("label")).otherwise(F.col("label2")).alias("big"),
                                     F.when(first, F.col("label2")).otherwise(F.col("label")).alias("label"),
                                     F.least("size", "size2").alias("rows")), "meeting-sizes")
    packs = F.ceil(F.col("rows") / PACK).cast("long")
    kind = "label long, reps binary, sizes binary, counts binary, keys binary"
    part = F.pmod(F.xxhash64("rep"), packs).alias("part")
    few = sized.join(sized.groupBy("big").agg(F.sum("rows").alias("total")), "big").select("big", "label", F.col("total").alias("rows"))
    few = few.join(named, "label").select(F.col("big").alias("label"), "rep", "n", "keys", part)
    few = few.groupBy("label", "part").applyInArrow(_pack, kind)
    large = named.join(sized.select(F.col("big").alias("label")).distinct(), "label", "left_semi").join(size.withColumnRenamed("size", "rows"), "label")
    large = large.select("label", "rep", "n", "keys", part).groupBy("label", "part").applyInArrow(_pack, kind)
    large = large.select("label", *(F.col(c).alias(f"{c}2") for c in ("reps", "sizes", "counts", "keys")))
    found = materialize(few.join(large, "label").mapInArrow(_verify_packs(limit), "a long, b long, shared long"), "links")
    discard(pairs, named, sized)
    return found


#: Sets and keys of one tile, give or take the spread of a hash; keys that are
#: multiplied at once.
TILE, TILE_KEYS, TILE_STEP = 2048, 1 << 19, 1 << 12


def _incidence(owner: np.ndarray, at: np.ndarray, low: int, rows: int, width: int) -> np.ndarray:
    inside = (at >= low) & (at < low + width)
    out = np.zeros((rows, width), np.float32)
    out[owner[inside], at[inside] - low] = 1
    return out


def _shared_keys(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How many keys each set of one tile shares with each of the other."""
    flat = [np.frombuffer(b"".join(side), np.uint64) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side)), [len(k) // 8 for k in side]) for side in (left, right)]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return both
    found = [np.minimum(np.searchsorted(common, f), len(common) - 1) for f in flat]
    hits = [common[at] == f for at, f in zip(found, flat)]
    (a, x), (b, y) = ((o[h], at[h]) for o, at, h in zip(owners, found, hits))
    for low in range(0, len(common), TILE_STEP):
        width = min(TILE_STEP, len(common) - low)
        both += _incidence(a, x, low, len(left), width) @ _incidence(b, y, low, len(right), width).T
    return both


def _counted_tiles(limit: Threshold):
    """Links of every set of a tile pair, each as often as the other has copies."""
    def work(batches):
        for batch in batches:
            for same, left, right in zip(*(batch.column(c).to_pylist() for c in ("same", "sets", "sets2"))):
                # Rows that repeat a document's text are one set.
                left, right = ({s["sig"]: s for s in side} for side in (left, right))
                left, right = list(left.values()), list(right.values())
                both = _shared_keys([s["keys"] for s in left], [s["keys"] for s in right]).astype(np.int64)
                n, m = (np.array([s["n"] for s in side], np.int64) for side in (left, right))
                copies, copies2 = (np.array([s["copies"] for s in side], np.int64) for side in (left, right))
                linked = 100 * both >= limit.percent * (n[:, None] + m - both)
                if same:
                    np.fill_diagonal(linked, False)
                sides = [(left, linked @ copies2)] + ([] if same else [(right, copies @ linked)])
                out = [(s["sig"], k) for side, links in sides for s, k in zip(side, links.tolist()) if k]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([k for _, k in out], pa.int64())], ["sig", "links"])

    return work


def _link_counts(ordered: DataFrame, members: DataFrame, roots: DataFrame, limit: Threshold) -> DataFrame:
    """doc_id, n_links of the documents in ``members``."""
    copies = members.groupBy("sig").agg(F.count("*").alias("copies"))
    held = F.sum("m")
    named = materialize(ordered.select("rep", "sig", "n", "m").join(roots.select(F.col("node").alias("rep"), "root"), "rep").join(copies, "sig"), "named")
    whole = named.groupBy("root").agg(F.count("*").alias("sets"), held.alias("held")).where("sets > 1").select(
        "root", "sets", ((F.col("sets") <= TILE) & (F.col("held") <= TILE_KEYS)).alias("whole"))
    # Sizes of linked sets differ by less than one step, rounding included.
    step = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / limit.percent) * 1.0001 if limit.percent < 100 else 1e-6))
    stepped = named.join(whole, "root").withColumn("step", F.when(F.col("whole"), F.lit(0)).otherwise(step).cast("long"))
    counts = stepped.groupBy("root", "step").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(held / TILE_KEYS)).cast("long").alias("parts"))
    dealt = materialize(stepped.join(counts, ["root", "step"]).select(
        "rep", "sig", "copies", "root", "sets", "step", F.pmod(F.xxhash64("sig"), F.col("parts")).alias("part")), "dealt")
    # The keys travel once, to their tile, which is one task's only while it is
    # made. A filter made of linked sets holds most others back.
    with filtered_joins(ordered.sparkSession):
        tiles = ordered.select("rep", "sig", "n", "keys").join(dealt.where("sets > 1").drop("sets"), ["rep", "sig"])
        tiles = materialize(tiles.groupBy("root", "step", "part").agg(F.collect_list(F.struct("sig", "n", "copies", "keys")).alias("sets")), "link-tiles")
    right = tiles.select("root", F.col("step").alias("step2"), F.col("part").alias("part2"), F.col("sets").alias("sets2"))
    names = dealt.select("root", "step", "part").distinct()
    names2 = names.select("root", F.col("step").alias("step2"), F.col("part").alias("part2"))
    near = (F.col("step2") == F.col("step") + 1) | ((F.col("step2") == F.col("step")) & (F.col("part2") > F.col("part")))
    pairs = materialize(names.join(names2, "root").where(near), "tile-pairs")
    pairs = pairs.join(tiles, ["root", "step", "part"]).join(right, ["root", "step2", "part2"])
    # A tile with itself stays where it is.
    same = tiles.select(F.lit(True).alias("same"), "sets", F.col("sets").alias("sets2"))
    every = same.unionByName(pairs.select(F.lit(False).alias("same"), "sets", "sets2"))
    found = materialize(every.mapInArrow(_counted_tiles(limit), "sig binary, links long"), "link-counts")
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    each = members.select("doc_id", "sig").join(copies, "sig").join(links, "sig", "left")
    counted = materialize(each.groupBy("doc_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "doc-links")
    discard(tiles, found, named, dealt)
    return counted


def shingle_links(docs: DataFrame, percent: int = 75, count: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """``docs`` (doc_id, text) -> sizes (doc_id, n_shingles); links (a, b,
    shared) between representatives of equal sets; roots (node, root); with
    ``count``, the number of all links (doc_id, n_links).

    Links join every pair of linked texts directly or through other links; a
    pair whose ends were already joined may be left out of them, but not of
    ``n_links``. Roots hold the documents that are linked with another."""
    limit, spark = Threshold(percent), docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    width = shuffle_width(spark)
    # A prefix takes about as many bytes as a text; sets have eight a word or less.
    length = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(4 * width, -(-length // BUCKET_BYTES)))
    work, schema = _first_filter(limit, parts)
    # ``mark`` tells the rows of a repeated doc_id apart without hashing shingles again.
    texts = texts.withColumn("mark", F.xxhash64("text"))
    hits = texts.mapInArrow(work, schema).groupBy("bucket").applyInArrow(
        _count_hits, "doc_id long, size long, hits long, sig binary, mark long")
    hits = materialize(hits, "hits")
    sizes = materialize(hits.groupBy("doc_id").agg(
        F.max("size").alias("n_shingles"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.sum("hits").alias("hits"),
    ), "sizes")
    enough = F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("least") / SLACK))
    near = sizes.where(enough).select("doc_id")
    near = materialize(hits.where("sig is not null").join(near, "doc_id", "left_semi").select("doc_id", "sig", "mark").distinct(), "near")
    equal = near.groupBy("sig").agg(F.min(F.struct("doc_id", "mark")).alias("least")).select(
        "sig", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("mark"))
    members = materialize(near.select("doc_id", "sig").distinct().join(equal, "sig").select("doc_id", "sig", "rep", "mark"), "members")
    discard(hits)
    # Of equal sets the text of one is read again; a filter made of the ids of
    # these holds most others back before the shuffle.
    with filtered_joins(spark):
        own = texts.join(members.where("doc_id = rep").select("doc_id", "mark"), ["doc_id", "mark"], "left_semi").select("doc_id", "text")
        blocks = materialize(own.mapInArrow(_blocks, "block long, reps binary, sigs binary, sizes binary, keys binary"), "blocks")
    discard(near)
    counted = blocks.select("block", "keys").mapInArrow(_block_counts(parts), "bucket int, block long, keys binary, counts binary")
    shared = counted.groupBy("bucket").applyInArrow(_frequencies, "block long, bucket int, df binary")
    shared = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "df")).alias("found"))
    ordered = materialize(blocks.join(shared, "block").mapInArrow(
        _order(limit, parts), "rep long, sig binary, n long, keys binary, prefix binary, m long, p long, scan long"), "ordered")
    discard(blocks)
    # A few keys of each set join most near copies; of all keys, only the lists
    # of several components are left.
    small, cost = boundary(ordered)
    seeds = _list_table(ordered.withColumn("label", F.col("rep")), limit, small, min(cost, 2 * SEEDS * ordered.count()), SEEDS)
    links = _links(_central_pairs(seeds, limit, small), ordered, limit)
    discard(seeds)
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.select("a", "b").unionByName(copies))
    lists = _list_table(_labelled(ordered, roots), limit, small, cost)
    for turn in range(1, OUTER_TURNS + 1):
        found = _links(_outer_pairs(lists, turn, limit, small), ordered, limit)
        links, roots = links.unionByName(found), _merged(roots, found)
        left = _open_lists(lists, roots)
        discard(lists)
        lists = left
    found = _other_links(lists, ordered, roots, limit, small)
    discard(lists)
    roots = _merged(roots, found)
    counts = _link_counts(ordered, members, roots, limit) if count else None
    discard(ordered)
    return sizes.select("doc_id", "n_shingles"), links.unionByName(found), roots, counts


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after more links: those of the roots that the links join."""
    if links.isEmpty():
        return roots
    known = roots.select("node", "root")
    ends = links.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    upper = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    every = known.unionByName(upper.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("low"))
    upper = upper.select(F.col("node").alias("low"), "root")
    return materialize(every.join(upper, "low", "left").select("node", F.coalesce("root", "low").alias("root")), "roots")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id,
    n_shingles, component_id: one row per doc_id.

    Null, empty or blank text: no shingles, linked with nothing. Fewer than
    five words: one shingle of the whole sequence. Rows that repeat a doc_id
    are one document with the links of all its texts and the size of the
    largest. Rows without doc_id take no part. No rows give no rows."""
    sizes, _, roots, _ = shingle_links(docs, percent)
    return _classes(sizes, roots)


def jaccard_join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``jaccard_components`` with ``n_links``: the number of texts of the table
    that the document's text is linked with, whether or not they are joined
    through others as well. A doc_id with several texts has the sum over them,
    with the links between its own; equal texts of one doc_id are one text."""
    sizes, _, roots, counts = shingle_links(docs, percent, count=True)
    return _classes(sizes, roots).join(counts, "doc_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def _classes(sizes: DataFrame, roots: DataFrame) -> DataFrame:
    joined = sizes.join(roots, sizes["doc_id"] == roots["node"], "left")
    return joined.select(sizes["doc_id"], "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
