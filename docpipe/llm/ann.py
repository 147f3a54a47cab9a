"""Nearest neighbours by inner product, with balanced posting lists.

Centroids are fitted on a bounded sample and split until no list of the sample
is much larger than the mean. Every vector goes to its nearest list and, near a
boundary, to further ones. A query walks a graph over the centroids from the
best of a few entry points, and takes all lists whose distance is at most a
ratio times the nearest one's. The ratio is measured on the sample, so that the
lists of nearly all true neighbours are taken. Inner products become distances
by one more coordinate that brings every vector to the same length.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.shared import materialize, once, share
from docpipe.llm.vectors import matrix, plain, usable

#: Rows the centroids are fitted on, and numbers in them, at most.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 20_000_000
#: Lists of a vector at most; a further list is taken within this ratio.
COPIES, BOUNDARY = 3, 1.05
#: Share of the sample's true neighbours whose lists the ratio must reach.
REACH = 0.985
#: Vectors of one piece of a list, and of one task; queries of one task.
PIECE, SHARD, QUERIES = 4_096, 16_384, 8_192
#: Different ids in the taken lists at least, if there are so many.
LEAST = 400


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def lifted(x: np.ndarray, length2: float, width: int) -> np.ndarray:
    """Rows brought to one length by a last coordinate."""
    out = np.zeros((len(x), width + 1))
    out[:, : x.shape[1]] = x
    out[:, width] = np.sqrt(np.maximum(length2 - (x * x).sum(1), 0))
    return out


def balanced_centroids(x: np.ndarray, count: int, steps: int = 8) -> np.ndarray:
    """K-means whose large clusters are split and whose small ones are freed."""
    rng = np.random.default_rng(11)
    centres = x[np.sort(rng.choice(len(x), count, replace=False))]
    for step in range(steps):
        near = _distances(x, centres).argmin(1)
        size = np.bincount(near, minlength=count)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        if step < steps - 2:
            small = [k for k in np.argsort(size, kind="stable") if size[k] < 0.3 * len(x) / count]
            large = [k for k in np.argsort(-size, kind="stable") if size[k] > 2 * len(x) / count]
            for free, full in zip(small, large):
                own = x[near == full]
                centres[free] = own[rng.integers(len(own))]
    return centres


@dataclass
class AnnIndex:
    centres: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratio: float
    length2: float
    width: int

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of each vector: the nearest, and those hardly farther."""
        out = []
        for low in range(0, len(x), 2_048):
            d = np.sqrt(_distances(x[low : low + 2_048], self.centres))
            order = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
            near = np.take_along_axis(d, order, 1)
            out += [o[n <= BOUNDARY * n[0]] for o, n in zip(order, near)]
        return out

    def walk(self, q: np.ndarray, sizes: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Lists for one query, nearest first, by best-first search. It ends
        when what is left is beyond the ratio and enough vectors are held:
        ``least`` different ids, of which the sum of ``weights`` is a lower
        bound, and ``COPIES`` times as many rows."""
        centres, seen = self.centres, np.zeros(len(self.centres), bool)

        def reach(names):
            names = names[~seen[names]]
            seen[names] = True
            gap = centres[names] - q
            return zip(np.sqrt((gap * gap).sum(1)).tolist(), names.tolist())

        heap = list(reach(self.entries))
        heapq.heapify(heap)
        enough = lambda names: weights[names].sum() >= least and sizes[names].sum() >= least * COPIES
        best, found, held, ids = np.inf, [], 0, 0.0
        while heap:
            distance, name = heapq.heappop(heap)
            best = min(best, distance)
            if distance > self.ratio * best and held >= least * COPIES and ids >= least:
                break
            found.append((distance, name))
            held, ids = held + sizes[name], ids + weights[name]
            for item in reach(self.graph[name]):
                heapq.heappush(heap, item)
        found.sort()
        inside = [n for d, n in found if d <= self.ratio * best]
        return np.array(inside if enough(inside) else [n for _, n in found], int)


def build_index(sample: np.ndarray, rows: int, length2: float, queries: int = 300, top: int = 20) -> AnnIndex:
    """Centroids, their graph and the ratio from a sample of ``rows`` vectors."""
    width = sample.shape[1]
    x = lifted(sample, length2, width)
    count = int(max(1, min(np.sqrt(rows) * 1.5, len(x) // 8)))
    centres = balanced_centroids(x, count)
    d = _distances(centres, centres)
    np.fill_diagonal(d, np.inf)
    degree = min(24, count - 1)
    graph = np.argsort(d, axis=1, kind="stable")[:, :degree] if degree else np.empty((count, 0), int)
    # A ring keeps the graph in one piece whatever the neighbours are.
    graph = np.column_stack([graph, (np.arange(count) + 1) % count, (np.arange(count) - 1) % count])
    index = AnnIndex(centres, graph, np.unique(np.linspace(0, count - 1, 8).astype(int)), np.inf, length2, width)
    asked = sample[:: max(1, len(sample) // queries)]
    q = np.column_stack([asked, np.zeros(len(asked))])
    scores = asked @ sample.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, 1 : top + 1]
    to = np.sqrt(_distances(q, centres))
    lists = index.lists(x)
    need = [min(to[k, c] for c in lists[n]) / to[k].min() for k, row in enumerate(near) for n in row]
    index.ratio = float(np.quantile(need, REACH)) + 1e-9 if need else np.inf
    return index


def _rows(vectors: pa.Array, width: int) -> np.ndarray:
    x = matrix(vectors)
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _shard(name: int, piece: int, shards: int) -> int:
    return (name * 1_000_003 + piece * 7_919) % shards


def _best(held, k: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        index = once(held)[0]
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        x, q = _rows(left["vector"].combine_chunks(), index.width), _rows(right["vector"].combine_chunks(), index.width)
        ids, names = np.asarray(left["vec_id"]), np.asarray(left["list"])
        order = np.argsort(ids, kind="stable")
        x, ids, names = x[order], ids[order], names[order]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        last = min(k, len(starts))
        taken = [np.frombuffer(t, np.int32) for t in right["lists"].to_pylist()]
        asked, out = np.asarray(right["query_id"]), []
        rows = max(1, (1 << 22) // len(x))
        for low in range(0, len(q), rows):
            scores = q[low : low + rows] @ x.T
            chosen = np.zeros((len(scores), int(names.max()) + 1), bool)
            for r, t in enumerate(taken[low : low + rows]):
                chosen[r, t[t < chosen.shape[1]]] = True
            scores[~chosen[:, names]] = -np.inf
            scores[asked[low : low + rows, None] == ids] = -np.inf
            # Rows of one id are one candidate, with its best row, before the cut.
            cut = np.partition(np.maximum.reduceat(scores, starts, axis=1), -last, axis=1)[:, -last]
            for r, row in enumerate(scores):
                at = np.flatnonzero((row >= cut[r] - 1e-9 * (1 + abs(cut[r]))) & np.isfinite(row)) if np.isfinite(cut[r]) else np.flatnonzero(np.isfinite(row))
                if len(at):
                    exact = (x[at] * q[low + r]).sum(1)
                    order = np.lexsort((-exact, ids[at]))
                    order = order[np.unique(ids[at][order], return_index=True)[1]]
                    order = order[np.lexsort((ids[at][order], -exact[order]))[:k]]
                    out.append((np.full(len(order), asked[low + r]), ids[at][order], exact[order]))
        if not out:
            return none
        a, b, c = (np.concatenate(v) for v in zip(*out))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return work


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, embedding; other columns are
    ignored) -> query_id, rank, vec_id, score: the ``k`` vectors found with the
    largest inner product, other than the query's own id; ties to the smaller
    id. Unusable vectors (see ``vectors.usable``) take no part; shorter ones
    count as filled with zeros; an id that repeats counts once, as the best of
    its rows. Lists in pieces of bounded size are dealt to tasks by hash, so a
    list that holds a third of all vectors is many pieces."""
    spark = vectors.sparkSession
    pick = lambda df: plain(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding").where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumnRenamed("embedding", "vector")
    data, asked = pick(vectors), pick(queries)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    rows, length2, width, n_asked = data.agg(F.count("*"), F.max(squares), F.max(F.size("vector")), F.lit(0)).first()
    n_asked = asked.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not rows or not n_asked:
        return spark.createDataFrame([], schema)
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    # One row an id, so that the ratio is measured to other ids, not to repeats.
    drawn = data.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound)
    sample = data.join(drawn, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sample = sample.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").toArrow()["vector"].combine_chunks()
    index = build_index(_rows(sample, width), rows, length2, top=k)
    first = share(spark, index)

    def place(batches):
        index = once(first)
        for batch in batches:
            x = _rows(batch.column("vector"), index.width)
            lists = index.lists(lifted(x, index.length2, index.width))
            at = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if lists else [], pa.int32()), batch.column("vec_id").take(pa.array(at)),
                                              batch.column("vector").take(pa.array(at))], ["list", "vec_id", "vector"])

    placed = materialize(data.mapInArrow(place, "list int, vec_id long, vector array<double>"), "lists")
    sizes, weights = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres))
    rows_of = placed.groupBy("vec_id", "list").agg(F.count("*").alias("rows"))
    share_of = rows_of.withColumn("share", 1 / F.count("*").over(Window.partitionBy("vec_id")))
    for r in share_of.groupBy("list").agg(F.sum("rows"), F.sum("share")).collect():
        sizes[r[0]], weights[r[0]] = r[1], r[2] + 1e-6
    least = max(LEAST, k + 1)
    pieces, shards, turns = -(-sizes // PIECE), int(-(-sizes.sum() // SHARD)), -(-n_asked // QUERIES)
    held = share(spark, (index, sizes, pieces, weights))

    def shard(batches):
        pieces = once(held)[2]
        for batch in batches:
            names, ids = np.asarray(batch.column("list")), np.asarray(batch.column("vec_id"))
            piece = (ids * 2_654_435_761 >> 8) % np.maximum(pieces[names], 1)
            yield pa.RecordBatch.from_arrays([pa.array(_shard(names.astype(np.int64), piece, shards), pa.int32()), *batch.columns],
                                             ["shard", "list", "vec_id", "vector"])

    def ask(batches):
        index, sizes, pieces, weights = once(held)
        for batch in batches:
            q, rows = _rows(batch.column("vector"), index.width), []
            for r, vector in enumerate(q):
                by_shard: dict[int, list[int]] = {}
                for name in index.walk(np.append(vector, 0.0), sizes, weights, least).tolist():
                    for s in {_shard(name, p, shards) for p in range(pieces[name])}:
                        by_shard.setdefault(s, []).append(name)
                rows += [(s, r, np.array(names, np.int32).tobytes()) for s, names in by_shard.items()]
            at = pa.array([r for _, r, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), batch.column("vec_id").take(at),
                                              batch.column("vector").take(at), pa.array([n for _, _, n in rows], pa.binary())],
                                             ["shard", "query_id", "vector", "lists"])

    turn = F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")
    lists = placed.mapInArrow(shard, "shard int, list int, vec_id long, vector array<double>").withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    wanted = asked.mapInArrow(ask, "shard int, query_id long, vector array<double>, lists binary").withColumn("turn", turn)
    found = lists.groupBy("shard", "turn").cogroup(wanted.groupBy("shard", "turn")).applyInArrow(
        _best(held, k), "query_id long, vec_id long, score double")
    once_each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once_each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
