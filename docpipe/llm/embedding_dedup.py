"""Near copies among embeddings of one label, by quantised tile products.

Vectors are scaled to length 1 and quantised to 8 bits with a scale of their
own. For vectors u, v with quantised forms q, w and errors of norm e, f, the
product u.v differs from q.w by at most e (1 + f) + f. Tiles of one label are
multiplied in the quantised form (exact in single precision); only the pairs
that can reach the threshold under their bound are recomputed in doubles from
the original vectors. A tile pair sends one row a vector: its links and the
least vector it hangs together with, so links are counted without being listed.
Equal vectors are one vector with a multiplicity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.components import components
from docpipe.llm.shared import materialize
from docpipe.llm.vectors import matrix, plain, usable

THRESHOLD = 0.93
TILE = 2048
#: Pairs recomputed at once.
PAIRS = 1 << 16


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scale and error norm of each row scaled to length 1."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1)) + 1e-12
    return q.astype(np.int8), scale, error


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows side by side, in doubles."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, rows: int = 512):
    """Index pairs with a cosine of at least ``threshold``; i < j if ``same``."""
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    qy = qy.astype(np.float32).T.copy()
    for low in range(0, len(x), rows):
        near = (qx[low : low + rows].astype(np.float32) @ qy).astype(np.float64) * sx[low : low + rows, None] * sy
        e = ex[low : low + rows, None]
        i, j = np.nonzero(near + e * (1 + ey) + ey + 1e-9 >= threshold)
        i = i + low
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            keep = cosines(x[a], y[b]) >= threshold
            yield a[keep], b[keep]


def least_joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lowers labels to the least of their component under links i, j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def _packed(batches):
    for batch in batches:
        x = matrix(batch.column("embedding"))
        data = [np.ascontiguousarray(r).tobytes() for r in x]
        yield pa.RecordBatch.from_arrays([
            batch.column("vec_id"), batch.column("label"),
            pa.array([hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary()), pa.array(data, pa.binary())],
            ["vec_id", "label", "sig", "vector"])


def _tile(group: pa.Table) -> pa.Table:
    """One row for a tile: ids, multiplicities and vectors."""
    order = np.argsort(np.asarray(group["rep"]), kind="stable")
    vectors = group["vector"].to_pylist()
    one = lambda values: pa.array([values], pa.binary())
    return pa.table({
        "label": group["label"][:1], "tiles": group["tiles"][:1], "tile": group["tile"][:1],
        "ids": one(np.asarray(group["rep"])[order].astype(np.int64).tobytes()),
        "copies": one(np.asarray(group["copies"])[order].astype(np.int64).tobytes()),
        "vectors": one(b"".join(vectors[k] for k in order)),
    })


def _multiplied(threshold: float):
    def work(batches):
        for batch in batches:
            names = ("tile", "other", "ids", "copies", "vectors", "ids2", "copies2", "vectors2")
            for tile, other, a, m, x, b, n, y in zip(*(batch.column(c).to_pylist() for c in names)):
                same = tile == other
                a, m, b, n = (np.frombuffer(v, np.int64) for v in (a, m, b, n))
                x, y = np.frombuffer(x).reshape(len(a), -1), np.frombuffer(y).reshape(len(b), -1)
                if x.shape[1] != y.shape[1]:
                    continue
                ids = a if same else np.concatenate((a, b))
                shift = 0 if same else len(a)
                links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for i, j in linked_pairs(x, y, threshold, same):
                    j = j + shift
                    copies = m if same else np.concatenate((m, n))
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    label = least_joined(label, i, j)
                hit = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(links[hit])], ["a", "b", "links"])

    return work


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vectors`` (vec_id, embedding, label; other columns are ignored) ->
    vec_id, n_links, component_id, kept: one row per row.

    Only vectors of equal, not null label and equal length are compared.
    Vectors that are null, empty, zero, or hold null or non-finite components,
    and those without a label or id, link with nothing. Repeated rows and equal
    vectors link with each other. The work is that of all tile pairs of a
    label, spread over tasks of two tiles each; no tile is collected whole
    beyond ``tile`` rows, give or take the spread of a hash."""
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    valid = plain(source, "embedding").where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    packed = materialize(valid.mapInArrow(_packed, "vec_id long, label string, sig binary, vector binary"), "vectors")
    equal = packed.groupBy("label", "sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = materialize(packed.select("vec_id", "label", "sig").join(equal, ["label", "sig"]), "members")
    reps = packed.join(members.where("vec_id = rep").select("vec_id", "label", "sig", "copies").distinct(), ["vec_id", "label", "sig"])
    reps = reps.withColumn("size", F.length("vector")).dropDuplicates(["vec_id", "label", "sig"])
    counts = reps.groupBy("label", "size").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = reps.join(counts, ["label", "size"]).select(
        F.concat_ws(":", F.col("size").cast("string"), "label").alias("label"), "tiles", F.col("vec_id").alias("rep"), "copies", "vector",
        F.pmod(F.xxhash64("vec_id"), F.col("tiles").cast("long")).cast("int").alias("tile"))
    tiles = materialize(placed.groupBy("label", "tile").applyInArrow(
        _tile, "label string, tiles int, tile int, ids binary, copies binary, vectors binary"), "tiles")
    left = tiles.withColumn("other", F.explode(F.expr("sequence(tile, tiles - 1)")))
    right = tiles.select("label", F.col("tile").alias("other"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"),
                         F.col("vectors").alias("vectors2"))
    pairs = left.join(right, ["label", "other"]).repartition(F.col("label"), F.col("tile"), F.col("other"))
    found = materialize(pairs.mapInArrow(_multiplied(threshold), "a long, b long, links long"), "tile-links")
    roots = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    known = members.select("vec_id", "rep", "copies").distinct()
    known = known.join(links, known["rep"] == links["a"], "left").join(roots, known["rep"] == roots["node"], "left").select(
        known["vec_id"], (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    known = known.groupBy("vec_id").agg(F.max("n").alias("n"), F.min("root").alias("root"))
    every = source.select("vec_id")
    joined = every.join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id"))
