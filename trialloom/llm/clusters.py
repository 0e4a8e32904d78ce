"""Centroid clustering of integer vectors over dictionaries of their subvectors.

Components become the integers floor(scale * x). Vectors are packed into shards; in
each, every block of ``WIDTH`` dimensions is replaced by codes into the shard's
dictionary of distinct subvectors, without loss. Shards are written once. A round is one
pass over them without a shuffle of vectors: the exact squared distances of every
dictionary entry to all centroids are computed once, a vector's distances are the
sums of its entries' by code, and new centroids come from the number of times each
code fell to each cluster. A dictionary belongs to a shard because one for all
vectors would grow with them: it would have to be joined to every vector and block
in every round, or broadcast without a bound. Only k centroids travel.

All is exact integer arithmetic: 64-bit where no square can leave it, else Python's
integers; sums leave a task in limbs of 31 bits, so no total overflows. A distance or inertia
beyond 64 bits, which only components near 2**28 and more can cause, is null; the
cluster is right all the same.

Defined cases: vectors that are null, of another length or with a null or
non-finite component take no part. Repeated rows are vectors of their own; so are
rows with a null id, which draw as the word ``null``. Starting vectors with equal ids come in the
order of their components; fewer than k vectors are so many centroids. Ties go to the
smaller centroid, an empty cluster keeps its centroid. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.staging import stage

#: Dimensions in a block. Two integers repeat often, longer subvectors seldom do.
WIDTH = 2
#: Vectors in a shard: a dictionary pays from some thousands on, and a shard of 64 dimensions is some 1 MB.
SHARD = 16_384
#: Components up to this size keep a squared distance over 64 dimensions within 62 bits.
SMALL = 1 << 27
_LIMB = 31

_SHARD_ROW = "ids array<long>, small boolean, sizes array<int>, entries binary, codes binary"


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter((F.size("embedding") == dimensions) & finite)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: int64, or Python integers where some are large."""
    values = values.astype(np.float64)
    if not len(values) or np.abs(values).max() * scale < SMALL:
        return np.floor(values * scale).astype(np.int64)
    flat = [floor(Fraction(float(x)) * scale) for x in values.ravel()]
    return np.array(flat, dtype=object).reshape(values.shape)


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _distinct(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and each row's code."""
    if block.dtype != object:
        shifted = block - block.min(axis=0)
        span = [int(x) + 1 for x in shifted.max(axis=0)]
        if np.prod(span, dtype=object) < 1 << 62:
            key = np.ravel_multi_index(shifted.T, span)
            _, first, codes = np.unique(key, return_index=True, return_inverse=True)
            return block[first], codes
    known: dict[tuple, int] = {}
    codes = np.array([known.setdefault(tuple(row), len(known)) for row in block.tolist()])
    return np.array(list(known), dtype=block.dtype), codes


def _pack(ids: list, ints: np.ndarray) -> dict:
    small = ints.dtype != object
    sizes, entries, codes = [], [], []
    for at in range(0, ints.shape[1], WIDTH):
        found, own = _distinct(ints[:, at : at + WIDTH])
        sizes.append(len(found))
        flat = found.ravel()
        entries.append(flat.astype("<i8").tobytes() if small else (",".join(map(str, flat)) + ",").encode())
        codes.append(own.astype("<u2").tobytes())
    return {"ids": ids, "small": small, "sizes": sizes, "entries": b"".join(entries), "codes": b"".join(codes)}


def encode(vectors: DataFrame, scale: int, dimensions: int) -> DataFrame:
    """The shards of ``usable`` vectors."""
    kinds = [pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(("ids", "small", "sizes", "entries", "codes"), kinds, strict=True)))

    def run(batches):
        ids, parts = [], []

        def shard():
            row = _pack(ids[:SHARD], np.concatenate(parts)[:SHARD])
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for low in range(0, batch.num_rows, SHARD):
                piece = batch.slice(low, SHARD)
                ids += piece.column("vec_id").to_pylist()
                parts.append(integers(_matrix(piece.column("embedding"), dimensions), scale))
                if len(ids) >= SHARD:
                    yield shard()
                    ids, parts = ids[SHARD:], [np.concatenate(parts)[SHARD:]]
        if ids:
            yield shard()

    return vectors.mapInArrow(run, _SHARD_ROW)


def _blocks(shard: dict, dimensions: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, entries, codes) of each block."""
    n, done = len(shard["ids"]), 0
    if shard["small"]:
        entries = np.frombuffer(shard["entries"], "<i8")
    else:
        entries = np.array([int(x) for x in shard["entries"].decode().split(",")[:-1]], dtype=object)
    codes = np.frombuffer(shard["codes"], "<u2").reshape(-1, n)
    for at, size, own in zip(range(0, dimensions, WIDTH), shard["sizes"], codes, strict=True):
        width = min(WIDTH, dimensions - at)
        yield at, entries[done : done + size * width].reshape(size, width), own
        done += size * width


def assign(shard: dict, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector of a shard."""
    dimensions = len(centroids[0])
    far = max(abs(x) for c in centroids for x in c) > SMALL
    kind = object if far or not shard["small"] else np.int64
    middle, total = np.array(centroids, dtype=kind), 0
    for at, entries, codes in _blocks(shard, dimensions):
        difference = entries.astype(kind)[:, None, :] - middle[None, :, at : at + entries.shape[1]]
        total = total + (difference * difference).sum(axis=2)[codes]
    nearest = total.argmin(axis=1)
    return nearest, np.take_along_axis(total, nearest[:, None], 1)[:, 0]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    at = 0
    while not -(1 << 40) <= value < 1 << 40:
        yield at, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        at += 1
    yield at, value


def moved(shards: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of each cluster's mean, component by component."""
    k, dimensions = len(centroids), len(centroids[0])

    def run(batches):
        for batch in batches:
            rows = []
            for shard in batch.to_pylist():
                nearest, _ = assign(shard, centroids)
                rows += [(c, -1, 0, n) for c, n in enumerate(np.bincount(nearest, minlength=k).tolist()) if n]
                for at, entries, codes in _blocks(shard, dimensions):
                    size = len(entries)
                    fell = np.bincount(nearest * size + codes, minlength=k * size).reshape(k, size)
                    sums = fell.astype(entries.dtype) @ entries
                    rows += [
                        (c, at + d, limb, part)
                        for c in range(k) if fell[c].any()
                        for d in range(entries.shape[1])
                        for limb, part in _limbs(int(sums[c, d]))
                    ]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                names=["cluster", "dimension", "limb", "part"],
            )

    parts = shards.mapInArrow(run, "cluster int, dimension int, limb int, part long")
    # At most k * (dimensions + 1) * limbs rows.
    found = parts.groupBy("cluster", "dimension", "limb").agg(F.sum("part").alias("part")).collect()
    totals: dict[tuple[int, int], int] = {}
    for cluster, dimension, limb, part in found:
        totals[cluster, dimension] = totals.get((cluster, dimension), 0) + (part << (_LIMB * limb))
    return [
        [totals[c, d] // totals[c, -1] for d in range(dimensions)] if (c, -1) in totals else centroids[c]
        for c in range(k)
    ]


def starts(vectors: DataFrame, k: int, seed: int, scale: int, dimensions: int) -> list[list[int]]:
    """The k ``usable`` vectors of least digest, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    # Equal ids: in the order of the components.
    rows = vectors.select(digest.alias("digest"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("digest", "embedding").limit(k).collect()
    return [[floor(Fraction(x) * scale) for x in row["embedding"]] for row in rows]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, dimensions: int = 64
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster and distance of every usable vector, the centroids they were assigned to)."""
    kept = usable(vectors, dimensions)
    centroids = starts(kept, k, seed, scale, dimensions)
    shards = stage(encode(kept, scale, dimensions), "cluster-shards")
    for _ in range(rounds if centroids else 0):
        centroids = moved(shards, centroids)

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                nearest, distance = assign(shard, centroids)
                fits = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard["ids"], pa.int64()), pa.array(nearest.astype(np.int32)), pa.array(fits, pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    return stage(shards.mapInArrow(run, "vec_id long, cluster int, distance long"), "cluster-assigned"), centroids


def described(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (null beyond 64 bits) and centroid_sha256."""
    spark = assigned.sparkSession
    # One row for each of k clusters. A null distance is too large to add up.
    known = (F.count("*") == F.count("distance")).alias("known")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), known).collect()
    long = lambda rows: t if all(r["known"] for r in rows) and (t := sum(int(r["total"]) for r in rows)) < 1 << 63 else None
    table = [
        (r["cluster"], long([r]), long(sums), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest())
        for r in sums
    ]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
