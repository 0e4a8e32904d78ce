"""Approximate nearest neighbours by cosine: few stable projections, a kd-tree, and a chi-square stop.

Unit vectors are projected on ``PROJECTIONS`` Gaussian directions. The squared
projected distance of two vectors is their squared distance times a chi-square
variable with as many degrees of freedom. So neighbours are taken in the order of
their projected distance r from the kd-tree and verified by their exact cosine,
until r**2 is so large that a vector closer than the k-th found, d, would with
probability ``CONFIDENCE`` have come before: r**2 > quantile * d**2.

The tree is one over all rows. Its upper part splits space into at most ``CELLS``
cells; the splits come from a bounded sample, every row is indexed. A cell is
stored in shards of bounded size, each with a lower tree, built where it is
searched. A query first searches its own cell, then the cells whose boxes the
stopping test cannot rule out with the distance found. Queries meet shards in
blocks.

Equal vectors are indexed once, with the smallest ids, as many as a result can
hold; so a vector that a third of all rows share is one point, and its ties come
out right.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, as queries and candidates; vectors of another length than
the query's are no candidates; a null id takes no part; repeated rows are one; with
fewer candidates than asked for, all are found; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.staging import stage

PROJECTIONS = 8
CONFIDENCE = 0.97
#: The splits of the cells come from so many vectors, the first by a hash of their content.
SAMPLE = 8_192
CELLS, CELL_ROWS = 256, 4_096
SHARD_ROWS, QUERY_BLOCK = 16_384, 2_048
LEAF = 256


def chi_square_quantile(p: float, degrees: int) -> float:
    """Inverse of the chi-square distribution, for an even number of degrees of freedom."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return low


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """Arrow lists of one length as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Tree:
    """A kd-tree over projected vectors, searched leaf by leaf in the order of their boxes' distance."""

    def __init__(self, points: np.ndarray):
        self.nodes: list[tuple] = []
        self._grow(points, np.arange(len(points)))

    def _grow(self, points: np.ndarray, rows: np.ndarray) -> int:
        here = points[rows]
        low, high = here.min(0), here.max(0)
        at = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= LEAF or (high == low).all():
            self.nodes[at] = (low, high, rows, -1, -1)
        else:
            axis = int(np.argmax(high - low))
            order = np.argsort(here[:, axis], kind="stable")
            half = len(rows) // 2
            left, right = self._grow(points, rows[order[:half]]), self._grow(points, rows[order[half:]])
            self.nodes[at] = (low, high, None, left, right)
        return at

    def leaves(self, q: np.ndarray):
        """(squared distance of the box, rows) of each leaf, nearest box first."""
        far = lambda n: float((np.maximum(np.maximum(n[0] - q, q - n[1]), 0) ** 2).sum())
        heap = [(far(self.nodes[0]), 0)]
        while heap:
            distance, at = heapq.heappop(heap)
            _, _, rows, left, right = self.nodes[at]
            if rows is not None:
                yield distance, rows
            else:
                for child in (left, right):
                    heapq.heappush(heap, (far(self.nodes[child]), child))


def search(tree: Tree, vectors: np.ndarray, norms: np.ndarray, ids: list[list[int]], q: np.ndarray, projected: np.ndarray, bound: float, k: int, quantile: float) -> list[tuple[float, int]]:
    """The k best (score, id), best first; ``bound`` is a squared distance known to hold k vectors."""
    best: list[tuple[float, int]] = []
    size = float(np.linalg.norm(q))
    limit = bound
    for distance, rows in tree.leaves(projected):
        if distance > quantile * limit:
            break
        # Rounding cannot order equal vectors differently: they are one row.
        scores = vectors[rows] @ q / (norms[rows] * size)
        least = best[k - 1][0] if len(best) >= k else -math.inf
        better = np.flatnonzero(scores >= least)
        if not len(better):
            continue
        if len(better) > k:  # no more than the k best, and what equals the last of them, can stay
            better = better[scores[better] >= np.partition(scores[better], -k)[-k]]
        for i in better.tolist():
            best.extend((float(scores[i]), v) for v in ids[rows[i]])
        best = sorted(best, key=lambda b: (-b[0], b[1]))[:k]
        if len(best) >= k:
            limit = min(limit, max(2 - 2 * best[k - 1][0], 1e-12))
    return best


def valid(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Cells:
    """The upper tree: a split for each inner node, and the box of each cell's rows."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.splits = depth, {}
        self._split(sample, 1, depth)

    def _split(self, points: np.ndarray, node: int, depth: int) -> None:
        if depth:
            axis = int(np.argmax(points.max(0) - points.min(0))) if len(points) else 0
            cut = float(np.median(points[:, axis])) if len(points) else 0.0
            self.splits[node] = (axis, cut)
            right = points[:, axis] > cut if len(points) else np.zeros(0, bool)
            self._split(points[~right], 2 * node, depth - 1)
            self._split(points[right], 2 * node + 1, depth - 1)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        axis, cut = np.zeros(2 << self.depth, np.int64), np.zeros(2 << self.depth)
        for node, (a, c) in self.splits.items():
            axis[node], cut[node] = a, c
        node, every = np.ones(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[every, axis[node]] > cut[node])
        return node


_FOUND = "query long, vec_id long, score double"


def _candidates(points: DataFrame, queries: DataFrame, blocks: int, k: int, quantile: float) -> DataFrame:
    """Search each query (query, vector, bound, cell, shard, block) in its shard."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors, ids = _matrix(left.column("vector")), left.column("ids").to_pylist()
            project = directions(vectors.shape[1])
            norms = np.linalg.norm(vectors, axis=1)
            tree = Tree(_units(vectors) @ project)
            asked = _matrix(right.column("vector"))
            for query, q, p, bound in zip(right.column("query").to_pylist(), asked, _units(asked) @ project, right.column("bound").to_pylist(), strict=True):
                found.extend((query, v, s) for s, v in search(tree, vectors, norms, ids, q, p, bound, k, quantile))
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query", "vec_id", "score"])

    keys = ["dim", "cell", "shard", "block"]
    spread = points.withColumn("block", F.explode(F.lit(list(range(blocks)))))
    return spread.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(rows: DataFrame, asked: Column, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row that ``asked`` holds for.

    ``rows`` has vec_id and embedding; a row is no neighbour of itself.
    """
    quantile = chi_square_quantile(confidence, PROJECTIONS)
    usable = rows.filter(valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    usable = usable.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), asked.alias("_asked"))
    k1 = k + 1  # a row finds itself
    order = W.partitionBy("vector").orderBy("vec_id")
    few = usable.select("vec_id", "vector").withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= k1)
    distinct = few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    distinct = stage(distinct.withColumn("dim", F.size("vector")), "nearest-vectors")

    def projected(batches):
        for batch in batches:
            p = np.array([_units(np.array([v], np.float64))[0] @ directions(len(v)) for v in batch.column("vector").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(list(p), pa.list_(pa.float64()))], names=["dim", "p"])

    total = distinct.count()
    depth = min(max(total // CELL_ROWS, 1).bit_length() - 1, CELLS.bit_length() - 1)
    sample = distinct.orderBy(F.xxhash64("vector"), F.col("ids")[0]).limit(SAMPLE).select("dim", "vector")
    by_dim: dict[int, list] = {}
    for r in sample.mapInArrow(projected, "dim int, p array<double>").collect() if depth else ():
        by_dim.setdefault(r.dim, []).append(r.p)
    cells = {dim: Cells(np.array(p), depth) for dim, p in by_dim.items()}

    def place(batches):
        for batch in batches:
            cell = np.ones(batch.num_rows, np.int64)
            box = np.zeros((batch.num_rows, PROJECTIONS))
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                box[here] = _units(_matrix(batch.column("vector").take(pa.array(here)))) @ directions(dim)
                if dim in cells:
                    cell[here] = cells[dim](box[here])
            names = [n for n in batch.schema.names if n not in ("cell", "p")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(cell), pa.array(list(box), pa.list_(pa.float64()))], names=[*names, "cell", "p"])

    placed = stage(distinct.mapInArrow(place, "vector array<double>, ids array<long>, dim int, cell long, p array<double>"), "nearest-placed")
    edges = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTIONS)]
    known = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), *edges).collect()
    # A table of at most CELLS rows for each length of vectors.
    shape = {(r.dim, r.cell): (-(-r.n // SHARD_ROWS), np.array([r[f"low{i}"] for i in range(PROJECTIONS)]), np.array([r[f"high{i}"] for i in range(PROJECTIONS)])) for r in known}
    shards = placed.sparkSession.createDataFrame([(d, c, s[0]) for (d, c), s in shape.items()], "dim int, cell long, shards int")
    points = placed.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int")).select("dim", "cell", "shard", "vector", "ids")

    queries = usable.filter("_asked").select("vec_id", "vector").distinct()
    one = stage(queries.groupBy("vector").agg(F.min("vec_id").alias("query")).withColumn("dim", F.size("vector")), "nearest-queries")
    blocks = max(1, -(-one.count() // QUERY_BLOCK))

    def route(first: bool):
        """Queries to the shards of their own cell, or of the other cells that the test leaves."""

        def run(batches):
            for batch in batches:
                vectors = batch.column("vector").to_pylist()
                out: list[tuple] = []
                for query, dim, vector, bound in zip(batch.column("query").to_pylist(), batch.column("dim").to_pylist(), vectors, batch.column("bound").to_pylist(), strict=True):
                    p = _units(np.array([vector], np.float64)) @ directions(dim)
                    own = int(cells[dim](p)[0]) if dim in cells else 1
                    for (d, cell), (n, low, high) in shape.items():
                        if d != dim or (cell == own) != first:
                            continue
                        if float((np.maximum(np.maximum(low - p[0], p[0] - high), 0) ** 2).sum()) <= quantile * bound:
                            out.extend((query, dim, vector, bound, cell, shard) for shard in range(n))
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["query", "dim", "vector", "bound", "cell", "shard"])

        return run

    routed = "query long, dim int, vector array<double>, bound double, cell long, shard int"
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    no_bound = one.withColumn("bound", F.lit(math.inf))
    first = no_bound.mapInArrow(route(True), routed).select("*", block)
    found = stage(_best(_candidates(points, first, blocks, k1, quantile), k1).select("query", "vec_id", "score"), "nearest-first")
    kth = found.groupBy("query").agg(F.count("*").alias("_n"), F.min("score").alias("_kth"))
    reach = F.when(F.col("_n") >= k1, F.greatest(2 - 2 * F.col("_kth"), F.lit(1e-12))).otherwise(math.inf)
    bounded = one.join(kth, "query", "left").withColumn("bound", F.coalesce(reach, F.lit(math.inf))).select("query", "dim", "vector", "bound")
    second = bounded.mapInArrow(route(False), routed).select("*", block)
    every = _best(found.unionByName(_candidates(points, second, blocks, k1, quantile)), k1).select("query", "vec_id", "score")

    named = queries.withColumnRenamed("vec_id", "query_id").join(one.select("query", "vector"), "vector").select("query_id", "query")
    others = named.join(every, "query").filter("query_id <> vec_id")
    final = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return others.select("query_id", final.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
