"""Centroid clustering against plain integer k-means."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from trialloom.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string"


def plain_version(rows, k=16, rounds=3, dimensions=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(Fraction(x) * 64) for x in v]))
    digest = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds if centroids else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    found = [(i, nearest(v)) for i, v in kept]
    total = sum(d for _, (d, _) in found)
    own = {c: sum(d for _, (d, x) in found if x == c) for _, (_, c) in found}
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(repr((i, c, fits(d), fits(own[c]), fits(total), sha(c))) for i, (d, c) in found)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    return sorted(map(repr, (tuple(r) for r in clusters.described(*clusters.cluster(df, **more)).collect())))


def vectors(rng, n, spread=0.4):
    return [(i, [rng.gauss(0, spread) for _ in range(64)]) for i in range(n)]


def test_equals_plain_k_means(shipped, monkeypatch):
    rng = random.Random(1)
    rows = vectors(rng, 300)
    # Left out, tied, repeated, without an id.
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63)]
    rows += [(910, [0.0] * 64)] * 20 + [(None, [0.25] * 64), (None, [-0.26] * 64)] + [(911, rows[0][1]), (911, rows[1][1])]
    expected = plain_version(rows)
    assert run(shipped, rows) == expected
    monkeypatch.setattr(clusters, "SHARD", 50)  # several shards in a partition, cut inside an Arrow batch
    shipped.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        assert run(shipped, rows) == expected
    finally:
        shipped.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_few_vectors_and_empty_tables(shipped):
    rows = vectors(random.Random(2), 5)
    assert run(shipped, rows) == plain_version(rows)
    assert run(shipped, []) == []
    assert run(shipped, [(1, None)]) == []


def test_empty_clusters_keep_their_centroid(shipped):
    # Equal starting vectors: the later of two never wins a tie.
    rows = [(i, [float(i % 3)] * 64) for i in range(40)]
    assert run(shipped, rows) == plain_version(rows)


@pytest.mark.parametrize("size", [1e6, 1e15, 1e300])
def test_components_beyond_64_bit_squares(shipped, size):
    rng = random.Random(3)
    rows = vectors(rng, 30) + [(100 + i, [rng.uniform(-size, size) for _ in range(64)]) for i in range(30)]
    assert run(shipped, rows) == plain_version(rows)


def test_odd_dimensions_and_other_sizes(shipped):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)]
    assert run(shipped, rows, k=3, rounds=5, dimensions=5) == plain_version(rows, k=3, rounds=5, dimensions=5)


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(5)
    for ints in (rng.integers(-40, 40, (500, 64)), rng.integers(-(1 << 26), 1 << 26, (200, 7)), np.array([[1 << 200, -5], [3, 1 << 90]], dtype=object)):
        shard = clusters._pack(list(range(len(ints))), ints)
        back = np.concatenate([entries[codes] for _, entries, codes in clusters._blocks(shard, ints.shape[1])], axis=1)
        assert back.tolist() == ints.tolist()
    # Two-dimensional blocks of small integers repeat.
    assert max(clusters._pack(list(range(500)), rng.integers(0, 9, (500, 64)))["sizes"]) <= 81
