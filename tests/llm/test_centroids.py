"""Centroids against Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from kgloom.llm import op12_centroids as op

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= 10**18 / 64 for x in v)]
    by_hash = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in by_hash[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    fit = lambda x: None if x is None or x >= 2**63 else x
    inertia = {}
    for _, j, d in found:
        inertia[j] = None if fit(d) is None or inertia.get(j, 0) is None else inertia.get(j, 0) + d
    total = None if None in inertia.values() else sum(inertia.values())
    return [(i, j, fit(d), fit(inertia[j]), fit(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found]


def result(spark, rows, tmp_path):
    spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op.op12_centroids(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(rng, n, spread=1.0):
    return [[rng.gauss(0, spread) for _ in range(64)] for _ in range(n)]


def test_random(spark, tmp_path):
    rng = random.Random(1)
    rows = list(enumerate(vectors(rng, 120)))
    rows += [(200, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]  # copies, equal ids, no id
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [None] + [0.5] * 63), (304, [math.nan] * 64), (305, [math.inf] + [0.1] * 63), (306, [1e17] + [0.1] * 63)]
    assert result(spark, rows, tmp_path) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("spread", [1e6, 1e9, 1e15])
def test_large(spark, tmp_path, spread):
    """Beyond what squares in 64 bits hold: Python's integers, and null where a distance doesn't fit."""
    rng = random.Random(2)
    rows = list(enumerate(vectors(rng, 30, 1.0) + vectors(rng, 10, spread)))
    assert result(spark, rows, tmp_path) == sorted(brute(rows), key=str)


def test_few(spark, tmp_path):
    assert result(spark, [], tmp_path / "none") == []
    few = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)]  # ties go to the lower number, and leave a centroid empty
    assert result(spark, few, tmp_path / "few") == sorted(brute(few), key=str)


@pytest.mark.parametrize("scale", [3, 1000, 10**6, 10**8])
def test_intervals(scale):
    """The exact value lies within the bounds, and the screen never changes the winner, also among near ties."""
    rng = np.random.default_rng(scale)
    c = rng.integers(-scale, scale + 1, (16, 64))
    c[5], c[9] = c[2], c[2]
    c[9, 0] += 1
    x = np.concatenate([rng.integers(-scale, scale + 1, (300, 64)), (c[rng.integers(0, 16, 300)] + c[rng.integers(0, 16, 300)]) // 2, c])
    near = op.Nearest(c.tolist())
    assert near.screens
    exact = np.array([[int(sum(int(b) ** 2 for b in cj) - 2 * sum(int(a) * int(b) for a, b in zip(xi, cj, strict=True))) for cj in c] for xi in x], dtype=object)
    lower, upper = near.bounds(x)
    assert all(lo <= e <= hi for lo, e, hi in zip(lower.ravel(), exact.ravel(), upper.ravel(), strict=True))
    cluster, distance, pairs = near(x)
    full = ((x.astype(object)[:, None, :] - c.astype(object)[None, :, :]) ** 2).sum(axis=2)
    assert cluster.tolist() == [r.index(min(r)) for r in full.tolist()] and distance == [min(r) for r in full.tolist()]
    assert pairs < x.shape[0] * 16  # most pairs are screened out
