from __future__ import annotations

import hashlib

import numpy as np
import pytest

from gridloom.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, upper string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, "u") for i, v in rows], SCHEMA)


def brute(rows, k=8, rounds=10, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    if not kept:
        return []
    vectors = np.array([v for _, v in kept], np.int64)
    hashes = [("~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept]
    centroids = vectors[sorted(range(len(kept)), key=hashes.__getitem__)[:k]].copy()
    for turn in range(rounds + 1):
        squares = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        own, d = squares.argmin(axis=1), squares.min(axis=1)
        if turn < rounds:
            for j in range(len(centroids)):
                mine = vectors[own == j]
                if len(mine):
                    centroids[j] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, int(a), int(x), int(d[own == a].sum()), int(d.sum()), digests[a]) for (i, _), a, x in zip(kept, own, d)),
        key=str,
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def blobs(n, seed=0, around=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(around, 64)) * 2
    at = rng.integers(0, around, n)
    return [(int(k), (middle[at[k]] + rng.normal(size=64) * 0.4).astype(np.float32).tolist()) for k in range(n)]


def test_blobs_against_brute_force(spark):
    rows = blobs(700)
    assert found(clusters.cluster(table(spark, rows).repartition(3))) == brute(rows)


def test_edges(spark):
    good = blobs(12, seed=5)
    rows = good + good[:3] + [
        (None, good[0][1]), (50, None), (51, []), (52, [0.5] * 63), (53, [0.5] * 65), (54, [None] + [0.5] * 63),
        (55, [float("nan")] + [0.5] * 63), (56, [float("inf")] * 64), (57, [-0.0] * 64), (58, [0.5] * 64), (58, [0.25] * 64),
    ]
    assert found(clusters.cluster(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0] * 64)], [(k, [2.0] * 64) for k in range(20)]])
def test_few_or_equal_vectors(spark, rows):
    got = clusters.cluster(table(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(got) == brute(rows)


def test_only_the_last_round_stays_on_disk(spark, monkeypatch):
    made, gone = [], []
    monkeypatch.setattr(clusters, "new_folder", lambda s, w, f=clusters.new_folder: made.append(f(s, w)) or made[-1])
    monkeypatch.setattr(clusters, "removed", lambda s, p, f=clusters.removed: gone.append(p) or f(s, p))
    clusters.cluster(table(spark, blobs(30)), rounds=4).collect()
    assert len(made) == 5 and gone == made[:-1]


def test_drops_bound_what_distances_fall():
    """No vector in a cluster's sphere comes nearer to a moved centroid than the bound says."""
    rng = np.random.default_rng(7)
    less = 0
    for size in (2, 3, 16):
        for _ in range(60):
            old = rng.integers(-400, 400, (4, size))
            new = old + rng.integers(-60, 60, (4, size))
            radius = rng.uniform(0, 250, 4)
            bound = clusters.drops(old, new, radius)
            drift = np.sqrt(((new - old) ** 2).sum(axis=1))
            assert (bound <= drift[None] + 1e-9).all()
            less += int((bound < 0.9 * drift[None]).sum())
            way = rng.normal(size=(4, 300, size))
            far = radius[:, None] * rng.uniform(0, 1, (4, 300)) ** (1 / size)
            inside = old[:, None] + way / np.linalg.norm(way, axis=2, keepdims=True) * far[..., None]
            for i in range(4):
                before = np.linalg.norm(inside[i][:, None] - old[None], axis=2)
                after = np.linalg.norm(inside[i][:, None] - new[None], axis=2)
                assert (before - after <= bound[i] + 1e-7).all()
    assert less > 500


def test_tight_bounds_spare_scans():
    """Vectors of clear clusters are not scanned again, and geometry spares more than drift."""
    rows = blobs(2000, seed=2, around=8)
    vectors = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    scans = {}
    for tight in (True, False):
        centroids = vectors[:8].copy()
        n, k = len(vectors), 8
        state = np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
        drift, drop, scans[tight] = np.zeros(k), np.zeros((k, k)), 0
        for _ in range(8):
            own, upper, lower, met = clusters.reassign(vectors, *state, centroids, drift, drop)
            assert (own == clusters._squares(vectors, centroids).argmin(axis=1)).all()
            scans[tight] += met
            moved = np.array([vectors[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else centroids[j] for j in range(k)])
            radius = np.array([upper[own == j].max(initial=0) for j in range(k)], float)
            drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1))
            drop = clusters.drops(centroids, moved, radius) if tight else np.tile(drift, (k, 1))
            state, centroids = (own, upper, lower), moved
    assert scans[True] <= scans[False] < 8 * len(vectors) / 2
