"""Centroid clustering with lower bounds that loosen by geometry, not by full drift."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import new_folder, removed
from .topk import whole_components

# Relative room that covers the rounding of distances and bounds.
SLACK = 1e-6
SLICE_ROWS = 16_384

STATE = "vec_id long, v array<long>, cluster int, upper float, lower array<float>"
TOTALS = "group int, n long, sums array<long>, radius double, inertia long"
SCHEMA = f"{STATE}, distance long, {TOTALS}"


def drops(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer centroid ``j`` can have come to any vector of cluster ``i``.

    The vectors of cluster ``i`` lie in a sphere of ``radius[i]`` about ``old[i]``. For a vector
    at distance ``d`` from the midpoint of a centroid's way, at an angle ``t`` to its
    direction, the distance to the centroid falls by ``2 * drift * d * cos(t)`` over the sum of
    its distances to both ends, which is at least ``2 * d``: by at most ``drift * cos(t)``.
    In the plane through the way and the sphere's centre the least angle to the sphere is the
    centre's angle less the one under which the radius appears. If the midpoint lies in the
    sphere or the way points into it, that is the full drift; beyond a right angle, nothing.
    """
    way = (new - old).astype(np.float64)
    drift = np.sqrt((way * way).sum(axis=1))
    moved = drift > 0
    ahead = np.divide(way, drift[:, None], out=np.zeros_like(way), where=moved[:, None])
    seen = old.astype(np.float64)[:, None, :] - (old + new).astype(np.float64)[None] / 2
    far = np.sqrt((seen * seen).sum(axis=2))
    outside = far > radius[:, None] * (1 + SLACK)
    cosine = np.divide((seen * ahead[None]).sum(axis=2), far, out=np.ones_like(far), where=outside)
    sine = np.divide(radius[:, None], far, out=np.ones_like(far), where=outside)
    least = np.arccos(np.clip(cosine, -1, 1)) - np.arcsin(np.clip(sine, 0, 1))
    share = np.where(outside & (least > 0), np.maximum(np.cos(least), 0.0), 1.0)
    return drift[None] * np.minimum(1.0, share + SLACK)


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        apart = vectors - c
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def _below(x: np.ndarray) -> np.ndarray:
    """Lower bounds as 32-bit floats, never above ``x``."""
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def reassign(
    vectors: np.ndarray,
    cluster: np.ndarray,
    upper: np.ndarray,
    lower: np.ndarray,
    centroids: np.ndarray,
    drift: np.ndarray,
    drop: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of every vector, its bounds, and how many vectors were scanned.

    ``upper`` bounds the distance to a vector's own centroid before the move, ``lower`` that to
    each centroid; ``drift`` and ``drop`` say how far centroids moved and how much nearer they
    can have come. A vector whose own centroid is surely nearer than all others is left; then
    its own distance is measured; only one that is still ambiguous meets all centroids, and
    equal distances go to the smaller number.
    """
    rows, k = np.arange(len(vectors)), len(centroids)
    high = upper.astype(np.float64) + drift[cluster]
    low = np.maximum(lower.astype(np.float64) - drop[cluster], 0.0)
    low[rows, cluster] = np.inf
    nearest_other = low.min(axis=1) if k > 1 else np.full(len(rows), np.inf)
    unsure = np.flatnonzero(high * (1 + SLACK) >= nearest_other)
    apart = vectors[unsure] - centroids[cluster[unsure]]
    high[unsure] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    scanned = unsure[high[unsure] * (1 + SLACK) >= nearest_other[unsure]]
    cluster = cluster.copy()
    squares = _squares(vectors[scanned], centroids)
    best = squares.argmin(axis=1)
    cluster[scanned] = best
    low[scanned] = np.sqrt(squares)
    high[scanned] = low[scanned, best]
    low[rows, cluster] = 0.0
    return cluster, _above(high), _below(low), len(scanned)


def _matrix(batch: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


class _Totals:
    """Sums over the vectors of one task, by cluster."""

    def __init__(self, k: int, size: int) -> None:
        self.n, self.sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        self.radius, self.inertia = np.zeros(k), np.zeros(k, np.int64)

    def add(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, distance) -> None:
        self.n += np.bincount(cluster, minlength=len(self.n))
        np.maximum.at(self.radius, cluster, upper.astype(np.float64))
        for j in np.unique(cluster):
            mine = cluster == j
            self.sums[j] += vectors[mine].sum(axis=0)
            if distance is not None:
                self.inertia[j] += distance[mine].sum()

    def batch(self) -> pa.RecordBatch:
        k = len(self.n)
        held = [
            *(pa.nulls(k, t) for t in _types(STATE)), pa.nulls(k, pa.int64()),
            pa.array(np.arange(k, dtype=np.int32)), pa.array(self.n),
            pa.array(list(self.sums), pa.list_(pa.int64())), pa.array(self.radius), pa.array(self.inertia),
        ]
        return pa.RecordBatch.from_arrays(held, _names(SCHEMA))


KINDS = {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64(),
         "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    return [KINDS[c.split()[1]] for c in schema.split(", ")]


def _step(
    state: DataFrame,
    centroids: np.ndarray,
    drift: np.ndarray | None,
    drop: np.ndarray | None,
    *,
    measured: bool,
) -> DataFrame:
    """One pass: assigns every vector and adds, per task, one row of totals for each cluster.

    Without ``drift`` there are no bounds yet and every vector meets all centroids.
    """
    k, size = centroids.shape
    shared = state.sparkSession.sparkContext.broadcast((centroids, drift, drop))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, drift, drop = shared.value
        totals = _Totals(k, size)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                vectors = _matrix(batch, "v", size, np.int64)
                n = len(vectors)
                if drift is None:
                    start = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k)), centroids, np.zeros(k), np.zeros((k, k))
                else:
                    own = batch.column("cluster").to_numpy()
                    bounds = batch.column("upper").to_numpy(), _matrix(batch, "lower", k, np.float32)
                    start = own, *bounds, centroids, drift, drop
                cluster, upper, lower, _ = reassign(vectors, *start)
                distance = None
                if measured:
                    apart = vectors - centroids[cluster]
                    distance = np.einsum("ij,ij->i", apart, apart)
                totals.add(vectors, cluster, upper, distance)
                # The last pass hands on distances only.
                last = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.float32()))
                columns = [
                    batch.column("vec_id"), last[0] if measured else batch.column("v"),
                    pa.array(cluster.astype(np.int32)), pa.array(upper),
                    last[1] if measured else pa.array(list(lower), pa.list_(pa.float32())),
                    pa.nulls(n, pa.int64()) if distance is None else pa.array(distance),
                    *(pa.nulls(n, t) for t in _types(TOTALS)),
                ]
                yield pa.RecordBatch.from_arrays(columns, _names(SCHEMA))
        yield totals.batch()

    return state.mapInArrow(run, SCHEMA)


def _totals(step: DataFrame, k: int, size: int) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """Vectors, sums, radius and inertia of every cluster; reads no column of the vectors."""
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    rows = (
        step.where("group is not null").groupBy("group")
        .agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"), *sums)
        .collect()
    )
    n, total = np.zeros(k, np.int64), [[0] * size for _ in range(k)]
    radius, inertia = np.zeros(k), np.zeros(k, np.int64)
    for r in rows:
        j = r["group"]
        n[j], radius[j], inertia[j] = r["n"], r["radius"], r["inertia"]
        total[j] = [r[f"s{i}"] for i in range(size)]
    return n, total, radius, inertia


def cluster(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    size: int = 64,
    scale: int = 1024,
    k: int = 8,
    seed: int = 3,
    rounds: int = 10,
) -> DataFrame:
    """Clusters vectors about ``k`` centroids; one row per vector that takes part.

    Components become ``floor(scale * x)``; a vector that is null, has another number of
    components than ``size`` or holds a null or non-finite one takes no part. Centroids start
    as the vectors whose id has the smallest ``sha256("<seed>:<id>")``, and each round replaces
    them by the floors of their vectors' means; all distances and sums are exact integers
    (squared distances must fit 64 bits).

    Every round is one pass. The vectors' cluster and bounds (an upper one to the own centroid,
    a lower one to each) are written beside them to the shared folder, and the round before is
    removed once they are; sums by cluster ride along as one row per task and cluster, so no
    vector is shuffled and none can be hot. To every task go ``k`` centroids and a ``k * k``
    table of ``drops``.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.
    Null ids pass through and serve as first centroids last; equal distances go to the smaller
    number, equal hashes (repeated ids) by components; repeated rows each count; fewer than
    ``k`` vectors give fewer centroids; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    whole = whole_components(named(vector_column), scale)
    state = vectors.select(named(id_column).cast("long").alias("vec_id"), whole.alias("v"))
    state = state.where(F.col("v").isNotNull() & (F.size("v") == size))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids = np.array([r["v"] for r in first], np.int64)
    k, drift, drop, before = len(centroids), None, None, None
    for turn in range(rounds + 1):
        folder = new_folder(spark, "clusters")
        step = _step(state, centroids, drift, drop, measured=turn == rounds)
        step.write.parquet(folder)
        step = spark.read.schema(step.schema).parquet(folder)
        if before:
            removed(spark, before)
        before, state = folder, step.where("group is null")
        n, sums, radius, inertia = _totals(step, k, size)
        if turn < rounds:
            moved = np.array(
                [[s // int(m) for s in row] if m else list(c) for row, m, c in zip(sums, n, centroids)], np.int64
            )
            drift = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1))
            drop, centroids = drops(centroids, moved, radius), moved
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame(
        [(j, int(inertia[j]), int(inertia.sum()), digests[j]) for j in range(k)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    found = state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster")
    return found.select(*_names(result))
