"""Exact search for the largest inner products with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import stored

SLACK = 1e-6


def whole_components(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null if one is null or not finite."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return F.when(vector.isNotNull() & F.coalesce(fine, F.lit(False)), whole)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows filled with zeros."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    counts = np.diff(offsets)
    out = np.zeros((len(counts), size), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], counts)] = values
    return out


def _lifted(vectors: np.ndarray, top: int) -> np.ndarray:
    """Vectors with one more component that gives all of them the squared norm ``top``.

    Then the squared distance to a query lifted by 0 is ``|q|^2 + top - 2 * (q . v)``: the
    nearest vectors are those of the largest inner products.
    """
    flat = vectors.astype(np.float64)
    rest = np.maximum(top - (flat * flat).sum(axis=1), 0.0)
    return np.hstack([flat, np.sqrt(rest)[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point only where every sum is a whole number there."""
    top = [int(np.abs(m).max(initial=0)) for m in (queries, vectors)]
    if top[0] * top[1] * queries.shape[1] < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Pivots of a sample of lifted vectors: the farthest from those before, then centred."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    centres = sample[chosen].copy()
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(axis=1)
        for k in np.unique(own):
            centres[k] = sample[own == k].mean(axis=0)
    return centres


def _blocks(rows: DataFrame, size: int, top: int, centres: np.ndarray, per_block: int) -> DataFrame:
    """The index: rows keyed by nearest pivot and distance, sorted, cut into blocks."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), size)
            apart = _distances(_lifted(vectors, top), centres)
            own = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(own),
                 pa.array(apart[np.arange(len(own)), own])],
                ["vec_id", "v", "pivot", "distance"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        held: list[tuple[int, float, int, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal number, held
            number += 1
            values = [
                number - 1, held[0][0], held[0][1], held[-1][1],
                np.array([h[2] for h in held], np.int64).tobytes(),
                np.stack([h[3] for h in held]).tobytes(),
            ]
            held = []
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(values, kinds)],
                ["block", "pivot", "low", "high", "ids", "vectors"],
            )

        for batch in batches:
            vectors = _matrix(batch.column("v"), size)
            columns = (batch.column(c).to_pylist() for c in ("pivot", "distance", "vec_id"))
            for i, (pivot, distance, vec_id) in enumerate(zip(*columns)):
                if held and (held[0][0] != pivot or len(held) == per_block):
                    yield block()
                held.append((pivot, distance, vec_id, vectors[i]))
        if held:
            yield block()

    keyed = rows.mapInArrow(key, "vec_id long, v array<long>, pivot long, distance double")
    ordered = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions(
        "pivot", "distance", "vec_id"
    )
    return ordered.mapInArrow(
        cut, "block long, pivot long, low double, high double, ids binary, vectors binary"
    )


def _query_groups(queries: DataFrame, size: int, centres: np.ndarray, per_group: int) -> DataFrame:
    """Queries of the same nearest pivot in groups, with their distances to all pivots."""

    def lift(vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), 1))])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _distances(lift(_matrix(batch.column("v"), size)), centres)
            own = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(own),
                 pa.array(apart[np.arange(len(own)), own])],
                ["vec_id", "v", "pivot", "distance"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            pivots = batch.column("pivot").to_numpy()
            vectors, ids = _matrix(batch.column("v"), size), batch.column("vec_id").to_numpy()
            for pivot in np.unique(pivots):
                of = np.flatnonzero(pivots == pivot)
                for at in range(0, len(of), per_group):
                    part = of[at : at + per_group]
                    apart = _distances(lift(vectors[part]), centres)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([int(pivot)]),
                         pa.array([ids[part].tobytes()], pa.binary()),
                         pa.array([vectors[part].tobytes()], pa.binary()),
                         pa.array([apart.tobytes()], pa.binary())],
                        ["group", "home", "query_ids", "queries", "apart"],
                    )
                    number += 1

    keyed = queries.mapInArrow(nearest, "vec_id long, v array<long>, pivot long, distance double")
    ordered = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions(
        "pivot", "distance", "vec_id"
    )
    return ordered.mapInArrow(
        gather, "group long, home long, query_ids binary, queries binary, apart binary"
    )


def _rings(groups: DataFrame, pivots: int, top: int, home_only: bool) -> DataFrame:
    """For every group and pivot the distances a block must meet to hold a nearer vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                apart = np.frombuffer(row["apart"]).reshape(-1, pivots)
                reach = np.zeros(len(apart))
                if not home_only:
                    size = len(row["queries"]) // 8 // len(apart)
                    queries = np.frombuffer(row["queries"], np.int64).reshape(-1, size)
                    reach = _reach(queries, np.frombuffer(row["least"], np.int64), top)
                low, high = (apart - reach[:, None]).min(0), (apart + reach[:, None]).max(0)
                used = [row["home"]] if home_only else list(range(pivots))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["group"]] * len(used)), pa.array(used, pa.int64()),
                     pa.array(low[used] - SLACK * (1 + top**0.5)),
                     pa.array(high[used] + SLACK * (1 + top**0.5))],
                    ["group", "pivot", "inner", "outer"],
                )

    return groups.mapInArrow(run, "group long, pivot long, inner double, outer double")


NONE = -(1 << 62)


def _reach(queries: np.ndarray, least: np.ndarray, top: int) -> np.ndarray:
    """Distance within which a vector's inner product is ``least`` or more."""
    own = (queries.astype(np.float64) ** 2).sum(axis=1)
    squares = own + top - 2.0 * least
    return np.where(least == NONE, np.inf, np.sqrt(np.maximum(squares, 0.0)))


# Blocks and groups meet by tiles of 2 ** TILE_BITS neighbours each.
TILE_BITS = 4


def _tiles(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, block) pairs by tile: blocks with the groups that want them, and groups.

    Numbers follow the sorted order, so neighbours are close and mostly wanted together. A
    tile's rows are bounded, whatever the number of pairs.
    """
    bundle = F.shiftright("group", TILE_BITS).alias("bundle")
    shelf = F.shiftright("block", TILE_BITS).alias("shelf")
    wanted = pairs.groupBy(bundle, shelf, "block").agg(F.collect_set("group").alias("wanted"))
    return wanted, pairs.select(bundle, shelf, "group").distinct()


def _best(names: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, names))
    starts = np.flatnonzero(np.diff(names[order], prepend=names[order[:1]] - 1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < k]


def _scan(
    pairs: DataFrame, blocks: DataFrame, groups: DataFrame, size: int, pivots: int, top: int, k: int
) -> DataFrame:
    """The best ``k`` rows of a tile's blocks for every query of the groups that want them.

    A block's vectors travel once for all groups of a tile, a group's queries once for all
    blocks of a tile.
    """

    def serve(block: dict, group: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        names = np.frombuffer(group["query_ids"], np.int64)
        queries = np.frombuffer(group["queries"], np.int64).reshape(len(names), size)
        apart = np.frombuffer(group["apart"]).reshape(-1, pivots)[:, block["pivot"]]
        least = np.frombuffer(group["least"], np.int64)
        nearest = np.maximum(apart - block["high"], block["low"] - apart)
        live = np.flatnonzero(nearest <= _reach(queries, least, top) + SLACK * (1 + top**0.5))
        if not len(live):
            return
        ids = np.frombuffer(block["ids"], np.int64)
        vectors = np.frombuffer(block["vectors"], np.int64).reshape(len(ids), size)
        scores = _products(queries[live], vectors)
        for i, q in enumerate(live):
            fit = np.flatnonzero((scores[i] >= least[q]) & (ids != names[q]))
            if len(fit) > k:
                bar = np.partition(scores[i, fit], len(fit) - k)[len(fit) - k]
                fit = fit[scores[i, fit] >= bar]
            if len(fit):
                best = fit[np.lexsort((ids[fit], -scores[i, fit]))][:k]
                yield np.full(len(best), names[q]), ids[best], scores[i, best]

    def run(shelf: pa.Table, bundle: pa.Table) -> pa.Table:
        asking = {row["group"]: row for row in bundle.to_pylist()}
        found = [
            part
            for block in shelf.to_pylist()
            for group in block["wanted"]
            for part in serve(block, asking[group])
        ]
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 3
        kept = _best(*columns, k)
        return pa.table([c[kept] for c in columns], ["query_id", "vec_id", "score"])

    wanted, asked = _tiles(pairs)
    shelves = wanted.join(blocks, "block").groupBy("bundle", "shelf")
    bundles = asked.join(groups, "group").groupBy("bundle", "shelf")
    return shelves.cogroup(bundles).applyInArrow(run, "query_id long, vec_id long, score long")


def _with_bounds(groups: DataFrame, bounds: DataFrame) -> DataFrame:
    """Groups with the least score that can still enter each query's result, in its order."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, ids in zip(*(batch.column(c).to_pylist() for c in ("group", "query_ids"))):
                found = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(found)), pa.array(found), pa.array(np.arange(len(found)))],
                    ["group", "query_id", "place"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(x, np.int64).tobytes() for x in batch.column("least").to_pylist()]
            at = batch.schema.get_field_index("least")
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()) if i == at else batch.column(i)
                 for i in range(batch.num_columns)],
                batch.schema.names,
            )

    listed = groups.select("group", "query_ids").mapInArrow(
        names, "group long, query_id long, place long"
    )
    least = (
        listed.join(bounds, "query_id", "left")
        .groupBy("group")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("bound", F.lit(NONE)).alias("b")))).alias("x"))
        .select("group", F.col("x.b").alias("least"))
    )
    joined = groups.join(least, "group")
    return joined.mapInArrow(
        pack,
        "group long, home long, query_ids binary, queries binary, apart binary, least binary",
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    pivots: int = 32,
    sample_rows: int = 2048,
    per_block: int = 1024,
    per_group: int = 512,
) -> DataFrame:
    """The ``k`` rows of largest inner product for every row that ``is_query`` (on the id) marks.

    Components are ``floor(scale * x)``. Returns query_id, rank (from 1), vec_id and score,
    ties in order of vec_id. Pivots are fitted on about ``sample_rows`` rows drawn by a hash of
    the id; every row is indexed under its nearest pivot, sorted by its distance and cut into
    blocks. Groups of queries first meet the annuli at their own distance from their own
    pivot, which gives each query a bound; then, of all pivots, those annuli that the triangle
    inequality leaves within the bound, where each block skips the queries it can't serve.
    The result is exact.

    Rows whose id is null, or whose vector is null or holds a null or a non-finite component,
    take no part. Vectors of unlike length are filled with zeros. A query's candidates are the
    rows of another id; rows that repeat an id are candidates each, and a repeated query gives
    one result. Fewer candidates than ``k`` give fewer rows; an empty table gives none; other
    columns are ignored.
    """
    rows = stored(
        vectors.select(
            named(id_column).cast("long").alias("vec_id"),
            whole_components(named(vector_column), scale).alias("v"),
        ).where("vec_id is not null and v is not null")
    )
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    facts = rows.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(square).alias("top")
    ).first()
    size, top = max(1, facts["size"] or 0), int(facts["top"] or 0)
    rate = min(1.0, sample_rows / max(1, facts["n"]))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < rate * 1_000_003)
    drawn = drawn.select("v").orderBy("vec_id").limit(2 * sample_rows).collect()
    sample = pa.array([r["v"] for r in drawn], pa.list_(pa.int64()))
    centres = fit_pivots(_lifted(_matrix(sample, size), top), pivots)
    pivots = len(centres)

    blocks = stored(_blocks(rows, size, top, centres, per_block))
    asked = rows.withColumnRenamed("vec_id", id_column).where(is_query)
    asked = asked.withColumnRenamed(id_column, "vec_id").dropDuplicates(["vec_id"])
    groups = stored(_query_groups(asked, size, centres, per_group))

    def meet(groups: DataFrame, home_only: bool) -> DataFrame:
        rings = _rings(groups, pivots, top, home_only)
        shells = blocks.select("block", "pivot", "low", "high")
        pairs = rings.join(shells, "pivot").where("high >= inner and low <= outer")
        pairs = stored(pairs.select("group", "block"))
        return _scan(pairs, blocks, groups, size, pivots, top, k)

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unbound = _with_bounds(groups, groups.sparkSession.createDataFrame([], "query_id long, bound long"))
    first = meet(unbound, home_only=True).withColumn("rank", F.row_number().over(place))
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = stored(_with_bounds(groups, bounds))
    found = meet(bounded, home_only=False).withColumn("rank", F.row_number().over(place))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
