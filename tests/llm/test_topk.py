from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, topk
from oracle import connect, difference
from samples import FOLDER

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows, k=10, of=100):
    fine = [
        (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, a in dict(fine).items():
        if q % of == 0:
            scores = sorted(
                (-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q
            )
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, of=100, **settings):
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % of == 0, **settings).collect()
    return sorted(map(tuple, found))


def test_query_against_its_sql(spark):
    con = connect(FOLDER)
    name = "op3_pivot_topk"
    assert difference(spark, FOLDER, con, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("spread", [0.01, 1.0, 30.0])
def test_many_blocks_against_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5))
    rows = [
        (k, [float(x) for x in (centres[k % 6] + spread * rng.normal(size=5)).astype(np.float32)])
        for k in range(400)
    ]
    found = search(spark, rows, of=20, pivots=5, per_block=16, per_group=4, sample_rows=64)
    assert found == brute(rows, of=20)


def test_ties_and_repeats(spark):
    rows = [(k, [1.0, 2.0]) for k in range(150)] + [(7, [1.0, 2.0]), (100, [1.0, 2.0])]
    assert search(spark, rows, per_block=8) == brute(rows)


def test_what_takes_no_part(spark):
    rows = [
        (0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
        (None, [9.0, 9.0]), (5, [0.25, 0.75]), (6, []), (7, [1.0, 1.0, 1.0]), (100, None), (200, [-0.3, 0.1]),
    ]
    found = search(spark, rows)
    want = brute([(i, None if v is None else (v + [0.0] * 3)[: max(3, len(v))]) for i, v in rows])
    assert found == want and {r[0] for r in found} == {0, 200}


def test_few_or_no_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert search(spark, [(0, [1.0]), (2, [2.0])]) == [(0, 1, 2, 2 * 1024 * 1024)]


def test_payloads_travel_once_per_tile(spark):
    wide = 1 << topk.TILE_BITS
    pairs = spark.range(3 * wide).select(F.col("id").alias("group")).crossJoin(
        spark.range(2 * wide + 1).select(F.col("id").alias("block"))
    )
    wanted, asked = topk._tiles(pairs)
    assert wanted.count() == 3 * (2 * wide + 1) and asked.count() == 3 * (3 * wide)
    assert wanted.agg(F.max(F.size("wanted"))).first()[0] == wide
    # Only listed pairs meet, not all of a tile.
    few, _ = topk._tiles(pairs.where("group = block"))
    assert few.agg(F.max(F.size("wanted"))).first()[0] == 1


def test_best_of_each_query():
    names, ids = np.array([2, 1, 2, 2, 1]), np.array([9, 4, 3, 5, 8])
    kept = topk._best(names, ids, np.array([7, 1, 7, 8, 1]), 2)
    assert [(int(names[i]), int(ids[i])) for i in kept] == [(1, 4), (1, 8), (2, 5), (2, 3)]
    empty = np.zeros(0, np.int64)
    assert len(topk._best(empty, empty, empty, 2)) == 0


def test_products_beyond_floating_point_stay_exact():
    big = np.array([[1 << 30, 3], [1 << 30, 5]], np.int64)
    assert topk._products(big, big).tolist() == [
        [(1 << 60) + 9, (1 << 60) + 15], [(1 << 60) + 15, (1 << 60) + 25]
    ]
