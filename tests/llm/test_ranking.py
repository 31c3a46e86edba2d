from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import ranking
from samples import EDGES, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans(ranking.CAPITALS, ranking.SMALL)


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, most=50):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, ts) for d, ts in held if ts]
    n, words = len(held), sum(len(ts) for _, ts in held)
    df: dict = {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, ts in held:
            m = 50 + 50 * len(ts) * n // words
            score = 0
            for t in wanted & set(ts):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * ts.count(t) // (1000 * ts.count(t) + 20 * m))
            if score > 0:
                scored.append((score, d))
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        out += [(i, k, d, s) for k, (s, d) in enumerate(scored[:most], 1)]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def item_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, score int")


def made(seed, docs=300, items=25):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["Über", "한국", "ÀB", "x1"]

    def text(n):
        return "".join(rng.choice(pool) + rng.choice(" ,.-_\n") for _ in range(n))

    return ([(rng.randint(0, 200), text(rng.randint(0, 60))) for _ in range(docs)],
            [(k, text(rng.randint(1, 25))) for k in range(items)])


@pytest.mark.parametrize("pairs, held", [(200_000, 32_000_000), (40, 20_000)])
def test_made_tables_against_brute_force(spark, monkeypatch, pairs, held):
    """Once in one block, once in several and with few documents at a time."""
    monkeypatch.setattr(ranking, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(ranking, "HELD_BYTES", held)
    docs, items = made(4)
    got = ranking.rank(documents(spark, docs).repartition(5), item_table(spark, items), most=7)
    assert found(got) == brute(docs, items, 7)


def test_edges(spark, edges, nothing):
    items = [(None, "NO id"), (1, None), (2, ""), (3, "quick fox, row"), (3, "row one 한국어"), (4, "!!"), (5, "unmet"), (6, "é über wörter")]
    rows = [r[:2] for r in EDGES]
    want = brute(rows, items)
    assert found(ranking.rank(edges, item_table(spark, items))) == want
    assert {r[0] for r in want} == {None, 3, 6}
    assert found(ranking.rank(nothing, item_table(spark, items))) == []
    assert found(ranking.rank(edges, item_table(spark, []))) == []
    assert found(ranking.rank(documents(spark, [(1, None), (2, " !")]), item_table(spark, items))) == []


def test_ties_and_hot_copies(spark):
    """One text makes up most rows: equal scores go by id, and ranks stay unique."""
    docs = [(k % 400, "common words of all copies") for k in range(2000)] + [(k, f"lone {k}") for k in range(500)]
    items = [(1, "copies of common words"), (2, "lone 7")]
    assert found(ranking.rank(documents(spark, docs), item_table(spark, items))) == brute(docs, items)


def test_every_order_of_texts(spark):
    texts = pa.array([None, "", "A b", "...", "ÀB  c1-c2\n", "x" * 9])
    whole = [terms(t) for t in texts.to_pylist()]
    rng = np.random.default_rng(1)
    for _ in range(200):
        order = rng.permutation(len(texts))
        got, ends = ranking.terms_of(texts.take(pa.array(order)).slice(int(order[0]) % 3))
        part = [got.to_pylist()[a:b] for a, b in zip(ends[:-1], ends[1:])]
        assert part == [whole[o] for o in order[int(order[0]) % 3 :]]


def test_shared_sets_are_summed_once():
    rng = random.Random(2)
    common = [set(rng.sample(range(40), 8)) for _ in range(6)]
    items = [np.array(sorted(set().union(*rng.sample(common, 2), {100 + k}))) for k in range(50)]
    sharing = ranking.share(items, 150)
    parts = np.zeros((sharing.size, 3), np.int64)
    values = np.random.default_rng(0).integers(0, 1000, (150, 3))
    np.add.at(parts, sharing.leaf, values)
    want = np.array([values[i].sum(axis=0) for i in items])
    assert (ranking.scores(sharing, parts) == want).all()
    plain = sum(len(i) - 1 for i in items)
    assert sharing.levels and sharing.additions < plain / 3
    # Terms that the same items hold are one leaf.
    assert sharing.leaves < len({int(t) for i in items for t in i})
