from __future__ import annotations

import random

import numpy as np
import xxhash

from samples import EDGES, documents
from gridloom.llm import simhash
from gridloom.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def near_copies(count=60, seed=1):
    rng = random.Random(seed)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 99))
            for _ in range(400)]
    rows = []
    for k in range(count):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"new{k}"
        rows.append((1000 - k, " ".join(words)))
    return rows


def test_edges_against_brute_force(edges):
    found = sorted((tuple(r) for r in simhash.near_duplicates(edges).collect()), key=str)
    assert found == brute_components([r[:2] for r in EDGES])


def test_near_copies_against_brute_force(spark):
    rows = near_copies() + [(k, f"lone text {k} {k * 7} {k * 31} words") for k in range(40)]
    found = sorted((tuple(r) for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    want = brute_components(rows)
    assert found == want
    assert len({r[2] for r in want}) < len(rows) - 20


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.keep_one(nothing).collect() == []


def test_links_lose_no_pair(spark):
    """All pairs at most 3 bits apart, wherever the bits lie, and no others."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for base in list(prints)[:150]:
        for n in (1, 2, 3, 4):
            start = rng.randrange(64)
            near = rng.sample(range(64), n) if n % 2 else [(start + k) % 64 for k in range(n)]
            prints.add(base ^ sum(1 << b for b in near))
    prints |= {0, (1 << 64) - 1, 1, 3, 7, 15}
    signed = np.array(sorted(prints), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fingerprint long")
    found = [tuple(r) for r in simhash.links(df).collect()]
    want = {
        (min(int(a), int(b)), max(int(a), int(b)))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if (int(a) ^ int(b)) & (1 << 64) - 1 and ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 3
    }
    assert len(found) == len(set(found)) and set(found) == want


def test_chains_prune_candidates_before_the_full_check():
    assert [simhash._budget(n) for n in range(1, 9)] == [0, 0, 1, 1, 1, 2, 2, 3]


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    df = spark.createDataFrame([*chain, *star, (200, 201), (300, 300)], "a long, b long")
    found = dict(map(tuple, components(df.repartition(3)).collect()))
    assert {found[k] for k in range(41)} == {0}
    assert {found[k] for k in range(100, 130)} == {100}
    assert found[200] == found[201] == 200 and 300 not in found
    assert components(df.limit(0)).collect() == []


def test_one_row_of_every_group_stays(spark, edges):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    # No two different fingerprints of these are linked.
    assert len(rows) == len({r[1] for r in brute_components([r[:2] for r in EDGES])})
    assert len([r for r in rows if (r["text"] or "").lower() == "repeated row"]) == 1
    copies = near_copies(30)
    left = simhash.keep_one(documents(spark, copies)).collect()
    assert {r["doc_id"] for r in left} == {r[2] for r in brute_components(copies)}
