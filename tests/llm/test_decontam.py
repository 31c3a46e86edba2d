from __future__ import annotations

import itertools
import random
import re

from gridloom.llm import decontam, queries
from oracle import connect, difference
from samples import EDGES, FOLDER, documents

ITEM_SCHEMA = "item_id long, text string, key string, at string, start string"


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ITEM_SCHEMA)


def brute(docs, benchmark):
    out = set()
    for (d, t), (i, u) in itertools.product(docs, benchmark):
        a, b = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (t, u))
        if len(b) < 5:
            continue
        span = min(13, len(b))
        best = None
        for start in range(-len(b) + 1, len(a)):
            agree = [0 <= start + j < len(a) and a[start + j] == w for j, w in enumerate(b)]
            most = max(sum(agree[j : j + span]) for j in range(len(b) - span + 1))
            if most >= (len(b) if len(b) < 13 else 11) and (best is None or most > best[0]):
                best = (most, start)
        if best:
            out.add((d, i, best[1], best[0], len(b)))
    return out


def found(spark, docs, benchmark):
    rows = decontam.overlaps(documents(spark, docs), items(spark, benchmark)).drop("text_hash")
    return {tuple(r) for r in rows.collect()}


def test_query_against_its_sql(spark):
    con = connect(FOLDER)
    name = "op2_spaced_seed_decontamination"
    assert difference(spark, FOLDER, con, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_masks_meet_every_window_with_two_substitutions():
    for places in itertools.combinations(range(13), 2):
        assert any(
            not {o + k for k in mask} & set(places)
            for mask in decontam.MASKS
            for o in range(13 - max(mask))
        )


def test_substitutions_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)]
    benchmark = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([13, 14, 20, 40, 5, 8, 4, 12])]
    benchmark += [(None, benchmark[2][1]), (9, None), (10, ""), (11, benchmark[3][1]), (3, benchmark[3][1])]
    docs = []
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        text = (rng.choice(benchmark)[1] or "").split()
        for _ in range(rng.randint(0, 4)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(["changed", *vocabulary])
        cut = rng.randint(0, 4)
        docs.append((k, " ".join([*words, *text[cut:], *rng.choices(vocabulary, k=3)]).title()))
    want = brute(docs, set(benchmark))
    assert found(spark, docs, benchmark) == want and len(want) > 40


def test_edges(spark):
    edges = [r[:2] for r in EDGES]
    benchmark = [(1, "quick brown fox jumps over the lazy dog again and again the quick brown"),
                 (2, "no id at all here"), (3, "repeated row"), (4, None)]
    assert found(spark, edges, benchmark) == brute([e for e in edges if e[0] != 5], benchmark) | {
        (5, 1, 1, 13, 14)
    }


def test_empty_tables(spark):
    text = "a b c d e f g h i j k l m n"
    assert found(spark, [], [(1, text)]) == set()
    assert found(spark, [(1, text)], []) == set()
    assert found(spark, [(1, text)], [(1, None)]) == set()


def test_documents_with_passages_go_and_all_others_stay(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = documents(spark, [(1, f"before {passage} after"), (2, "clean text"), (None, passage),
                             (3, None), (2, "clean text"), (4, " ".join(passage.split()[:9]))])
    kept = decontam.without_overlaps(docs, items(spark, [(1, passage)]))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [
        (2, "clean text"), (2, "clean text"), (3, ""), (4, " ".join(passage.split()[:9]))
    ]


def test_main_path_is_native(spark):
    docs, benchmark = documents(spark, [(1, "a")]), items(spark, [(1, "b c d e f g")])
    text = decontam.overlaps(docs, benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", text)


def test_many_seeds_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 10)
    passage = " ".join(f"p{k}" for k in range(20))
    assert found(spark, [(1, f"x {passage}")], [(1, passage)]) == {(1, 1, 1, 13, 20)}
