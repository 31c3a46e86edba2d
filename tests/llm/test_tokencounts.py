from __future__ import annotations

import random
from itertools import permutations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import queries, tokencounts
from samples import EDGES, FOLDER, documents

PATH = tokencounts.default_model()
PROOF = tokencounts.prove(PATH)
COUNTER = tokencounts.Counter(PATH, PROOF)
LIBRARY = tokencounts.processor(PATH)
PIECES = ["a", "the", " ", "  ", "\n", "▁", "한", "😀", "é", "Ä", "<s>", "</s>", "<0x0A>", "\t", "\x00", "ing", " of", "12", "."]


def expected(texts):
    return [len(LIBRARY.encode(t or "")) for t in texts]


def counted(texts, counter=COUNTER):
    return counter.count(pa.array(texts, pa.string()))[0].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20), st.lists(st.sampled_from(PIECES)).map("".join)), max_size=8))
def test_any_texts(texts):
    assert counted(texts) == expected(texts)


def test_every_order(spark):
    for order in permutations([None, "", " ", "a ", " the", "\n x"]):
        assert counted(list(order)) == expected(order)
        assert COUNTER.count(pa.array(order, pa.string()).slice(2))[0].tolist() == expected(order[2:])


def test_proof_names_single_tokens_only():
    """Against the library without the proof's own way of encoding."""
    rng = random.Random(1)
    assert PROOF.cuts and PROOF.line_break == 1 and len(PROOF.after_blank) > 10_000
    for word in rng.sample(PROOF.after_blank, 2000):
        assert len(LIBRARY.encode(word)) == 1 and len(LIBRARY.encode(f"a {word}")) == len(LIBRARY.encode("a")) + 1


def test_most_words_of_prose_need_no_merge():
    tokens, direct = COUNTER.count(pa.array(["the cat is on the table and it is there"]))
    assert tokens[0] == direct[0] == 10


def test_small_cache_and_models_without_cuts(monkeypatch):
    monkeypatch.setattr(tokencounts, "CACHED_WORDS", 3)
    texts = [r[1] for r in EDGES]
    assert counted(texts, tokencounts.Counter(PATH, PROOF)) == expected(texts)
    assert counted(texts, tokencounts.Counter(PATH, tokencounts.Shortcut(False, 0, [], []))) == expected(texts)


def test_edges(spark, edges, nothing):
    got = sorted((tuple(r)[:4] for r in tokencounts.count_tokens(edges, limit=10).collect()), key=str)
    want = [(d, len((t or "").encode()), n, n > 10) for (d, t), n in zip(EDGES, expected([r[1] for r in EDGES]))]
    assert got == sorted(want, key=str)
    assert tokencounts.count_tokens(nothing).collect() == []


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 50_000, "\n" * 50_000, "ab " * 100_000])
def test_very_long_texts(spark, text):
    (row,) = tokencounts.count_tokens(documents(spark, [(1, text)])).collect()
    assert (row["n_bytes"], row["n_tokens"]) == (len(text), len(LIBRARY.encode(text)))


def test_query_against_the_library(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_token_counts"](spark, folder).collect()
    want = dict(zip(docs, expected(docs.values())))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(docs)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)
    assert all(r["n_bytes"] == len((docs[r["doc_id"]] or "").encode()) for r in rows)
