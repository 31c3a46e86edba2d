from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import packing
from samples import EDGES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def expected(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, docs, tokenizer, limit=4096):
    """Every id lies in one piece, sequences have no gaps, and no sequence is padded."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["sequence_id"]].append(r)
    for held in pieces.values():
        held.sort(key=lambda r: r["offset"])
        at = 0
        for r in held:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limit and at & (at - 1) == 0
    # Every place of a document is covered once for each time the document occurs.
    texts = defaultdict(list)
    for d, ids in ((d, expected(tokenizer, t)) for d, t in docs):
        texts[(d, len(ids))].append(ids)
    covered = {k: np.zeros(k[1], np.int64) for k in texts}
    for r in rows:
        key = (r["doc_id"], r["doc_tokens"])
        ids = list(np.frombuffer(bytes(r["ids"]), "<u4"))
        assert any(ids == t[r["start"] : r["start"] + r["length"]] for t in texts[key])
        covered[key][r["start"] : r["start"] + r["length"]] += 1
    for key, found in covered.items():
        assert (found == len(texts[key])).all()


def test_round_trip_of_edge_cases(edges, tokenizer):
    check(packing.pack(edges).collect(), [r[:2] for r in EDGES], tokenizer)


def test_round_trip_of_whole_documents(small, tokenizer):
    rows = packing.pack(small).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in small.collect()], tokenizer)


def test_empty_table(nothing):
    assert packing.digests(packing.pack(nothing)).collect() == []


def test_digest_is_the_crc_of_little_endian_ids(small):
    pieces = packing.pack(small).limit(20).cache()
    for whole, digest in zip(pieces.collect(), packing.digests(pieces).collect()):
        assert digest["ids_crc32"] == zlib.crc32(bytes(whole["ids"]))


@pytest.mark.parametrize("joined", [1, 7, 100_000])
def test_ids_are_the_tokenizers_own(tokenizer, monkeypatch, joined):
    monkeypatch.setattr(packing, "JOINED_WORDS", joined)
    encoder = packing.WordEncoder(packing.default_tokenizer())
    rng = random.Random(1)
    letters = list("abzAZ09 \t\n\x0b\x0c\x1c\x85\xa0éÉŸßÿ÷À.,!?;:'\"-_<|>̱́İΣσ漢\U0001f600")
    letters += ["'s", "<|endoftext|>", "<|ENDOFTEXT|>", " the "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(3000)]
    found = [
        list(ids[first:after])
        for ids, bounds in encoder.encode(pa.array([*texts, None]), 2)
        for first, after in zip(bounds[:-1], bounds[1:])
    ]
    assert len(found) == len(texts) + 1
    for ids, text in zip(found, [*texts, None]):
        assert ids == expected(tokenizer, text), repr(text)


def test_largest_pieces_go_to_the_cheapest_sequence():
    sizes = np.array([6, 5, 4, 3, 3, 2, 1])
    placed = packing.place(sizes, 2, 12, 1.0, 0.5)
    order = [p[0] for p in placed]
    assert order == [0, 1, 2, 3, 4, 5, 6]
    assert [p[3] for p in placed[:3]] == [0, 1, 1]
    filled = [sum(p[2] for p in placed if p[3] == k) for k in (0, 1)]
    assert filled == [12, 12]


def test_what_fits_nowhere_whole_is_cut():
    placed = packing.place(np.array([7, 7, 7]), 2, 10, 1.0, 0.1)
    assert sum(p[2] for p in placed if p[3] >= 0) == 20
    assert [p for p in placed if p[3] < 0] == [(2, 6, 1, -1, 0)]
