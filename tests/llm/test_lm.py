from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import eliasfano as ef
from gridloom.llm import lm, queries
from samples import EDGES, FOLDER, documents


@pytest.mark.parametrize(
    "n, top", [(0, 1), (1, 1), (1, 2**63), (5, 3), (1000, 10), (30_000, 2**64 - 1), (40_000, 50_000)]
)
def test_sequences_give_back_their_values(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    held = ef.Sequence(ef.encode(values))
    assert (held.get(np.arange(n)) == values).all() and (held.all() == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
    assert (held.successor(asked) == np.searchsorted(values, asked)).all()


def test_buffers_are_found_within_a_file(tmp_path):
    one = ef.dump(ef.encoded("a", np.arange(5, dtype=np.uint64)), {"k": 1})
    two = ef.dump(ef.encoded("a", np.arange(9, dtype=np.uint64)), {"k": 2})
    path = tmp_path / "levels"
    path.write_bytes(b"head" + one + b"xyz" + two + one[:60])
    found = ef.load(str(path))
    assert [f["k"] for _, f in found] == [1, 2]
    assert [len(ef.sequence(p, "a")) for p, _ in found] == [5, 9]


def tokens(text):
    return [b"", *(text or "").encode().lower().split(), b""]


class Brute:
    """The same model from plain counters, without quantising."""

    def __init__(self, texts, least=2, discount=lm.DISCOUNT):
        self.least, self.discount = least, discount
        self.c = [Counter(), Counter(), Counter()]
        for t in texts:
            q = tokens(t)
            self.c[0].update(q[1:])
            self.c[1].update(zip(q, q[1:]))
            self.c[2].update(zip(q, q[1:], q[2:]))
        self.total, self.distinct = sum(self.c[0].values()), len(self.c[0])
        self.kept = [defaultdict(lambda: [0, 0]) for _ in range(3)]
        for level in (1, 2):
            for gram, n in self.c[level].items():
                if n >= least:
                    held = self.kept[level][gram[:-1]]
                    held[0] += 1
                    held[1] += n

    def left(self, level, context, count):
        n, total = self.kept[level][context]
        return 1 - (total - self.discount * n) / count if count else 1.0

    def share(self, level, gram, count):
        n = self.c[level][gram]
        return (n - self.discount) / count if n >= self.least else 0.0

    def score(self, text):
        q, base, score = tokens(text), 0.0, 0.0
        for i in range(1, len(q)):
            single = (self.c[0][q[i]] + 1) / (self.total + self.distinct + 1)
            base += math.log10(single)
            count = self.c[0][q[i - 1]]
            p = self.left(1, (q[i - 1],), count) * single + self.share(1, (q[i - 1], q[i]), count)
            if i > 1 and self.c[1][q[i - 2], q[i - 1]] >= self.least:
                pair = (q[i - 2], q[i - 1])
                p *= self.left(2, pair, self.c[1][pair])
                p += self.share(2, (*pair, q[i]), self.c[1][pair])
            score += math.log10(p)
        return len(q) - 1, sum(self.c[0][w] > 0 for w in q[1:]), base, score


def compare(rows, texts, model):
    step = lm.DEEPEST / lm.STEPS / 2
    for r in rows:
        n, known, base, score = model.score(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert abs(r["score"] - score) <= step * n + 1e-9


def test_query_against_plain_counts(spark):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    model = Brute([t for d, t in texts.items() if d not in held])
    rows = queries.QUERIES["op1_elias_fano_lm"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == held
    assert {r["train_tokens"] for r in rows} == {model.total}
    compare(rows, texts, model)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_nodes_that_span_shards(spark):
    """One word before and after hundreds of others, in shards of a few tokens."""
    texts = {
        k: " ".join(f"hub a{k * 31 + j} b{j}" for j in range(30)) + " hub hub hub" for k in range(12)
    }
    texts |= {100 + k: texts[k] for k in range(6)}
    docs = documents(spark, list(texts.items()))
    model = lm.train(docs, tokens_per_shard=100)
    compare(lm.score(docs, model).collect(), texts, Brute(texts.values()))


def test_probabilities_add_up(spark):
    docs = documents(spark, [(1, "a b a b a c"), (2, "a b a c c a b"), (3, "a b c a b")])
    counts = Brute([r["text"] for r in docs.collect()])
    words = sorted(w.decode() for w in counts.c[0] if w)
    model = lm.train(docs)
    stems = [(0, ""), (1, "a"), (2, "a b"), (3, "c c"), (4, "zzz")]
    asked = [(k, t) for k, t in stems]
    asked += [(100 * (k + 1) + j, f"{t} {w}".strip()) for k, t in stems for j, w in enumerate(words)]
    scores = {r["doc_id"]: r["score"] for r in lm.score(documents(spark, asked), model).collect()}
    brute = {d: counts.score(t)[3] for d, t in asked}
    assert all(abs(scores[d] - brute[d]) < 0.2 for d in scores)
    for level, context in ((1, (b"a",)), (2, (b"a", b"b")), (1, (b"",))):
        held = counts.c[0][context[-1]] if level == 1 else counts.c[1][context]
        single = {w: (n + 1) / (counts.total + counts.distinct + 1) for w, n in counts.c[0].items()}
        single["unknown"] = 1 / (counts.total + counts.distinct + 1)
        total = sum(
            counts.left(level, context, held) * p
            + (counts.share(level, (*context, w), held) if w != "unknown" else 0)
            for w, p in single.items()
        )
        assert total == pytest.approx(1.0)


def test_edges(edges, nothing):
    texts = [r[1] for r in EDGES]
    model, brute = lm.train(edges), Brute(texts)
    rows = lm.score(edges, model).collect()
    assert len(rows) == len(EDGES) and model.tokens == brute.total and model.words == brute.distinct
    by_text = {t: brute.score(t) for t in texts}
    step = lm.DEEPEST / lm.STEPS / 2
    for r, t in zip(rows, [x["text"] for x in edges.collect()]):
        n, known, base, score = by_text[t]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["base_score"] == pytest.approx(base) and abs(r["score"] - score) <= step * n + 1e-6
    assert lm.score(nothing, model).collect() == []


def test_nothing_to_learn_from(edges, nothing):
    model = lm.train(nothing)
    assert (model.tokens, model.words) == (0, 0)
    for r in lm.score(edges, model).collect():
        assert r["score"] == r["base_score"] == 0 and r["n_known"] == 0
