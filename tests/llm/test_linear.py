"""The linear classifiers against plain Python: n-gram slots, counts, one learner's steps, scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language, linear, toxicity
from gridloom.llm.common import MULTIPLIERS
from samples import EDGES, documents

M32 = 0xFFFFFFFF


def slot(gram, bits):
    mixed = len(gram) * 0x5BD1E995 & M32
    for k, c in enumerate(gram):
        mixed = (mixed + ord(c) * MULTIPLIERS[k]) & M32
        mixed = (mixed ^ mixed >> 15) * 0x2C1B3C6D & M32
    return (mixed ^ mixed >> 13) >> (32 - bits)


def slots(text, orders, bits):
    padded = f" {(text or '').lower()} "
    return [slot(padded[i : i + n], bits) for n in orders for i in range(len(padded) - n + 1)]


def plain_ftrl(rows, labels, classes, size, epochs, alpha, beta, l1, l2):
    """Scalar form: one coordinate and class at a time; the last slot is the bias."""
    z = [[0.0] * classes for _ in range(size + 1)]
    n = [[0.0] * classes for _ in range(size + 1)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            held = [*rows[r].items(), (size, 1.0)]
            scores = [sum(weight(i, c) * x for i, x in held) for c in range(classes)]
            top = max(scores)
            shares = [math.exp(s - top) for s in scores]
            old = {(i, c): weight(i, c) for i, _ in held for c in range(classes)}
            for c in range(classes):
                off = shares[c] / sum(shares) - (c == labels[r])
                for i, x in held:
                    g = x * off
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * old[i, c]
                    n[i][c] += g * g
    return [[weight(i, c) for c in range(classes)] for i in range(size + 1)]


@pytest.mark.parametrize("l1, epochs", [(0.0, 1), (0.05, 3), (0.4, 2)])
def test_learner_against_scalar_steps(l1, epochs):
    rng = np.random.default_rng(5)
    rows = [{int(i): float(rng.normal()) for i in rng.choice(12, 4, replace=False)} for _ in range(30)]
    labels = rng.integers(0, 3, 30)
    settings = {"epochs": epochs, "alpha": 0.5, "beta": 1.0, "l1": l1, "l2": 0.1}
    sparse = linear.Rows.of([(np.array(list(r), np.int32), np.array(list(r.values()))) for r in rows])
    w, bias = linear.ftrl(sparse, labels, 3, 12, **settings)
    want = np.array(plain_ftrl(rows, labels, 3, 12, **settings))
    assert np.allclose(w, want[:-1], atol=1e-9) and np.allclose(bias, want[-1], atol=1e-9)
    assert (w == 0).any() == (want[:-1] == 0).any()


LANGUAGES = [
    (k, f"{words} {k % 7}", lang)
    for k in range(40)
    for words, lang in ([("the cat and the dog", "en"), ("der Hund und die Katze über", "de")][k % 2],)
]


def test_language_model_against_plain_python(spark):
    orders, bits = (1, 2, 3), 11
    docs = documents(spark, [*LANGUAGES, (50, None, "en"), (51, "left out", None), (52, "", "de")])
    model = language.train(docs, orders=orders, bits=bits)
    known = [(t, lang) for _, t, lang in LANGUAGES] + [("", "de")]
    df = np.zeros(1 << bits)
    for text, _ in known:
        df[list(set(slots(text, orders, bits)))] += 1
    want = np.where(df > 0, np.log((1 + len(known)) / (1 + df)) + 1, np.log(1 + len(known)))
    assert model.languages == ["de", "en"] and np.allclose(model.idf, want)
    texts = [*LANGUAGES[:6], *[(d, t, None) for d, t in EDGES if t and len(t) < 100 and any(map(str.isalpha, t))]]
    found = language.predict(documents(spark, texts), model, lang_as="told").collect()
    for row in found:
        held = slots(row["text"], orders, bits)
        x = np.bincount(held, minlength=1 << bits) * want
        p = linear.softmax((x / np.sqrt(x @ x)) @ model.weights + model.bias)
        assert row["told"] == model.languages[int(p.argmax())] and math.isclose(row["score"], p.max(), rel_tol=1e-9)


def test_toxicity_model_against_plain_python(spark):
    orders, bits, smoothing, least = (3, 4), 12, 1.0, 0.7
    rows = [(k, f"you worthless idiot {k % 5}" if k % 3 == 0 else f"a calm day {k % 4}") for k in range(45)]
    rows += [(45, None), (46, "")]
    marks = {k: int(k % 3 == 0) for k, _ in rows}
    docs = documents(spark, rows)
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    counts = {
        r["slot"]: (r["toxic"], r["clean"])
        for r in toxicity._class_counts(
            docs.join(labels, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"), orders, bits
        ).collect()
    }
    held = {k: set(slots(t, orders, bits)) for k, t in rows}
    want: dict = {-1: [0, 0]}
    for k, found in held.items():
        for s in [*found, -1]:
            want.setdefault(s, [0, 0])[1 - marks[k]] += 1
    assert counts == {s: tuple(n) for s, n in want.items()}

    toxic, clean = want.pop(-1)
    base = smoothing / (toxic + clean)
    ratios = np.zeros(1 << bits)
    for s, (t, c) in want.items():
        r = math.log((t / toxic + base) / (c / clean + base))
        ratios[s] = r if t + c >= 3 and abs(r) >= least else 0.0
    turn = {
        r["doc_id"]: r["turn"]
        for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)).alias("turn")).collect()
    }
    order = sorted(held, key=lambda k: turn[k])
    assert len(set(turn.values())) == len(turn)
    sparse = [{s: float(np.float32(ratios[s])) for s in sorted(held[k]) if ratios[s]} for k in order]
    w = np.array(plain_ftrl(sparse, [marks[k] for k in order], 2, 1 << bits, 5, 0.1, 1.0, 0.0, 1.0))
    model = toxicity.train(docs, labels, orders=orders, bits=bits, smoothing=smoothing, least_ratio=least)
    assert np.allclose(model.weights, (w[:-1, 1] - w[:-1, 0]) * ratios, atol=1e-6)
    # All labelled rows are in the fit, so the bias needs no move to their share.
    assert math.isclose(model.bias, w[-1, 1] - w[-1, 0], rel_tol=1e-6, abs_tol=1e-6)
    for row in toxicity.score(docs, model).collect():
        total = model.bias + sum(model.weights[s] for s in held[row["doc_id"]])
        assert math.isclose(row["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)
