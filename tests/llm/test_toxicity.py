from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from samples import EDGES, FOLDER, documents
from gridloom.llm import queries, toxicity


@pytest.fixture(scope="module")
def trained(spark):
    folder = FOLDER.replace("0.001", "0.1")
    found = queries.QUERIES["op6_naive_bayes_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    return found.join(labels, "doc_id").cache()


def test_held_out_accuracy(trained):
    held = trained.where("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in held)
    assert hits / sum(r["predicted"] for r in held) > 0.9
    assert hits / sum(r["toxic"] for r in held) > 0.7
    assert all(0 <= r["score"] <= 1 for r in held)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in held)


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(k, f"you are a worthless idiot number {k}" if k % 3 == 0 else f"a calm day number {k}")
            for k in range(60)]
    labels = spark.createDataFrame(
        [(k, 1, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (3, 1, None), (99, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    docs = documents(spark, rows)
    return docs, labels, toxicity.train(docs, labels, bits=14, smoothing=1.0)


def test_learns_what_the_labels_mark(taught):
    docs, _, model = taught
    for row in toxicity.score(docs, model).collect():
        assert (row["score"] > 0.5) == (row["doc_id"] % 3 == 0)


def test_edges(edges, taught):
    found = toxicity.score(edges, taught[2]).collect()
    assert len(found) == len(EDGES)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert set(found[0].asDict()) == set(edges.columns)
    empty = {r["score"] for r in found if not r["text"]}
    assert len(empty) == 1


def test_nothing_to_learn_or_read(nothing, taught):
    docs, labels, model = taught
    assert toxicity.score(nothing, model).collect() == []
    assert toxicity.train(nothing, labels) is None
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_held_out_labels_are_never_read(taught):
    docs, labels, _ = taught
    out = F.col("doc_id") % 5 != 0
    flipped = labels.withColumn("toxic", F.when(out, F.col("toxic")).otherwise(1 - F.col("toxic")))
    scores = []
    for given in (labels, flipped):
        model = toxicity.train(docs, given, out, bits=14, smoothing=1.0)
        scores.append([r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]


def test_ratios_count_all_rows_whatever_the_fit_takes(taught, monkeypatch):
    docs, labels, _ = taught
    seen, kept = [], toxicity._kept_slots

    def spy(rows, ratios, *rest):
        seen.append((rows.count(), ratios))
        return kept(rows, ratios, *rest)

    monkeypatch.setattr(toxicity, "_kept_slots", spy)
    for rows in (4000, 12):
        toxicity.train(docs, labels, bits=14, smoothing=1.0, rows_per_fit=rows)
    (whole, every), (few, same) = seen
    assert whole == 60 and 0 < few < 30
    assert (every == same).all() and every.any()


def test_a_slot_repeated_in_a_text_counts_once(spark):
    rows = spark.createDataFrame([("ababab" * 50, 1), ("ab", 0), ("", 0)], "text string, toxic int")
    found = toxicity._class_counts(rows, (1, 2), 12).collect()
    assert max(r["toxic"] for r in found) == 1
    assert {(r["toxic"], r["clean"]) for r in found if r["slot"] == -1} == {(1, 2)}


def test_labels_beyond_the_broadcast_find_the_same(taught, monkeypatch):
    docs, labels, model = taught
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    other = toxicity.train(docs, labels, bits=14, smoothing=1.0)
    assert (other.weights == model.weights).all() and other.bias == model.bias
