"""Null, empty, short and longer texts in every order, each order an Arrow batch of its own."""

from __future__ import annotations

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gridloom.llm import language, licenses, lm, packing, pii, simhash, toxicity

KINDS = [None, "", "two words", "now four words here", "licensed under the MIT License",
         "a@b.org 10.0.0.1 " + "under the Apache License version 2.0 " * 9]


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(len(KINDS) * n + k, text) for n, order in enumerate(permutations(KINDS)) for k, text in enumerate(order)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(len(KINDS)))
    yield spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def same_for_a_text(orders, found, *columns):
    """A text's answer does not hang on the texts before and after it."""
    met = orders.join(found.select("doc_id", *columns), "doc_id", "left").groupBy("text").agg(F.collect_set(F.struct(*columns)).alias("s"))
    answers = {r["text"]: r["s"] for r in met.collect()}
    assert len(answers) == len(KINDS) and all(len(a) == 1 for a in answers.values())
    return {t: tuple(a[0]) for t, a in answers.items()}


def test_licenses(orders):
    found = licenses.scan(orders)
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("license_id", "start_word", "windows"))).alias("held"))
    answers = same_for_a_text(orders, per_doc, "held")
    assert answers[None] == answers[""] == answers["two words"] == (None,)
    assert any(x["license_id"].startswith("MIT") for x in answers[KINDS[4]][0])


def test_fingerprints(orders):
    answers = same_for_a_text(orders, simhash.fingerprints(orders), "fingerprint")
    assert answers[None] == answers[""] == (0,)


def test_language_and_toxicity(spark, orders):
    learnt = spark.createDataFrame([(k, f"some text {k}", "en") for k in range(9)], "doc_id long, text string, lang string")
    same_for_a_text(orders, language.predict(orders, language.train(learnt, bits=10)), "lang_pred", "score")
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, toxic int")
    same_for_a_text(orders, toxicity.score(orders, toxicity.train(learnt, labels, F.lit(True))), "score")


def test_personal_data(orders):
    answers = same_for_a_text(orders, pii.extract(orders, {}), "base", "n_email", "n_ip")
    assert answers[KINDS[5]][1:] == (1, 1) and answers[None][0] == ""


def test_packing(orders):
    sums = packing.pack(orders).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    answers = same_for_a_text(orders, sums, "n", "t")
    assert answers[None] == (1, 1) and all(n == t for n, t in answers.values())


def test_language_model(orders):
    answers = same_for_a_text(orders, lm.score(orders, lm.train(orders)), "n_tokens", "n_known", "score")
    assert answers[None] == answers[""]
