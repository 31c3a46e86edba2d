from __future__ import annotations

import corpus_pipeline as pipeline
from gridloom.llm import pii
from samples import FOLDER, documents
from test_decontam import brute as brute_overlaps
from test_packing import expected
from test_simhash import brute_components


def texts(df):
    found = ((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    return sorted(found, key=lambda r: (r[0] is not None, r[0], r[1] or ""))


def test_every_stage_against_brute_force(spark, small):
    docs = small
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before = texts(docs)
        after = stage(spark, docs, FOLDER).cache()
        if name == "language":
            lettered = [b for b in before if any(map(str.isalpha, b[1] or ""))]
            assert set(texts(after)) <= set(lettered)
            assert len(lettered) - after.count() <= 0.01 * len(lettered)
        elif name == "near_duplicates":
            stay = {r[2] for r in brute_components(before)}
            assert texts(after) == [b for b in before if b[0] in stay]
        elif name == "decontamination":
            gone = {r[0] for r in brute_overlaps(before, benchmark)}
            assert gone and texts(after) == [b for b in before if b[0] not in gone]
        elif name == "personal_data":
            assert texts(after) == [(d, pii.masked(t, pii.base_spans(t))) for d, t in before]
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        else:
            from gridloom.llm import packing
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(packing.default_tokenizer())
            sizes = {d: len(expected(tokenizer, t)) for d, t in before}
            got: dict[int, int] = {}
            for r in after.collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
                assert r["doc_tokens"] == sizes[r["doc_id"]]
            assert got == sizes
        if name != "packing":
            assert after.columns == small.columns and after.schema == small.schema
        docs = after


def test_run_is_its_stages(spark):
    found = pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
    # Sequences depend on how rows are dealt out; the documents' ids don't.
    columns = ["doc_id", "doc_tokens"]
    assert sorted(found.select(columns).distinct().collect()) == sorted(
        docs.select(columns).distinct().collect()
    )


def test_empty_table(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.collect() == []


def test_null_texts_and_ids(spark):
    rows = [(None, "a text without id"), (1, None), (2, "12 34"), (3, "some words to keep"), (3, "some words to keep")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
    assert texts(docs) == [(None, "a text without id"), (3, "some words to keep")]


def test_without_languages_to_learn_from_only_texts_without_a_letter_go(spark):
    rows = [(1, "clean text", None), (2, "Ünder", None), (3, "12 34 !", None), (4, None, None), (5, "", None), (None, "한국어", None)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    left = pipeline.known_language(spark, docs, FOLDER)
    assert left.schema == docs.schema
    assert texts(left) == [(None, "한국어"), (1, "clean text"), (2, "Ünder")]
