from __future__ import annotations

import pytest

from gridloom.llm import licenses, queries
from samples import EDGES, FOLDER, documents


def shingles(text):
    words = licenses.words(text or "")
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(rows, templates):
    """Best containment over the windows of the docstring, and the windows that suffice."""
    out = []
    for doc, text in rows:
        held = shingles(text)
        for name, template in templates.items():
            wanted = set(shingles(template))
            if not wanted:
                continue
            half = 1 << (len(wanted) - 1).bit_length()
            shares = [
                len(wanted & set(held[k : k + 2 * half])) / len(wanted)
                for k in range(0, len(held), half)
            ]
            good = [s for s in shares if s >= 0.8]
            if good:
                out.append((doc, name, max(good), len(good)))
    return sorted(out, key=str)


def found(df, **settings):
    rows = licenses.scan(df, **settings).collect()
    return sorted(((r["doc_id"], r["license_id"], r["containment"], r["windows"]) for r in rows), key=str)


def test_query_against_brute_force(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = queries.QUERIES["op10_license_scan"](spark, folder).collect()
    got = sorted(((r["doc_id"], r["license_id"], r["containment"], r["windows"]) for r in rows), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], licenses.TEMPLATES)
    assert len(got) > 10


def test_changed_and_embedded_texts(spark):
    filler = " ".join(f"w{k}" for k in range(300))
    rows = []
    for k, (_, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = text.split()
        changed = list(words)
        changed[len(changed) // 2] = "different"
        rows += [
            (10 * k, text), (10 * k + 1, f"{filler} {text} {filler}"), (10 * k + 2, text.upper()),
            (10 * k + 3, f"{filler} {' '.join(changed)} {filler}"), (10 * k + 4, " ".join(words[: len(words) // 2])),
        ]
    want = brute(rows, licenses.TEMPLATES)
    assert found(documents(spark, rows)) == want
    assert len(want) >= 3 * len(licenses.TEMPLATES)


def test_edges(spark, edges, nothing):
    templates = {"fox": "the quick brown fox jumps over the lazy dog", "short": "lazy dog", "id": "no id at all here"}
    assert found(edges, templates=templates) == brute([r[:2] for r in EDGES], templates)
    assert found(nothing) == []
    assert found(edges, templates={}) == []


def test_spans_name_the_words(spark):
    text = "some words first. Released under the MIT License. More."
    (row,) = licenses.scan(documents(spark, [(1, text)])).collect()
    assert licenses.words(text)[row["start_word"] : row["end_word"]] == licenses.words("Released under the MIT License.")


def test_bands_guarantee_the_probability():
    bands = licenses.bands_for(0.9999)
    least = 0.4 / 2.1
    assert licenses.collision_probability(least, bands) >= 0.9999
    assert licenses.collision_probability(least, bands - 1) < 0.9999
    assert licenses.collision_probability(0.5, 4, 2) == pytest.approx(1 - 0.75**4)


def test_whole_texts_and_other_wordings_are_found(spark):
    texts = {name: text for name, text in licenses.TEMPLATES.items() if name.endswith("-full")}
    assert {"Apache-2.0-full", "GPL-2-full", "GPL-3-full", "LGPL-2.1-full", "CC0-1.0-full"} <= set(texts)
    rows = [(k, f"code of ours {text} and more of it") for k, text in enumerate(texts.values())]
    rows += [(100, "this file is licensed under the MIT License and so on"), (101, licenses.NOTICES["ISC"]),
             (102, licenses.NOTICES["Unlicense"]), (103, licenses.NOTICES["BSD-3-Clause"])]
    got = {(d, name) for d, name, share, _ in found(documents(spark, rows)) if share == 1}
    wanted = {*enumerate(texts), (100, "MIT-notice-1"), (101, "ISC"), (102, "Unlicense"), (103, "BSD-3-Clause")}
    assert wanted <= got
