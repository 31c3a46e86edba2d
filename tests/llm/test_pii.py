from __future__ import annotations

import hashlib
import random
import re

from gridloom.llm import pii, queries
from samples import EDGES, FOLDER, documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(found):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)


def test_query_against_brute_force(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_contextual_pii"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[1] == i for w in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest()
        assert set(written(want).split(",")) <= set(r["spans"].split(",")) | {""}


def test_base_against_the_plain_patterns():
    rng = random.Random(3)
    parts = ["1", "23", "45", " ", "-", ".", "+", "@", "a", "b.c", "(", ")", "%", "x", "é", "０", "256",
             "4111111111111111", "10.0.0.1", "+1 (988) 555-2485", "me@b.co"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert [(s, pii.KINDS.index(k), e) for k, s, e in pii.base_spans(text)] == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 300_000, "a@" * 100_000,
                 "1 " * 150_000, "+" * 300_000):
        pii.spans(text, {"x y _": "phone"})


def taught(spark, extra=()):
    """Phones after 'reach me on', some without the plus that the fixed shape needs."""
    rows = [(k, f"please reach me on +1 (20{k % 10}) 555-{1000 + k} today, note {k}") for k in range(20)]
    rows += [(100 + k, f"please reach me on 20{k}-555-{2000 + k} today, note {k}") for k in range(2)]
    rows += [(200 + k, f"in total we sold {k}0{k}-555-{3000 + k} units of it") for k in range(5)]
    return documents(spark, [*rows, *extra])


def test_contexts_find_what_has_no_fixed_shape(spark):
    docs = taught(spark)
    found = pii.bootstrap(docs)
    known = pii.trusted(found)
    assert known["me on _"] == "phone" and not any(p.startswith("we sold") for p in known)
    assert all(0.9 <= r["confidence"] <= 1 for r in found.collect())
    rows = {r["doc_id"]: r for r in pii.extract(docs, known).collect()}
    for k in range(2):
        text = f"please reach me on 20{k}-555-{2000 + k} today"
        start = text.index("20")
        assert rows[100 + k]["base"] == "" and rows[100 + k]["n_phone"] == 0
        assert rows[100 + k]["spans"] == f"phone:{start}:{start + 12}"
    assert all(rows[200 + k]["spans"] == "" for k in range(5))


def test_copies_add_no_support(spark):
    rows = [(k, "please reach me on +1 (201) 555-1000 today") for k in range(50)]
    assert pii.bootstrap(documents(spark, rows)).collect() == []


def test_edges(edges, nothing):
    found = pii.extract(edges, {}).collect()
    assert len(found) == len(EDGES) and {r["spans"] for r in found} == {""}
    assert pii.bootstrap(edges).collect() == []
    assert pii.extract(nothing, {}).collect() == [] == pii.bootstrap(nothing).collect()
    assert pii.redact(nothing, {}).collect() == []
    same = pii.redact(edges, {})
    assert same.columns == edges.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, edges.collect()))


def test_redaction_replaces_spans_and_counts(spark):
    text = "mail me@b.co or +1 (988) 555-2485, host 10.0.0.1, card 4111111111111111."
    (row,) = pii.redact(documents(spark, [(1, text)]), {}).collect()
    assert row["text"] == "mail <email> or <phone>, host <ip>, card <card>."
    assert row["n_chars"] == len(row["text"])
    assert pii.masked("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a<ip>f"


def test_patterns_beyond_a_broadcast_are_used(spark):
    """What the patterns after the first find is found too, whichever way they are handed out."""
    other = [(300 + k, f"our card number is 4111 1111 1111 {c} thanks, note {k}")
             for k, c in enumerate(last for last in range(1000, 10_000) if pii.luhn(f"411111111111{last}")) if k < 20]
    docs = taught(spark, [*other, (400, "our card number is 4111 1111 1111 1112 thanks"), (None, None),
                          (100, "please reach me on 200-555-2000 today, note 0")])
    found = pii.bootstrap(docs)
    assert {r["kind"] for r in found.collect()} >= {"card", "phone"}
    whole, cut = pii.trusted(found), pii.trusted(found, most=1)
    want = sorted(map(str, pii.extract(docs, whole).collect()))
    assert sum("card:" in r for r in want) == 21 and sum("phone:" in r for r in want) > 20
    assert sorted(map(str, pii.extract(docs, cut).collect())) == want
    masked = pii.redact(docs, cut)
    assert masked.schema == docs.schema
    assert sorted(map(str, masked.collect())) == sorted(map(str, pii.redact(docs, whole).collect()))
    assert sum("<card>" in r["text"] for r in masked.where("text is not null").collect()) == 21
