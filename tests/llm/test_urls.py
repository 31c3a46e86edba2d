from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from samples import FOLDER
from gridloom.llm import queries, urls

RULES = queries.URL_RULES


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def ruled(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


def tokens(url):
    host, path = parse(url)
    query = re.match(r"(?s)^.*?://[^?#]*\?([^#]*)", url or "")
    out = [f"host:{p}" for p in host.split(".") if p]
    out += [f"path:{p}" for p in re.sub("[0-9]+", "0", path).split("/") if p]
    out += [f"query:{p}" for p in re.sub("=[^&]*", "", query[1]).split("&") if p] if query else []
    return frozenset(out)


def brute(pages, rules):
    """Mined verdicts by trying every rule on every page."""
    # An item is met by any of its tokens.
    mined = [([set(i.split(urls.OR)) for i in r["tokens"]], r) for r in rules.collect()]
    out = {}
    for page_id, url in pages:
        host, path = parse(url)
        rule, verdict = ruled(host, path)
        if rule is None:
            met = tokens(url)
            found = [r for items, r in mined if all(i & met for i in items)]
            best = max(
                found,
                key=lambda r: (r["confidence"], r["support"], len(r["tokens"]), r["verdict"], r["rule"]),
                default=None,
            )
            verdict = best["verdict"] if best else "allow"
        out[page_id] = (host, path, rule, verdict)
    return out


def test_query_against_brute_force(spark):
    folder = FOLDER.replace("0.001", "0.01")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    listed = [tuple(r) for r in pages.collect()]
    labelled = [
        (sorted(tokens(u)), ruled(*parse(u))[1]) for _, u in listed if ruled(*parse(u))[0]
    ]
    rules = urls.mine(spark.createDataFrame(labelled, "tokens array<string>, verdict string")).rules
    want = brute(listed, rules)
    found = queries.QUERIES["op8_url_rules"](spark, folder).collect()
    assert {r["page_id"]: tuple(r)[1:5] for r in found} == want
    assert any(r["mined_rule"] for r in found)


def test_rules_are_as_supported_and_confident_as_counted(spark):
    rows = [(["host:a", "path:x"], "block")] * 8 + [(["host:a", "path:y"], "allow")] * 2
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"),
                      min_support=0.1, min_confidence=0.7).rules
    found = {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert found[(("host:a",), "block")] == pytest.approx((0.8, 0.8))
    assert found[(("path:x",), "block")] == pytest.approx((1.0, 0.8))
    assert found[(("path:y",), "allow")] == pytest.approx((1.0, 0.2))
    assert (("host:a",), "allow") not in found


def every_rule(labelled, min_support, min_confidence):
    """Each frequent set of tokens with a confident verdict: no folding, no pruning."""
    counts = Counter()
    for held, verdict in labelled:
        for n in range(1, len(held) + 1):
            for subset in combinations(sorted(held), n):
                counts[subset, None] += 1
                counts[subset, verdict] += 1
    return [
        (set(subset), verdict, n / counts[subset, None], n / len(labelled))
        for (subset, verdict), n in counts.items()
        if verdict and n >= min_support * len(labelled) and n / counts[subset, None] >= min_confidence
    ]


@pytest.mark.parametrize("seed", range(4))
def test_verdicts_are_those_of_every_unfolded_rule(spark, seed):
    rng = random.Random(seed)
    names = [f"path:{c}" for c in "abcdefgh"]
    always = {"path:a": ["query:p", "query:q", "query:r"], "path:b": ["query:s"]}

    def url():
        held = {n for n in names if rng.random() < 0.35} or {"path:h"}
        return sorted(held.union(*(always.get(n, []) for n in held)))

    labelled = []
    for _ in range(120):
        held = url()
        blocked = "path:c" in held or rng.random() < (0.8 if "path:a" in held else 0.3)
        labelled.append((held, "block" if blocked else "allow"))
    mined = urls.mine(
        spark.createDataFrame(labelled, "tokens array<string>, verdict string"),
        min_support=0.05, min_confidence=0.7,
    )
    assert {i["item"] for i in mined.items.collect()} >= {urls.OR.join(["path:a", *always["path:a"]]), "path:c"}
    rules = every_rule(labelled, 0.05, 0.7)
    # Open URLs may hold tokens apart that the labelled ones only hold together.
    sets = {tuple(sorted(rng.sample([*names, "query:p", "query:s", "query:x"], rng.randint(1, 5)))) for _ in range(60)}
    told = urls.match(spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>"), mined).collect()
    found = {tuple(r["tokens"]): (r["mined_verdict"], r["confidence"]) for r in told}
    for held in sets:
        fits = [(conf, support, verdict) for tokens, verdict, conf, support in rules if tokens <= set(held)]
        if not fits:
            assert held not in found
            continue
        confidence, support, _ = max(fits)
        assert found[held][1] == pytest.approx(confidence)
        assert found[held][0] in {v for c, s, v in fits if (c, s) == (confidence, support)}


def test_tokens_that_always_occur_together_do_not_multiply(spark):
    keys = [f"query:k{i}" for i in range(30)]
    decided = [f"path:d{i}" for i in range(30)]
    rows = [([*keys, f"path:x{k % 7}"], "block" if k % 3 else "allow") for k in range(300)]
    rows += [([d for i, d in enumerate(decided) if i % 7 != k % 7], "allow") for k in range(300)]
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"),
                      min_confidence=0.6).rules.collect()
    assert len(rules) < 100
    both = urls.OR.join(sorted(keys))
    assert any(list(r["tokens"]) == [both] and r["verdict"] == "block" for r in rules)
    assert sum(r["confidence"] == 1.0 and r["tokens"][0].startswith("path:d") for r in rules) == 7


def test_edges(spark):
    long = "http://example.org/" + "a/" * 5000
    rows = [
        (1, None), (2, ""), (3, "no scheme/com"), (4, "http://"), (5, "HTTP://WWW.EXAMPLE.COM/en/1"),
        (6, "http://example.com/en/1?q=http://x.net/es/"), (7, "http://a.net/es/x#y"), (7, "http://a.net/es/x#y"),
        (8, "http://notcom/"), (9, "http://x.com"), (10, "http://x.com/"), (None, "http://x.net/fr/"),
        (11, long), (12, "http://b.example.com/EN/"), (13, "http://É.example.com?x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr(
        "*", "'x' AS host", "'y' AS rule", "'z' AS tokens", "'v' AS verdict"
    )
    found = urls.judge(df, RULES).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: tuple(r)[1:5] for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == ("", "", None, "allow")
    assert by_id[5] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by_id[6] == ("example.com", "/en/1", "example.com/en/", "block")
    assert by_id[7] == ("a.net", "/es/x", "net/es/", "block")
    assert by_id[8][2] is None and by_id[9] == ("x.com", "", None, by_id[9][3])
    assert by_id[10][2:] == ("com/", "allow") and by_id[None][2:] == ("net/fr/", "block")
    assert by_id[12][2] == "com/" and by_id[13][0] == "É.example.com"
    assert len([r for r in found if r["page_id"] == 7]) == 2


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, RULES).collect() == []
    open_only = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(open_only, RULES).collect()] == [
        (1, "x.org", "/a", None, "allow", None)
    ]


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    text = urls.judge(df, RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)
