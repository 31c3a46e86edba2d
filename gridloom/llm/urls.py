"""URL filters: given host and path rules, then association rules mined from URL tokens."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import stored

ALLOW, BLOCK = "allow", "block"
MARK = "verdict="
# Between the tokens of an item and the items of a rule; no token holds a ``#``.
OR, AND = " #or# ", " #and# "

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in small letters and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (
        F.coalesce(F.regexp_extract(url, pattern, group), F.lit("")) for group in (1, 2)
    )
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct labels of the host, parts of the path (numbers as ``0``) and keys of the query."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))

    def parts(text: Column, at: str, prefix: str) -> Column:
        found = F.filter(F.split(text, at), lambda p: p != "")
        return F.transform(found, lambda p: F.concat(F.lit(prefix), p))

    return F.array_distinct(
        F.concat(
            parts(host, r"\.", "host:"),
            parts(F.regexp_replace(path, "[0-9]+", "0"), "/", "path:"),
            parts(F.regexp_replace(query, "=[^&]*", ""), "&", "query:"),
        )
    )


def given_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does.

    A rule ``(verdict, host, path)`` fits its host and every subdomain where the URL's path
    starts with the rule's; of equally long rules the first in text order counts.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(
        rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True
    ):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, what).otherwise(verdict)
    return text, verdict


@dataclass
class Mined:
    #: rule (text), tokens (its items), verdict, confidence and support.
    rules: DataFrame
    #: token and the item that stands for it and for all tokens of the same labelled URLs.
    items: DataFrame


def _items(labelled: DataFrame, least: float) -> DataFrame:
    """Frequent tokens with their item, its rows and its rows by verdict.

    Tokens that occur in the same labelled URLs, and no others, are one item, named by them in
    text order. Their sets of URLs are compared by two 64-bit hashes and the number of rows.
    At most ``average tokens of a URL * rows / least`` tokens are frequent.
    """
    baskets = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("rows"))
    held = baskets.select(
        F.explode("tokens").alias("token"),
        "rows",
        (F.col("verdict") == BLOCK).cast("int").alias("blocks"),
        F.xxhash64("tokens", "verdict").alias("h1"),
        F.xxhash64(F.lit("second"), "verdict", "tokens").alias("h2"),
    )
    alike = ["rows", "blocked", "h1", "h2"]
    return (
        held.groupBy("token")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(F.col("rows") * F.col("blocks")).alias("blocked"),
            F.bit_xor("h1").alias("h1"),
            F.bit_xor("h2").alias("h2"),
        )
        .where(F.col("rows") >= least)
        .groupBy(*alike)
        .agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        .select(
            F.explode("tokens").alias("token"),
            F.array_join("tokens", OR).alias("item"),
            "rows",
            "blocked",
        )
    )


def _items_of(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Token sets beside each of their items, once each."""
    return (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(items.select("token", "item"), "token")
        .select("tokens", "item")
        .distinct()
    )


def mine(
    labelled: DataFrame,
    *,
    min_support: float = 0.005,
    min_confidence: float = 0.7,
) -> Mined:
    """Rules from token combinations to a verdict, found by FP-growth.

    ``labelled`` holds ``tokens`` (distinct) and ``verdict`` (``allow`` or ``block``). Rules that
    cannot change a verdict are not mined, as there are exponentially many of them: tokens
    that always occur together are one item (any of them meets a rule, as each alone has the
    same support and confidence), and an item whose URLs have one verdict is a rule by itself
    that no longer rule with it can beat in confidence or support. FP-growth combines the items
    with both verdicts; its rules double with every such item that occurs with all others and
    also without them. Without labelled rows there are no rules.
    """
    total = labelled.count()
    items = stored(_items(labelled, min_support * total))
    told = (F.col("blocked") == 0) | (F.col("blocked") == F.col("rows"))
    single = items.where(told).select(
        F.array("item").alias("tokens"),
        F.when(F.col("blocked") > 0, BLOCK).otherwise(ALLOW).alias("verdict"),
        F.lit(1.0).alias("confidence"),
        (F.col("rows") / F.lit(max(1, total))).alias("support"),
    )
    mixed = stored(
        _items_of(labelled.select("tokens").distinct(), items.where(~told))
        .groupBy("tokens")
        .agg(F.collect_list("item").alias("items"))
    )
    baskets = labelled.join(mixed, "tokens", "left").select(
        F.concat(
            F.coalesce("items", F.array().cast("array<string>")),
            F.array(F.concat(F.lit(MARK), "verdict")),
        ).alias("items")
    )
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(baskets)
    target = F.col("consequent")[0]
    grown = model.associationRules.where(target.startswith(MARK)).where(
        ~F.exists("antecedent", lambda t: t.startswith(MARK))
    )
    rules = grown.select(
        F.array_sort("antecedent").alias("tokens"),
        F.replace(target, F.lit(MARK), F.lit("")).alias("verdict"),
        "confidence",
        "support",
    ).union(single.distinct())
    rules = rules.withColumn("rule", F.concat_ws(AND, F.col("tokens"), F.col("verdict")))
    return Mined(stored(rules), items)


def match(urls: DataFrame, mined: Mined) -> DataFrame:
    """The best rule's verdict for every distinct token set of ``urls`` (column ``tokens``).

    Rules are found by their items: an inverted index from item to rule is joined with the
    items of the set, and a rule counts if all its items were met. The most confident rule
    wins, then the best supported, the one of most items, ``block`` before ``allow``, and the
    text order. Token sets that meet no rule are left out.
    """
    index = mined.rules.select(
        F.explode("tokens").alias("item"),
        "rule",
        F.size("tokens").alias("needed"),
        F.struct(
            "confidence", "support", F.size("tokens").alias("n"), "verdict", "rule"
        ).alias("rank"),
    )
    met = _items_of(urls.select("tokens").distinct(), mined.items).join(index, "item")
    whole = (
        met.groupBy("tokens", "rule")
        .agg(F.count("*").alias("met"), F.first("needed").alias("needed"), F.first("rank").alias("rank"))
        .where("met = needed")
    )
    return whole.groupBy("tokens").agg(F.max("rank").alias("best")).select(
        "tokens",
        F.col("best.verdict").alias("mined_verdict"),
        F.col("best.rule").alias("mined_rule"),
        F.col("best.confidence").alias("confidence"),
    )


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    min_support: float = 0.005,
    min_confidence: float = 0.7,
    otherwise: str = ALLOW,
) -> DataFrame:
    """Verdict for every page: the given rule's, else the mined rules', else ``otherwise``.

    The URLs that a given rule judges are the labels the mined rules learn from. Returns id,
    host, path, rule (text or null), verdict and mined_rule (null where none was used). Null
    URLs and URLs without ``://`` have an empty host and path, meet no rule and get
    ``otherwise``. Repeated rows are judged alike; other columns are ignored; an empty table
    gives an empty result.
    """
    read = pages.select(named(id_column).alias(id_column), named(url_column).alias("url"))
    host, path = host_and_path(F.col("url"))
    read = read.withColumns({"host": host, "path": path})
    text, verdict = given_rule(F.col("host"), F.col("path"), rules)
    read = read.withColumns(
        {
            "rule": text,
            "given": verdict,
            "tokens": tokens(F.col("url"), F.col("host"), F.col("path")),
        }
    ).drop("url")
    ruled, open_pages = read.where("given is not null"), read.where("given is null")
    labelled = ruled.select("tokens", F.col("given").alias("verdict"))
    mined = mine(labelled, min_support=min_support, min_confidence=min_confidence)
    # Stored, so that the join meets two plain shuffles and Spark can split a frequent token set.
    best = stored(match(open_pages, mined))
    found = open_pages.join(best, "tokens", "left").select(
        id_column, "host", "path", "rule",
        F.coalesce("mined_verdict", F.lit(otherwise)).alias("verdict"),
        "mined_rule",
    )
    return found.union(
        ruled.select(
            id_column, "host", "path", "rule", F.col("given").alias("verdict"),
            F.lit(None).cast("string").alias("mined_rule"),
        )
    )
