"""Benchmark decontamination by spaced seeds, verified along the diagonal of a hit."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import stored, without

# Places of a window that a mask compares; the others are ignored. Together they meet every
# window of 13 words in which at most 2 words differ, wherever those lie.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
# Items shorter than a window are looked for whole and unchanged, by their first words.
SHORT_MASK = (0, 1, 2, 3, 4)
SPAN, SIMILARITY = 13, 0.8
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Words of letters, marks and digits in small letters; none for a null text."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_remove(found, "")


def _key(hashes: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    """Hash of the words a mask compares, null where its window leaves the text."""
    parts = [F.get(hashes, at + k) for k in mask]
    return F.when(at + max(mask) < F.size(hashes), F.xxhash64(F.lit(number), *parts))


def _seeds(items: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    at = F.col("item_at")
    placed = items.select(
        "item_id", "item_hash", "item_words", F.explode(F.sequence(F.lit(0), F.size("item_words") - 1)).alias("item_at")
    )
    short = F.size("item_words") < SPAN
    keys = [
        F.when(
            short & (at == 0) if mask == SHORT_MASK else ~short,
            _key(F.col("item_words"), at, mask, number),
        )
        for number, mask in masks
    ]
    return (
        placed.select(
            "item_id", "item_hash", "item_at", F.size("item_words").alias("item_size"),
            F.explode(F.array(*keys)).alias("key"),
        )
        .where("key is not null")
    )


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Documents that hold a passage of a benchmark item, one row per document text and item.

    A document and an item overlap if somewhere 13 consecutive words of the item, laid on the
    document's words, agree in at least 11 (a similarity of 0.8); an item of 5 to 12 words must
    occur whole and unchanged, and shorter items are not looked for. Words are runs of letters,
    marks and digits in small letters. Returns doc_id, text_hash (of the text), item_id, start
    (word of the document on which the item's first word falls, negative if it lies before),
    matched (agreeing words of the best window) and item_size.

    Every position of a document gives one key per mask; keys meet the items' keys in a join
    whose item side is broadcast in parts of at most ``BROADCAST_SEEDS`` keys. Only the
    document's words under the item travel on, once per diagonal, to be compared in full.

    Null texts hold no words; documents with a null id are reported with it; repeated rows are
    reported once; of several best places the first counts; an item without id or repeated is
    like any other; empty tables give an empty result; other columns are ignored.
    """
    hashed = lambda text: F.transform(words(text), lambda w: F.xxhash64(w))
    items = (
        benchmark.select(
            named(item_id_column).alias("item_id"),
            hashed(named(item_text_column)).alias("item_words"),
        )
        .where(F.size("item_words") >= len(SHORT_MASK))
        .withColumn("item_hash", F.xxhash64("item_words"))
        .dropDuplicates(["item_id", "item_hash"])
    )
    sizes = items.agg(
        F.sum(F.size("item_words")).alias("words"), F.min(F.size("item_words")).alias("least")
    ).first()
    masks = list(enumerate(MASKS))
    if (sizes["least"] or SPAN) < SPAN:
        masks.append((len(MASKS), SHORT_MASK))
    seeds = _seeds(items, masks)
    parts = max(1, math.ceil((sizes["words"] or 0) * len(masks) / BROADCAST_SEEDS))

    at = F.col("at")
    placed = docs.select(
        named(id_column).alias("doc_id"),
        F.xxhash64(named(text_column)).alias("text_hash"),
        hashed(named(text_column)).alias("doc_words"),
    )
    # No filter on the size: it would be pushed below and split every text a second time.
    places = F.when(
        F.size("doc_words") >= len(SHORT_MASK), F.sequence(F.lit(0), F.size("doc_words") - 1)
    )
    placed = placed.select("*", F.explode(places).alias("at"))
    keyed = placed.select(
        "*", F.explode(F.array(*[_key(F.col("doc_words"), at, m, n) for n, m in masks])).alias("key")
    ).where("key is not null")
    hits = reduce(
        DataFrame.union,
        [
            keyed.join(F.broadcast(seeds.where(F.pmod("key", F.lit(parts)) == p)), "key")
            for p in range(parts)
        ],
    )
    start = at - F.col("item_at")
    lines = (
        hits.select(
            "doc_id", "text_hash", "item_id", "item_hash", start.alias("start"),
            F.slice(
                "doc_words",
                F.greatest(start, F.lit(0)) + 1,
                F.col("item_size") + F.least(start, F.lit(0)),
            ).alias("under"),
        )
        .groupBy("doc_id", "text_hash", "item_id", "item_hash", "start")
        .agg(F.first("under").alias("under"))
    )
    joined = lines.join(
        items.withColumnsRenamed({"item_id": "i", "item_hash": "h"}),
        F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("h")),
    )
    shift = F.least("start", F.lit(0))
    agree = F.transform(
        "item_words", lambda w, j: F.coalesce((F.get("under", j + shift) == w).cast("int"), F.lit(0))
    )
    # Out-of-range places before the document give a negative index, which get() answers null.
    size = F.size("item_words")
    window = F.least(size, F.lit(SPAN))
    counts = F.transform(
        F.sequence(F.lit(0), F.size("agree") - F.col("span")),
        lambda j: F.aggregate(F.slice("agree", j + 1, F.col("span")), F.lit(0), lambda s, x: s + x),
    )
    need = F.when(size < SPAN, size).otherwise(math.ceil(SIMILARITY * SPAN))
    scored = joined.withColumns({"agree": agree, "span": window, "need": need, "item_size": size})
    scored = scored.withColumn("matched", F.array_max(counts)).where("matched >= need")
    best = scored.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("matched", (-F.col("start")).alias("before"), "item_size")).alias("best")
    )
    return best.select(
        "doc_id", "text_hash", "item_id",
        (-F.col("best.before")).alias("start"),
        F.col("best.matched").alias("matched"),
        F.col("best.item_size").alias("item_size"),
    )


def without_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", **names: str
) -> DataFrame:
    """The documents whose text holds no passage of the benchmark, all columns kept."""
    found = overlaps(docs, benchmark, text_column=text_column, **names)
    gone = stored(found.select("text_hash").distinct())
    return without(docs, gone, F.xxhash64(named(text_column)) == gone["text_hash"])
