"""Personal data: fixed shapes, and contexts bootstrapped from what they find."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import free_name, slices, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Fixed shapes. Possessive and look-behind forms find the same matches as the plain ones in
# time linear in the text.
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARACTERS = frozenset(
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    for m in HOST.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            end = m.end()


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of every kind, by start, then kind.

    A match that fails its check (parts of an address over 255, a card's length or Luhn sum, a
    phone's digits) is dropped and not tried otherwise.
    """
    found = list(_emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# What may be an identifier without having a fixed shape: addresses spelled out or without a
# domain, and groups of digits.
LOOSE = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]++(?:@| ?[\[(]at[\])] ?)[\w-]++"
    r"(?:(?:\.| ?[\[(]dot[\])] ?)[\w-]++)*+)"
    r"|(?P<digits>[(]?(?<![0-9])[0-9]++(?:[().:-]++ ?[0-9]++| [(]?[0-9]++)*+)"
)


def loose_kinds(text: str, kind: str) -> tuple[str, ...]:
    """Kinds that a loose match can be of, by its count of digits and points."""
    if kind == "email":
        return ("email",)
    digits = sum("0" <= c <= "9" for c in text)
    kinds = []
    if text.count(".") == 3 and digits <= 12 and not set(text) - set("0123456789."):
        kinds.append("ip")
    if 12 <= digits <= 19:
        kinds.append("card")
    if 7 <= digits <= 15:
        kinds.append("phone")
    return tuple(kinds)


def candidates(text: str, base: list[Span]) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """Loose matches that no fixed span touches, with the kinds they can be of."""
    taken = sorted((s, e) for _, s, e in base)
    at = 0
    for m in LOOSE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        kinds = loose_kinds(m[0], m.lastgroup)
        if kinds:
            yield kinds, m.start(), m.end()


BEFORE, AFTER, REACH = re.compile(r"\w+"), re.compile(r"\w+"), 80


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a place: the words before it, and those on either side.

    Digits in words read as 0. The words are looked for within 80 characters.
    """
    before = re.sub("[0-9]", "0", text[max(0, start - REACH) : start].lower())
    after = re.sub("[0-9]", "0", text[end : end + REACH].lower())
    left, right = BEFORE.findall(before)[-3:], AFTER.findall(after)[:2]
    out = []
    if len(left) >= 2:
        out.append(" ".join(left[-2:]) + " _")
    if len(left) >= 3:
        out.append(" ".join(left) + " _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(left) >= 2 and right:
        out.append(f"{left[-2]} {left[-1]} _ {right[0]}")
    return out


MAY_HOLD = re.compile(r"[0-9@]|[\[(]at[\])]")


def _occurrences(docs: DataFrame, text_column: str) -> DataFrame:
    """Distinct (pattern, instance) pairs: what stands in a pattern's gap, and its kinds.

    ``seed`` is the kind of a fixed span, else null; ``kinds`` holds what a loose match can be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = set()
            for text in texts_of(batch, "text"):
                if not MAY_HOLD.search(text):
                    continue
                base = base_spans(text)
                places = [((k,), k, s, e) for k, s, e in base]
                places += [(ks, None, s, e) for ks, s, e in candidates(text, base)]
                for kinds, seed, start, end in places:
                    instance = xxhash.xxh64_intdigest(text[start:end]) - (1 << 63)
                    for pattern in patterns(text, start, end):
                        rows.add((pattern, instance, seed, ",".join(kinds)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*sorted(rows, key=str)), kinds)],
                    ["pattern", "instance", "seed", "kinds"],
                )

    read = docs.select(named(text_column).alias("text"))
    found = read.mapInArrow(run, "pattern string, instance long, seed string, kinds string")
    return found.distinct()


def bootstrap(
    docs: DataFrame,
    *,
    text_column: str = "text",
    rounds: int = 3,
    least_support: int = 5,
    least_confidence: float = 0.9,
) -> DataFrame:
    """Patterns that may be trusted with a kind: pattern, kind, confidence, support.

    Seeds are the instances of fixed shape. Each round scores a pattern for a kind by the mean
    belief in what stands in its gap, where a seed is believed 1 for its own kind and 0 for
    others, and then believes in every other instance as far as the best of its patterns that
    hold ``least_support`` seeds of that kind. Pairs of pattern and instance are counted once,
    so copies of a text add nothing. Both steps are joins and aggregations over the pairs, each
    round written to the shared folder.
    """
    edges = stored(_occurrences(docs, text_column))
    asked = edges.select("pattern", "instance", "seed", F.explode(F.split("kinds", ",")).alias("kind"))
    total = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("total"))
    support = (
        edges.where("seed is not null")
        .groupBy("pattern", F.col("seed").alias("kind"))
        .agg(F.count_distinct("instance").alias("support"))
        .where(F.col("support") >= least_support)
        .join(total, "pattern")
    )
    support = stored(support)
    seeds = F.col("support").cast("double")
    scores = support.select("pattern", "kind", "support", "total", (seeds / F.col("total")).alias("confidence"))
    # Only instances without a fixed shape, in a pattern that has support, change their belief.
    open_edges = stored(
        asked.where("seed is null")
        .join(support.select("pattern", "kind", "support", "total"), ["pattern", "kind"])
        .select("pattern", "instance", "kind")
        .distinct()
    )
    for _ in range(rounds):
        belief = (
            open_edges.join(scores.select("pattern", "kind", "confidence"), ["pattern", "kind"])
            .groupBy("instance", "kind")
            .agg(F.max("confidence").alias("belief"))
        )
        gained = (
            open_edges.join(belief, ["instance", "kind"])
            .groupBy("pattern", "kind")
            .agg(F.sum("belief").alias("gained"))
        )
        scores = stored(
            support.join(gained, ["pattern", "kind"], "left").select(
                "pattern", "kind", "support", "total",
                ((seeds + F.coalesce("gained", F.lit(0.0))) / F.col("total")).alias("confidence"),
            )
        )
    # Seeds alone must make up most of what a trusted pattern was seen with.
    return scores.where(
        (F.col("confidence") >= least_confidence) & (F.col("support") * 2 >= F.col("total"))
    ).select("pattern", "kind", "confidence", "support")


def trusted(found: DataFrame, most: int = 100_000) -> dict[str, str] | DataFrame:
    """Kind by pattern, of all patterns: the kind with the best support, then confidence.

    Up to ``most`` patterns come as a dictionary, which tasks get whole; more stay a stored
    table (pattern, kind), which texts are joined with. Both find the same.
    """
    order = F.struct(-F.col("support"), -F.col("confidence"), "kind")
    kinds = stored(found.groupBy("pattern").agg(F.min_by("kind", order).alias("kind")))
    rows = kinds.limit(most + 1).collect()
    return kinds if len(rows) > most else {r["pattern"]: r["kind"] for r in rows}


def spans(text: str, known: dict[str, str]) -> tuple[list[Span], list[Span]]:
    """Fixed spans, and all spans with those that trusted patterns add."""
    if not MAY_HOLD.search(text):
        return [], []
    base = base_spans(text)
    added = []
    for kinds, start, end in candidates(text, base) if known else ():
        told = {known.get(p) for p in patterns(text, start, end)} - {None}
        fit = [k for k in kinds if k in told]
        if len(told) == 1 and fit:
            added.append((fit[0], start, end))
    return base, sorted(base + added, key=_order)


def _asked(texts: DataFrame) -> DataFrame:
    """Distinct (text_hash, pattern): what surrounds the loose matches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = set()
            for text_hash, text in zip(batch.column("text_hash").to_pylist(), texts_of(batch, "text")):
                if MAY_HOLD.search(text):
                    for _, start, end in candidates(text, base_spans(text)):
                        rows.update((text_hash, p) for p in patterns(text, start, end))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*sorted(rows)), (pa.int64(), pa.string()))],
                    ["text_hash", "pattern"],
                )

    return texts.mapInArrow(run, "text_hash long, pattern string").distinct()


def _with_hits(docs: DataFrame, known: DataFrame, text_column: str, hits_as: str) -> DataFrame:
    """``docs`` with column ``hits_as``: the trusted patterns around each text's loose matches.

    The column holds patterns and kinds by turns, null where there are none; a text's list is
    bounded by its own matches.
    """
    own_hash = free_name(docs, "own_hash")
    text_hash = F.xxhash64(named(text_column))
    asked = _asked(docs.select(text_hash.alias("text_hash"), named(text_column).alias("text")))
    hits = stored(
        asked.join(known, "pattern")
        .groupBy("text_hash")
        .agg(F.flatten(F.collect_list(F.array("pattern", "kind"))).alias(hits_as))
    )
    hits = hits.withColumnRenamed("text_hash", own_hash)
    joined = docs.join(hits, text_hash == hits[own_hash], "left")
    return joined.select(*map(named, docs.columns), hits_as)


def _known(
    batch: pa.RecordBatch, known: dict[str, str] | None, hits: str
) -> Iterator[dict[str, str]]:
    """For each row the kinds of the patterns that may matter to it."""
    if known is not None:
        return itertools.repeat(known, batch.num_rows)
    lists = batch.column(hits).to_pylist()
    return (dict(zip(held[::2], held[1::2])) if held else {} for held in lists)


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def extract(
    docs: DataFrame,
    known: dict[str, str] | DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, base (fixed spans as text), spans (all spans) and counts of the fixed spans.

    Spans are ``kind:start:end`` in code points, end exclusive, joined by commas. A null text
    reads as empty and has none; null ids pass through; repeated rows are searched each; equal
    starts go by kind; an empty table gives an empty result; other columns are ignored.
    """
    joined = isinstance(known, DataFrame)
    shared = docs.sparkSession.sparkContext.broadcast(None if joined else known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            told = zip(texts_of(batch, "text"), _known(batch, shared.value, "hits"))
            found = [spans(t, kinds) for t, kinds in told]
            counts = [
                pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64())
                for kind in KINDS
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([written(base) for base, _ in found], pa.string()),
                    pa.array([written(every) for _, every in found], pa.string()),
                    *counts,
                ],
                ["doc_id", "base", "spans", *(f"n_{k}" for k in KINDS)],
            )

    chosen = docs.select(
        named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text")
    )
    if joined:
        chosen = _with_hits(chosen, known, "text", "hits")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return chosen.mapInArrow(run, f"doc_id long, base string, spans string, {counts}")


def masked(text: str, every: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans count as one."""
    out, at = [], 0
    for kind, start, end in every:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(
    docs: DataFrame,
    known: dict[str, str] | DataFrame,
    *,
    text_column: str = "text",
    length_column: str | None = "n_chars",
) -> DataFrame:
    """All rows and columns of ``docs`` with personal data replaced by ``<kind>``.

    ``length_column``, where there is one, is brought up to date for the texts that changed.
    Null and empty texts stay; texts of any length are read whole; repeated rows change alike;
    an empty table gives an empty result; columns of any name keep their values.
    """
    joined = isinstance(known, DataFrame)
    shared = docs.sparkSession.sparkContext.broadcast(None if joined else known)
    names, hits = docs.columns, free_name(docs, "hits")
    counted = length_column in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            columns = {c: batch.column(c) for c in names}
            old = batch.column(text_column).to_pylist()
            told = zip(old, _known(batch, shared.value, hits))
            new = [t and masked(t, spans(t, kinds)[1]) for t, kinds in told]
            columns[text_column] = pa.array(new, batch.column(text_column).type)
            if counted:
                lengths = batch.column(length_column)
                columns[length_column] = pa.array(
                    [n if a == b else len(b) for n, a, b in zip(lengths.to_pylist(), old, new)],
                    lengths.type,
                )
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    read = _with_hits(docs, known, text_column, hits) if joined else docs
    return read.mapInArrow(run, docs.schema)
