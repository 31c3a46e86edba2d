"""SimHash near-duplicates, candidates filtered by chains of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import free_name, slices, stored, without
from .components import components


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space.

    A bit is 1 if it is set in over half the hashes of the ``words``-word shingles, repeats
    included; a shorter text is one shingle, and a text without words has fingerprint 0.
    """
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    digest, n = xxhash.xxh64_intdigest, len(found) - words + 1
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words))))
    hashes = np.fromiter((digest(s, seed) for s in shingles), "<u8", n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
    seed: int = 42,
) -> DataFrame:
    """doc_id, fingerprint (a long with the 64 bits) and hash of every whole text.

    A null text has the fingerprint of an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(pc.cast(batch.column("text"), pa.binary()), b"").to_pylist()
            found = np.array([fingerprint(t, words, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("text_hash")],
                ["doc_id", "fingerprint", "text_hash"],
            )

    chosen = docs.select(
        named(id_column).cast("long").alias("doc_id"),
        named(text_column).alias("text"),
        F.xxhash64(named(text_column)).alias("text_hash"),
    )
    return chosen.mapInArrow(run, "doc_id long, fingerprint long, text_hash long")


SEGMENTS, WIDTH = 8, 8
# Of the third to fifth segment of a chain, the two that a key holds besides the first two.
PICKS = ((2, 3), (2, 4), (3, 4))
DISTANCE = 3


def _budget(length: int) -> int:
    """Differing bits that a chain of ``length`` segments may have."""
    return DISTANCE * length // SEGMENTS


def _segment(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit(0xFF))


def _rotated(value: Column, start: int) -> Column:
    if start == 0:
        return value
    down = F.shiftrightunsigned(value, WIDTH * start)
    return down.bitwiseOR(F.shiftleft(value, 64 - WIDTH * start))


def _within(turned: Column) -> Column:
    """Whether every chain that begins at the lowest segment keeps to its budget."""
    held = F.lit(True)
    for length in range(1, SEGMENTS):
        mask = (1 << WIDTH * length) - 1
        held &= F.bit_count(turned.bitwiseAND(F.lit(mask))) <= _budget(length)
    return held


def keys(value: Column) -> Column:
    """Keys of a fingerprint, three for each start of a chain.

    Two fingerprints that differ in at most 3 of 64 bits have, on the ring of 8 segments of 8
    bits, a start from which every chain of ``l`` segments differs in at most ``3 * l / 8``
    bits. The first two segments of that chain are then equal and the next three differ in one
    bit at most, so two of these three are equal too: 32 equal bits at known places.
    """
    found = []
    for start in range(SEGMENTS):
        for number, pick in enumerate(PICKS):
            key = F.lit(start * len(PICKS) + number).cast("long")
            for k in (0, 1, *pick):
                key = F.shiftleft(key, WIDTH).bitwiseOR(_segment(value, start + k))
            found.append(
                F.struct(
                    key.alias("key"), F.lit(start).alias("start"), F.lit(number).alias("pick")
                )
            )
    return F.array(*found)


def links(prints: DataFrame) -> DataFrame:
    """Pairs a < b of different fingerprints (column ``fingerprint``) at most 3 bits apart.

    Candidates share a key; a pair that shares several counts at the first start whose chains
    all keep to their budgets, and there at the first pick, so every link comes out once. Only
    pairs that pass the chains come to the full check. No bucket has a cap: Spark's adaptive
    execution splits the partition of a large one.
    """
    keyed = prints.select("fingerprint", F.inline(keys(F.col("fingerprint"))))
    x, y = keyed.alias("x"), keyed.alias("y")
    d = F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))
    turned = [_rotated(d, s) for s in range(SEGMENTS)]
    first = F.coalesce(*[F.when(_within(t), s) for s, t in enumerate(turned)])
    start = F.col("x.start")
    own = F.coalesce(*[F.when(start == s, t) for s, t in enumerate(turned)])
    pick = F.coalesce(
        *[
            F.when((_segment(own, a) == 0) & (_segment(own, b) == 0), number)
            for number, (a, b) in enumerate(PICKS)
        ]
    )
    together = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.fingerprint") < F.col("y.fingerprint"))
        & _within(own)
        & (F.bit_count(d) <= DISTANCE)
        & (first == start)
        & (pick == F.col("x.pick"))
    )
    return x.join(y, together).select(
        F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b")
    )


def _groups(
    docs: DataFrame, id_column: str, text_column: str, words: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and fingerprints with their component and least id."""
    prints = stored(
        fingerprints(docs, id_column=id_column, text_column=text_column, words=words)
    )
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct))
    reached = distinct.join(joined, distinct["fingerprint"] == joined["node"], "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least"
    )
    heads = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, stored(reached.select("fingerprint", "component").join(heads, "component"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of ``docs``.

    Documents are linked where their fingerprints differ in at most 3 bits; component_id is
    the smallest doc_id that links reach, the row's own included. Links are looked for between
    distinct fingerprints only, so copies never form pairs. Null and wordless texts have
    fingerprint 0 and are linked like any other; a null id never names a component (a component
    of null ids has a null component_id); repeated rows appear as often as they occur; ties
    cannot arise; an empty table gives an empty result; other columns are ignored.
    """
    prints, heads = _groups(docs, id_column, text_column, words)
    return prints.join(heads, "fingerprint").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
) -> DataFrame:
    """One row of every component of ``near_duplicates``, all columns kept.

    The row with the smallest id stays, null ids last; of rows that share it the one whose
    text has the smallest hash, and of rows equal in both any one. Null, empty and wordless
    texts are one component; texts of any length are read whole; an empty table gives an empty
    result; other columns keep their names and values.
    """
    prints, heads = _groups(docs, id_column, text_column, words)
    rows = prints.join(heads.select("fingerprint", "component"), "fingerprint")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    counted = stored(rows.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = counted.groupBy("component").agg(F.min(order).alias("first"))
    first = first.select("component", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h"))
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    gone_id, gone_hash = free_name(docs, "gone_id"), free_name(docs, "gone_hash")
    gone = stored(
        counted.join(first, "component").where(~stays).select(
            F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)
        )
    )
    own, text_hash = named(id_column).cast("long"), F.xxhash64(named(text_column))
    kept = without(docs, gone, own.eqNullSafe(gone[gone_id]) & (text_hash == gone[gone_hash]))
    twice = stored(
        counted.where("n > 1").select(
            F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)
        )
    )
    if twice.isEmpty():
        return kept
    same = own.eqNullSafe(twice[gone_id]) & (text_hash == twice[gone_hash])
    mark = free_name(docs, "hash")
    marked = kept.join(twice, same, "left_semi").withColumn(mark, text_hash)
    return without(kept, twice, same).unionByName(
        marked.dropDuplicates([id_column, mark]).drop(mark)
    )
