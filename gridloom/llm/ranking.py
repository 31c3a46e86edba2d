"""Ranked lexical search of many items at once, sharing partial scores among them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import slices, stored

# A term is a run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) pairs that one pass over the documents serves.
BLOCK_PAIRS = 200_000
#: Bytes of partial scores that a task holds at a time.
HELD_BYTES = 32_000_000
#: Shared sets are mined among so many of the commonest terms; others are added one by one.
MINED = 3_000
BUCKETS = 64


def _spelling() -> np.ndarray:
    """For every byte what it reads as: small letters, a blank for what is in no term."""
    table = np.arange(256, dtype=np.uint8)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[low : high + 1] = 0x20
    table[0x41:0x5B] += 0x20
    return table


SPELLING = _spelling()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in order, and the offsets of the texts; null has none."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    spelled = pa.StringArray.from_buffers(
        len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(SPELLING[held].tobytes())
    )
    lists = pc.ascii_split_whitespace(spelled)
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    terms = lists.flatten()
    # Blanks at either end of a text leave an empty term.
    kept = pc.greater(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)
    return terms.filter(pa.array(kept)), np.concatenate([[0], np.cumsum(kept)])[ends]


def wanted(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Distinct (item_id, term) pairs of all items; rows that share an id are one item."""
    small = F.translate(named(text_column), CAPITALS, SMALL)
    terms = F.regexp_extract_all(small, F.lit(f"({TERM})"))
    return items.select(
        named(id_column).cast("long").alias("item_id"), F.explode(terms).alias("term")
    ).distinct()


STAT = "met_term array<int>, met_in array<long>, docs long, words long"
COUNTED = f"doc_id long, size long, terms binary, counts binary, {STAT}"


def _counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Size of every document and how often it holds each term of ``vocabulary``.

    Documents without any such term are left out. Every task adds one row (``docs`` not null)
    with the numbers of its documents and words and, for each term, of its documents with it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shared.value, pa.string())
        met, held, words = np.zeros(len(asked), np.int64), 0, 0
        for batch in slices(batches, "text"):
            terms, ends = terms_of(batch.column("text"))
            sizes = np.diff(ends)
            held, words = held + int((sizes > 0).sum()), words + len(terms)
            place = pc.fill_null(pc.index_in(terms, value_set=asked), -1).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)[place >= 0]
            keys, times = np.unique(row * len(asked) + place[place >= 0], return_counts=True)
            row, term = np.divmod(keys, max(1, len(asked)))
            met += np.bincount(term, minlength=len(asked))
            rows, first = np.unique(row, return_index=True)
            if not len(rows):
                continue
            ends = np.append(first, len(keys))[1:]
            term, times = term.astype("<i4"), times.astype("<i4")
            columns = [
                batch.column("doc_id").take(pa.array(rows)), pa.array(sizes[rows]),
                pa.array([term[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                pa.array([times[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                pa.nulls(len(rows), pa.list_(pa.int32())), pa.nulls(len(rows), pa.list_(pa.int64())),
                pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
        some = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([met[some]], pa.list_(pa.int64())),
                pa.array([held], pa.int64()), pa.array([words], pa.int64()),
            ],
            names,
        )

    return docs.mapInArrow(run, COUNTED)


@dataclass
class Sharing:
    """How the items' scores are put together from partial sums.

    Leaves are groups of terms that the same items hold; ``leaf`` names each term's. Level after
    level, further nodes are the sums of two earlier ones (``left``, ``right``). An item's score
    is the sum of ``nodes[starts[i]:starts[i + 1]]``.
    """

    leaf: np.ndarray
    leaves: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    nodes: np.ndarray
    starts: np.ndarray

    @property
    def size(self) -> int:
        return self.leaves + sum(len(x) for x, _ in self.levels)

    @property
    def additions(self) -> int:
        """Sums per document once the leaves are there."""
        return self.size - self.leaves + int(np.maximum(np.diff(self.starts) - 1, 0).sum())


def share(items: list[np.ndarray], terms: int) -> Sharing:
    """Mines the term sets that items share and orders them as a graph of sums.

    Terms that occur in the same items become one leaf. Then, level by level, of all pairs of
    nodes that two or more items hold, the commonest is taken as a new node in place of both,
    then the next whose nodes are still free, until no pair is shared. Every shared set is so
    summed once, whatever number of items or larger sets hold it.
    """
    holders: list[list[int]] = [[] for _ in range(terms)]
    for i, held in enumerate(items):
        for t in held:
            holders[t].append(i)
    groups: dict[tuple[int, ...], int] = {}
    leaf = np.array([groups.setdefault(tuple(h), len(groups)) for h in holders], np.int64)
    nodes: list[set[int]] = [set(leaf[held].tolist()) for held in items]
    total, levels = len(groups), []
    while True:
        often: dict[int, int] = {}
        for held in nodes:
            for x in held:
                often[x] = often.get(x, 0) + 1
        common = sorted((x for x, n in often.items() if n > 1), key=lambda x: (-often[x], x))[:MINED]
        place = {x: p for p, x in enumerate(common)}
        grid = np.zeros((len(items), len(common)), np.float32)
        for i, held in enumerate(nodes):
            grid[i, [place[x] for x in held if x in place]] = 1
        together = np.triu(grid.T @ grid, 1)
        a, b = np.nonzero(together >= 2)
        order = np.lexsort((b, a, -together[a, b]))
        free, left, right = np.ones(len(common), bool), [], []
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if free[x] and free[y]:
                free[x] = free[y] = False
                left.append(common[x])
                right.append(common[y])
        if not left:
            break
        for z, (x, y) in enumerate(zip(left, right), total):
            for held in nodes:
                if x in held and y in held:
                    held -= {x, y}
                    held.add(z)
        levels.append((np.array(left), np.array(right)))
        total += len(left)
    ends = np.cumsum([0, *map(len, nodes)])
    ordered = np.array([x for held in nodes for x in sorted(held)], np.int64)
    return Sharing(leaf, len(groups), levels, ordered, ends)


def scores(sharing: Sharing, parts: np.ndarray) -> np.ndarray:
    """Scores (items x documents); ``parts`` has the leaves' sums, and room for all nodes."""
    at = sharing.leaves
    for left, right in sharing.levels:
        parts[at : at + len(left)] = parts[left] + parts[right]
        at += len(left)
    out = np.zeros((len(sharing.starts) - 1, parts.shape[1]), np.int64)
    for i, (a, b) in enumerate(zip(sharing.starts[:-1], sharing.starts[1:])):
        for x in sharing.nodes[a:b]:
            out[i] += parts[x]
    return out


class _Best:
    """The best rows of every item that a task has met."""

    def __init__(self, items: int, most: int) -> None:
        self.most, self.floor = most, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        self.waiting: list[list[np.ndarray]] = []

    def add(self, found: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """``found`` has a score for each item and document."""
        item, doc = np.nonzero(found >= self.floor[:, None])
        self.waiting.append([item, found[item, doc], ids[doc], unnamed[doc]])
        if sum(len(w[0]) for w in self.waiting) > 4 * self.most * len(self.floor):
            self.settle()

    def settle(self) -> None:
        item, score, ids, unnamed = (np.concatenate(c) for c in zip(self.held, *self.waiting))
        order = np.lexsort((ids, unnamed, -score, item))
        item, score, ids, unnamed = item[order], score[order], ids[order], unnamed[order]
        first = np.searchsorted(item, np.arange(len(self.floor)))
        rank = np.arange(len(item)) - first[item]
        last = np.flatnonzero(rank == self.most - 1)
        self.floor[item[last]] = score[last]
        kept = rank < self.most
        self.held, self.waiting = [item[kept], score[kept], ids[kept], unnamed[kept]], []


def _ranked(
    counted: DataFrame, item_ids: list, weights: np.ndarray, sharing: Sharing, docs: int, words: int, most: int
) -> DataFrame:
    """The best documents of every item among each task's: item_id, doc_id, score."""
    shared = counted.sparkSession.sparkContext.broadcast((item_ids, weights, vars(sharing)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, weights, held = shared.value
        sharing = Sharing(**held)
        best = _Best(len(item_ids), most)
        width = max(16, HELD_BYTES // 8 // max(1, sharing.size + len(item_ids)))
        for whole in batches:
            for at in range(0, whole.num_rows, width):
                batch = whole.slice(at, width)
                n = batch.num_rows
                lists = batch.column("terms").to_pylist()
                row = np.repeat(np.arange(n), [len(x) // 4 for x in lists])
                term = np.frombuffer(b"".join(lists), "<i4").astype(np.int64)
                tf = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4").astype(np.int64)
                size = batch.column("size").to_numpy().astype(np.int64)
                norm = 100 - 50 + 50 * size * docs // words
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * norm[row]))
                parts = np.zeros((sharing.size, n), np.int64)
                np.add.at(parts, (sharing.leaf[term], row), part)
                ids = batch.column("doc_id")
                best.add(
                    scores(sharing, parts),
                    pc.fill_null(ids, 0).to_numpy(zero_copy_only=False),
                    ids.is_null().to_numpy(zero_copy_only=False),
                )
        best.settle()
        item, score, ids, unnamed = best.held
        names = pa.array(item_ids, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(ids, pa.int64(), mask=unnamed), pa.array(score)], ["item_id", "doc_id", "score"]
        )

    read = counted.where("docs is null").select("doc_id", "size", "terms", "counts")
    return read.mapInArrow(run, "item_id long, doc_id long, score long")


def rank(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    most: int = 50,
) -> DataFrame:
    """The ``most`` best documents of every item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in small letters.
    A document scores, for each distinct term of the item, the term's weight times its damped
    frequency, all in whole numbers. Items are taken in blocks of about ``BLOCK_PAIRS`` (item,
    term) pairs, so what the driver and tasks hold of them is bounded, but for an item that
    alone has more. For a block, one pass counts its terms in all documents and writes the
    counts to the shared folder; ``share`` mines the term sets that its items share; a second
    pass over the counts sums, for some documents at a time, every shared set once and the
    items from them. Each task hands on its best rows only, ranked in two steps.

    Rows that share an item_id are one item; an item without a term (null or empty text) and a
    document that shares no weighted term have no rows; null ids come last among equal scores;
    repeated rows are ranked each; texts of any length are read whole; an empty table of either
    kind gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pairs = stored(wanted(items, item_id_column, item_text_column))
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    texts = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    found = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        asked: dict = {}
        for item, term in pairs.where(mine).collect():
            asked.setdefault(item, []).append(term)
        vocabulary = sorted({t for held in asked.values() for t in held})
        counted = stored(_counted(texts, vocabulary))
        stats = counted.where("docs is not null")
        whole = stats.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        if not whole["docs"] or not asked:
            continue
        each = F.explode(F.arrays_zip("met_term", "met_in")).alias("m")
        met = stats.select(each).groupBy("m.met_term").agg(F.sum("m.met_in").alias("n")).collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in met:
            weights[r["met_term"]] = math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * r["n"] + 1)))
        code = {t: c for c, t in enumerate(vocabulary)}
        item_ids = sorted(asked, key=lambda i: (i is None, i))
        sharing = share([np.array([code[t] for t in asked[i]]) for i in item_ids], len(vocabulary))
        part = _ranked(counted, item_ids, weights, sharing, whole["docs"], whole["words"], most)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    near = Window.partitionBy("item_id", bucket).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most)
    last = Window.partitionBy("item_id").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= most)
    return found.select("item_id", "rank", "doc_id", "score")
