"""Language-model scoring with an n-gram trie in Elias-Fano coded levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import new_folder, slices, words_of
from .eliasfano import dump, encoded, load, parse, sequence

DISCOUNT = 0.75
# Logarithms of probabilities down to 1e-12 in 256 steps.
STEPS, DEEPEST = 255, 12.0
END = xxhash.xxh64_intdigest(b"")
HELD_KEYS = 3_000_000
# Bytes of text at a time: words and pairs are looked up once for all their places in a slice.
SLICE = 8_000_000


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS / DEEPEST), 0, STEPS).astype(np.uint8)


def restore(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code.astype(np.float64) * DEEPEST / STEPS)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Vocabulary:
    """Level 1: the hashes of all words in order; a word's id is its place among them."""

    def __init__(self, shards: list[tuple[dict, dict]]) -> None:
        shards = sorted(shards, key=lambda s: s[1]["first"])
        self.firsts = np.array([f["first"] for _, f in shards], np.uint64)
        self.words = [sequence(parts, "words") for parts, _ in shards]
        self.counts = [sequence(parts, "counts") for parts, _ in shards]
        sizes = [len(w) for w in self.words]
        totals = [f["total"] for _, f in shards]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
        self.size, self.tokens = int(self.offsets[-1]), int(self.before[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), counts and the tokens of all words with smaller ids."""
        ids, counts, before = (np.zeros(len(hashes), np.int64) for _ in range(3))
        ids -= 1
        shard = np.searchsorted(self.firsts, hashes, side="right") - 1
        for k in np.unique(shard[shard >= 0]):
            at = np.flatnonzero(shard == k)
            place = self.words[k].successor(hashes[at])
            inside = np.flatnonzero(place < len(self.words[k]))
            inside = inside[self.words[k].get(place[inside]) == hashes[at[inside]]]
            at, place = at[inside], place[inside]
            ids[at] = self.offsets[k] + place
            low = self.counts[k].get(place).astype(np.int64)
            counts[at] = self.counts[k].get(place + 1).astype(np.int64) - low
            before[at] = self.before[k] + low
        return ids, counts, before

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.offsets, ids, side="right") - 1
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            place = ids[at] - self.offsets[k]
            ends = self.counts[k].get(np.concatenate([place, place + 1])).astype(np.int64)
            out[at] = ends[len(place) :] - ends[: len(place)]
        return out


class Level:
    """A level below the first: children of nodes, found by node and child.

    Of every shard, which covers a run of the keys in order: pointers from the nodes between
    its first and last to their children, the children made monotone by adding the last value
    of the node before, cumulative counts at every child, and a code for the discounted
    probability of every child. A node with many children may go through several shards.
    """

    def __init__(self, shards: list[tuple[dict, dict]]) -> None:
        shards = sorted(shards, key=lambda s: s[1]["first_key"])
        self.facts = [f for _, f in shards]
        self.pointers = [sequence(p, "pointers") for p, _ in shards]
        self.children = [sequence(p, "children") for p, _ in shards]
        self.counts = [sequence(p, "counts") for p, _ in shards]
        self.codes = [p["codes"] for p, _ in shards]
        sizes, totals = [f["n"] for f in self.facts], [f["total"] for f in self.facts]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
        self.size, self.total = int(self.offsets[-1]), int(self.before[-1])

    def totals(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending nodes: number of children, sum of their counts, place of the first."""
        n, total = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        first = np.full(len(nodes), -1, np.int64)
        for k, facts in enumerate(self.facts):
            a, b = np.searchsorted(nodes, [facts["low"], facts["high"] + 1])
            if a == b:
                continue
            node = nodes[a:b] - facts["low"]
            ends = self.pointers[k].get(np.concatenate([node, node + 1])).astype(np.int64)
            start, end = ends[: b - a], ends[b - a :]
            sums = self.counts[k].get(np.concatenate([start, end])).astype(np.int64)
            n[a:b] += end - start
            total[a:b] += sums[b - a :] - sums[: b - a]
            new = np.flatnonzero((first[a:b] < 0) & (end > start))
            first[a + new] = self.offsets[k] + start[new]
        return n, total, first

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For ascending keys, ``node << 32 | child``: place of the child, -1 if there is none."""
        out = np.full(len(keys), -1, np.int64)
        for k, facts in enumerate(self.facts):
            a, b = np.searchsorted(keys, np.array([facts["first_key"], facts["last_key"]], np.uint64))
            b += int(b < len(keys) and int(keys[b]) == facts["last_key"])
            if a >= b:
                continue
            node = (keys[a:b] >> np.uint64(32)).astype(np.int64) - facts["low"]
            child = keys[a:b] & np.uint64(0xFFFFFFFF)
            ends = self.pointers[k].get(np.concatenate([node, node + 1])).astype(np.int64)
            start, end = ends[: b - a], ends[b - a :]
            some = np.flatnonzero(end > start)
            start, end, child = start[some], end[some], child[some]
            base = np.zeros(len(some), np.uint64)
            later = np.flatnonzero(start > 0)
            base[later] = self.children[k].get(start[later] - 1)
            wanted = base + child + np.uint64(1)
            place = self.children[k].successor(wanted)
            hit = np.flatnonzero(place < end)
            hit = hit[self.children[k].get(place[hit]) == wanted[hit]]
            out[a + some[hit]] = self.offsets[k] + place[hit]
        return out

    def shares(self, places: np.ndarray) -> np.ndarray:
        """Discounted probabilities at ascending places."""
        cuts = np.searchsorted(places, self.offsets)
        parts = [
            restore(self.codes[k][places[cuts[k] : cuts[k + 1]] - self.offsets[k]])
            for k in range(len(self.facts))
        ]
        return np.concatenate([np.zeros(0), *parts])

    def values(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and the counts of all before, at ascending places."""
        counts, before = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        cuts = np.searchsorted(places, self.offsets)
        for k in range(len(self.facts)):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                at = places[a:b] - self.offsets[k]
                sums = self.counts[k].get(np.concatenate([at, at + 1])).astype(np.int64)
                counts[a:b] = sums[b - a :] - sums[: b - a]
                before[a:b] = self.before[k] + sums[: b - a]
        return counts, before


def level_shard(keys: np.ndarray, counts: np.ndarray, held_by: np.ndarray, facts: dict) -> bytes:
    """Encodes a run of ascending keys; ``held_by`` is the count of each key's node."""
    node = (keys >> np.uint64(32)).astype(np.int64)
    child = (keys & np.uint64(0xFFFFFFFF)) + np.uint64(1)
    low, high = int(node[0]), int(node[-1])
    pointers = np.searchsorted(node, np.arange(low, high + 2))
    ends = np.flatnonzero(np.concatenate([node[1:] != node[:-1], [True]]))
    lasts = np.cumsum(child[ends])
    step = np.zeros(len(ends), np.uint64)
    step[1:] = lasts[:-1]
    children = child + np.repeat(step, np.diff(np.concatenate([[-1], ends])))
    parts = {
        **encoded("pointers", pointers),
        **encoded("children", children),
        **encoded("counts", np.concatenate([[0], np.cumsum(counts)])),
        "codes": quantise((counts - DISCOUNT) / held_by),
    }
    facts = facts | {
        "low": low, "high": high, "first_key": int(keys[0]), "last_key": int(keys[-1]),
        "n": len(keys), "total": int(counts.sum()),
    }
    return dump(parts, facts)


class Trie:
    """The levels that are there, read from the files named."""

    def __init__(self, files: list[str]) -> None:
        # Statistics in a file's pages repeat a small value whole; a shard counts once.
        shards: dict[int, dict[int, tuple]] = {1: {}, 2: {}, 3: {}}
        for name in files:
            for parts, facts in load(SparkFiles.get(name)):
                first = facts["first"] if facts["level"] == 1 else facts["first_key"]
                shards[facts["level"]][first] = (parts, facts)
        words, pairs, triples = (list(shards[level].values()) for level in (1, 2, 3))
        self.words, self.pairs, self.triples = Vocabulary(words), Level(pairs), Level(triples)


@dataclass
class Tokens:
    """The tokens of a slice: every document's words between two end marks."""

    offsets: np.ndarray  # of the documents, in ``code``
    code: np.ndarray  # index into the arrays below
    ids: np.ndarray
    counts: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, words: Vocabulary) -> Tokens:
        known, codes, offsets = words_of(batch, "text")
        hashes = np.array([*map(xxhash.xxh64_intdigest, known), END], np.uint64)
        docs = np.arange(len(offsets) - 1)
        marks = np.concatenate([offsets[:-1], offsets[1:]])
        order = np.concatenate([2 * docs, 2 * docs + 1]).argsort()
        code = np.insert(codes.astype(np.int32), marks[order], len(known))
        return cls(offsets + 2 * np.arange(len(offsets)), code, *words.find(hashes))

    def pairs(self, level: Level) -> Pairs:
        """For every place but a document's first, the pair of the token before and it."""
        last = np.ones(len(self.code), bool)
        last[self.offsets[:-1]] = False
        at = np.flatnonzero(last)
        a, b = self.ids[self.code[at - 1]], self.ids[self.code[at]]
        known = (a >= 0) & (b >= 0)
        keys = a[known].astype(np.uint64) << np.uint64(32) | b[known].astype(np.uint64)
        unique, inverse = np.unique(keys, return_inverse=True)
        found = level.find(unique)
        place = np.full(len(self.code), -1, np.int64)
        place[at[known]] = found[inverse]
        return Pairs(at, place)


@dataclass
class Pairs:
    at: np.ndarray  # places that have a token before them
    place: np.ndarray  # by place of a token: its pair's place in the level, or -1

    def triples(self, tokens: Tokens, level: Level) -> tuple[np.ndarray, np.ndarray]:
        """Places whose pair and the pair before are known, and their keys in the next level.

        A triple's last word is not named by its id but by its rank among the words that
        follow its middle word: a small number, which takes few bits.
        """
        at = self.at[self.place[self.at] >= 0]
        at = at[(self.place[at - 1] >= 0)]
        middle = tokens.ids[tokens.code[at - 1]]
        nodes, inverse = np.unique(middle, return_inverse=True)
        first = level.totals(nodes)[2][inverse]
        rank = (self.place[at] - first).astype(np.uint64)
        return at, self.place[at - 1].astype(np.uint64) << np.uint64(32) | rank


Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def _gathered(docs: DataFrame, make: Callable[[], Keys], schema_of: Callable) -> DataFrame:
    """Counts keys over all documents and hands runs of keys, in order, to ``schema_of``.

    ``make()`` gives, in a task, a function from a batch to keys and their buckets, which must
    not fall as keys rise. A task counts its own keys first and sends them coded; no bucket
    gets more from a task than the distinct keys it has there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = make()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([h[0] for h in held])
            order = np.argsort(keys)
            keys = keys[order]
            counts = np.concatenate([h[1] for h in held])[order]
            buckets = np.concatenate([h[2] for h in held])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts, keys, buckets = np.add.reduceat(counts, first), keys[first], buckets[first]
            held.clear()
            cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
                data = dump(
                    {**encoded("keys", keys[a:b]), **encoded("sums", np.cumsum(counts[a:b]))}, {}
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(buckets[a])]), pa.array([data], pa.binary())], ["bucket", "data"]
                )

        for batch in slices(batches, "text", SLICE):
            keys, buckets = keys_of(batch)
            if len(keys):
                # Equal keys have equal buckets, so any of them tells the bucket.
                order = np.argsort(keys)
                keys = keys[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                held.append((keys[first], np.diff(np.append(first, len(keys))), buckets[order[first]]))
            if sum(len(h[0]) for h in held) > HELD_KEYS:
                yield from flush()
        if held:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        parts = [parse(x)[0][0] for x in table.column("data").to_pylist()]
        keys = np.concatenate([sequence(p, "keys").all() for p in parts])
        counts = [np.diff(sequence(p, "sums").all().astype(np.int64), prepend=0) for p in parts]
        return schema_of(*merged(keys, np.concatenate(counts)))

    return (
        docs.mapInArrow(count, "bucket long, data binary")
        .groupBy("bucket")
        .applyInArrow(merge, "first decimal(20,0), n long, total long, data binary")
    )


def _row(first: int, n: int, total: int, data: bytes | None) -> pa.Table:
    from decimal import Decimal

    rows = [] if data is None else [(Decimal(first), n, total, data)]
    kinds = [pa.decimal128(20, 0), pa.int64(), pa.int64(), pa.binary()]
    return pa.table(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
        names=["first", "n", "total", "data"],
    )


def _distributed(spark: SparkSession, level: DataFrame) -> tuple[list[str], int, int]:
    """Writes a level's shards as they are to be mapped and gives every executor the files.

    Parquet without compression keeps a binary value in one piece, so the file itself is
    mapped. Returns the files' names, the keys and the sum of their counts.
    """
    folder = new_folder(spark, "trie")
    level.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(
        folder
    )
    written = spark.read.schema(level.schema).parquet(folder)
    facts = written.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    names = []
    for path in written.inputFiles():
        spark.sparkContext.addFile(path)
        names.append(path.rsplit("/", 1)[1])
    return names, int(facts["n"] or 0), int(facts["total"] or 0)


@dataclass
class Model:
    files: list[str]
    tokens: int
    words: int


def train(
    docs: DataFrame,
    *,
    text_column: str = "text",
    cutoffs: tuple[int, int] = (2, 2),
    tokens_per_shard: int = 4_000_000,
) -> Model:
    """Counts all words, pairs and triples of ``docs`` and builds the trie.

    Words are A-Z lower-cased runs between ASCII white space; each text ends with one end
    mark, which is also what its first word follows. All words are kept; pairs and triples
    are kept from their ``cutoffs`` on (a triple is only counted where both its pairs were
    kept, which loses none). Words are told apart by a 64-bit hash.

    Each level is one pass over the texts and one shuffle. Tasks send what they counted in runs
    of keys of about ``tokens_per_shard`` tokens, placed by the counts of the level above, so a
    frequent word or pair is spread over as many runs as it needs; each run is merged and
    encoded by one task as one shard. Executors get the files through Spark and map them.
    """
    spark = docs.sparkSession
    texts = docs.select(named(text_column).alias("text"))
    runs = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    least_pair, least_triple = cutoffs

    def word_keys() -> Keys:
        def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            known, codes, offsets = words_of(batch, "text")
            hashes = np.array([*map(xxhash.xxh64_intdigest, known), END], np.uint64)
            found = hashes[np.concatenate([codes, np.full(len(offsets) - 1, len(known))])]
            return found, ((found >> np.uint64(32)) * np.uint64(runs) >> np.uint64(32)).astype(np.int64)

        return keys

    def word_shard(keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        total = int(counts.sum())
        parts = {
            **encoded("words", keys),
            **encoded("counts", np.concatenate([[0], np.cumsum(counts)])),
        }
        data = dump(parts, {"level": 1, "first": int(keys[0]), "total": total})
        return _row(int(keys[0]), len(keys), total, data)

    files, words, tokens = _distributed(spark, _gathered(texts, word_keys, word_shard))
    model = Model(files, tokens, words)
    if not words:
        return model
    if words >= 1 << 32:
        raise ValueError("more than 2**32 distinct words do not fit the keys of this trie")
    shards = -(-tokens // tokens_per_shard)

    def pair_keys() -> Keys:
        trie = Trie(files)

        def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            found = Tokens.of(batch, trie.words)
            at = np.ones(len(found.code), bool)
            at[found.offsets[:-1]] = False
            at = np.flatnonzero(at)
            a, b = found.code[at - 1], found.code[at]
            keys = found.ids[a].astype(np.uint64) << np.uint64(32) | found.ids[b].astype(np.uint64)
            share = found.before[a] + found.counts[a] * (found.ids[b] / words)
            return keys, (share * (shards / tokens)).astype(np.int64)

        return keys

    def pair_shard(keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        kept = counts >= least_pair
        keys, counts = keys[kept], counts[kept]
        if not len(keys):
            return _row(0, 0, 0, None)
        held_by = Trie(files).words.counts_of((keys >> np.uint64(32)).astype(np.int64))
        data = level_shard(keys, counts, held_by, {"level": 2})
        return _row(int(keys[0]), len(keys), int(counts.sum()), data)

    more, pairs, total = _distributed(spark, _gathered(texts, pair_keys, pair_shard))
    files = [*files, *more]
    model.files = files
    if not pairs:
        return model
    if pairs >= 1 << 32:
        raise ValueError("more than 2**32 pairs do not fit the keys of this trie")
    shards = -(-total // tokens_per_shard)

    def triple_keys() -> Keys:
        trie = Trie(files)

        def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            found = Tokens.of(batch, trie.words)
            at, keys = found.pairs(trie.pairs).triples(found, trie.pairs)
            nodes, inverse = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
            counts, before = trie.pairs.values(nodes)
            middle, which = np.unique(found.ids[found.code[at - 1]], return_inverse=True)
            ranks = np.maximum(trie.pairs.totals(middle)[0], 1)[which]
            share = (keys & np.uint64(0xFFFFFFFF)).astype(np.float64) / ranks
            place = before[inverse] + counts[inverse] * share
            return keys, (place * (shards / total)).astype(np.int64)

        return keys

    def triple_shard(keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        kept = counts >= least_triple
        keys, counts = keys[kept], counts[kept]
        if not len(keys):
            return _row(0, 0, 0, None)
        nodes, inverse = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
        held_by = Trie(files).pairs.values(nodes)[0][inverse]
        data = level_shard(keys, counts, held_by, {"level": 3})
        return _row(int(keys[0]), len(keys), int(counts.sum()), data)

    more, _, _ = _distributed(spark, _gathered(texts, triple_keys, triple_shard))
    model.files = [*files, *more]
    return model


def _left_over(n: np.ndarray, total: np.ndarray, held_by: np.ndarray) -> np.ndarray:
    """The share of a context's probability that its kept continuations leave to others."""
    return np.where(held_by > 0, 1 - (total - DISCOUNT * n) / np.maximum(held_by, 1), 1.0)


def log_probabilities(
    batch: pa.RecordBatch, trie: Trie, tokens: int, words: int
) -> tuple[np.ndarray, ...]:
    """Per document: tokens, known tokens, base score and score."""
    found = Tokens.of(batch, trie.words)
    pairs = found.pairs(trie.pairs)
    single = (found.counts + 1) / (tokens + words + 1)

    order = np.argsort(found.ids)
    n, total, _ = trie.pairs.totals(found.ids[order])
    left = np.ones(len(order))
    left[order] = _left_over(n, total, found.counts[order])

    at = pairs.at
    p = left[found.code[at - 1]] * single[found.code[at]]
    held = np.flatnonzero(pairs.place[at] >= 0)
    places, inverse = np.unique(pairs.place[at[held]], return_inverse=True)
    p[held] += trie.pairs.shares(places)[inverse]

    # Where the pair before is known, it is the context and the pair's probability fills up.
    inner = np.flatnonzero(pairs.place[at - 1] >= 0)
    nodes, inverse = np.unique(pairs.place[at[inner] - 1], return_inverse=True)
    n, total, _ = trie.triples.totals(nodes)
    p[inner] *= _left_over(n, total, trie.pairs.values(nodes)[0])[inverse]
    where, keys = pairs.triples(found, trie.pairs)
    unique, inverse = np.unique(keys, return_inverse=True)
    place = trie.triples.find(unique)
    hit = np.flatnonzero(place >= 0)
    share = np.zeros(len(unique))
    share[hit] = trie.triples.shares(place[hit])
    p[np.searchsorted(at, where)] += share[inverse]

    row = np.searchsorted(found.offsets, at, side="right") - 1
    rows = batch.num_rows
    return (
        np.bincount(row, minlength=rows),
        np.bincount(row, found.counts[found.code[at]] > 0, rows).astype(np.int64),
        np.bincount(row, np.log10(single[found.code[at]]), rows),
        np.bincount(row, np.log10(np.minimum(p, 1.0)), rows),
    )


def score(
    docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Scores whole texts: doc_id, n_tokens, n_known, base_score and score.

    ``base_score`` adds the base-10 logarithms of ``(c + 1) / (N + V + 1)`` over a text's words
    and its end, ``c`` being the token's count, ``N`` the training tokens and ``V`` the distinct
    ones. ``score`` is the trie's: each token's discounted share in its context of two, plus
    what that context leaves times the same for a context of one, and so on down to the base.

    A null text reads as empty (its end alone); null ids pass through; repeated rows are scored
    each; without training texts every score is 0; an empty table gives an empty result; other
    columns are ignored.
    """
    files, tokens, words = model.files, model.tokens, model.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(files)
        for batch in slices(batches, "text", SLICE):
            found = log_probabilities(batch, trie, tokens, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, found)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    chosen = docs.select(
        named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text")
    )
    return chosen.mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
