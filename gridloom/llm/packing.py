"""Cost-balanced packing of documents into token sequences."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import slices

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long,"
    " offset long"
)
CACHED_WORDS = 500_000
# Words whose ids are put together at a time: those arrays are a task's largest.
JOINED_WORDS = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts, encoding each distinct word once.

    For BPE tokenizers that lower-case, drop white space and keep a run of letters as one
    piece: the texts are cut at ASCII white space. Words of Latin-1 letters, with or without
    one mark after them, need neither normalising nor cutting beyond that, so the library's
    model gets them at once; any other word goes through the library's whole chain.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {
            ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"
        }
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.pool, self.firsts, self.sizes = array("I"), array("q", [0]), array("q", [0])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(self.firsts)
        self.firsts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool.extend(ids)

    def _learn(self, plain: list[str], other: list[str]) -> None:
        for word in plain:
            if word not in self.known:
                spelled = word if word.isascii() else word.translate(self.letters)
                self._keep(word, [t.id for t in self.tokenizer.model.tokenize(spelled)])
        new = [w for w in other if w not in self.known]
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            for word, encoding in zip(part, found):
                self._keep(word, encoding.ids)

    def _codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of each word's two parts in ``firsts`` and ``sizes``."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        parts = pc.extract_regex(words, "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,!?;:]?)$")
        plain = pc.is_valid(parts)
        head = pc.utf8_lower(pc.struct_field(parts, 0))
        head = pc.if_else(plain, head, words).dictionary_encode()
        tail = pc.fill_null(pc.struct_field(parts, 1), "").dictionary_encode()
        rest = pc.unique(words.filter(pc.invert(plain))).to_pylist()
        other = set(rest)
        heads, tails = head.dictionary.to_pylist(), tail.dictionary.to_pylist()
        self._learn([w for w in heads if w not in other] + [t for t in tails if t], rest)
        return tuple(
            np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[
                coded.indices.to_numpy(zero_copy_only=False)
            ]
            for names, coded in ((heads, head), (tails, tail))
        )

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs of texts, each text followed by ``end_id``, and the offsets of its texts.

        Words are looked up for all texts together; a run has about ``JOINED_WORDS`` words and
        one text at least.
        """
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        heads, tails = self._codes(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = words.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        at = 0
        while at < len(texts):
            beyond = np.searchsorted(ends, ends[at] + JOINED_WORDS, side="right")
            stop = max(at + 1, int(beyond) - 1)
            run = ends[at : stop + 1]
            yield self._joined(heads, tails, codes[run[0] : run[-1]], run - run[0], end_id)
            at = stop

    def _joined(
        self, heads: np.ndarray, tails: np.ndarray, codes: np.ndarray, ends: np.ndarray, end_id: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as word codes and their offsets."""
        pool = np.frombuffer(self.pool, np.uint32)
        firsts, sizes = np.frombuffer(self.firsts, np.int64), np.frombuffer(self.sizes, np.int64)
        parts = np.empty(2 * len(codes), np.int64)
        parts[0::2], parts[1::2] = heads[codes], tails[codes]
        each = sizes[parts]
        total = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(firsts[parts] - total[:-1], each) + np.arange(total[-1])
        bounds = total[2 * ends]
        return np.insert(pool[source], bounds[1:], end_id), bounds + np.arange(len(bounds))


def place(
    sizes: np.ndarray, sequences: int, limit: int, linear: float, quadratic: float
) -> list[tuple[int, int, int, int, int]]:
    """Places pieces in ``sequences`` sequences of ``limit`` tokens and fills all of them.

    Pieces go, largest first, to the sequence of lowest cost (``linear * n + quadratic * n * n``
    summed over its pieces) that has room. A piece that fits nowhere whole is cut to fill the
    cheapest sequences that still have room. Returns (piece, first token, tokens, sequence,
    offset); sequence -1 is what remains beyond the room of all sequences.
    """
    cost, room = np.zeros(sequences), np.full(sequences, limit, np.int64)
    out, waiting = [], []

    def put(piece: int, first: int, n: int, to: int) -> None:
        out.append((piece, first, n, to, limit - int(room[to])))
        room[to] -= n
        cost[to] += linear * n + quadratic * n * n

    for piece in np.argsort(-sizes, kind="stable"):
        n = int(sizes[piece])
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(int(piece), 0, n, int(fits[np.argmin(cost[fits])]))
        else:
            waiting.append((int(piece), 0, n))
    for piece, first, n in waiting:
        while n:
            free = np.flatnonzero(room)
            if not len(free):
                out.append((piece, first, n, -1, 0))
                break
            to = int(free[np.argmin(cost[free])])
            taken = min(n, int(room[to]))
            put(piece, first, taken, to)
            first, n = first + taken, n - taken
    return out


class _Packer:
    """Packs the documents of one task block by block."""

    def __init__(self, limit: int, block: int, linear: float, quadratic: float, first: int) -> None:
        self.limit, self.block, self.linear, self.quadratic = limit, block, linear, quadratic
        self.next = first
        self.pieces: list[tuple[int | None, int, np.ndarray, int]] = []
        self.rows: list[tuple] = []
        self.held = 0

    def row(self, piece: tuple, first: int, n: int, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        data = ids[first : first + n].astype("<u4").tobytes()
        self.rows.append((doc, start + first, n, data, total, sequence, offset))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total = whole = len(ids)
        whole -= whole % self.limit
        for at in range(0, whole, self.limit):
            self.row((doc, 0, ids, total), at, self.limit, self.next, 0)
            self.next += 1
        if total > whole:
            self.pieces.append((doc, whole, ids[whole:].copy(), total))
            self.held += total - whole
        if self.held >= self.block * self.limit:
            self.settle()

    def settle(self) -> None:
        """Fills as many sequences as the held pieces have tokens for; the rest stays held."""
        n = self.held // self.limit
        sizes = np.array([len(p[2]) for p in self.pieces], np.int64)
        rest = []
        for piece, first, size, sequence, offset in place(
            sizes, n, self.limit, self.linear, self.quadratic
        ):
            if sequence >= 0:
                self.row(self.pieces[piece], first, size, self.next + sequence, offset)
            else:
                doc, start, ids, total = self.pieces[piece]
                rest.append((doc, start + first, ids[first:], total))
        self.next += n
        self.pieces, self.held = rest, sum(len(p[2]) for p in rest)

    def finish(self) -> None:
        """The last tokens, fewer than one sequence, go to sequences of powers of two."""
        self.settle()
        queue = self.pieces[::-1]
        for bit in reversed(range(self.limit.bit_length())):
            if not self.held >> bit & 1:
                continue
            offset, room = 0, 1 << bit
            while room:
                doc, start, ids, total = queue.pop()
                n = min(room, len(ids))
                self.row((doc, start, ids, total), 0, n, self.next, offset)
                if n < len(ids):
                    queue.append((doc, start + n, ids[n:], total))
                offset, room = offset + n, room - n
            self.next += 1


def pack(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | None = None,
    limit: int = 4096,
    end_id: int = 2,
    block: int = 256,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
) -> DataFrame:
    """Tokenises whole texts and packs them into sequences of at most ``limit`` tokens.

    Returns one row per piece: doc_id, start (tokens of the document before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with ``end_id``), sequence_id and offset (its
    place there). Every task packs its own documents, ``block`` sequences at a time, so memory
    is bounded by one block and one document, no row is shuffled and no key can be hot. All
    sequences are full but for the last tokens of a task, which fill sequences whose lengths
    are powers of two. Ids of sequences are unique: the task's number, then a count.

    A null text counts as empty and gives one piece with ``end_id``; null ids pass through;
    repeated rows are packed as often as they occur; ties in length keep the order of the
    input; an empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        packer = _Packer(limit, block, linear, quadratic, TaskContext.get().partitionId() << 36)
        for batch in slices(batches, "text"):
            docs = iter(batch.column("doc_id").to_pylist())
            for ids, bounds in encoder.encode(batch.column("text"), end_id):
                for first, after in zip(bounds[:-1], bounds[1:]):
                    packer.add(next(docs), ids[first:after])
            if packer.rows:
                yield _batch(packer)
        packer.finish()
        if packer.rows:
            yield _batch(packer)

    chosen = docs.select(
        named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text")
    )
    return chosen.mapInArrow(run, SCHEMA)


def _batch(packer: _Packer) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = [pa.array(c, k) for c, k in zip(zip(*packer.rows), kinds)]
    packer.rows = []
    return pa.RecordBatch.from_arrays(columns, names)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
