"""Token counts of whole texts, most words counted without merging."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import slices

# The mark that a sentencepiece vocabulary writes for a blank.
BLANK = "▁"
CACHED_WORDS = 300_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass
class Shortcut:
    """What is proved of a model before any text is read.

    Merges only ever build pieces of the vocabulary. If no piece has a blank after another
    character, no merge joins a blank to what stands before it; if no piece holds a line
    break, none crosses one. Then a text may be cut before every run of blanks and around
    every line break, and its count is the sum over the parts.
    """

    #: Whether texts may be cut so; if not, the library gets them whole.
    cuts: bool
    #: Tokens of a line break.
    line_break: int
    #: Words that are one token after a blank, and words that are one token without.
    after_blank: list[str]
    bare: list[str]


def _parts(model, parts: list[str]) -> list[int]:
    """Tokens of parts of a text, each read behind a line break, which no merge crosses."""
    before = len(model.encode("\n"))
    return [len(ids) - before for ids in model.encode([f"\n{p}" for p in parts], num_threads=1)]


def prove(path: str) -> Shortcut:
    """Reads a model's rules and vocabulary, and encodes every piece that may stand alone."""
    from sentencepiece import sentencepiece_model_pb2

    model, spec = processor(path), sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    rules, kind = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    pieces = [p.piece for p in spec.pieces if p.type == kind.NORMAL]
    usual = {kind.NORMAL, kind.CONTROL, kind.UNKNOWN, kind.BYTE}
    cuts = (
        not rules.precompiled_charsmap
        and rules.add_dummy_prefix
        and not rules.remove_extra_whitespaces
        and rules.escape_whitespaces
        and not spec.trainer_spec.treat_whitespace_as_suffix
        and spec.trainer_spec.model_type == spec.trainer_spec.BPE
        and all(p.type in usual for p in spec.pieces)
        and all(BLANK not in p[1:] or not p.strip(BLANK) for p in pieces)
        and not any("\n" in p for p in pieces)
    )
    if not cuts:
        return Shortcut(False, 0, [], [])
    words = [p[1:] for p in pieces if p[0] == BLANK and p.strip(BLANK)]
    bare = [p for p in pieces if BLANK not in p]
    blanked = zip(words, _parts(model, [f" {w}" for w in words]))
    return Shortcut(
        True,
        len(model.encode("a\n")) - len(model.encode("a")),
        [w for w, n in blanked if n == 1],
        [w for w, n in zip(bare, _parts(model, bare)) if n == 1],
    )


class Counter:
    """Counts the tokens of many texts; parts that need merges are kept by their text."""

    def __init__(self, path: str, shortcut: Shortcut) -> None:
        self.model, self.shortcut = processor(path), shortcut
        self.whole = {True: pa.array(shortcut.after_blank, pa.string()), False: pa.array(shortcut.bare, pa.string())}
        self.known: dict[str, int] = {}

    def _merged(self, parts: list[str]) -> np.ndarray:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, new = {}, parts
        self.known.update(zip(new, _parts(self.model, new)) if new else ())
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _words(self, known: pa.Array, codes: np.ndarray, blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, which stand after one blank or bare, and whether no merge was needed."""
        used = np.unique(codes)
        words = known.take(pa.array(used))
        direct = pc.is_valid(pc.index_in(words, value_set=self.whole[blank])).to_numpy(zero_copy_only=False)
        rest = words.filter(pa.array(~direct)).to_pylist()
        tokens = np.ones(len(known), np.int64)
        tokens[used[~direct]] = self._merged([f" {w}" for w in rest] if blank else rest)
        one = np.zeros(len(known), bool)
        one[used[direct]] = True
        return tokens[codes], one[codes]

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of every text, and how many of them were counted without merging."""
        texts = pc.fill_null(texts, "")
        if not self.shortcut.cuts:
            found = self.model.encode(texts.to_pylist(), num_threads=1)
            return np.array([len(ids) for ids in found], np.int64), np.zeros(len(texts), np.int64)
        lines = pc.split_pattern(pc.replace_substring(texts, BLANK, " "), "\n")
        line_ends = lines.offsets.to_numpy().astype(np.int64)
        line_ends -= line_ends[0]
        words = pc.split_pattern(lines.flatten(), " ")
        ends = words.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = coded.dictionary
        empty = pc.equal(pc.binary_length(known), 0).to_numpy(zero_copy_only=False)[codes]
        # A blank stands before every word but the first of a line; the library puts one before
        # every text that is not empty.
        blank = np.ones(len(codes), bool)
        blank[ends[:-1]] = False
        blank[ends[line_ends[:-1]]] = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        tokens, direct = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)

        # Runs of empty words are further blanks: of the word that follows in the line, or alone.
        line = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        gaps = np.flatnonzero(empty & blank)
        fresh = np.ones(len(gaps), bool)
        fresh[1:] = (np.diff(gaps) != 1) | (line[gaps[1:]] != line[gaps[:-1]])
        first, size = gaps[fresh], np.diff(np.append(np.flatnonzero(fresh), len(gaps)))
        after = first + size
        follows = after < len(codes)
        follows[follows] = line[after[follows]] == line[first[follows]]
        led = np.zeros(len(codes), bool)
        led[after[follows]] = True
        if len(first):
            word = np.where(follows, codes[np.minimum(after, len(codes) - 1)], -1)
            pairs, inverse = np.unique(np.stack([size + follows, word]), axis=1, return_inverse=True)
            spelled = [" " * int(n) + (known[int(w)].as_py() if w >= 0 else "") for n, w in pairs.T]
            tokens[first] = self._merged(spelled)[inverse.ravel()]

        for after_blank in (True, False):
            at = np.flatnonzero(~empty & ~led & (blank == after_blank))
            if len(at):
                tokens[at], direct[at] = self._words(known, codes[at], after_blank)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[ends[line_ends]])

        breaks = np.diff(line_ends) - 1
        return per_text(tokens) + breaks * self.shortcut.line_break, per_text(direct.astype(np.int64))


def count_tokens(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    model: str | None = None,
    limit: int = 4096,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``) and n_direct.

    Counts are those of the library for the sentencepiece ``model``, without begin or end.
    ``prove`` finds, before any text is read, which words are one token; of the texts' words
    those count at once (``n_direct``), and only the others are merged by the library, each
    distinct one once in a while. A model whose rules do not allow cuts gets the texts whole.
    The proof goes to every task; its size is bounded by the vocabulary. Nothing is shuffled.

    A null text reads as empty and has no token; null ids pass through; repeated rows are
    counted each; texts of any length are read whole, a text without a blank as one word; an
    empty table gives an empty result; other columns are ignored.
    """
    path = model or default_model()
    shared = docs.sparkSession.sparkContext.broadcast(vars(prove(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, Shortcut(**shared.value))
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            tokens, direct = counter.count(texts)
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit), pa.array(direct)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"],
            )

    chosen = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    return chosen.mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_direct long"
    )
