"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import row_slots, slices, texts_of
from .linear import Rows, ftrl, softmax, temperature

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    #: Inverse document frequency of every slot.
    idf: np.ndarray
    #: Weights, slots x languages, and biases, both divided by the temperature.
    weights: np.ndarray
    bias: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def scores(self, slots: np.ndarray) -> np.ndarray:
        counts = np.bincount(slots, minlength=1 << self.bits)
        at = np.flatnonzero(counts)
        x = _unit(counts[at] * self.idf[at])
        return x @ self.weights[at] + self.bias


def _unit(x: np.ndarray) -> np.ndarray:
    return x / max(1e-12, float(np.sqrt(x @ x)))


def _document_frequencies(texts: DataFrame, orders: tuple[int, ...], bits: int) -> DataFrame:
    """For every slot the number of texts that hold it; -1 counts all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, rows = np.zeros(1 << bits, bool), np.zeros(1 << bits, np.int64), 0
        for batch in slices(batches, "text"):
            for slots in row_slots(texts_of(batch, "text"), orders, bits):
                seen[slots] = True
                total += seen
                seen[slots] = False
                rows += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))],
            ["slot", "n"],
        )

    parts = texts.mapInArrow(run, "slot long, n long")
    return parts.groupBy("slot").agg(F.sum("n").alias("n"))


def _features(rows: DataFrame, orders: tuple[int, ...], bits: int) -> DataFrame:
    """Distinct slots and their counts for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            slots, counts = [], []
            for found in row_slots(texts_of(batch, "text"), orders, bits):
                used, each = np.unique(found, return_counts=True)
                slots.append(used.astype(np.int32).tobytes())
                counts.append(each.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("turn"),
                 pa.array(slots, pa.binary()), pa.array(counts, pa.binary())],
                ["lang", "turn", "slots", "counts"],
            )

    return rows.mapInArrow(run, "lang string, turn long, slots binary, counts binary")


def train(
    docs: DataFrame,
    learn_from: Column | None = None,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    rows_per_fit: int = 3000,
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 16,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
) -> LanguageModel | None:
    """Learns from rows with a text and a language; ``learn_from`` limits them further.

    Inverse document frequencies count every such row. The classifier is fitted on about
    ``rows_per_fit`` distinct texts, an equal share of each language, drawn by a hash of the
    text; a fifth of them is held back to fit the temperature. Copies of a text count once in
    the draw, so that they neither exceed its bound nor outweigh other texts. Every text is read
    whole; what is collected of it are its distinct slots, at most ``2 ** bits``. None if there
    is nothing to learn from.
    """
    text, lang = named(text_column), named(lang_column)
    usable = text.isNotNull() & lang.isNotNull()
    if learn_from is not None:
        usable &= learn_from
    known = docs.where(usable).select(text.alias("text"), lang.alias("lang"))
    distinct = F.count_distinct(F.xxhash64("text")).alias("n")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(distinct).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    slots = 1 << bits
    frequency = _document_frequencies(known.select("text"), orders, bits).toPandas()
    held = dict(zip(frequency["slot"], frequency["n"]))
    total = held.pop(-1)
    idf = np.log(1.0 + total) * np.ones(slots)
    places = np.fromiter(held, np.int64, len(held))
    idf[places] = np.log((1.0 + total) / (1.0 + np.fromiter(held.values(), np.int64, len(held)))) + 1

    share = rows_per_fit / len(languages)
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    rate = F.create_map(
        *[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_003.0, 1_000_003 * share / n))]
    )
    drawn = known.withColumn("turn", draw).where(F.col("turn") < rate[F.col("lang")]).distinct()
    sample = _features(drawn, orders, bits).collect()
    sample = sorted(sample, key=lambda r: (r["turn"], r["slots"], r["lang"]))
    code = {k: i for i, k in enumerate(languages)}
    labels = np.array([code[r["lang"]] for r in sample], np.int64)
    sparse = []
    for r in sample:
        at = np.frombuffer(r["slots"], np.int32)
        sparse.append((at, _unit(np.frombuffer(r["counts"], np.int32) * idf[at])))
    back = np.arange(len(sample)) % 5 == 4
    w, bias = ftrl(
        Rows.of([r for r, b in zip(sparse, back) if not b]), labels[~back], len(languages), slots,
        epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2,
    )
    scores = np.array([x @ w[at] + bias for (at, x), b in zip(sparse, back) if b])
    t = temperature(scores, labels[back])
    return LanguageModel(languages, idf, w / t, bias / t, orders, bits)


def predict(
    docs: DataFrame,
    model: LanguageModel | None,
    *,
    text_column: str = "text",
    lang_as: str = "lang_pred",
    score_as: str = "score",
) -> DataFrame:
    """Adds the likeliest language of every whole text and its calibrated probability.

    Ties go to the language first in the alphabet. A null text, one without a letter, or any
    text where there was nothing to learn from is ``und`` with score 0. Every other column is
    kept as it is, and a column with the name of a new one is replaced; repeated rows get
    repeated answers; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    kept = [c for c in docs.columns if c not in (lang_as, score_as)]
    schema = docs.select(*map(named, kept)).schema.add(lang_as, "string").add(score_as, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value and LanguageModel(**shared.value)
        for batch in slices(batches, text_column):
            texts = texts_of(batch, text_column)
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
            if known is not None and lettered:
                found = row_slots([texts[i] for i in lettered], known.orders, known.bits)
                for i, slots in zip(lettered, found):
                    p = softmax(known.scores(slots))
                    best = int(p.argmax())
                    langs[i], scores[i] = known.languages[best], float(p[best])
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*kept, lang_as, score_as],
            )

    return docs.select(*map(named, dict.fromkeys([*kept, text_column]))).mapInArrow(run, schema)
