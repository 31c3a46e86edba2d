"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .common import BROADCAST_ROWS, code_points, gram_slots, row_slots, slices, stored, texts_of
from .linear import Rows, ftrl


# Bytes of text at a time: every n-gram of a slice is sorted at once.
SLICE = 1_000_000


@dataclass
class ToxicityModel:
    #: Weight times log-count ratio of every slot; 0 for slots that say nothing.
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]
    bits: int


def _present(texts: list[str], orders: tuple[int, ...], bits: int, keep: np.ndarray):
    """Row and slot of every n-gram whose slot is kept, each pair once, by row."""
    points, offsets = code_points(texts)
    pairs = []
    for n in orders:
        slots = gram_slots(points, n, bits)
        at = np.flatnonzero(keep[slots])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + n <= offsets[row + 1]
        pairs.append((row[inside] << bits) | slots[at[inside]].astype(np.int64))
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _class_counts(rows: DataFrame, orders: tuple[int, ...], bits: int) -> DataFrame:
    """For every slot the toxic and the clean rows that hold it; slot -1 counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        place = np.zeros(1 << bits, np.int64)
        for batch in slices(batches, "text", SLICE):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for y, slots in zip(toxic, row_slots(texts_of(batch, "text"), orders, bits)):
                # Of a slot's places in the text one remains written, so each counts once.
                own = np.arange(len(slots))
                place[slots] = own
                found[y, slots[place[slots] == own]] += 1
                total[y] += 1
        used = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1))]
            + [pa.array(np.append(found[y][used], total[y])) for y in (1, 0)],
            ["slot", "toxic", "clean"],
        )

    parts = rows.mapInArrow(run, "slot long, toxic long, clean long")
    return parts.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _kept_slots(rows: DataFrame, ratios: np.ndarray, orders: tuple[int, ...], bits: int) -> DataFrame:
    """The telling slots of every row."""
    keep = rows.sparkSession.sparkContext.broadcast(np.flatnonzero(ratios))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << bits, bool)
        mask[keep.value] = True
        for batch in slices(batches, "text", SLICE):
            row, slot = _present(texts_of(batch, "text"), orders, bits, mask)
            cuts = np.searchsorted(row, np.arange(1, batch.num_rows))
            held = [part.astype(np.int32).tobytes() for part in np.split(slot, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("turn"), pa.array(held, pa.binary())],
                ["toxic", "turn", "slots"],
            )

    return rows.mapInArrow(run, "toxic int, turn long, slots binary")


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    rows_per_fit: int = 4_000,
    orders: tuple[int, ...] = (3, 4, 5, 6),
    bits: int = 20,
    smoothing: float = 20.0,
    least_ratio: float = 0.7,
    epochs: int = 5,
) -> ToxicityModel | None:
    """Learns from labelled documents; ``learn_from`` is a condition on the labels' id.

    The ratios count every labelled row: up to ``BROADCAST_ROWS`` labels go to every task, more
    meet the texts in a shuffle. The weights are fitted on about ``rows_per_fit`` of
    them, half of each class, drawn by a hash of the id; what is collected of a text, however
    long, are its distinct telling slots, at most ``2 ** bits``. A
    slot's ratio is ``log((t / T + s) / (c / C + s))`` for ``t`` of ``T`` toxic and ``c`` of
    ``C`` clean rows that hold it, with ``s = smoothing / (T + C)``; ratios nearer to 0 than
    ``least_ratio`` count as 0. The classifier is logistic on presence times ratio, and its
    bias is moved to the share of toxic rows among all labelled ones. None without both classes.
    """
    key, label = named(id_column), named(label_column)
    usable = key.isNotNull() & label.isin(0, 1)
    if learn_from is not None:
        usable &= learn_from
    known = labels.where(usable).select(key.alias("id"), label.cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003))

    def below(rows: int) -> Column:
        rates = {y: min(1_000_003.0, 1_000_003 * rows / 2 / n) for y, n in counts.items()}
        return F.col("turn") < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])

    read = docs.select(key.alias("id"), F.coalesce(named(text_column), F.lit("")).alias("text"))
    small = sum(counts.values()) <= BROADCAST_ROWS
    rows = read.join(F.broadcast(known) if small else known, "id")

    slots = 1 << bits
    found = stored(_class_counts(rows.select("text", "toxic"), orders, bits))
    total = found.where("slot = -1").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return None
    base = smoothing / (total["toxic"] + total["clean"])
    ratio = F.log(
        (F.col("toxic") / total["toxic"] + base) / (F.col("clean") / total["clean"] + base)
    )
    told = (
        found.where("slot >= 0 and toxic + clean >= 3")
        .select("slot", ratio.alias("ratio"))
        .where(F.abs("ratio") >= least_ratio)
        .toPandas()
    )
    ratios = np.zeros(slots)
    ratios[told["slot"].to_numpy()] = told["ratio"].to_numpy()

    drawn = F.broadcast(known.withColumn("turn", draw).where(below(rows_per_fit)))
    fitted = read.join(drawn, "id").select("text", "toxic", "turn")
    sample = _kept_slots(fitted, ratios, orders, bits).collect()
    sample = sorted(sample, key=lambda r: (r["turn"], r["toxic"], r["slots"]))
    labels01 = np.array([r["toxic"] for r in sample], np.int64)
    sparse = []
    for r in sample:
        at = np.frombuffer(r["slots"], np.int32)
        sparse.append((at, ratios[at].astype(np.float32)))
    toxic, clean = float(labels01.sum()), float(len(labels01) - labels01.sum())
    if not toxic or not clean:
        return None
    w, bias = ftrl(
        Rows.of(sparse), labels01, 2, slots, epochs=epochs, alpha=0.1, beta=1.0, l1=0.0, l2=1.0
    )
    prior = np.log(counts[1] / counts[0]) - np.log(toxic / clean)
    return ToxicityModel(
        (w[:, 1] - w[:, 0]) * ratios, float(bias[1] - bias[0] + prior), orders, bits
    )


def score(
    docs: DataFrame,
    model: ToxicityModel | None,
    *,
    text_column: str = "text",
    score_as: str = "score",
) -> DataFrame:
    """Adds the probability that a whole text is toxic.

    A null text reads as empty; without a model every score is 0. Other columns are kept, a
    column with the new name is replaced, repeated rows get equal scores, and an empty table
    gives an empty result.
    """
    packed = None
    if model is not None:
        used = np.flatnonzero(model.weights)
        packed = (used, model.weights[used], model.bias, model.orders, model.bits)
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    kept = [c for c in docs.columns if c != score_as]
    schema = docs.select(*map(named, kept)).schema.add(score_as, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        if shared.value is not None:
            used, values, bias, orders, bits = shared.value
            weights = np.zeros(1 << bits)
            weights[used] = values
            keep = weights != 0
        for batch in slices(batches, text_column, SLICE):
            found = np.zeros(batch.num_rows)
            if weights is not None:
                row, slot = _present(texts_of(batch, text_column), orders, bits, keep)
                found = bias + np.bincount(row, weights[slot], minlength=batch.num_rows)
                found = 1 / (1 + np.exp(-np.clip(found, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(found)], [*kept, score_as]
            )

    return docs.select(*map(named, dict.fromkeys([*kept, text_column]))).mapInArrow(run, schema)
