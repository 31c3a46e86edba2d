"""The corpus pipeline: documents from raw table to packed token sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, language, packing, pii, simhash
from gridloom.llm.common import crc_mod, free_name, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Below this probability of the likeliest language a document is rejected.
LEAST_CERTAIN = 0.3


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told; null texts and those without a letter go.

    Where there is nothing to learn from, all documents with a letter stay. Texts are read
    whole, however long; repeated rows get the same answer; an empty table stays empty; columns
    of any name keep their values.
    """
    model = language.train(docs, crc_mod("doc_id", 3) != 1)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs, "told_lang"), free_name(docs, "told_score")
    told = language.predict(docs, model, lang_as=lang, score_as=score)
    certain = (F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_CERTAIN)
    return told.where(certain).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near copies, by the operator's shingles and distance.

    Texts without a word are one group; texts are read whole; repeated rows are copies.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; texts of any length are read whole.

    Null and empty texts hold none and stay, as do repeated rows without one.
    """
    return decontam.without_overlaps(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their personal data replaced by its kind, texts of any length whole.

    Null and empty texts stay as they are; repeated rows are changed alike.
    """
    return pii.redact(docs, pii.trusted(pii.bootstrap(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Whole texts as pieces of token sequences; a null text packs as an empty one.

    A text longer than a sequence is cut into pieces that cover it; repeated rows are packed
    as often as they occur; an empty table gives no piece.
    """
    return packing.digests(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", pack_sequences),
]

# The stages have no form in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Every stage on what the one before kept, written to the shared folder in between."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
