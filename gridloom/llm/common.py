"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import named

SLICE_BYTES = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str = "table") -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``new_folder`` named and nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``docs`` that meet no row of ``gone``, a narrow table that has been stored.

    It is broadcast if it has at most ``BROADCAST_ROWS`` rows, else the join shuffles.
    """
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, condition, "left_anti")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc_mod(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; a null id counts as empty text."""
    column = named(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null reads as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def words_of(batch: pa.RecordBatch, column: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased: distinct words, codes, row offsets.

    Row ``i`` holds the words ``codes[offsets[i]:offsets[i + 1]]``. Null reads as empty.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(column), "")))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = pc.cast(coded.dictionary, pa.binary()).to_pylist()
    ends = lists.offsets.to_numpy().astype(np.int64)
    # White space at either end of a text leaves an empty word.
    if b"" not in known:
        return known, codes, ends - ends[0]
    kept = codes != known.index(b"")
    before = np.concatenate([[0], np.cumsum(kept)])
    return known, codes[kept], before[ends - ends[0]]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one array of code points, a blank before and after each.

    Returns the array and the offsets of the rows; a row has at least two code points.
    """
    lowered = [f" {t.lower()} " for t in texts]
    offsets = np.zeros(len(lowered) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=offsets[1:])
    joined = "".join(lowered).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), offsets


# Fixed odd multipliers of the rolling hash, one per position in a character n-gram.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)


def gram_slots(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash slot of the ``order`` code points that start at each position."""
    n = max(0, len(points) - order + 1)
    mixed = np.full(n, order * 0x5BD1E995 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        mixed += points[k : k + n] * np.uint32(MULTIPLIERS[k])
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    return mixed >> np.uint32(32 - bits)


def row_slots(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each text the slots of all its n-grams, with repeats."""
    points, offsets = code_points(texts)
    grams = [gram_slots(points, n, bits) for n in orders]
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield np.concatenate([g[a : max(a, b - n + 1)] for g, n in zip(grams, orders)])
