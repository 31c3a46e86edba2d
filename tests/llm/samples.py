from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names that the operators use for columns of their own.
CLASHING = ("key", "at", "score", "fingerprint", "tokens", "rank", "text_hash", "start", "slots")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHING
)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents of (doc_id, text) or (doc_id, text, lang), with columns of clashing names."""
    full = [
        (r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *CLASHING)
        for r in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


LONG = "the quick brown fox jumps over the lazy dog again and again " * 4000

EDGES = [
    (None, "no id at all here"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, LONG),
    (6, "Zwei Wörter über 한국어 \U0001f600 é"),
    (7, "repeated row"),
    (7, "repeated row"),
    (7, "same id, other text"),
    (8, "REPEATED ROW"),
    (9, "!!! ??? 123"),
]

FOLDER = "/root/testdata/sf0.001"
