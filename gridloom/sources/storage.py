"""Intermediate tables that outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """Folder for intermediate tables, if the cluster names one in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else None


def new_folder(spark: SparkSession, parent: str | None = None) -> str:
    """A new folder below ``parent``, else the shared folder, else the session's warehouse.

    A warehouse on a local disk serves only where driver and executors are one machine.
    """
    parent = parent or shared_folder(spark)
    if parent is None:
        parent = spark.conf.get("spark.sql.warehouse.dir")
        local = parent.startswith(("file:", "/")) or ":" not in parent
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{parent.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, parent: str | None) -> DataFrame:
    """Writes a table below a folder the caller names and reads it back.

    For results that are small beside their input and read more than once: the input is
    scanned once, and the optimizer knows the true size when it picks a join. The write is a
    job at the time of the call; without a folder the plan stays as it is, and nothing runs.
    """
    if parent is None:
        return df
    spark = df.sparkSession
    folder = new_folder(spark, parent)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
