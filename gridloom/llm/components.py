"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """Node and component (its smallest node) for every node of ``links`` (columns a, b).

    Alternates two steps until nothing changes: every node hands the smallest of its
    neighbours and itself first to its larger neighbours, then to its smaller ones. Links only
    ever shrink, a node's neighbours are met by a join and never gathered, and each round is
    written to the shared folder, so a lost executor costs no earlier round.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        )
        large = stored(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
        ).first()
        if now == before or not now["n"]:
            break
        before = now
    members = edges.select(a.alias("node"), b.alias("component"))
    return members.union(edges.select(b.alias("node"), b.alias("component")).distinct())
