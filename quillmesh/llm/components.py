"""Connected components of a distributed edge table (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.util import cut, forget


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u > v."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    inner = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v) links to (node, label): every node with a link, and the smallest node it reaches.

    Converges in about the logarithm of the longest path; each round is written to the shared folder.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = cut(e)
    seen = None
    for _ in range(limit):
        last, e = e, cut(_stars(e))
        forget(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    # smallest nodes name themselves
    labels = e.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(labels)
