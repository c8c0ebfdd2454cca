"""Connected components of links, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.sources.shared import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v); a hot node is aggregated before its links are joined back."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) of every linked node u but the smallest of its component v, from links (a, b).

    Every round moves links to smaller nodes; rounds end when the set of links stays as it is, which
    leaves stars around the smallest node of each component. Each round is written as a table, so
    no plan grows and a lost executor costs one round at most. Nodes without links do not appear;
    empty links give an empty result.
    """
    edges, path = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        after, next_path = cut(_star(_star(edges, True), False), name)
        now = mark(after)
        drop(edges.sparkSession, path)
        edges, path = after, next_path
        if now == before:
            return edges
        before = now
