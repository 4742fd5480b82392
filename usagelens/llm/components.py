"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`node, root` for every node of `links(a, b)`; the root is the smallest node of the component.

    Alternates large-star and small-star steps, each a grouping and an equality join on a node, until the edges stay
    as they are. Every round is written to the shared folder. A node linked to very many others is met by one row per
    link, which adaptive execution splits. Links of a node to itself and repeated links are harmless; an empty table
    gives an empty result.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = edges.agg(mark).first()[0]
    for _ in range(most_rounds if before[0] else 0):
        edges = written(_small_star(_large_star(edges)), "links")
        now = edges.agg(mark).first()[0]
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components have not settled")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
