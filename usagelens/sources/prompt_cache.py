"""The prompt cache as a table: new entries, hit counts, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["team_id", "prompt_hash"]


def scan(cache: DataFrame, team: str | None = None) -> DataFrame:
    return cache if team is None else cache.filter(F.col("team_id") == team)


def entry_id() -> F.Column:
    """A stable id per (team, prompt)."""
    return F.sha2(F.concat_ws(":", "team_id", "prompt_hash"), 256)


def new_entries(candidates: DataFrame, cache: DataFrame, order: list[str]) -> DataFrame:
    """Candidates whose key the cache lacks, the earliest of each key.

    A prompt sent very often collapses to one row per map task before anything
    is shuffled.
    """
    rest = [c for c in candidates.columns if c not in KEY]
    earliest = candidates.groupBy(*KEY).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    first = earliest.select(*KEY, "_row.*").select(*candidates.columns)
    return first.join(cache.select(*KEY), KEY, "left_anti")


def hit_counts(hits: DataFrame, cache_id: str = "cache_id") -> DataFrame:
    return hits.filter(F.col(cache_id).isNotNull()).groupBy(F.col(cache_id).alias("id")).agg(
        F.count("*").alias("new_hits")
    )


def with_hits(cache: DataFrame, hits: DataFrame, cache_id: str = "cache_id") -> DataFrame:
    """The cache with one added to ``hit_count`` per served hit."""
    return (
        cache.join(hit_counts(hits, cache_id), "id", "left")
        .withColumn(
            "hit_count",
            (F.col("hit_count") + F.coalesce("new_hits", F.lit(0))).cast("int"),
        )
        .drop("new_hits")
    )
