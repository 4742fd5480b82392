"""Cache, model, latency and team reports over the usage log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions.pricing import percent
from usagelens.functions.text import preview
from usagelens.schemas import COMPLEXITIES, DEFAULT_COMPLEXITY

PERCENTILES = (0.5, 0.95, 0.99)


def cache_stats(usage: DataFrame) -> DataFrame:
    """Lookups, hits, misses and hit percentage per team, in one pass."""
    return (
        usage.groupBy("team_id")
        .agg(
            F.count("*").alias("total_lookups"),
            F.count_if(F.col("cache_hit")).alias("hits"),
            F.count_if(~F.col("cache_hit")).alias("misses"),
        )
        .withColumn("hit_rate_pct", percent(F.col("hits"), F.col("total_lookups")))
    )


def top_cached_prompts(cache: DataFrame, team: str, limit: int = 10) -> DataFrame:
    """The team's most used entries with what they saved."""
    return (
        cache.filter(F.col("team_id") == team)
        .orderBy(F.desc("hit_count"), "id")
        .limit(limit)
        .select(
            F.coalesce(preview(F.col("prompt_text")), F.lit("")).alias("prompt_preview"),
            "hit_count",
            (F.col("hit_count") * F.col("cost_usd")).alias("cost_saved_usd"),
        )
    )


def top_prompts_by_team(cache: DataFrame, limit: int = 10) -> DataFrame:
    """The most used entries of every team with what they saved; each task keeps a team's ``limit`` best only."""
    order = Window.partitionBy("team_id").orderBy(F.desc("hit_count"), "id")
    return (
        cache.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(
            "team_id",
            "rank",
            F.coalesce(preview(F.col("prompt_text")), F.lit("")).alias("prompt_preview"),
            "hit_count",
            (F.col("hit_count") * F.col("cost_usd")).alias("cost_saved_usd"),
        )
    )


def complexity_distribution(usage: DataFrame) -> DataFrame:
    """Share of each class per team; every class is present."""
    level = F.coalesce(F.col("complexity"), F.lit(DEFAULT_COMPLEXITY))
    wide = usage.groupBy("team_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(level == c).alias(c) for c in COMPLEXITIES],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("complexity"),
                F.col(c).alias("requests"),
                percent(F.col(c), F.col("total")).alias("pct"),
            )
            for c in COMPLEXITIES
        ]
    )
    return wide.select("team_id", F.explode(rows).alias("r")).select("team_id", "r.*")


def model_usage(usage: DataFrame) -> DataFrame:
    return (
        usage.groupBy("team_id", F.col("model_used").alias("model"))
        .agg(
            F.count("*").alias("request_count"),
            F.sum("cost_usd").alias("total_cost_usd"),
            F.avg("latency_ms").alias("avg_latency_ms"),
        )
        .orderBy("team_id", F.desc("request_count"), "model")
    )


def _percentiles(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    points = F.percentile("latency_ms", list(PERCENTILES), F.col("n")).alias("p")
    return counted.groupBy(*keys).agg(points).select(
        *keys,
        F.col("p")[0].alias("p50_ms"),
        F.col("p")[1].alias("p95_ms"),
        F.col("p")[2].alias("p99_ms"),
    )


def latency_percentiles(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Interpolated p50, p95 and p99 per team and the given columns.

    Latencies are whole milliseconds: the log is reduced to counts per value
    first, and the exact percentiles are taken over the counts.
    """
    keys = ["team_id", *by]
    return _percentiles(usage.groupBy(*keys, "latency_ms").agg(F.count("*").alias("n")), keys)


def latency_report(usage: DataFrame) -> DataFrame:
    """Overall, per model and per hit or miss from one reading of the log."""
    served = F.when(F.col("cache_hit"), F.lit("hit")).otherwise(F.lit("miss"))
    counted = usage.groupBy("team_id", "model_used", served.alias("served"), "latency_ms").agg(
        F.count("*").alias("n")
    )
    views = F.array(
        F.struct(F.lit("overall").alias("section"), F.lit("").alias("label")),
        F.struct(F.lit("model").alias("section"), F.col("model_used").alias("label")),
        F.struct(F.lit("cache").alias("section"), F.col("served").alias("label")),
    )
    tall = (
        counted.withColumn("v", F.explode(views))
        .groupBy("team_id", "v.section", "v.label", "latency_ms")
        .agg(F.sum("n").alias("n"))
    )
    return _percentiles(tall, ["team_id", "section", "label"])


def latency_sketch(usage: DataFrame, by: Sequence[str] = ("model_used",)) -> DataFrame:
    """Mergeable daily sketches of latency, for rollups that are kept."""
    return usage.groupBy("team_id", *by, F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("requests"),
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint")).alias("sketch"),
    )


def sketch_percentiles(sketches: DataFrame, by: Sequence[str] = ("model_used",)) -> DataFrame:
    """Approximate percentiles from stored daily sketches."""
    merged = sketches.groupBy("team_id", *by).agg(
        F.sum("requests").alias("requests"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )
    return merged.select(
        "team_id",
        *by,
        "requests",
        *[
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(f"p{round(p * 100)}_ms")
            for p in PERCENTILES
        ],
    )


def team_summary(usage: DataFrame) -> DataFrame:
    """Cost, requests, hit rate, mean and p99 latency per team."""
    counted = usage.groupBy("team_id", "latency_ms").agg(
        F.count("*").alias("n"),
        F.sum("cost_usd").alias("cost"),
        F.count_if(F.col("cache_hit")).alias("hits"),
    )
    requests = F.sum("n")
    return counted.groupBy("team_id").agg(
        F.sum("cost").alias("total_cost_usd"),
        requests.alias("total_requests"),
        (F.sum("hits") / F.nullif(requests, F.lit(0))).alias("cache_hit_rate"),
        (F.sum(F.col("latency_ms") * F.col("n")) / requests).alias("avg_latency_ms"),
        F.percentile("latency_ms", 0.99, F.col("n")).alias("p99_latency_ms"),
    )


def hit_rate(usage: DataFrame) -> DataFrame:
    """One row; the rate is null when there are no rows."""
    share = F.count_if(F.col("cache_hit")) / F.nullif(F.count("*"), F.lit(0))
    return usage.agg(share.alias("cache_hit_rate"))


def team_models(usage: DataFrame) -> DataFrame:
    tokens = (F.col("input_tokens") + F.col("output_tokens")).cast("bigint")
    return usage.groupBy("team_id", "model_used").agg(
        F.count("*").alias("request_count"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum(tokens).alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def top_features(usage: DataFrame, limit: int = 5) -> DataFrame:
    """Each team's most used features, ties by name."""
    counted = usage.groupBy("team_id", "feature_tag").agg(F.count("*").alias("request_count"))
    order = Window.partitionBy("team_id").orderBy(F.desc("request_count"), "feature_tag")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
