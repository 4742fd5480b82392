"""Counter and histogram tables, one per monitoring series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Upper bounds of the histogram buckets, in milliseconds.
REQUEST_BUCKETS = (50, 100, 250, 500, 1000, 2500, 5000, 10000)
LOOKUP_BUCKETS = (1, 2, 5, 10, 25, 50, 100, 250, 500)
EMBEDDING_BUCKETS = (10, 25, 50, 100, 200, 500, 1000)
INF = float("inf")


def counter(df: DataFrame, labels: Sequence[str], name: str = "value") -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias(name))


def requests_total(usage: DataFrame) -> DataFrame:
    return counter(usage, ["team_id", "model_used", "complexity", "cache_hit"])


def cost_total(usage: DataFrame) -> DataFrame:
    return usage.groupBy("team_id", "model_used", "provider").agg(F.sum("cost_usd").alias("value"))


def tokens_total(usage: DataFrame) -> DataFrame:
    wide = usage.groupBy("team_id", "model_used").agg(
        F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output")
    )
    return wide.unpivot(["team_id", "model_used"], ["input", "output"], "type", "value")


def routes_total(routed: DataFrame) -> DataFrame:
    level = F.when(F.col("reason") == "model_override", F.lit("override")).otherwise(
        F.col("complexity")
    )
    return routed.groupBy("model", level.alias("complexity"), "reason").agg(
        F.count("*").alias("value")
    )


def proxy_requests_total(events: DataFrame) -> DataFrame:
    return counter(events, ["method", "status"])


def proxy_errors_total(events: DataFrame) -> DataFrame:
    return counter(events.filter(F.col("error_type").isNotNull()), ["error_type"])


def bucket_counts(value: Column, bounds: Sequence[float]) -> list[Column]:
    """Cumulative count columns b0..bn, the last one for all values."""
    return [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [
        F.count(value).alias(f"b{len(bounds)}")
    ]


def buckets_tall(wide: DataFrame, keep: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative"))
            for i, b in enumerate([*bounds, INF])
        ]
    )
    return wide.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def histogram(
    df: DataFrame,
    value: str,
    labels: Sequence[str],
    bounds: Sequence[float] = REQUEST_BUCKETS,
) -> DataFrame:
    """Cumulative bucket counts with the sum and count of each label set."""
    wide = df.groupBy(*labels).agg(
        *bucket_counts(F.col(value), bounds),
        F.sum(value).alias("sum"),
        F.count(value).alias("count"),
    )
    return buckets_tall(wide, [*labels, "sum", "count"], bounds)


def request_latency(usage: DataFrame) -> DataFrame:
    return histogram(usage, "latency_ms", ["model_used", "cache_hit", "complexity"])


def lookup_latency(lookups: DataFrame) -> DataFrame:
    """Of a log that times its lookups, per ``type`` of lookup."""
    return histogram(lookups, "latency_ms", ["type"], LOOKUP_BUCKETS)


def embedding_latency(calls: DataFrame) -> DataFrame:
    """Of a log that times its embedding calls, per ``cache_hit``."""
    return histogram(calls, "latency_ms", ["cache_hit"], EMBEDDING_BUCKETS)


def histogram_quantile(
    buckets: DataFrame, q: float, labels: Sequence[str], out: str = "quantile"
) -> DataFrame:
    """Quantile from cumulative buckets, linear within the bucket it falls in.

    In the last, open bucket the answer is that bucket's lower bound.
    """
    order = Window.partitionBy(*labels).orderBy("le")
    steps = (
        buckets.withColumn("_low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
        .withColumn("_before", F.coalesce(F.lag("cumulative").over(order), F.lit(0)))
        .withColumn(
            "_all", F.max("cumulative").over(Window.partitionBy(*labels))
        )
        .withColumn("_rank", F.col("_all") * F.lit(q))
    )
    crossing = steps.filter(
        (F.col("_all") > 0) & (F.col("cumulative") >= F.col("_rank"))
    ).groupBy(*labels).agg(
        F.min(F.struct("le", "_low", "_before", "cumulative", "_rank")).alias("_x")
    )
    inside = (F.col("_x._rank") - F.col("_x._before")) / F.nullif(
        F.col("_x.cumulative") - F.col("_x._before"), F.lit(0)
    )
    width = F.col("_x.le") - F.col("_x._low")
    value = F.when(F.col("_x.le") == INF, F.col("_x._low")).otherwise(
        F.col("_x._low") + width * F.coalesce(inside, F.lit(0.0))
    )
    return crossing.select(*labels, value.alias(out))
