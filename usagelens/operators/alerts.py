"""Rolling rates and alert rules as runs of breaching windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.operators.metrics import (
    REQUEST_BUCKETS,
    bucket_counts,
    buckets_tall,
    histogram_quantile,
)

# Thresholds and hold times of the three rules.
LOW_HIT_RATE, LOW_HIT_RATE_FOR = 0.2, 600
HIGH_LATENCY_MS, HIGH_LATENCY_FOR = 500.0, 300
HIGH_ERROR_RATE, HIGH_ERROR_RATE_FOR, ERROR_RANGE = 0.01, 120, 120


def _pane(ts: str, seconds: int) -> Column:
    """Index of the pane of that many seconds since the epoch."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("bigint")


def _moment(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    window: int,
    slide: int,
    ts: str = "created_at",
) -> DataFrame:
    """Sums over sliding windows, by way of panes one slide long.

    Rows are added up per pane before panes are copied to the windows that
    cover them, so what is copied does not grow with the rows.
    """
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    panes = df.groupBy(*keys, _pane(ts, slide).alias("_pane")).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    span = window // slide
    starts = F.sequence(F.col("_pane") - (span - 1), F.col("_pane"))
    return (
        panes.withColumn("_start", F.explode(starts))
        .groupBy(*keys, "_start")
        .agg(*[F.sum(n).alias(n) for n in sums])
        .withColumn("window_start", _moment(F.col("_start") * slide))
        .withColumn("window_end", _moment(F.col("_start") * slide + window))
        .drop("_start")
    )


def rolling_hit_rate(usage: DataFrame, window: int = 30, slide: int = 10) -> DataFrame:
    out = rolling(
        usage,
        ["team_id"],
        {"hits": F.col("cache_hit").cast("int"), "lookups": F.lit(1)},
        window,
        slide,
    )
    return out.withColumn("cache_hit_rate", F.col("hits") / F.col("lookups"))


def held_breaches(
    samples: DataFrame, keys: Sequence[str], at: str, breach: str, hold: int
) -> DataFrame:
    """Runs of breaching samples of a gauge that keeps its value between samples.

    A run starts at its first breaching sample and ends at the next one that
    does not breach, or at the last sample. Runs shorter than ``hold`` seconds
    raise nothing.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    marked = samples.withColumn(
        "_run", F.row_number().over(order) - F.sum(F.col(breach).cast("int")).over(order)
    ).withColumn("_next", F.coalesce(F.lead(at).over(order), F.col(at)))
    runs = (
        marked.filter(F.col(breach))
        .groupBy(*keys, "_run")
        .agg(
            F.min(at).alias("started_at"),
            F.max("_next").alias("ended_at"),
            F.count("*").alias("samples"),
        )
    )
    return _firing(runs, hold).drop("_run")


def stepped_breaches(
    samples: DataFrame, keys: Sequence[str], at: str, step: int, hold: int
) -> DataFrame:
    """Runs of breaching evaluations exactly one step apart."""
    order = Window.partitionBy(*keys).orderBy(at)
    index = F.unix_seconds(F.col(at)) / F.lit(step)
    runs = (
        samples.withColumn("_run", index.cast("bigint") - F.row_number().over(order))
        .groupBy(*keys, "_run")
        .agg(
            F.min(at).alias("started_at"),
            F.max(at).alias("ended_at"),
            F.count("*").alias("samples"),
        )
    )
    return _firing(runs, hold).drop("_run")


def _firing(runs: DataFrame, hold: int) -> DataFrame:
    lasted = F.unix_seconds("ended_at") - F.unix_seconds("started_at")
    return runs.filter(lasted >= hold).withColumn(
        "fired_at", F.col("started_at") + F.make_dt_interval(secs=F.lit(hold))
    )


def low_hit_rate(
    usage: DataFrame,
    window: int = 30,
    below: float = LOW_HIT_RATE,
    hold: int = LOW_HIT_RATE_FOR,
) -> DataFrame:
    """Teams whose hit rate stayed under the limit."""
    rate = rolling_hit_rate(usage, window, window)
    rate = rate.withColumn("breach", F.col("cache_hit_rate") < below)
    return held_breaches(rate, ["team_id"], "window_end", "breach", hold)


def high_latency(
    usage: DataFrame,
    every: int = 30,
    above_ms: float = HIGH_LATENCY_MS,
    hold: int = HIGH_LATENCY_FOR,
    q: float = 0.99,
) -> DataFrame:
    """Label sets whose bucket quantile stayed over the limit.

    The buckets are running counters since the start, as the rule reads them.
    """
    labels = ["model_used", "cache_hit", "complexity"]
    wide = usage.groupBy(*labels, _pane("created_at", every).alias("_pane")).agg(
        *bucket_counts(F.col("latency_ms"), REQUEST_BUCKETS)
    )
    so_far = Window.partitionBy(*labels).orderBy("_pane").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = wide.select(
        *labels,
        _moment((F.col("_pane") + 1) * every).alias("at"),
        *[F.sum(f"b{i}").over(so_far).alias(f"b{i}") for i in range(len(REQUEST_BUCKETS) + 1)],
    )
    p = histogram_quantile(
        buckets_tall(running, [*labels, "at"], REQUEST_BUCKETS), q, [*labels, "at"]
    )
    p = p.withColumn("breach", F.col("quantile") > above_ms)
    return held_breaches(p, labels, "at", "breach", hold)


def high_error_rate(
    events: DataFrame,
    window: int = ERROR_RANGE,
    step: int = 30,
    above: float = HIGH_ERROR_RATE,
    hold: int = HIGH_ERROR_RATE_FOR,
) -> DataFrame:
    """Error kinds whose errors per second stayed over the limit."""
    errors = rolling(
        events.filter(F.col("error_type").isNotNull()),
        ["error_type"],
        {"errors": F.lit(1)},
        window,
        step,
    )
    over = errors.filter(F.col("errors") / F.lit(float(window)) > above)
    return stepped_breaches(over, ["error_type"], "window_end", step, hold)
