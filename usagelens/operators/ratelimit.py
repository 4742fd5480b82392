"""Token-bucket decisions per team over a table of requests."""

from __future__ import annotations

from collections.abc import Iterator


import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

# Refill per second and bucket size.
RATE, BURST = 100.0, 20


def check_limits(rate: float, burst: int) -> None:
    if rate <= 0:
        raise ValueError(f"rate must be positive, got {rate}")
    if burst <= 0:
        raise ValueError(f"burst must be positive, got {burst}")


class Bucket:
    """Tokens of one team; a refused request takes none."""

    __slots__ = ("tokens", "last", "rate", "burst")

    def __init__(self, rate: float, burst: int, tokens: float | None = None, last: int | None = None):
        self.rate, self.burst = rate, float(burst)
        self.tokens = self.burst if tokens is None else tokens
        self.last = last

    def allow(self, micros: int) -> bool:
        now = self.tokens
        if self.last is not None and micros > self.last:
            now = min(self.burst, now + (micros - self.last) * self.rate / 1e6)
        # A shortfall worth less than a nanosecond of refill counts as covered.
        if (1.0 - now) / self.rate * 1e9 >= 1.0:
            return False
        self.tokens, self.last = now - 1.0, micros if self.last is None else max(micros, self.last)
        return True


def decide(
    requests: DataFrame,
    rate: float = RATE,
    burst: int = BURST,
    team: str = "team_id",
    ts: str = "created_at",
    order_id: str = "event_id",
    slice_seconds: int = 60,
) -> DataFrame:
    """Add ``allowed`` in (time, id) order within each team.

    Where a bucket is sure to be full, what follows does not depend on what came
    before. Each team's requests are cut at such moments, at most once per time
    slice, and the pieces are decided side by side. A task reads its piece in
    order and keeps one bucket, never the piece.

    A moment is sure when even a bucket that was empty at the start of the slice
    and paid for every request since would be full. That lowest level is a sum of
    refills and payments held at zero from below, so it is the running sum minus
    its running minimum.
    """
    check_limits(rate, burst)
    # A hair above full, against rounding in the running sums.
    sure = burst + 1e-6
    refill = F.lit(rate / 1e6)
    rows = requests.withColumn("_us", F.unix_micros(F.col(ts))).withColumn(
        "_slice", F.floor(F.col("_us") / F.lit(slice_seconds * 1_000_000)).cast("bigint")
    )
    within = Window.partitionBy(team, "_slice").orderBy("_us", order_id)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lowest = rows.select(team, "_slice", "_us", order_id).withColumn(
        "_sum", (F.col("_us") - F.first("_us").over(so_far)) * refill - F.row_number().over(within)
    )
    lowest = lowest.withColumn("_left", F.col("_sum") - F.min("_sum").over(so_far))
    lowest = lowest.withColumn(
        "_level",
        F.lag("_left").over(within) + (F.col("_us") - F.lag("_us").over(within)) * refill,
    )
    slices = lowest.groupBy(team, "_slice").agg(
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.min(F.when(F.col("_level") >= sure, F.col("_us"))).alias("_inner"),
    )
    # One row per team and slice from here on.
    over = Window.partitionBy(team).orderBy("_slice")
    pause = F.col("_first") - F.lag("_last").over(over)
    cut = F.when(F.coalesce(pause * refill >= sure, F.lit(True)), F.col("_first")).otherwise(
        F.col("_inner")
    )
    cuts = (
        slices.withColumn("_cut", cut)
        .withColumn(
            "_open",
            F.last("_cut", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(team, "_slice", "_cut", "_open")
    )
    piece = F.when(F.col("_us") >= F.col("_cut"), F.col("_cut")).otherwise(F.col("_open"))
    placed = rows.join(cuts, [team, "_slice"]).withColumn("_piece", piece).drop("_cut", "_open", "_slice")
    ordered = placed.repartition(team, "_piece").sortWithinPartitions(team, "_piece", "_us", order_id)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bucket = None, Bucket(rate, burst)
        for frame in frames:
            allowed = []
            for t, p, us in zip(frame[team], frame["_piece"], frame["_us"]):
                if (t, p) != current:
                    current, bucket = (t, p), Bucket(rate, burst)
                allowed.append(bucket.allow(us))
            yield frame.drop(columns=["_piece", "_us"]).assign(allowed=allowed)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return ordered.mapInPandas(run, f"{fields}, allowed boolean")


def audit(
    requests: DataFrame,
    rate: float = RATE,
    burst: int = BURST,
    seconds: int = 1,
    team: str = "team_id",
    ts: str = "created_at",
) -> DataFrame:
    """Windows that hold more requests than refill and burst can cover."""
    check_limits(rate, burst)
    width = F.lit(seconds * 1_000_000)
    start = F.floor(F.unix_micros(F.col(ts)) / width).cast("bigint") * seconds
    limit = rate * seconds + burst
    return (
        requests.groupBy(team, F.timestamp_seconds(start).alias("window_start"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .withColumn("excess", F.col("requests") - F.lit(limit))
    )
