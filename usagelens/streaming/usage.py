"""Usage events as a stream: ingest, counters, rates, daily cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from usagelens.sources.usage_log import accepted, with_layout
from usagelens.streaming.run import each_batch


def append_usage(
    events: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Append valid events to the log, exactly once, laid out by day.

    ``every`` is a processing-time interval; without it the stream stops when
    the input is used up.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        with_layout(accepted(events))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("created_date")
        .trigger(**trigger)
        .start()
    )


def daily_cost(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Cost per team and day; in append mode a day appears once it is closed."""
    return (
        events.withWatermark("created_at", late)
        .groupBy("team_id", F.window("created_at", "1 day"))
        .agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("requests"))
        .select("team_id", F.col("window.start").alias("day"), "cost_usd", "requests")
    )


def rolling_hit_rate(
    events: DataFrame, window: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute"
) -> DataFrame:
    return (
        events.withWatermark("created_at", late)
        .groupBy("team_id", F.window("created_at", window, slide))
        .agg(
            F.count_if(F.col("cache_hit")).alias("hits"),
            F.count("*").alias("lookups"),
        )
        .select(
            "team_id",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "hits",
            "lookups",
            (F.col("hits") / F.col("lookups")).alias("cache_hit_rate"),
        )
    )


def live_counters(events: DataFrame) -> DataFrame:
    """Requests, cost and tokens by their labels, for update or complete mode."""
    return events.groupBy("team_id", "model_used", "provider", "complexity", "cache_hit").agg(
        F.count("*").alias("requests"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("latency_ms").alias("latency_ms_sum"),
    )


def first_sightings(
    requests: DataFrame, horizon: str = "24 hours", text: str = "prompt_text"
) -> DataFrame:
    """One request per team and prompt within the horizon."""
    return (
        requests.withColumn("prompt_hash", F.sha2(F.col(text), 256))
        .withWatermark("created_at", horizon)
        .dropDuplicatesWithinWatermark(["team_id", "prompt_hash"])
    )


def part_late(
    events: DataFrame, out: str, checkpoint: str, late: str = "1 hour", ts: str = "created_at"
) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows too late, as two tables with the batch they came in.

    A row is too late if it is older than the newest row of all earlier batches
    by more than ``late``. Each batch leaves its newest time behind, so nothing
    is kept in the driver, and a batch that is tried again decides as before.
    """
    spark = events.sparkSession
    marks = "newest timestamp"
    spark.createDataFrame([], marks).write.mode("overwrite").parquet(f"{out}/marks/batch_id=-1")
    for name in ("rows", "late"):
        spark.createDataFrame([], events.schema).write.mode("overwrite").parquet(f"{out}/{name}/batch_id=-1")

    def work(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema(f"{marks}, batch_id bigint").parquet(f"{out}/marks").filter(F.col("batch_id") < batch_id)
        # One row per earlier batch.
        bound = seen.agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("bound")).first()["bound"]
        is_late = F.lit(False) if bound is None else F.coalesce(F.col(ts) < F.lit(bound), F.lit(False))
        batch.filter(is_late).write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        batch.agg(F.max(ts).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")

    each_batch(events, work, checkpoint)
    schema = StructType([*events.schema.fields, StructField("batch_id", LongType())])
    return tuple(spark.read.schema(schema).parquet(f"{out}/{name}") for name in ("rows", "late"))


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks refuse, batch by batch, for as long as it listens.

    A query keeps its last progress entries only; this keeps one number per
    batch. Attach it with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def add(self, progress) -> None:
        dropped = sum(int(op.numRowsDroppedByWatermark) for op in progress.stateOperators)
        self.batches[str(progress.runId), int(progress.batchId)] = dropped

    def total(self, query: StreamingQuery) -> int:
        """Rows refused so far in this run; entries still on their way to the listener are read from the query."""
        for progress in query.recentProgress:
            self.add(progress)
        return sum(n for (run, _), n in self.batches.items() if run == str(query.runId))


def dropped_late(query: StreamingQuery, late: LateRows | None = None) -> int:
    """Rows the watermark refused so far in this run; give the listener for runs of many batches."""
    return (late or LateRows()).total(query)
