"""Reading, checking and laying out the usage log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from usagelens.schemas import USAGE_LOG, usage_violations

LAID_OUT = T.StructType([*USAGE_LOG.fields, T.StructField("created_date", T.DateType())])


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    """A log written by ``write_usage_log``; ``created_date`` prunes folders.

    The schema is given, so a log that has no rows yet reads as empty.
    """
    return spark.read.schema(LAID_OUT).parquet(path)


def scan(
    usage: DataFrame, team: str | None = None, since: datetime | None = None
) -> DataFrame:
    """Rows of one team (or all) from a moment on; there is no upper bound.

    When the log is laid out by day the day is filtered too, which is what
    skips folders.
    """
    if since is not None:
        usage = usage.filter(F.col("created_at") >= F.lit(since))
        if "created_date" in usage.columns:
            # Both days in the session's zone, whatever zone the moment was given in.
            usage = usage.filter(F.col("created_date") >= F.to_date(F.lit(since)))
    if team is not None:
        usage = usage.filter(F.col("team_id") == team)
    return usage


def checked(usage: DataFrame) -> DataFrame:
    """Add ``violations`` and ``valid``."""
    return usage.withColumn("violations", usage_violations()).withColumn(
        "valid", F.size("violations") == 0
    )


def accepted(usage: DataFrame) -> DataFrame:
    """Rows that keep the rules, in the log's column types."""
    ok = usage.filter(F.size(usage_violations()) == 0)
    return ok.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in USAGE_LOG])


def rejected(usage: DataFrame) -> DataFrame:
    return checked(usage).filter(~F.col("valid")).drop("valid")


def with_layout(usage: DataFrame) -> DataFrame:
    return usage.withColumn("created_date", F.to_date("created_at"))


def write_usage_log(usage: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows by day, sorted by team and time within each file.

    The rebalance hint lets the runtime split a heavy day over several files
    and merge light ones, so neither one writer nor many tiny files result.
    """
    (
        with_layout(usage)
        .hint("rebalance", "created_date")
        .sortWithinPartitions("created_date", "team_id", "created_at")
        .write.mode(mode)
        .partitionBy("created_date")
        .parquet(path)
    )
