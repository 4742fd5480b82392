"""Small helpers the operators share: tables, scratch tables, free column names, slices of Arrow batches."""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import scratch_path

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame doesn't have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; a text without other letters than ASCII takes the cheap way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def row_key(id_: Column, text: Column) -> Column:
    """A key of the id and the text that is never null: joins decisions about a row back to the row.

    Rows with the same id and different texts get different keys; exact repeats share one.
    """
    content = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("-")), content.cast("string"))


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most `most` characters (a longer row is a run of its own)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
