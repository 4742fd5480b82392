"""Starting streams, and reading back what a finite run wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from usagelens.session import scratch_path


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    glob: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a table, be it one file or a folder of files.

    A stream's path must be a folder, unless it is a pattern; so it is made one that only this name fits.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(
    stream: DataFrame,
    mode: str = "append",
    checkpoint: str | None = None,
    out: str | None = None,
) -> DataFrame:
    """Run the stream over what is there now and return what it emitted.

    Each micro-batch is written under its own id, so a batch that is tried again
    after a failure replaces itself. What is returned is read from ``out``, so a
    run that goes on from a checkpoint returns the rows of earlier runs as well.
    In complete mode the last batch is the result; otherwise all batches are.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream-out")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # An empty first batch, so the folder is there whatever comes.
    save(spark.createDataFrame([], stream.schema), -1)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    rows = spark.read.schema(schema).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch_id").alias("last"))
        rows = rows.filter(F.col("batch_id") == last.scalar())
    return rows.drop("batch_id")


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Run ``work`` on every micro-batch until the input is used up."""
    (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(work)
        .start()
        .awaitTermination()
    )
