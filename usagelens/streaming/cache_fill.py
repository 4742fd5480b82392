"""Filling the prompt cache from a stream of answered requests."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from usagelens.functions.text import prompt_hash
from usagelens.functions.vectors import HIT_AT, NEAR_AT
from usagelens.operators.embedding import Embedder, embed
from usagelens.sources.cache_store import CacheStore
from usagelens.sources.prompt_cache import KEY, entry_id
from usagelens.streaming.run import each_batch

#: What a reply adds to an entry.
REPLY = ["response_json", "model_used", "input_tokens", "output_tokens", "cost_usd"]


def fill(
    requests: DataFrame,
    store: CacheStore,
    checkpoint: str,
    hit_at: float = HIT_AT,
    near_at: float = NEAR_AT,
    embedder: Embedder | None = None,
    compact_every: int | None = None,
) -> CacheStore:
    """Look each micro-batch up in the cache as it stood, then add what missed.

    A prompt is looked up once per batch, however often it was sent: by its hash,
    else by the vector index. A hit of either layer counts for the entry that
    serves it. What missed both and was answered well becomes one entry, that of
    its earliest answer, as concurrent inserts would. Entries, hits and vectors
    are written under the batch's id, so a batch that is tried again changes
    nothing. Every ``compact_every`` batches the older versions are joined.
    """
    spark = requests.sparkSession
    store.begin()

    def work(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            store.compact(batch_id)
        ok = F.col("status").between(200, 299)
        first = F.struct("created_at", "event_id", "prompt_text", *REPLY)
        known = store.entries(batch_id).select("id", *KEY)
        # One row per prompt before the cache is read, however often it was sent.
        asked = (
            batch.withColumn("prompt_hash", prompt_hash(F.col("prompt_text")))
            .groupBy(*KEY)
            .agg(
                F.count("*").alias("new_hits"),
                F.min(F.when(ok, first)).alias("_first"),
                F.any_value("prompt_text").alias("text"),
            )
            .join(known, KEY, "left")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        open_ = asked.filter(F.col("id").isNull()).withColumn("key", entry_id())
        vectors = embed(open_.select(F.col("prompt_hash").alias("text_hash"), "text").dropDuplicates(["text_hash"]), embedder)
        open_ = open_.join(vectors.withColumnRenamed("text_hash", "prompt_hash"), "prompt_hash").persist(
            StorageLevel.MEMORY_AND_DISK
        )
        try:
            # Prompts of one vector have the same neighbour, so it is searched once.
            alike = open_.groupBy("team_id", "embedding").agg(F.min("key").alias("_asked")).persist(StorageLevel.MEMORY_AND_DISK)
            near = store.similar(alike, near_at, "_asked", batch_id).select("_asked", "cache_id", "similarity")
            near = alike.join(near, "_asked").select("team_id", "embedding", "cache_id", "similarity")
            looked = open_.drop("id").join(near, ["team_id", "embedding"], "left").persist(StorageLevel.MEMORY_AND_DISK)
            is_hit = F.coalesce(F.col("similarity") >= hit_at, F.lit(False))
            exact = asked.filter(F.col("id").isNotNull()).select("id", F.lit("exact_hash").alias("layer"), "new_hits")
            semantic = looked.filter(is_hit).groupBy(F.col("cache_id").alias("id"), F.lit("semantic").alias("layer"))
            store.add_hits(exact.unionByName(semantic.agg(F.sum("new_hits").alias("new_hits"))), batch_id)
            fresh = looked.filter(~is_hit & F.col("_first").isNotNull())
            store.add(fresh.select(F.col("key").alias("id"), *KEY, "embedding", "_first.*"), batch_id)
            looked.unpersist()
            alike.unpersist()
        finally:
            open_.unpersist()
            asked.unpersist()

    each_batch(requests, work, checkpoint)
    return store
