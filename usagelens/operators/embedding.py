"""Embedding only what is not embedded yet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.text import prompt_hash
from usagelens.operators.replay import TTL_SECONDS, settings
from usagelens.session import stored

Embedder = Callable[[list[str]], np.ndarray]
BATCH_SIZE = 20


def word_buckets(texts: list[str], dims: int = 64) -> np.ndarray:
    """Stand-in for a model, as a function for tasks: unit vectors of hashed word counts."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in t.split(" "):
            out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dims] += 1.0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1.0, length)


def hashed_words(text: Column, dims: int = 64) -> Column:
    """The same vectors as an expression: no Python, and no shuffle.

    Every bucket is put once among the sorted bucket numbers of the words; the
    places of two that follow each other tell how many words lie between.
    """
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dims
    # One bucket more than there are, which closes the last.
    buckets = F.sort_array(F.concat(F.transform(F.split(text, " ", -1), bucket), F.sequence(F.lit(0), F.lit(dims))))
    places = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims)), lambda b: F.array_position(s, b))

    def counts(at: Column) -> Column:
        between = lambda b: (F.get(at, b + 1) - F.get(at, b) - 1).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), between)

    def unit(n: Column) -> Column:
        length = F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x))
        # Divided by a value that is worked out once for the text.
        return _let(length, lambda l: F.transform(n, lambda x: (x / l).cast("float")))

    return _let(_let(_let(buckets, places), counts), unit)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pending(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct text that has no embedding, once."""
    hashed = texts.select(F.col(text).alias("text"), prompt_hash(F.col(text)).alias("text_hash"))
    # A text repeated very often collapses before the shuffle.
    once = hashed.groupBy("text_hash").agg(F.any_value("text").alias("text"))
    return once.join(known.select("text_hash"), "text_hash", "left_anti")


def embed(
    texts: DataFrame, embedder: Embedder | None = None, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """(text_hash, embedding) of (text_hash, text) rows.

    Without an embedder the vectors are an expression; one that is given is
    called on batches of texts.
    """
    if embedder is None:
        return texts.select("text_hash", hashed_words(F.col("text")).alias("embedding"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                vectors = embedder(part["text"].tolist()).astype("float32")
                yield pd.DataFrame({"text_hash": part["text_hash"], "embedding": list(vectors)})

    return texts.select("text_hash", "text").mapInPandas(
        run, "text_hash string, embedding array<float>"
    )


def embed_missing(
    texts: DataFrame,
    known: DataFrame,
    text: str = "text",
    embedder: Embedder | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Embeddings of all distinct texts: the known ones and the new ones.

    The result is keyed by text hash, so vectors are not copied to every row
    that repeats a text. ``known`` is read once.
    """
    hashed = texts.select(F.col(text).alias("text"), prompt_hash(F.col(text)).alias("text_hash"))
    once = hashed.groupBy("text_hash").agg(F.any_value("text").alias("text"))
    found = once.join(known.select("text_hash", F.col("embedding").alias("_known")), "text_hash", "left")
    if embedder is None:
        vector = F.coalesce("_known", F.when(F.col("_known").isNull(), hashed_words(F.col("text"))))
        source = F.when(F.col("_known").isNotNull(), F.lit("cached")).otherwise(F.lit("computed"))
        return found.select("text_hash", vector.alias("embedding"), source.alias("source"))
    # A function is called for the open texts only, so they are parted first; written, as both parts read them.
    found = stored(found, "texts")
    old = found.filter(F.col("_known").isNotNull()).select("text_hash", F.col("_known").alias("embedding"))
    new = embed(found.filter(F.col("_known").isNull()), embedder, batch_size)
    return old.withColumn("source", F.lit("cached")).unionByName(new.withColumn("source", F.lit("computed")))


def embedding_times(
    requests: DataFrame,
    known: DataFrame,
    ttl_seconds: int = TTL_SECONDS,
    text: str = "text",
    ts: str = "created_at",
) -> DataFrame:
    """Each request with the moment ``computed_at`` its text's embedding was made, and where it came from.

    An embedding serves for ``ttl_seconds`` from that moment on; a request that
    finds none that is still valid makes a new one, which later requests share,
    those of the same moment too (the first of them in no order counts as the
    one that made it, so all of them are ``computed``). ``known(text_hash,
    computed_at)`` holds embeddings made before the requests.

    Requests meet settings by an as-of join on the validity: two settings of a
    text are at least the validity apart, so a slice of time of that length
    holds one, and a request looks at its own slice and the one before.
    """
    asked = requests.withColumn("text_hash", prompt_hash(F.col(text)))
    before = known.groupBy("text_hash").agg(F.max("computed_at").alias(ts))
    moments = asked.select("text_hash", ts).unionByName(
        before.join(asked.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", ts)
    )
    ttl_us = ttl_seconds * 1_000_000
    slice_of = F.floor(F.col("_set") / ttl_us).cast("bigint")
    made = settings(moments, ttl_seconds, ts, ["text_hash"]).withColumn("_slice", slice_of)
    made = made.select("text_hash", "_set", F.explode(F.array(F.col("_slice"), F.col("_slice") + 1)).alias("_slice"))
    us = F.unix_micros(F.col(ts))
    placed = asked.withColumn("_slice", F.floor(us / ttl_us).cast("bigint"))
    valid = (F.col("_set") <= us) & (us < F.col("_set") + ttl_us)
    joined = placed.join(made, ["text_hash", "_slice"]).filter(valid)
    source = F.when(F.col("_set") == us, F.lit("computed")).otherwise(F.lit("cached"))
    return joined.select(
        *requests.columns, "text_hash", F.timestamp_micros("_set").alias("computed_at"), source.alias("source")
    )


def embed_valid(
    requests: DataFrame,
    known: DataFrame,
    ttl_seconds: int = TTL_SECONDS,
    text: str = "text",
    ts: str = "created_at",
    embedder: Embedder | None = None,
) -> DataFrame:
    """(text_hash, computed_at, embedding, requests) of every embedding that the requests use.

    One row, and one call, per text and validity. A text asked for very often is
    pre-aggregated; rows of ``known`` bring their own vectors.
    """
    timed = embedding_times(requests, known, ttl_seconds, text, ts)
    used = timed.groupBy("text_hash", "computed_at").agg(
        F.count("*").alias("requests"), F.any_value(text).alias("text")
    )
    latest = known.groupBy("text_hash", "computed_at").agg(F.any_value("embedding").alias("_known"))
    used = used.join(latest, ["text_hash", "computed_at"], "left")
    if embedder is None:
        fresh = F.when(F.col("_known").isNull(), hashed_words(F.col("text")))
        return used.select("text_hash", "computed_at", F.coalesce("_known", fresh).alias("embedding"), "requests")
    used = stored(used, "texts")
    new = embed(used.filter(F.col("_known").isNull()).dropDuplicates(["text_hash"]), embedder)
    return used.join(new, "text_hash", "left").select(
        "text_hash", "computed_at", F.coalesce("_known", "embedding").alias("embedding"), "requests"
    )


def request_counts(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Embedding requests answered from the table (hit) or not (miss)."""
    per_text = texts.groupBy(prompt_hash(F.col(text)).alias("text_hash")).agg(F.count("*").alias("n"))
    flag = known.select("text_hash", F.lit(True).alias("_known"))
    label = F.when(F.col("_known"), F.lit("hit")).otherwise(F.lit("miss"))
    return (
        per_text.join(flag, "text_hash", "left")
        .groupBy(label.alias("cache_hit"))
        .agg(F.sum("n").cast("bigint").alias("requests"))
    )
