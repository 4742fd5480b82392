"""Replay of an exact cache whose entries live for a fixed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions.text import prompt_hash
from usagelens.session import stored

KEY = ["team_id", "prompt_hash"]
# Fixed value: an entry serves for a day after it was set.
TTL_SECONDS = 24 * 3600


def _followers(times: DataFrame, ttl_us: int, key: list[str]) -> DataFrame:
    """(key, moment, next): the first moment not before this one's expiry, null when there is none.

    Moments and expiries are merged inside slices of one TTL, so a prompt sent
    very often is as many groups as it has slices. An expiry that no moment of
    its slice follows takes the first moment of the next slice that has any.
    """
    slice_of = F.floor(F.col("at") / ttl_us).cast("bigint")
    marks = times.select(*key, F.col("_us").alias("at"), F.col("_us").alias("moment"), F.lit(None).cast("bigint").alias("of"))
    ends = times.select(
        *key, (F.col("_us") + ttl_us).alias("at"), F.lit(None).cast("bigint").alias("moment"), F.col("_us").alias("of")
    )
    both = marks.unionByName(ends).withColumn("slice", slice_of)
    # From the last to the first, as frames that grow are worked out row by row; shrinking ones begin anew at each row.
    onward = Window.partitionBy(*key, "slice").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("next", F.min("moment").over(onward)).filter(F.col("of").isNotNull())
    # One row per prompt and slice from here on.
    firsts = both.groupBy(*key, "slice").agg(F.min("moment").alias("first"))
    later = Window.partitionBy(*key).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*key, "slice", F.min("first").over(later).alias("carried"))
    return inside.join(carried, [*key, "slice"]).select(
        *key, F.col("of").alias("_us"), F.coalesce("next", "carried").alias("next")
    )


def settings(
    requests: DataFrame, ttl_seconds: int = TTL_SECONDS, ts: str = "created_at", key: list[str] = KEY
) -> DataFrame:
    """(key, moment) of every time an entry was set.

    A key whose moments lie within one TTL is set once. For the others, which get
    a number of their own, every moment points to the next setting, were it one
    itself. From each key's first moment the pointers are followed by doubling:
    after n rounds all settings up to 2^n - 1 steps away are known. The rounds
    end when no pointer is left, after log2(range / TTL) of them, as two settings
    are at least one TTL apart. Only pointers that lead somewhere are kept and
    written.
    """
    ttl_us = ttl_seconds * 1_000_000
    times = requests.select(*key, F.unix_micros(F.col(ts)).alias("_us")).filter(F.col("_us").isNotNull()).distinct()
    times = stored(times, "moments")
    spans = times.groupBy(*key).agg(F.min("_us").alias("_set"), F.max("_us").alias("_last"))
    spans = stored(spans.withColumn("_key", F.monotonically_increasing_id()), "spans")
    renewed = F.col("_last") - F.col("_set") >= ttl_us
    long_ = spans.filter(renewed)
    found = long_.select("_key", F.col("_set").alias("_us"))
    # Null keys are keys like others.
    same = [times[k].eqNullSafe(long_[k]) for k in key]
    moments = stored(times.join(long_, same).select("_key", "_us"), "numbered")
    jumps = _followers(moments, ttl_us, ["_key"]).filter(F.col("next").isNotNull())
    while True:
        # Settings and pointers of a round are written by one job.
        both = stored(found.withColumn("next", F.lit(None).cast("bigint")).unionByName(jumps), "settings")
        found, jumps = both.filter("next IS NULL").drop("next"), both.filter("next IS NOT NULL")
        if jumps.isEmpty():
            break
        # From the settings known so far none is met again: a round doubles the distance.
        ahead = found.join(jumps, ["_key", "_us"]).select("_key", F.col("next").alias("_us"))
        found = found.unionByName(ahead)
        twice = jumps.select("_key", F.col("_us").alias("next"), F.col("next").alias("after"))
        jumps = jumps.join(twice, ["_key", "next"]).select("_key", "_us", F.col("after").alias("next"))
    once = spans.filter(~renewed).select(*key, "_set")
    return once.unionByName(found.join(long_.select("_key", *key), "_key").select(*key, F.col("_us").alias("_set")))


def replay(
    requests: DataFrame,
    ttl_seconds: int = TTL_SECONDS,
    text: str = "prompt_text",
    ts: str = "created_at",
) -> DataFrame:
    """Per team: exact hits, first settings and settings after expiry.

    A hit does not lengthen an entry's life. Requests with the same moment as a
    setting, after it in id order, are hits.
    """
    keyed = requests.select("team_id", prompt_hash(F.col(text)).alias("prompt_hash"), ts)
    sizes = keyed.groupBy(*KEY).agg(F.count("*").alias("requests"))
    sets = settings(keyed, ttl_seconds, ts).groupBy(*KEY).agg(
        F.count("*").alias("sets")
    )
    return (
        sizes.join(sets, KEY)
        .groupBy("team_id")
        .agg(
            F.count("*").alias("prompts"),
            F.sum("requests").cast("bigint").alias("requests"),
            F.sum("sets").cast("bigint").alias("sets"),
            F.sum(F.col("requests") - F.col("sets")).cast("bigint").alias("exact_hits"),
            F.sum(F.col("sets") - 1).cast("bigint").alias("renewals"),
        )
    )
