"""Two-layer cache lookup and the reports drawn from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from usagelens.functions.text import prompt_hash
from usagelens.functions.vectors import HIT_AT, NEAR_AT, outcome, outcome_label
from usagelens.operators.nearest import Cells, nearest
from usagelens.session import stored
from usagelens.sources.vector_index import probe

KEY = ["team_id", "prompt_hash"]


def exact(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries with the entry that holds the same prompt, if any."""
    entries = cache.select(*KEY, F.col("id").alias("cache_id"))
    return queries.join(entries, KEY, "left")


def two_layer(
    queries: DataFrame,
    cache: DataFrame,
    hit_at: float = HIT_AT,
    near_at: float = NEAR_AT,
    cells: Cells | None = None,
    text: str = "prompt_text",
    vectors: DataFrame | None = None,
    index: str | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact match first, then nearest neighbour for the prompts left over.

    Every distinct (team, prompt) is looked up once, however often it was sent.
    A similarity below ``near_at`` is a clear miss and is not reported. Vectors
    come from the queries' ``embedding`` or, keyed by ``text_hash``, from a table,
    or ``embed`` makes them from (text_hash, text) of the distinct texts that are
    left over, as no other text needs one.
    ``index`` is the folder of the cache's stored vector index; without it the
    cache's vectors are searched as they come.
    """
    asked = queries.withColumn("prompt_hash", prompt_hash(F.col(text)))
    if embed is None:
        keyed = asked.select(*KEY).distinct()
    else:
        keyed = asked.groupBy(*KEY).agg(F.any_value(text).alias("_text"))
    keyed = keyed.withColumn("query_key", F.concat_ws(":", *KEY))
    first = exact(keyed, cache)
    if embed is not None:
        # Written, as the search, the embedder and the result read it.
        first = stored(first, "first-layer")
    # A team without entries has none to find, so its prompts need no vectors.
    open_ = first.filter(F.col("cache_id").isNull()).drop("cache_id").join(
        cache.select("team_id").distinct(), "team_id", "left_semi"
    )
    if embed is not None:
        once = open_.groupBy(F.col("prompt_hash").alias("text_hash")).agg(F.any_value("_text").alias("text"))
        open_ = open_.join(embed(once).withColumnRenamed("text_hash", "prompt_hash"), "prompt_hash")
    elif vectors is None:
        # Same text, same vector: one per prompt is enough.
        own = asked.groupBy(*KEY).agg(F.any_value("embedding").alias("embedding"))
        open_ = open_.join(own, KEY)
    else:
        known = vectors.select(F.col("text_hash").alias("prompt_hash"), "embedding")
        open_ = open_.join(known, "prompt_hash")
    if index is None:
        second = nearest(open_, cache, "query_key", "id", floor=near_at, cells=cells)
    else:
        kind = cache.schema["id"].dataType.simpleString()
        second = probe(open_, index, None, near_at, "query_key", key_type=kind)
    second = second.select("query_key", F.col("cache_id").alias("_near_id"), F.col("similarity").alias("_near"))
    is_exact = F.col("cache_id").isNotNull()
    similarity = F.when(is_exact, F.lit(1.0)).otherwise(F.col("_near"))
    found = (
        first.join(second, "query_key", "left")
        .withColumn("similarity", similarity)
        .withColumn("layer", F.when(is_exact, F.lit("exact_hash")).when(F.col("_near") >= hit_at, F.lit("semantic")))
        .withColumn("outcome", outcome(F.col("similarity"), hit_at, near_at))
        .withColumn("matched_id", F.coalesce(F.col("cache_id"), F.col("_near_id")))
        .select(*KEY, "layer", "outcome", "similarity", "matched_id")
    )
    served = {"model_used": "cached_model", "cost_usd": "cached_cost", "response_json": "cached_response"}
    served = {c: name for c, name in served.items() if c in cache.columns}
    answers = cache.select(F.col("id").alias("matched_id"), *(F.col(c).alias(name) for c, name in served.items()))
    found = found.join(answers, "matched_id", "left")
    is_hit = F.col("outcome") == "hit"
    found = (
        found.withColumn("cache_label", outcome_label(is_hit, F.col("similarity")))
        .withColumn("cache_id", F.when(is_hit, F.col("matched_id")))
        .withColumns({name: F.when(is_hit, F.col(name)) for name in served.values()})
    )
    rows = asked.drop("embedding") if vectors is None else asked
    # One row per prompt on the right; a prompt sent very often makes a heavy
    # partition on the left, which adaptive execution splits.
    return rows.join(found, KEY, "left")


def near_misses(lookups: DataFrame, cache: DataFrame, text: str = "prompt_text") -> DataFrame:
    """Rejected look-alikes with both texts."""
    cached = cache.select(
        F.col("id").alias("matched_id"), F.col("prompt_text").alias("cached_text")
    )
    return lookups.filter(F.col("outcome") == "near_miss").join(cached, "matched_id")


def threshold_sweep(
    best: DataFrame, thresholds: list[float], near_at: float = NEAR_AT
) -> DataFrame:
    """Hits, near misses and wrong-label hits for each candidate threshold.

    ``best`` has each query's top ``similarity`` and ``same_label``. All
    thresholds are counted in one pass, side by side.
    """
    sim = F.col("similarity")
    counts = []
    for i, t in enumerate(thresholds):
        hit = sim >= t
        counts += [
            F.count_if(hit).alias(f"h{i}"),
            F.count_if((sim >= near_at) & ~hit).alias(f"n{i}"),
            F.count_if(hit & ~F.col("same_label")).alias(f"w{i}"),
        ]
    wide = best.agg(F.count("*").alias("lookups"), *counts)
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"h{i}").alias("hits"),
                F.col(f"n{i}").alias("near_misses"),
                F.col(f"w{i}").alias("mismatched"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    tall = wide.select("lookups", F.explode(rows).alias("r")).select("lookups", "r.*")
    rate = F.when(F.col("hits") > 0, F.col("mismatched") / F.col("hits")).otherwise(F.lit(0.0))
    return tall.withColumn("false_hit_rate", rate)


def quality(lookups: DataFrame) -> DataFrame:
    """Near misses and the mean similarity of hits, per team."""
    return lookups.groupBy("team_id").agg(
        F.count_if(F.col("outcome") == "hit").alias("hits"),
        F.count_if(F.col("outcome") == "near_miss").alias("near_misses"),
        F.avg(F.when(F.col("outcome") == "hit", F.col("similarity"))).alias("avg_similarity_on_hits"),
    )


def counters(lookups: DataFrame) -> DataFrame:
    """Lookup counters per team, one row per (series, label).

    A first-layer miss is counted even when the second layer hits.
    """
    exact_hit = F.col("layer") == "exact_hash"
    semantic = (F.col("layer") == "semantic") & (F.col("outcome") == "hit")
    wide = lookups.groupBy("team_id").agg(
        F.count_if(exact_hit).alias("exact"),
        F.count_if(semantic).alias("semantic"),
        F.count_if(~F.coalesce(exact_hit, F.lit(False))).alias("first_miss"),
        F.count_if(F.col("outcome") == "near_miss").alias("near"),
        F.count_if(F.col("outcome") != "hit").alias("true_miss"),
    )
    series = [
        ("cache_hits_total", "exact_hash", "exact"),
        ("cache_hits_total", "semantic", "semantic"),
        ("cache_misses_total", "", "first_miss"),
        ("cache_near_misses_total", "intent_mismatch", "near"),
        ("cache_true_misses_total", "", "true_miss"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(l).alias("label"), F.col(c).alias("value"))
            for m, l, c in series
        ]
    )
    return wide.select("team_id", F.explode(rows).alias("r")).select("team_id", "r.*")
