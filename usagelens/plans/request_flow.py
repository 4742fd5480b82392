"""From raw request bodies to usage rows, and what routing would save."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions.pii import DEFAULT_PATTERNS
from usagelens.functions.pricing import ROUTES, provider_of, routed_model, with_cost
from usagelens.functions.text import byte_tokens
from usagelens.operators import lookup, redact, routing
from usagelens.operators.embedding import Embedder, embed
from usagelens.operators.nearest import Cells
from usagelens.session import stored
from usagelens.sources import requests as R


def prepare(bodies: DataFrame, pats=DEFAULT_PATTERNS) -> DataFrame:
    """Decode, keep the good requests, redact, and take the prompt."""
    good = R.accepted(R.decode(bodies))
    clean = redact.redact_requests(good, pats=pats)
    return clean.withColumn("prompt_text", R.first_user_message(F.col("messages")))


def prompt_vectors(
    prompts: DataFrame, embedder: Embedder | None = None, text: str = "prompt_text"
) -> DataFrame:
    """(text_hash, embedding) of every distinct text, each embedded once."""
    once = prompts.groupBy(F.sha2(F.col(text), 256).alias("text_hash")).agg(
        F.any_value(text).alias("text")
    )
    return embed(once, embedder)


def usage_rows(
    prepared: DataFrame,
    cache: DataFrame,
    responses: DataFrame,
    request: str = "request_id",
    embedder: Embedder | None = None,
    cells: Cells | None = None,
    index: str | None = None,
) -> DataFrame:
    """Look up, route and price prepared requests; the result fits the usage log.

    ``responses`` has, per request, the reply's ``response_json``, ``status``
    and ``latency_ms``; a request without a reply failed and leaves no row. A
    cache hit costs what the cached entry cost and no tokens.
    """
    # Redacted prompts feed the lookup, the embedder and the result: they are
    # stored once in the shared folder rather than redacted for each.
    asked = stored(
        prepared.select(request, "created_at", "team_id", "feature_tag", "model_override", "prompt_text"), "asked"
    )
    seen = lookup.two_layer(asked, cache, cells=cells, index=index, embed=lambda texts: embed(texts, embedder))
    hit = F.col("outcome") == "hit"
    routed = routing.routed(routing.classified(seen))
    answered = routed.join(responses, request, "left").filter(hit | F.col("response_json").isNotNull())
    counted = answered.withColumn(
        "input_tokens", F.when(hit, F.lit(0)).otherwise(byte_tokens(F.col("prompt_text")))
    ).withColumn(
        "output_tokens", F.when(hit, F.lit(0)).otherwise(byte_tokens(F.col("response_json")))
    )
    priced = with_cost(counted, out="estimated")
    model = F.when(hit, F.col("cached_model")).otherwise(F.col("model"))
    return priced.select(
        F.col(request).cast("bigint").alias("id"),
        "created_at",
        "team_id",
        "feature_tag",
        model.alias("model_used"),
        provider_of(model).alias("provider"),
        "input_tokens",
        "output_tokens",
        F.when(hit, F.col("cached_cost")).otherwise(F.col("estimated")).cast("decimal(10,8)").alias("cost_usd"),
        F.coalesce("latency_ms", F.lit(0)).cast("int").alias("latency_ms"),
        hit.alias("cache_hit"),
        "complexity",
    )


def routing_savings(
    usage: DataFrame,
    baseline: str,
    routes=ROUTES,
) -> DataFrame:
    """Cost of the same traffic on one model, routed, and routed with the cache.

    Every policy is priced in the row, so nothing is multiplied.
    """
    rows = usage.withColumn("_base", F.lit(baseline)).withColumn(
        "_routed", routed_model(F.col("complexity"), routes)
    )
    rows = with_cost(rows, model="_base", out="_base_cost")
    rows = with_cost(rows, model="_routed", out="_routed_cost")
    zero = F.lit(0).cast("decimal(18,8)")
    sums = rows.groupBy("team_id").agg(
        F.count("*").alias("requests"),
        F.sum("_base_cost").alias("baseline_usd"),
        F.sum("_routed_cost").alias("routed_usd"),
        F.sum(F.when(F.col("cache_hit"), zero).otherwise(F.col("_routed_cost"))).alias("routed_cached_usd"),
    )

    def cut(column: str):
        base = F.nullif(F.col("baseline_usd").cast("double"), F.lit(0.0))
        return (F.lit(1.0) - F.col(column).cast("double") / base) * F.lit(100.0)

    return sums.withColumn("routed_reduction_pct", cut("routed_usd")).withColumn(
        "cached_reduction_pct", cut("routed_cached_usd")
    )
