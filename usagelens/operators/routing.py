"""Classify prompts, choose models, and audit models and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions import text as T
from usagelens.functions.pricing import DEFAULT_MODEL, ROUTES, provider_of, routed_model

HEALTH_PATH = "/health"


def classified(
    prompts: DataFrame,
    text: str = "prompt_text",
    simple_below: int = T.SIMPLE_BELOW,
    complex_above: int = T.COMPLEX_ABOVE,
) -> DataFrame:
    """Add the four text features and ``complexity``."""
    t = F.col(text)
    return (
        prompts.withColumn("tokens", T.word_tokens(t))
        .withColumn("fence", T.code_fence(t))
        .withColumn("score", T.keyword_score(t))
        .withColumn("steps", T.multi_step(t))
        .withColumn(
            "complexity",
            T.complexity(
                F.col("tokens"),
                F.col("fence"),
                F.col("score"),
                F.col("steps"),
                simple_below,
                complex_above,
            ),
        )
    )


def routed(
    prompts: DataFrame,
    override: str = "model_override",
    routes=ROUTES,
    default: str = DEFAULT_MODEL,
) -> DataFrame:
    """Add ``model``, ``provider`` and ``reason``; a given override wins."""
    forced = F.coalesce(F.col(override), F.lit("")) != ""
    level = F.col("complexity")
    by_level = F.when(
        level.isin(*[name for name, _ in routes]), F.concat(level, F.lit("_prompt"))
    ).otherwise(F.lit("default_model"))
    model = F.when(forced, F.col(override)).otherwise(routed_model(level, routes, default))
    return (
        prompts.withColumn("model", model)
        .withColumn("provider", provider_of(F.col("model")))
        .withColumn("reason", F.when(forced, F.lit("model_override")).otherwise(by_level))
    )


def unknown_models(routed_rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Requests per model that has no price."""
    priced = prices.select(F.col("model").alias(model)).distinct()
    return (
        routed_rows.groupBy(model)
        .agg(F.count("*").alias("requests"))
        .join(priced, model, "left_anti")
    )


def key_audit(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests refused for a missing or unknown key, by key fingerprint.

    No keys at all means open mode: nothing is refused.
    """
    key = F.coalesce("api_key", F.lit(""))
    known = key.isin(*keys) if keys else F.lit(True)
    refused = requests.filter((F.col("path") != HEALTH_PATH) & ((key == "") & F.lit(bool(keys)) | ~known))
    print_ = F.when(key == "", F.lit("")).otherwise(F.substring(F.sha2(key, 256), 1, 8))
    why = F.when(key == "", F.lit("missing")).otherwise(F.lit("invalid"))
    return refused.groupBy("team_id", why.alias("problem"), print_.alias("key_sha256_prefix")).agg(
        F.count("*").alias("requests")
    )
