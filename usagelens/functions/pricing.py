"""Model prices, providers, routing targets and cost arithmetic."""

from __future__ import annotations

from decimal import Decimal
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# USD per one million input and output tokens.
PRICES = (
    ("openai/gpt-4o-mini", "0.15", "0.60"),
    ("openai/gpt-4o", "2.50", "10.00"),
    ("anthropic/claude-haiku-3", "0.25", "1.25"),
    ("anthropic/claude-sonnet-4", "3.00", "15.00"),
    ("groq/gpt-oss-20b", "0.075", "0.30"),
    ("groq/llama-3.3-70b-versatile", "0.59", "0.79"),
    ("groq/gpt-oss-120b", "0.15", "0.60"),
)
FALLBACK_MODEL = "anthropic/claude-haiku-3"
DEFAULT_MODEL = "anthropic/claude-haiku-3"
PROVIDERS = ("openai", "anthropic", "groq")
# Complexity class -> model.
ROUTES = (
    ("simple", "groq/gpt-oss-20b"),
    ("medium", "groq/llama-3.3-70b-versatile"),
    ("complex", "groq/gpt-oss-120b"),
)
# Internal model name -> name on the provider's wire.
WIRE_NAMES = (
    ("groq/gpt-oss-20b", "openai/gpt-oss-20b"),
    ("groq/llama-3.3-70b-versatile", "llama-3.3-70b-versatile"),
    ("groq/gpt-oss-120b", "openai/gpt-oss-120b"),
    ("anthropic/claude-haiku-3", "claude-3-haiku-20240307"),
    ("anthropic/claude-sonnet-4", "claude-sonnet-4-5"),
    ("openai/gpt-4o-mini", "gpt-4o-mini"),
    ("openai/gpt-4o", "gpt-4o"),
)

_PRICE_SCHEMA = "model string, input_per_1m decimal(12,6), output_per_1m decimal(12,6)"


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    """The price list as a table of literals."""
    rows = [(m, Decimal(i), Decimal(o)) for m, i, o in prices]
    return spark.createDataFrame(rows, _PRICE_SCHEMA)


def provider_of(model: Column) -> Column:
    out = F.lit("unknown")
    for name in PROVIDERS:
        out = F.when(F.startswith(model, F.lit(f"{name}/")), F.lit(name)).otherwise(out)
    return out


def routed_model(level: Column, routes=ROUTES, default: str = DEFAULT_MODEL) -> Column:
    out = F.lit(default)
    for name, model in routes:
        out = F.when(level == name, F.lit(model)).otherwise(out)
    return out


def wire_name(model: Column) -> Column:
    """Provider-side model name; unmapped names lose their provider prefix."""
    names = F.create_map(*[F.lit(v) for v in chain.from_iterable(WIRE_NAMES)])
    prefix = "^(?:" + "|".join(PROVIDERS) + ")/"
    return F.coalesce(F.try_element_at(names, model), F.regexp_replace(model, prefix, ""))


def with_cost(
    df: DataFrame,
    prices: DataFrame | None = None,
    model: str = "model",
    tokens_in: str = "input_tokens",
    tokens_out: str = "output_tokens",
    out: str = "cost_usd",
    fallback: str = FALLBACK_MODEL,
) -> DataFrame:
    """Add the estimated cost; a model without a price takes the fallback's.

    Without a price table the literal list is used as a map in the expression,
    so pricing needs no join. A given table is joined without a hint: Spark
    broadcasts it only if its measured size allows that.
    """
    if prices is None:
        table = F.create_map(
            *chain.from_iterable(
                (F.lit(m), F.struct(_rate(i).alias("i"), _rate(o).alias("o")))
                for m, i, o in PRICES
            )
        )
        known = F.coalesce(
            F.try_element_at(table, F.col(model)),
            F.try_element_at(table, F.lit(fallback)),
            F.struct(_rate("0").alias("i"), _rate("0").alias("o")),
        )
        priced = df.withColumn("_price", known)
        rate_in, rate_out = F.col("_price.i"), F.col("_price.o")
    else:
        # One price per model (the dearest, should the table have several), so no row is doubled.
        rates = F.max(F.struct("input_per_1m", "output_per_1m")).alias("_r")
        prices = prices.groupBy("model").agg(rates).select("model", "_r.*")
        known = prices.select(
            F.col("model").alias("_m"),
            F.col("input_per_1m").alias("_i"),
            F.col("output_per_1m").alias("_o"),
        )
        spare = prices.filter(F.col("model") == fallback)
        # The fallback's two numbers are looked up once, as scalar subqueries.
        spare_in = spare.agg(F.first("input_per_1m")).scalar()
        spare_out = spare.agg(F.first("output_per_1m")).scalar()
        none = F.lit(0).cast("decimal(12,6)")
        priced = df.join(known, F.col(model) == F.col("_m"), "left")
        rate_in = F.coalesce("_i", spare_in, none)
        rate_out = F.coalesce("_o", spare_out, none)
    total = cost(F.col(tokens_in), F.col(tokens_out), rate_in, rate_out)
    return priced.withColumn(out, total).drop("_price", "_m", "_i", "_o")


def _rate(value: str) -> Column:
    return F.lit(Decimal(value)).cast("decimal(12,6)")


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """tokens / 1e6 * rate, summed, to eight decimals."""
    micro = tokens_in.cast("decimal(10,0)") * rate_in + tokens_out.cast("decimal(10,0)") * rate_out
    return F.round(micro * F.lit(Decimal("0.000001")), 8).cast("decimal(18,8)")


def projected_month(total: Column, days: int) -> Column:
    return total / F.lit(float(days)) * F.lit(30.0) if days > 0 else F.lit(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))
