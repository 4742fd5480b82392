"""Table layouts, column defaults and the row rules of the usage log."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Defaults and domains of the data model.
DEFAULT_TEAM = "default"
DEFAULT_FEATURE = "untagged"
DEFAULT_COMPLEXITY = "medium"
COMPLEXITIES = ("simple", "medium", "complex")
MAX_BODY_BYTES = 10 * 1024 * 1024

USAGE_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("team_id", T.StringType()),
        T.StructField("feature_tag", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("cost_usd", T.DecimalType(10, 8)),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("complexity", T.StringType()),
    ]
)

PROMPT_CACHE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("prompt_text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("response_json", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("cost_usd", T.DecimalType(10, 8)),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("hit_count", T.IntegerType()),
        T.StructField("team_id", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)

REQUEST_BODY = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("stream", T.BooleanType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("system", T.StringType()),
    ]
)

REQUEST_LOG_LINE = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("team_id", T.StringType()),
        T.StructField("feature_tag", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("status_code", T.IntegerType()),
    ]
)


def or_default(col: Column | str, default: str) -> Column:
    """Absent and empty both take the default; nothing is trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def usage_violations() -> Column:
    """Names of the usage-log rules a row breaks, in a fixed order."""
    required = ["created_at"] + [
        f.name for f in USAGE_LOG if f.name not in ("id", "created_at")
    ]
    checks = [
        F.when(F.col(c).isNull(), F.lit(f"{c}:null")) for c in required
    ]
    checks += [
        F.when(F.col(c) < 0, F.lit(f"{c}:negative"))
        for c in ("input_tokens", "output_tokens", "cost_usd", "latency_ms")
    ]
    checks.append(F.when(F.abs(F.col("cost_usd")) >= 100, F.lit("cost_usd:too_large")))
    checks.append(
        F.when(~F.col("complexity").isin(*COMPLEXITIES), F.lit("complexity:domain"))
    )
    return F.array_compact(F.array(*checks))
