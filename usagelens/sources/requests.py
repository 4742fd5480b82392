"""Chat requests: decoding, checks, prompts, replies and provider bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.functions.pricing import provider_of, wire_name
from usagelens.schemas import (
    DEFAULT_FEATURE,
    DEFAULT_TEAM,
    MAX_BODY_BYTES,
    REQUEST_BODY,
    REQUEST_LOG_LINE,
    or_default,
)

DEFAULT_MAX_TOKENS = 1024


def first_user_message(messages: Column) -> Column:
    """Content of the first user message; null when there is none."""
    mine = F.filter(messages, lambda m: m["role"] == "user")
    return F.get(mine, F.lit(0))["content"]


def _kind(value: Column, path: str) -> Column:
    """Type name of a variant's field; null when it is absent, VOID when it is null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _is(kind: Column, *names: str) -> Column:
    """Absent and null fields take any type."""
    ok = kind.isNull() | (kind == "VOID")
    for name in names:
        ok = ok | kind.startswith(name)
    return ok


def well_typed(v: Column) -> Column:
    """Whether a parsed body is an object whose known fields have their types; other fields are free."""
    messages = F.try_variant_get(v, "$.messages", "array<variant>")
    sound = F.forall(
        messages,
        lambda m: F.coalesce(_is(F.schema_of_variant(m), "OBJECT"), F.lit(True))
        & _is(_kind(m, "$.role"), "STRING")
        & _is(_kind(m, "$.content"), "STRING"),
    )
    whole = _is(_kind(v, "$.messages"), "ARRAY") & F.coalesce(sound, F.lit(True))
    return (
        F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        & whole
        & _is(_kind(v, "$.model"), "STRING")
        & _is(_kind(v, "$.stream"), "BOOLEAN")
        & _is(_kind(v, "$.max_tokens"), "BIGINT")
        & _is(_kind(v, "$.temperature"), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    )


def decode(requests: DataFrame, body: str = "body", max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Decode bodies and give each row its ``reject_reason`` (null when good).

    Expects ``team_header``, ``feature_header`` and ``model_header``. Rows marked
    ``oversize`` (see ``gather_messages``) are too large whatever their body is.
    """
    too_large = F.coalesce(F.octet_length(body) > max_bytes, F.lit(False))
    if "oversize" in requests.columns:
        too_large = too_large | F.col("oversize")
    ok_size = ~too_large
    df = requests.withColumn("_v", F.try_parse_json(F.when(ok_size, F.col(body))))
    df = df.withColumn("_b", F.from_json(F.when(ok_size, F.col(body)), REQUEST_BODY))
    df = df.withColumn("_readable", ok_size & well_typed(F.col("_v")))
    df = df.withColumn("prompt_text", first_user_message(F.col("_b.messages")))
    reason = (
        F.when(~ok_size, F.lit("too_large"))
        .when(~F.coalesce(F.col("_readable"), F.lit(False)), F.lit("invalid_body"))
        .when(F.coalesce("prompt_text", F.lit("")) == "", F.lit("no_prompt"))
    )
    return (
        df.withColumn("team_id", or_default("team_header", DEFAULT_TEAM))
        .withColumn("feature_tag", or_default("feature_header", DEFAULT_FEATURE))
        .withColumn("model_override", F.coalesce("model_header", F.lit("")))
        .withColumn("reject_reason", reason)
        .select(
            *[c for c in requests.columns if c not in (body, "team_header", "feature_header", "model_header", "oversize")],
            "team_id",
            "feature_tag",
            "model_override",
            F.col("_b.model").alias("model"),
            F.col("_b.messages").alias("messages"),
            F.coalesce("_b.stream", F.lit(False)).alias("stream"),
            F.coalesce("_b.max_tokens", F.lit(0)).alias("max_tokens"),
            F.col("_b.temperature").alias("temperature"),
            F.col("_b.system").alias("system"),
            "prompt_text",
            "reject_reason",
        )
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNotNull())


def oversize(
    turns: DataFrame,
    request: str = "conv_id",
    role: str = "role",
    text: str = "text",
    max_bytes: int = MAX_BODY_BYTES,
) -> DataFrame:
    """Requests whose messages alone pass the body limit, with their size.

    Sizes are summed map-side, so a request made of very many rows is measured
    without being gathered.
    """
    wrapped = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.octet_length(role) + 24
    return (
        turns.groupBy(request)
        .agg(F.sum(wrapped.cast("bigint")).alias("body_bytes"))
        .filter(F.col("body_bytes") > max_bytes)
    )


def gather_messages(
    turns: DataFrame,
    request: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    max_bytes: int = MAX_BODY_BYTES,
) -> DataFrame:
    """One row per request: its messages in turn order, and whether it is ``oversize``.

    A request over the body limit is kept as a row without messages, so no one
    row gathers more than the limit; ``decode`` rejects it as too large, and its
    turns can still be worked on as rows (``oversize_turns``).
    """
    big = oversize(turns, request, role, text, max_bytes).select(request)
    message = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))
    rows = turns.join(big, request, "left_anti")
    listed = F.array_sort(F.collect_list(message))
    small = rows.groupBy(request).agg(
        F.transform(
            listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages")
    )
    return small.withColumn("oversize", F.lit(False)).unionByName(
        big.withColumn("oversize", F.lit(True)), allowMissingColumns=True
    )


def oversize_turns(
    turns: DataFrame,
    request: str = "conv_id",
    role: str = "role",
    text: str = "text",
    max_bytes: int = MAX_BODY_BYTES,
) -> DataFrame:
    """The turns of the requests that ``gather_messages`` doesn't gather."""
    return turns.join(oversize(turns, request, role, text, max_bytes).select(request), request, "left_semi")


def reply_text(response: Column) -> Column:
    """The first choice's message; empty when absent or not a string."""
    v = F.try_parse_json(response)
    content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    return F.when(
        F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")
    ).otherwise(F.lit(""))


def stored(responses: DataFrame, status: str = "status") -> DataFrame:
    """Only successful responses may enter the cache."""
    return responses.filter(F.col(status).between(200, 299))


def provider_body(df: DataFrame, model: str = "model", out: str = "provider_body") -> DataFrame:
    """Shape each request for its provider, as a JSON string.

    Anthropic bodies carry the last system message at the top and need a token
    limit; the others only change the model's name.
    """
    wire = wire_name(F.col(model))
    systems = F.filter("messages", lambda m: m["role"] == "system")
    system = F.nullif(F.element_at(systems, -1)["content"], F.lit(""))
    limit = F.nullif(F.coalesce("max_tokens", F.lit(0)), F.lit(0))
    streaming = F.when(F.col("stream"), F.lit(True))
    hoisted = F.to_json(
        F.struct(
            wire.alias("model"),
            F.coalesce(limit, F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
            F.filter("messages", lambda m: m["role"] != "system").alias("messages"),
            F.when(F.size(systems) > 0, system).alias("system"),
            streaming.alias("stream"),
        )
    )
    renamed = F.to_json(
        F.struct(
            wire.alias("model"),
            F.col("messages"),
            streaming.alias("stream"),
            limit.alias("max_tokens"),
            F.nullif(F.col("temperature"), F.lit(0.0)).alias("temperature"),
        )
    )
    provider = provider_of(F.col(model))
    body = F.when(provider == "anthropic", hoisted).when(provider != "unknown", renamed)
    return df.withColumn("provider", provider).withColumn(out, body)


def write_provider_files(shaped: DataFrame, path: str, request: str = "request_id", body: str = "provider_body") -> None:
    """One JSON line per request for offline calls, ``{"custom_id": ..., "body": ...}``, in a folder per provider.

    Requests of unknown providers have no body and are left out.
    """
    head = F.to_json(F.struct(F.col(request).cast("string").alias("custom_id")))
    line = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"body":'), F.col(body), F.lit("}"))
    rows = shaped.filter(F.col(body).isNotNull()).select("provider", line.alias("value"))
    rows.write.mode("overwrite").partitionBy("provider").text(path)


def read_provider_files(spark: SparkSession, path: str, request: str = "request_id") -> DataFrame:
    """``request_id, provider, model, system, messages`` of every line; messages in their order."""
    parsed = F.try_parse_json("value")
    messages = F.try_variant_get(parsed, "$.body.messages", "array<struct<role:string,content:string>>")
    return (
        spark.read.schema("value string, provider string").text(path)
        .select(
            F.try_variant_get(parsed, "$.custom_id", "string").alias(request),
            "provider",
            F.try_variant_get(parsed, "$.body.model", "string").alias("model"),
            F.try_variant_get(parsed, "$.body.system", "string").alias("system"),
            messages.alias("messages"),
        )
    )


def read_request_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Structured log lines (JSON) with defaults; a missing id is derived."""
    row = F.from_json(value, REQUEST_LOG_LINE)
    df = lines.select(value, row.alias("r")).select(value, "r.*")
    made_up = F.sha2(F.col(value), 256)
    return df.select(
        F.to_timestamp("time").alias("time"),
        F.coalesce(F.nullif(F.col("request_id"), F.lit("")), made_up).alias("request_id"),
        "method",
        "path",
        or_default("team_id", DEFAULT_TEAM).alias("team_id"),
        or_default("feature_tag", DEFAULT_FEATURE).alias("feature_tag"),
        F.coalesce("model", F.lit("")).alias("model"),
        "latency_ms",
        "status_code",
    )
