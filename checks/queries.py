"""One query per operator, each over whole sample tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.functions import pii, pricing, text as T, vectors as V
from usagelens.functions.timerange import range_days, since_days, since_hours
from usagelens.operators import (
    alerts,
    costs,
    embedding,
    lookup,
    metrics,
    nearest,
    ratelimit,
    redact,
    replay,
    reports,
    routing,
)
from usagelens.plans import request_flow, workload as W
from usagelens.session import ROCKSDB, conf, scratch_path, stored
from usagelens.sources import cache_store, prompt_cache as PC, requests as R, usage_log as U, vector_index
from usagelens.streaming import cache_fill, run, stateful, usage as SU

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The sample covers 30 days; this range holds all of it.
RANGE = "30d"
DAYS = range_days(RANGE)
THRESHOLDS = [0.86, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98]
PROBED = 4
#: Tables that are stored once per session and folder, as a service keeps them: place by (session, folder, name).
_KEPT: dict[tuple[str, str, str], str] = {}


def _kept(spark, folder, name, make):
    """Where the stored table is; ``make(place)`` writes it the first time."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _KEPT:
        place = scratch_path(spark, name)
        make(place)
        _KEPT[key] = place
    return _KEPT[key]


def query(f: Query) -> Query:
    def ready(spark: SparkSession, folder: str) -> DataFrame:
        # Days and labels are in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, folder)

    QUERIES[f.__name__] = ready
    return ready


def _usage(spark, folder):
    """The log from the range's start on, all teams."""
    log = W.view(spark, folder, "usage_log")
    return U.scan(log, since=since_days(W.AS_OF, RANGE))


def _double(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def _when(name, fmt="yyyy-MM-dd HH:mm:ss"):
    return F.date_format(name, fmt).alias(name)


def _money(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles, so engines compare."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f.name)
            for f in df.schema
        ]
    )


# ---- sources and row checks


@query
def usage_scan_team_since(spark, folder):
    log = U.with_layout(W.view(spark, folder, "usage_log"))
    rows = U.scan(log, "default", since_days(W.AS_OF, "7d"))
    return _money(rows.select("id", "team_id", "model_used", "cost_usd", "latency_ms"))


@query
def usage_validate(spark, folder):
    rows = U.checked(W.view(spark, folder, "usage_raw"))
    return rows.select("id", "valid", F.array_join("violations", ",").alias("violations"))


@query
def usage_write_layout(spark, folder):
    path = scratch_path(spark, "usage-log")
    U.write_usage_log(W.view(spark, folder, "usage_log"), path)
    back = U.read_usage_log(spark, path)
    return _money(
        back.groupBy(F.date_format("created_date", "yyyy-MM-dd").alias("day"), "team_id").agg(
            F.count("*").alias("requests"), F.sum("cost_usd").alias("cost_usd")
        )
    )


@query
def requests_ingest(spark, folder):
    good = R.accepted(R.decode(W.bodies(spark, folder)))
    return good.select(
        "request_id", "team_id", "feature_tag", "model_override", "stream", "max_tokens",
        F.size("messages").alias("n_messages"), "prompt_text",
    )


@query
def rejected_requests(spark, folder):
    bad = R.rejected(R.decode(W.bodies(spark, folder)))
    return bad.select("request_id", "team_id", "reject_reason")


# A limit that some sample conversations pass.
SMALL_BODY = 4000


@query
def rejected_oversize(spark, folder):
    bad = R.rejected(R.decode(W.bodies(spark, folder, max_bytes=SMALL_BODY)))
    return bad.filter(F.col("reject_reason") == "too_large").select("request_id", "reject_reason")


@query
def response_content(spark, folder):
    turns = W.table(spark, folder, "conversations")
    choice = F.struct(F.struct(F.col("role"), F.col("text").alias("content")).alias("message"))
    shapes = (
        F.when(F.col("turn") % 7 == 3, F.lit('{"choices":[]}'))
        .when(F.col("turn") % 7 == 5, F.lit("not json"))
        .otherwise(F.to_json(F.struct(F.array(choice).alias("choices"))))
    )
    return turns.select("conv_id", "turn", R.reply_text(shapes).alias("content"))


@query
def request_log_ingest(spark, folder):
    ev = W.view(spark, folder, "request_events")
    line = F.to_json(
        F.struct(
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
            F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
            "method",
            "path",
            F.when(F.col("team_id") != "default", F.col("team_id")).alias("team_id"),
            F.when(F.col("event_id") % 2 == 0, F.lit("chat")).otherwise(F.lit("")).alias("feature_tag"),
            F.pmod("event_id", F.lit(900)).alias("latency_ms"),
            F.col("status").alias("status_code"),
        )
    )
    log = R.read_request_log(ev.select(line.alias("value")))
    return log.select(_when("time"), "request_id", "path", "team_id", "feature_tag", "model", "latency_ms", "status_code")


@query
def api_key_audit(spark, folder):
    ev = W.view(spark, folder, "request_events")
    return routing.key_audit(ev, ["key-1", "key-2", "key-3", "key-4"])


# ---- prompt features, routing, price


def _prompts(spark, folder):
    return W.view(spark, folder, "prompts")


@query
def prompt_hash(spark, folder):
    h = T.prompt_hash(F.col("prompt_text"))
    return _prompts(spark, folder).select(
        "prompt_id", h.alias("prompt_hash"), T.cache_key(F.lit("default"), h).alias("cache_key"),
        T.embedding_key(h).alias("embedding_key"),
    )


@query
def word_tokens(spark, folder):
    return _prompts(spark, folder).select("prompt_id", T.word_tokens(F.col("prompt_text")).cast("bigint").alias("tokens"))


@query
def byte_tokens(spark, folder):
    return _prompts(spark, folder).select("prompt_id", T.byte_tokens(F.col("prompt_text")).cast("bigint").alias("tokens"))


@query
def code_fence(spark, folder):
    return _prompts(spark, folder).select("prompt_id", T.code_fence(F.col("prompt_text")).alias("fence"))


@query
def keyword_score(spark, folder):
    return _prompts(spark, folder).select("prompt_id", T.keyword_score(F.col("prompt_text")).cast("bigint").alias("score"))


@query
def multi_step(spark, folder):
    return _prompts(spark, folder).select("prompt_id", T.multi_step(F.col("prompt_text")).alias("steps"))


@query
def complexity_class(spark, folder):
    return routing.classified(_prompts(spark, folder)).select("prompt_id", "complexity")


def _routed(spark, folder):
    return routing.routed(routing.classified(_prompts(spark, folder)))


@query
def route_models(spark, folder):
    return _routed(spark, folder).select("prompt_id", "model", "provider", "reason")


@query
def provider_of(spark, folder):
    return _routed(spark, folder).groupBy("provider").agg(F.count("*").alias("requests"))


@query
def estimate_cost(spark, folder):
    rows = _routed(spark, folder).select(
        "prompt_id", "model",
        T.byte_tokens(F.col("prompt_text")).alias("input_tokens"),
        T.word_tokens(F.col("prompt_text")).alias("output_tokens"),
    )
    return _money(pricing.with_cost(rows, pricing.price_table(spark)))


@query
def classify_route_cost(spark, folder):
    rows = _routed(spark, folder).withColumn("input_tokens", T.byte_tokens(F.col("prompt_text")))
    rows = pricing.with_cost(rows.withColumn("output_tokens", F.col("tokens")))
    return _money(
        rows.groupBy("model", "provider", "reason").agg(
            F.count("*").alias("requests"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("cost_usd").alias("cost_usd"),
        )
    )


@query
def unknown_models(spark, folder):
    return routing.unknown_models(_routed(spark, folder), pricing.price_table(spark))


@query
def provider_export(spark, folder):
    good = R.accepted(R.decode(W.bodies(spark, folder)))
    third = F.element_at(
        F.array(F.lit("anthropic/claude-haiku-3"), F.lit("groq/gpt-oss-20b"), F.lit("openai/gpt-4o-mini")),
        (F.floor(F.col("request_id") / 3) % 3 + 1).cast("int"),
    )
    shaped = R.provider_body(good.withColumn("model", third))
    parsed = F.try_parse_json("provider_body")

    def field(path, kind):
        return F.try_variant_get(parsed, path, kind)

    return shaped.select(
        "request_id",
        "provider",
        field("$.model", "string").alias("wire_model"),
        field("$.max_tokens", "bigint").alias("max_tokens"),
        F.size(field("$.messages", "array<variant>")).cast("bigint").alias("n_messages"),
        field("$.system", "string").alias("system"),
        field("$.stream", "boolean").alias("stream"),
    )


@query
def provider_files(spark, folder):
    good = R.accepted(R.decode(W.bodies(spark, folder)))
    models = F.array(F.lit("anthropic/claude-haiku-3"), F.lit("groq/gpt-oss-20b"), F.lit("openai/gpt-4o-mini"))
    shaped = R.provider_body(good.withColumn("model", F.element_at(models, (F.col("request_id") % 3 + 1).cast("int"))))
    path = scratch_path(spark, "provider-files")
    R.write_provider_files(shaped, path)
    back = R.read_provider_files(spark, path)
    return back.select("request_id", "provider", "model", "system", F.posexplode("messages").alias("pos", "m")).select(
        F.col("request_id").cast("bigint").alias("request_id"), "provider", "model", "system",
        F.col("pos").cast("bigint").alias("pos"), F.col("m.role").alias("role"), F.col("m.content").alias("text"),
    )


# ---- redaction


def _one_pattern(name):
    def run_(spark, folder):
        (p,) = [x for x in pii.DEFAULT_PATTERNS if x.name == name]
        out = redact.redact_column(W.view(spark, folder, "docs_pii"), "text", [p])
        return out.select("doc_id", "text", "unique_tokens")

    return run_


for _query, _name in (
    ("redact_url", "url_credentials"),
    ("redact_api_key", "api_key"),
    ("redact_email", "email"),
    ("redact_card", "credit_card"),
    ("redact_ssn", "ssn"),
    ("redact_phone", "phone_us"),
    ("redact_ipv4", "ipv4"),
):
    _f = _one_pattern(_name)
    _f.__name__ = _query
    query(_f)


@query
def luhn_valid(spark, folder):
    ev = W.table(spark, folder, "events")
    digits = (F.lit(4000000000000000) + F.col("event_id") * 7919).cast("string")
    return ev.select("event_id", pii.luhn_valid(digits).alias("valid"))


def _redacted_docs(spark, folder):
    return redact.redact_column(W.view(spark, folder, "docs_pii"), "text")


@query
def redact_documents(spark, folder):
    return _redacted_docs(spark, folder).select("doc_id", "text", "unique_tokens")


@query
def redaction_map_json(spark, folder):
    return _redacted_docs(spark, folder).select(
        "doc_id",
        redact.map_header(F.col("redaction_map")).alias("map_header"),
        (F.size("redaction_map") > 0).alias("has_redactions"),
    )


@query
def redact_conversations(spark, folder):
    out = redact.redact_turns(W.view(spark, folder, "conv_turns"))
    return out.select("conv_id", "turn", "text", "has_redactions")


@query
def redact_request_rows(spark, folder):
    """Every request: those above the limit, some of the sample's, are worked on as rows of turns."""
    out = redact.redact_messages(W.view(spark, folder, "conv_turns"), max_bytes=SMALL_BODY)
    return out.select("conv_id", F.col("pos").cast("int").alias("pos"), "role", "text", "unique_tokens")


@query
def redact_restore(spark, folder):
    docs = W.view(spark, folder, "docs_pii")
    # Kept until the replies are there, as both sides of the restoring join read it.
    clean = stored(redact.redact_column(docs, "text").select("doc_id", "text", "redaction_map"), "redacted")
    replies = clean.select("doc_id", F.col("text").alias("response"))
    return redact.restore_responses(replies, clean, "doc_id")


@query
def redact_disabled_patterns(spark, folder):
    pats = pii.patterns(disabled=["ipv4", " phone_us"])
    out = redact.redact_column(W.view(spark, folder, "docs_pii"), "text", pats)
    return out.select("doc_id", "text", "unique_tokens")


EXTRA = pii.Pattern("question_no", "QUESTION", r"question [0-9]+")


@query
def redact_extra_pattern(spark, folder):
    ev = W.view(spark, folder, "request_events")
    out = redact.redact_column(ev, "prompt_text", pii.patterns(extra=[EXTRA]))
    return out.select("event_id", "prompt_text", "unique_tokens")


@query
def redact_bad_input(spark, folder):
    bodies = W.bodies(spark, folder, "conv_turns")
    body = F.when(F.col("request_id") % 11 != 0, F.col("body"))
    out = redact.redact_bodies(bodies.withColumn("body", body), fail_closed=True)
    return out.select(
        "request_id", "redaction_error", "blocked", "unique_tokens",
        F.contains("body", F.lit("[EMAIL_1]")).alias("masked"),
    )


def _body_messages(df):
    parsed = F.try_parse_json("body")
    messages = F.try_variant_get(parsed, "$.messages", "array<struct<role:string,content:string>>")
    return df.select("request_id", F.posexplode(messages).alias("pos", "m")).select(
        "request_id", F.col("pos").cast("bigint").alias("pos"), F.col("m.role").alias("role"), F.col("m.content").alias("text")
    )


def _some_unread(spark, folder):
    bodies = W.bodies(spark, folder, "conv_turns")
    return bodies.withColumn("body", F.when(F.col("request_id") % 11 != 0, F.col("body")))


@query
def redact_bodies_open(spark, folder):
    return _body_messages(redact.redact_bodies(_some_unread(spark, folder)))


@query
def redact_bodies_closed(spark, folder):
    """What may be sent on: a body that could not be read is blocked, one that is no JSON passes as it is."""
    out = redact.redact_bodies(_some_unread(spark, folder), fail_closed=True)
    return out.select("request_id", "blocked", F.col("body").isNotNull().alias("sent"), F.substring("body", 1, 2).alias("opening"))


@query
def redact_switched_off(spark, folder):
    return _body_messages(redact.redact_bodies(_some_unread(spark, folder), enabled=False))


def _odd_number(values):
    """A check in Python: the question's number is odd."""
    return values.str.extract(r"([0-9]+)$")[0].astype("int64") % 2 == 1


@query
def redact_checked_pattern(spark, folder):
    ev = W.view(spark, folder, "request_events")
    out = redact.redact_checked(ev, "prompt_text", "event_id", EXTRA, _odd_number)
    return out.select("event_id", "prompt_text", "unique_tokens", redact.map_header(F.col("redaction_map")).alias("map_header"))


@query
def pii_counts_by_type_team(spark, folder):
    return redact.pii_counts(_redacted_docs(spark, folder))


@query
def requests_with_pii(spark, folder):
    return redact.requests_with_pii(_redacted_docs(spark, folder))


@query
def redaction_errors(spark, folder):
    bodies = W.bodies(spark, folder)
    body = F.when(F.col("request_id") % 11 != 0, F.col("body"))
    return redact.redaction_errors(redact.redact_bodies(bodies.withColumn("body", body)))


# ---- cost, cache, model, latency and team reports


@query
def cost_total(spark, folder):
    return costs.total(_usage(spark, folder)).select(*_double("cost_usd"))


@query
def cost_by_model(spark, folder):
    return _money(costs.by(_usage(spark, folder), "model"))


@query
def cost_by_feature(spark, folder):
    return _money(costs.by(_usage(spark, folder), "feature"))


@query
def cost_by_day(spark, folder):
    out = costs.by(_usage(spark, folder), "day")
    return _money(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@query
def cache_savings(spark, folder):
    return costs.savings(_usage(spark, folder)).select(*_double("savings_usd"))


@query
def cost_summary(spark, folder):
    out = costs.summary(_usage(spark, folder), DAYS)
    return _money(out.withColumn("projected_monthly_usd", F.round("projected_monthly_usd", 6)))


def _breakdown(group):
    def run_(spark, folder):
        out = costs.breakdown(_usage(spark, folder), group)
        avg = F.round(F.col("avg_cost_per_request").cast("double"), 9)
        return _money(out.withColumn("avg_cost_per_request", avg))

    return run_


for _group in ("model", "feature", "day"):
    _f = _breakdown(_group)
    _f.__name__ = f"breakdown_{_group}"
    query(_f)


@query
def cache_stats(spark, folder):
    out = reports.cache_stats(_usage(spark, folder))
    return out.withColumn("hit_rate_pct", F.round("hit_rate_pct", 6))


@query
def cache_stats_last_day(spark, folder):
    log = W.view(spark, folder, "usage_log")
    out = reports.cache_stats(U.scan(log, since=since_hours(W.AS_OF, "24h")))
    return out.withColumn("hit_rate_pct", F.round("hit_rate_pct", 6))


@query
def top_cached_prompts(spark, folder):
    return _money(reports.top_cached_prompts(W.view(spark, folder, "prompt_cache"), "default"))


@query
def top_prompts_by_team(spark, folder):
    out = reports.top_prompts_by_team(W.view(spark, folder, "prompt_cache"))
    return _money(out.withColumn("rank", F.col("rank").cast("bigint")))


@query
def complexity_distribution(spark, folder):
    out = reports.complexity_distribution(_usage(spark, folder))
    return out.withColumn("pct", F.round("pct", 6))


@query
def model_usage(spark, folder):
    out = reports.model_usage(_usage(spark, folder))
    return _money(out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6)))


def _points(df):
    return df.select(
        *[c for c in df.columns if not c.startswith("p")],
        *[F.round(c, 4).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")],
    )


@query
def latency_overall(spark, folder):
    return _points(reports.latency_percentiles(_usage(spark, folder)))


@query
def latency_by_model(spark, folder):
    return _points(reports.latency_percentiles(_usage(spark, folder), ["model_used"]))


@query
def latency_by_cache_hit(spark, folder):
    served = F.when(F.col("cache_hit"), F.lit("hit")).otherwise(F.lit("miss"))
    rows = _usage(spark, folder).withColumn("served", served)
    return _points(reports.latency_percentiles(rows, ["served"]))


@query
def latency_report(spark, folder):
    return _points(reports.latency_report(_usage(spark, folder)))


@query
def latency_sketch(spark, folder):
    return reports.sketch_percentiles(reports.latency_sketch(_usage(spark, folder)))


@query
def team_summary(spark, folder):
    out = _money(reports.team_summary(_usage(spark, folder)))
    names = ("cache_hit_rate", "avg_latency_ms", "p99_latency_ms")
    return out.select(
        "team_id", "total_cost_usd", "total_requests", *[F.round(c, 6).alias(c) for c in names]
    )


@query
def team_hit_rate(spark, folder):
    return reports.hit_rate(_usage(spark, folder)).select(
        F.round("cache_hit_rate", 9).alias("cache_hit_rate")
    )


@query
def team_model_breakdown(spark, folder):
    out = reports.team_models(_usage(spark, folder))
    return _money(out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6)))


@query
def team_top_features(spark, folder):
    return reports.top_features(_usage(spark, folder)).withColumn("rank", F.col("rank").cast("bigint"))


# ---- metric tables


@query
def metric_requests(spark, folder):
    return metrics.requests_total(_usage(spark, folder))


@query
def metric_cost(spark, folder):
    return _money(metrics.cost_total(_usage(spark, folder)))


@query
def metric_tokens(spark, folder):
    return metrics.tokens_total(_usage(spark, folder))


def _bounded(df):
    # Infinity does not compare across engines.
    return df.withColumn("le", F.when(F.col("le") == metrics.INF, F.lit(-1.0)).otherwise(F.col("le")))


@query
def metric_latency_histogram(spark, folder):
    return _bounded(metrics.request_latency(_usage(spark, folder)))


@query
def metric_histogram_quantile(spark, folder):
    labels = ["model_used", "cache_hit", "complexity"]
    out = metrics.histogram_quantile(metrics.request_latency(_usage(spark, folder)), 0.99, labels)
    return out.withColumn("quantile", F.round("quantile", 4))


@query
def metric_routes(spark, folder):
    return metrics.routes_total(_routed(spark, folder))


@query
def metric_proxy_status(spark, folder):
    return metrics.proxy_requests_total(W.view(spark, folder, "request_events"))


@query
def metric_proxy_errors(spark, folder):
    return metrics.proxy_errors_total(W.view(spark, folder, "request_events"))


@query
def metric_cache(spark, folder):
    return lookup.counters(_lookups(spark, folder))


@query
def metric_embedding_requests(spark, folder):
    turns = W.table(spark, folder, "conversations")
    return embedding.request_counts(turns, _known_embeddings(spark, folder))


# ---- cache lookups

BUCKETS = 8


def _cache_rows(spark, folder):
    cache = W.view(spark, folder, "prompt_cache")
    reply = F.struct(F.struct(F.concat(F.lit("reply to "), F.col("prompt_text")).alias("content")).alias("message"))
    return cache.withColumn("prompt_hash", T.prompt_hash(F.col("prompt_text"))).withColumn(
        "response_json", F.to_json(F.struct(F.array(reply).alias("choices")))
    )


def _cache(spark, folder):
    """The cache as it is stored: bucketed by (team, hash)."""
    name = "prompt_cache_" + hashlib.sha256(folder.encode()).hexdigest()[:12]
    _kept(spark, folder, name, lambda path: cache_store.write_bucketed(_cache_rows(spark, folder), name, BUCKETS, path))
    return spark.table(name)


def _index(spark, folder):
    """The stored index of the cache's vectors."""
    return _kept(spark, folder, "vector-index", lambda path: vector_index.create(_cache_rows(spark, folder), path))


def _probes(spark, folder):
    return W.view(spark, folder, "probes")


def _lookups(spark, folder):
    return lookup.two_layer(_probes(spark, folder), _cache(spark, folder), index=_index(spark, folder))


@query
def cache_scan_team(spark, folder):
    return PC.scan(_cache(spark, folder), "default").select("id", "prompt_hash", "model_used", "hit_count")


@query
def exact_lookup(spark, folder):
    asked = _probes(spark, folder).withColumn("prompt_hash", T.prompt_hash(F.col("prompt_text")))
    return lookup.exact(asked, _cache(spark, folder)).select("query_id", "team_id", "cache_id")


@query
def semantic_lookup(spark, folder):
    found = nearest.nearest(_probes(spark, folder), _cache_rows(spark, folder))
    return found.select("query_id", "cache_id", F.round("similarity", 6).alias("similarity"))


@query
def two_layer_lookup(spark, folder):
    return _money(_lookups(spark, folder)).select(
        "query_id", "team_id", "layer", "outcome", "cache_label", "cache_id", "cached_model", "cached_cost",
        F.round("similarity", 6).alias("similarity"),
    )


@query
def cached_replies(spark, folder):
    hits = _lookups(spark, folder).filter(F.col("cache_id").isNotNull())
    return hits.select("query_id", "cache_id", R.reply_text(F.col("cached_response")).alias("reply"))


@query
def near_misses(spark, folder):
    out = lookup.near_misses(_lookups(spark, folder), _cache(spark, folder))
    return out.select("query_id", "team_id", "prompt_text", "cached_text", F.round("similarity", 6).alias("similarity"))


@query
def threshold_sweep(spark, folder):
    cache, probes = _cache(spark, folder), _probes(spark, folder)
    best = vector_index.probe(probes, _index(spark, folder), None, V.NEAR_AT)
    labels = cache.select(F.col("id").alias("cache_id"), F.col("label").alias("cached_label"))
    rows = probes.select("query_id", "label").join(best, "query_id", "left").join(labels, "cache_id", "left")
    rows = rows.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    rows = rows.withColumn("same_label", F.coalesce(F.col("label") == F.col("cached_label"), F.lit(False)))
    return lookup.threshold_sweep(rows, THRESHOLDS).withColumn(
        "false_hit_rate", F.round("false_hit_rate", 6)
    )


@query
def cache_quality(spark, folder):
    out = lookup.quality(_lookups(spark, folder))
    return out.withColumn("avg_similarity_on_hits", F.round("avg_similarity_on_hits", 6))


@query
def semantic_lookup_ivf(spark, folder):
    found = vector_index.probe(_probes(spark, folder), _index(spark, folder), PROBED)
    return found.select("query_id", "cache_id", F.round("similarity", 6).alias("similarity"))


@query
def semantic_lookup_all_lists(spark, folder):
    found = vector_index.probe(_probes(spark, folder), _index(spark, folder), None)
    return found.select("query_id", "cache_id", F.round("similarity", 6).alias("similarity"))


@query
def semantic_lookup_two_rounds(spark, folder):
    found = vector_index.nearest(_probes(spark, folder), _index(spark, folder))
    return found.select("query_id", "cache_id", F.round("similarity", 6).alias("similarity"))


@query
def semantic_lookup_reading(spark, folder):
    """Queries and lists that the two rounds bring together; how many depends on the data, so only the bounds compare."""
    out = vector_index.looked_at(_probes(spark, folder), _index(spark, folder))
    return out.select("all_pairs", (F.col("pairs") <= F.col("all_pairs")).alias("within"))


@query
def semantic_lookup_recall(spark, folder):
    probes, index = _probes(spark, folder), _index(spark, folder)
    few = vector_index.probe(probes, index, PROBED).select("query_id", F.col("cache_id").alias("found"))
    best = vector_index.probe(probes, index, None).join(few, "query_id", "left")
    same = F.count_if(F.col("found") == F.col("cache_id"))
    return best.agg(F.count("*").alias("queries"), (same >= 0.9 * F.count("*")).alias("recall_reached"))


@query
def vector_index_lists(spark, folder):
    """What the index holds: all vectors, each in one list, blocks within their bound."""
    blocks = vector_index.blocks_of(spark, _index(spark, folder), "bigint")
    return blocks.groupBy("team_id").agg(
        F.sum(F.size("ids")).alias("vectors"), (F.max(F.size("ids")) <= vector_index.BLOCK).alias("bounded")
    )


def _known_embeddings(spark, folder):
    """Embeddings of what the system messages say are there already."""
    turns = W.table(spark, folder, "conversations").filter(F.col("role") == "system")
    texts = turns.select(F.sha2("text", 256).alias("text_hash"), "text").distinct()
    return embedding.embed(texts)


#: Texts that were embedded six hours before the sample begins.
EARLY = datetime(2023, 12, 31, 18)


@query
def embed_valid_24h(spark, folder):
    ev = W.view(spark, folder, "request_events")
    early = spark.range(5).select(F.concat(F.lit("common question "), F.col("id").cast("string")).alias("text"))
    known = embedding.embed(early.select(T.prompt_hash(F.col("text")).alias("text_hash"), "text"))
    known = known.withColumn("computed_at", F.lit(EARLY).cast("timestamp"))
    out = embedding.embed_valid(ev, known, text="prompt_text")
    return out.select("text_hash", _when("computed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "requests", _weighted())


@query
def embedding_sources(spark, folder):
    ev = W.view(spark, folder, "request_events")
    known = spark.createDataFrame([], "text_hash string, computed_at timestamp")
    out = embedding.embedding_times(ev, known, text="prompt_text")
    return out.groupBy("team_id", "source").agg(F.count("*").alias("requests"))


def _weighted():
    """A number that depends on every entry of the vector."""
    weighted = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x
    )
    return F.round(weighted, 3).alias("weighted")


@query
def embed_pending(spark, folder):
    turns = W.table(spark, folder, "conversations")
    out = embedding.embed_missing(turns, _known_embeddings(spark, folder))
    return out.select("text_hash", "source", _weighted())


@query
def cache_insert_if_absent(spark, folder):
    ev = R.stored(W.view(spark, folder, "request_events"))
    rows = ev.select("team_id", T.prompt_hash(F.col("prompt_text")).alias("prompt_hash"), "created_at", "event_id")
    cache = _cache(spark, folder).select("team_id", "prompt_hash")
    fresh = PC.new_entries(rows, cache, ["created_at", "event_id"])
    return fresh.select("team_id", "prompt_hash", "event_id", PC.entry_id().alias("id"))


@query
def hit_count_update(spark, folder):
    cache = _cache(spark, folder)
    out = PC.with_hits(cache, _lookups(spark, folder))
    return out.select("id", "team_id", "hit_count")


# ---- rolling rates, alerts, limits, replay


@query
def hit_rate_30s(spark, folder):
    out = alerts.rolling_hit_rate(_usage(spark, folder))
    return out.select(
        "team_id", _when("window_start"), "hits", "lookups",
        F.round("cache_hit_rate", 9).alias("cache_hit_rate"),
    )


# The sample has some 14 events an hour, so windows are hours, not seconds.
@query
def alert_low_hit_rate(spark, folder):
    out = alerts.low_hit_rate(_usage(spark, folder), window=3600, below=0.2, hold=2 * 3600)
    return out.select("team_id", _when("started_at"), _when("ended_at"), _when("fired_at"), "samples")


@query
def alert_high_latency(spark, folder):
    out = alerts.high_latency(_usage(spark, folder), every=3600, above_ms=2475.0, hold=5 * 3600)
    return out.select(
        "model_used", "cache_hit", "complexity",
        _when("started_at"), _when("ended_at"), _when("fired_at"), "samples",
    )


@query
def alert_error_rate(spark, folder):
    ev = W.view(spark, folder, "request_events")
    out = alerts.high_error_rate(ev, window=7200, step=1800, above=0.0008, hold=3600)
    return out.select("error_type", _when("started_at"), _when("ended_at"), _when("fired_at"), "samples")


SLOW_RATE, SLOW_BURST = 0.001, 20


@query
def rate_limit_audit(spark, folder):
    ev = W.view(spark, folder, "request_events")
    out = ratelimit.audit(ev, SLOW_RATE, 2, seconds=3600)
    return out.select(
        "team_id", _when("window_start"), "requests", F.round("excess", 4).alias("excess")
    )


@query
def rate_limit_exact(spark, folder):
    ev = W.view(spark, folder, "request_events").select("team_id", "event_id", "created_at")
    out = ratelimit.decide(ev, SLOW_RATE, SLOW_BURST, slice_seconds=86400)
    return out.select("event_id", "team_id", "allowed")


@query
def ttl_exact_replay(spark, folder):
    return replay.replay(W.view(spark, folder, "request_events"))


# ---- streams


def _partitions(spark):
    """Stateful streams keep this many state partitions for life."""
    return str(max(8, spark.sparkContext.defaultParallelism))


def _event_stream(spark, folder, view):
    schema = W.table(spark, folder, "events").schema
    events = run.table_stream(spark, f"{folder}/events.parquet", schema)
    return W.derive(spark, view, events=events)


def _streaming(f):
    def run_(spark, folder):
        with conf(
            spark,
            spark__sql__shuffle__partitions=_partitions(spark),
            spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        ):
            return f(spark, folder)

    run_.__name__ = f.__name__
    return query(run_)


@_streaming
def stream_usage_append(spark, folder):
    out, state = scratch_path(spark, "usage"), scratch_path(spark, "state")
    SU.append_usage(_event_stream(spark, folder, "usage_raw"), out, state).awaitTermination()
    back = U.read_usage_log(spark, out)
    return back.select("id", "team_id", "model_used", "latency_ms", F.col("created_date").cast("string").alias("day"))


@_streaming
def stream_daily_cost(spark, folder):
    out = run.drain(SU.daily_cost(_event_stream(spark, folder, "usage_log")), "complete")
    return _money(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@_streaming
def stream_hit_rate(spark, folder):
    out = run.drain(SU.rolling_hit_rate(_event_stream(spark, folder, "usage_log")), "complete")
    return out.select("team_id", _when("window_start"), "hits", "lookups", F.round("cache_hit_rate", 9).alias("cache_hit_rate"))


PIECES = 5


def _in_order(spark, folder, delayed=False):
    """A folder with the events in five files of six days each, the oldest first; one file is one micro-batch.

    With ``delayed``, every fiftieth event comes a file too late.
    """

    def make(place):
        piece = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(PIECES - 1))
        if delayed:
            piece = F.least(piece + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0), F.lit(PIECES - 1))
        events = W.table(spark, folder, "events").withColumn("_piece", piece)
        for k in range(PIECES):
            events.filter(F.col("_piece") == k).drop("_piece").coalesce(1).write.mode("append").parquet(place)

    return _kept(spark, folder, "events-delayed" if delayed else "events-in-order", make)


def _ordered_stream(spark, folder, view, delayed=False):
    schema = W.table(spark, folder, "events").schema
    events = run.file_stream(spark, _in_order(spark, folder, delayed), schema, files_per_trigger=1)
    return W.derive(spark, view, events=events)


@_streaming
def stream_daily_cost_append(spark, folder):
    """Days that are closed, each emitted once."""
    out = run.drain(SU.daily_cost(_ordered_stream(spark, folder, "usage_log")))
    return _money(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@_streaming
def stream_hit_rate_append(spark, folder):
    out = run.drain(SU.rolling_hit_rate(_ordered_stream(spark, folder, "usage_log")))
    return out.select("team_id", _when("window_start"), "hits", "lookups", F.round("cache_hit_rate", 9).alias("cache_hit_rate"))


@_streaming
def stream_late_rows(spark, folder):
    ev = _ordered_stream(spark, folder, "request_events", delayed=True)
    _, late = SU.part_late(ev, scratch_path(spark, "parted"), scratch_path(spark, "state"))
    return late.groupBy("team_id", F.col("batch_id").alias("batch")).agg(F.count("*").alias("dropped"))


@_streaming
def stream_counters(spark, folder):
    return _money(run.drain(SU.live_counters(_event_stream(spark, folder, "usage_log")), "complete"))


@_streaming
def stream_redact(spark, folder):
    schema = W.table(spark, folder, "documents").schema
    docs = W.derive(spark, "docs_pii", documents=run.table_stream(spark, f"{folder}/documents.parquet", schema))
    return run.drain(redact.redact_column(docs, "text").select("doc_id", "text", "unique_tokens"))


@_streaming
def stream_dedup(spark, folder):
    seen = SU.first_sightings(_event_stream(spark, folder, "request_events"), "90 days")
    return run.drain(seen.select("team_id", "prompt_hash"))


@_streaming
def stream_rate_limit(spark, folder):
    ev = _event_stream(spark, folder, "request_events")
    return run.drain(stateful.rate_limited(ev, SLOW_RATE, SLOW_BURST))


@_streaming
def stream_ttl_cache(spark, folder):
    kinds = stateful.expired_by_batch(_event_stream(spark, folder, "request_events"))
    return kinds.groupBy("team_id", "kind").agg(F.count("*").alias("requests"))


@_streaming
def stream_cache_population(spark, folder):
    ev = _ordered_stream(spark, folder, "request_events")
    models = F.array(*(F.lit(m) for m in ("groq/gpt-oss-20b", "openai/gpt-4o", "anthropic/claude-haiku-3")))
    reply = F.struct(F.struct(F.concat(F.lit("reply "), F.col("event_id").cast("string")).alias("content")).alias("message"))
    ev = (
        ev.withColumn("response_json", F.to_json(F.struct(F.array(reply).alias("choices"))))
        .withColumn("model_used", F.element_at(models, (F.col("event_id") % 3 + 1).cast("int")))
        .withColumn("input_tokens", T.byte_tokens(F.col("prompt_text")).cast("int"))
        .withColumn("output_tokens", (F.col("event_id") % 100).cast("int"))
    )
    ev = pricing.with_cost(ev, model="model_used").withColumn("cost_usd", F.col("cost_usd").cast("decimal(10,8)"))
    store = cache_store.CacheStore(spark, scratch_path(spark, "cache"))
    store = cache_fill.fill(ev, store, scratch_path(spark, "state"), compact_every=3)
    per_layer = store.hits().groupBy("id").pivot("layer", ["exact_hash", "semantic"]).agg(F.sum("new_hits"))
    out = store.table().join(per_layer, "id", "left").na.fill(0, ["exact_hash", "semantic"])
    return _money(
        out.select(
            "id", "team_id", "prompt_hash", "prompt_text", "event_id", "model_used", "input_tokens", "output_tokens",
            "cost_usd", R.reply_text(F.col("response_json")).alias("reply"), _weighted(),
            F.col("hit_count").cast("bigint").alias("hit_count"),
            F.col("exact_hash").alias("exact_hits"), F.col("semantic").alias("semantic_hits"),
        )
    )


# ---- end to end


def flow_inputs(spark, folder):
    """Requests, a cache of what the opening turns asked, and the replies."""
    prepared = request_flow.prepare(W.bodies(spark, folder, "conv_turns"))
    turns = W.table(spark, folder, "conversations")

    def table(path):
        request_flow.prompt_vectors(W.view(spark, folder, "prompts")).select(
            F.col("text_hash").alias("id"),
            F.lit("default").alias("team_id"),
            F.col("text_hash").alias("prompt_hash"),
            "embedding",
            F.lit("groq/gpt-oss-20b").alias("model_used"),
            F.lit("0.00012500").cast("decimal(10,8)").alias("cost_usd"),
        ).write.parquet(path)

    # The cache and its index are stored tables, embedded once; the lookup searches exactly, so no vector is stored twice.
    cache = spark.read.parquet(_kept(spark, folder, "flow-cache", table))
    index = _kept(spark, folder, "flow-index", lambda path: vector_index.create(cache, path, places=1))
    replies = (
        turns.filter(F.col("role") == "assistant")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("response_json"))
        .select(
            F.col("conv_id").alias("request_id"),
            "response_json",
            F.lit(200).alias("status"),
            (F.lit(200) + F.col("conv_id") % 1000).cast("int").alias("latency_ms"),
        )
    )
    return prepared, cache, replies, index


@query
def request_usage_rows(spark, folder):
    prepared, cache, replies, index = flow_inputs(spark, folder)
    out = request_flow.usage_rows(prepared, cache, replies, index=index)
    return _money(out).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query
def routing_whatif(spark, folder):
    out = request_flow.routing_savings(W.view(spark, folder, "traffic"), "openai/gpt-4o")
    return _money(out).select(
        "team_id", "requests", "baseline_usd", "routed_usd", "routed_cached_usd",
        F.round("routed_reduction_pct", 6).alias("routed_reduction_pct"),
        F.round("cached_reduction_pct", 6).alias("cached_reduction_pct"),
    )
