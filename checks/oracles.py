"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

from usagelens.functions.text import COMPLEX_KEYWORDS, MULTI_STEP_PHRASES
from usagelens.plans import workload as W

ORACLES: dict[str, str] = {}

PROBES = W.PROBES.format(
    mixed="list_transform(list_zip(e.embedding, f.embedding),"
    f" lambda z: z[1]::DOUBLE + z[2]::DOUBLE * ({W._MIX})::DOUBLE)"
)
_VIEWS = {**W.VIEWS, "probes": PROBES}
SINCE = "TIMESTAMP '2024-01-01 00:00:00'"


def _with(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_VIEWS[n]})" for n in names)


def _add(name: str, sql: str, *views: str) -> None:
    head = _with(*views) if views else ""
    if views and sql.lstrip().startswith(","):
        ORACLES[name] = f"{head}{sql.lstrip()}"
    else:
        ORACLES[name] = f"{head} {sql}".strip()


def _usage(name: str, sql: str) -> None:
    """Over the log from the range's start on, as ``u``."""
    _add(name, f", u AS (SELECT * FROM usage_log WHERE created_at >= {SINCE}) {sql}", "usage_log")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _at(seconds: str) -> str:
    return _stamp(f"make_timestamp(CAST({seconds} AS BIGINT) * 1000000)")


# ---- sources and row checks

_add(
    "usage_scan_team_since",
    """SELECT id, team_id, model_used, cost_usd::DOUBLE AS cost_usd, latency_ms FROM usage_log
    WHERE team_id = 'default' AND created_at >= TIMESTAMP '2024-01-24 00:00:00'""",
    "usage_log",
)
_add(
    "usage_validate",
    """, v AS (SELECT id, list_filter([
      CASE WHEN team_id IS NULL THEN 'team_id:null' END,
      CASE WHEN input_tokens < 0 THEN 'input_tokens:negative' END,
      CASE WHEN cost_usd < 0 THEN 'cost_usd:negative' END,
      CASE WHEN latency_ms < 0 THEN 'latency_ms:negative' END,
      CASE WHEN abs(cost_usd) >= 100 THEN 'cost_usd:too_large' END,
      CASE WHEN complexity NOT IN ('simple', 'medium', 'complex') THEN 'complexity:domain' END
      ], lambda x: x IS NOT NULL) AS l FROM usage_raw)
    SELECT id, len(l) = 0 AS valid, array_to_string(l, ',') AS violations FROM v""",
    "usage_raw",
)
_add(
    "usage_write_layout",
    """SELECT strftime(created_at, '%Y-%m-%d') AS day, team_id, count(*) AS requests,
      sum(cost_usd)::DOUBLE AS cost_usd FROM usage_log GROUP BY ALL""",
    "usage_log",
)

_REQUEST = """
r AS (SELECT conv_id AS request_id,
    CASE conv_id % 4 WHEN 0 THEN 'team-alpha' WHEN 1 THEN 'team-beta' WHEN 2 THEN 'team-gamma'
      ELSE 'default' END AS team_id,
    CASE WHEN conv_id % 5 = 0 THEN 'untagged' ELSE 'chat' END AS feature_tag,
    CASE WHEN conv_id % 6 = 0 THEN 'openai/gpt-4o' ELSE '' END AS model_override,
    conv_id % 4 = 1 AS stream, CASE WHEN conv_id % 3 = 0 THEN 256 ELSE 0 END AS max_tokens,
    count(*)::INT AS n_messages, count(*) FILTER (role <> 'system') AS n_other,
    arg_min(text, turn) FILTER (role = 'user') AS prompt_text,
    arg_max(text, turn) FILTER (role = 'system') AS system,
    CASE WHEN conv_id % 13 = 0 THEN 'invalid_body'
      WHEN coalesce(arg_min(text, turn) FILTER (role = 'user'), '') = '' THEN 'no_prompt' END AS reject_reason
  FROM conversations GROUP BY conv_id)
"""
_add(
    "requests_ingest",
    f"""WITH {_REQUEST} SELECT request_id, team_id, feature_tag, model_override, stream, max_tokens,
    n_messages, prompt_text FROM r WHERE reject_reason IS NULL""",
)
_add(
    "rejected_requests",
    f"WITH {_REQUEST} SELECT request_id, team_id, reject_reason FROM r WHERE reject_reason IS NOT NULL",
)
_add(
    "rejected_oversize",
    """SELECT conv_id AS request_id, 'too_large' AS reject_reason FROM conversations
    GROUP BY conv_id HAVING sum(strlen(coalesce(text, '')) + strlen(role) + 24) > 4000""",
)
_add(
    "response_content",
    """SELECT conv_id, turn, CASE WHEN turn % 7 IN (3, 5) THEN '' ELSE text END AS content
    FROM conversations""",
)
_add(
    "request_log_ingest",
    f"""SELECT {_stamp('created_at')} AS time, 'req-' || event_id AS request_id, path, team_id,
    CASE WHEN event_id % 2 = 0 THEN 'chat' ELSE 'untagged' END AS feature_tag, '' AS model,
    event_id % 900 AS latency_ms, status AS status_code FROM request_events""",
    "request_events",
)
_add(
    "api_key_audit",
    """SELECT team_id, CASE WHEN api_key = '' THEN 'missing' ELSE 'invalid' END AS problem,
    CASE WHEN api_key = '' THEN '' ELSE substr(sha256(api_key), 1, 8) END AS key_sha256_prefix,
    count(*) AS requests FROM request_events
    WHERE path <> '/health' AND api_key NOT IN ('key-1', 'key-2', 'key-3', 'key-4') GROUP BY ALL""",
    "request_events",
)

# ---- prompt features, routing, price

_WORDS = r"len(regexp_extract_all(prompt_text, '[^\t-\r\x{85}\p{Z}\p{P}]+'))"
_SCORE = " + ".join(
    f"(length(lower(prompt_text)) - length(replace(lower(prompt_text), {_q(k)}, ''))) // {len(k)}"
    for k in COMPLEX_KEYWORDS
)
_STEPS = " OR ".join(f"contains(lower(prompt_text), {_q(p)})" for p in MULTI_STEP_PHRASES)
_CLASS = f"""
f AS (SELECT *, {_WORDS} AS tokens, contains(prompt_text, '```') AS fence, {_SCORE} AS score,
    ({_STEPS}) AS steps FROM prompts),
c AS (SELECT *, CASE WHEN tokens < 50 AND NOT fence AND score = 0 AND NOT steps THEN 'simple'
    WHEN tokens > 300 OR fence OR score >= 2 OR steps THEN 'complex' ELSE 'medium' END AS complexity FROM f),
m AS (SELECT *, CASE WHEN model_override <> '' THEN model_override
      ELSE CASE complexity WHEN 'simple' THEN 'groq/gpt-oss-20b'
        WHEN 'medium' THEN 'groq/llama-3.3-70b-versatile' ELSE 'groq/gpt-oss-120b' END END AS model,
    CASE WHEN model_override <> '' THEN 'model_override' ELSE complexity || '_prompt' END AS reason FROM c),
routed AS (SELECT *, CASE WHEN split_part(model, '/', 1) IN ('openai', 'anthropic', 'groq')
    THEN split_part(model, '/', 1) ELSE 'unknown' END AS provider, strlen(prompt_text) // 4 AS bytes FROM m)
"""
# Prices in thousandths of a dollar per million tokens.
_PRICE = """
price AS (SELECT * FROM (VALUES ('openai/gpt-4o-mini', 150, 600), ('openai/gpt-4o', 2500, 10000),
  ('anthropic/claude-haiku-3', 250, 1250), ('anthropic/claude-sonnet-4', 3000, 15000),
  ('groq/gpt-oss-20b', 75, 300), ('groq/llama-3.3-70b-versatile', 590, 790),
  ('groq/gpt-oss-120b', 150, 600)) AS v(pm, pin, pout))
"""


def _priced(tokens_in: str, tokens_out: str) -> str:
    units = f"({tokens_in} * coalesce(pin, 250) + {tokens_out} * coalesce(pout, 1250) + 5) // 10"
    return f"CAST({units} AS DECIMAL(18, 0)) * CAST('0.00000001' AS DECIMAL(9, 8))"


def _prompt(name: str, sql: str) -> None:
    _add(name, sql, "prompts")


_prompt(
    "prompt_hash",
    """SELECT prompt_id, sha256(prompt_text) AS prompt_hash,
    'cache:default:' || sha256(prompt_text) AS cache_key, 'emb:' || sha256(prompt_text) AS embedding_key
    FROM prompts""",
)
_prompt("word_tokens", f"SELECT prompt_id, {_WORDS} AS tokens FROM prompts")
_prompt("byte_tokens", "SELECT prompt_id, strlen(prompt_text) // 4 AS tokens FROM prompts")
_prompt("code_fence", "SELECT prompt_id, contains(prompt_text, '```') AS fence FROM prompts")
_prompt("keyword_score", f"SELECT prompt_id, {_SCORE} AS score FROM prompts")
_prompt("multi_step", f"SELECT prompt_id, ({_STEPS}) AS steps FROM prompts")
_prompt("complexity_class", f", {_CLASS} SELECT prompt_id, complexity FROM routed")
_prompt("route_models", f", {_CLASS} SELECT prompt_id, model, provider, reason FROM routed")
_prompt("provider_of", f", {_CLASS} SELECT provider, count(*) AS requests FROM routed GROUP BY ALL")
_prompt(
    "estimate_cost",
    f""", {_CLASS}, {_PRICE} SELECT prompt_id, model, bytes::INT AS input_tokens, tokens::INT AS output_tokens,
    ({_priced('bytes', 'tokens')})::DOUBLE AS cost_usd FROM routed LEFT JOIN price ON model = pm""",
)
_prompt(
    "classify_route_cost",
    f""", {_CLASS}, {_PRICE} SELECT model, provider, reason, count(*) AS requests,
    sum(bytes)::BIGINT AS input_tokens, sum({_priced('bytes', 'tokens')})::DOUBLE AS cost_usd
    FROM routed LEFT JOIN price ON model = pm GROUP BY ALL""",
)
_prompt(
    "unknown_models",
    f""", {_CLASS}, {_PRICE} SELECT model, count(*) AS requests FROM routed
    WHERE model NOT IN (SELECT pm FROM price) GROUP BY ALL""",
)
_prompt(
    "metric_routes",
    f""", {_CLASS} SELECT model, CASE WHEN reason = 'model_override' THEN 'override' ELSE complexity END
    AS complexity, reason, count(*) AS value FROM routed GROUP BY ALL""",
)
_add(
    "provider_export",
    f"""WITH {_REQUEST}, s AS (SELECT *, (request_id // 3) % 3 AS k FROM r WHERE reject_reason IS NULL)
    SELECT request_id, CASE k WHEN 0 THEN 'anthropic' WHEN 1 THEN 'groq' ELSE 'openai' END AS provider,
    CASE k WHEN 0 THEN 'claude-3-haiku-20240307' WHEN 1 THEN 'openai/gpt-oss-20b'
      ELSE 'gpt-4o-mini' END AS wire_model,
    CASE WHEN max_tokens > 0 THEN max_tokens WHEN k = 0 THEN 1024 END::BIGINT AS max_tokens,
    CASE WHEN k = 0 THEN n_other ELSE n_messages END::BIGINT AS n_messages,
    CASE WHEN k = 0 THEN system END AS system, CASE WHEN stream THEN true END AS stream FROM s""",
)

_add(
    "provider_files",
    f"""WITH {_REQUEST}, s AS (SELECT request_id, request_id % 3 AS k, system FROM r WHERE reject_reason IS NULL)
    SELECT request_id, CASE k WHEN 0 THEN 'anthropic' WHEN 1 THEN 'groq' ELSE 'openai' END AS provider,
    CASE k WHEN 0 THEN 'claude-3-haiku-20240307' WHEN 1 THEN 'openai/gpt-oss-20b' ELSE 'gpt-4o-mini' END AS model,
    CASE WHEN k = 0 THEN system END AS system,
    (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS pos, role, text
    FROM s JOIN conversations ON conv_id = request_id WHERE k <> 0 OR role <> 'system'""",
)

# ---- redaction

_LUHN_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"


def _luhn(x: str) -> str:
    d = _LUHN_DIGITS.format(x=x)
    digit = f"CAST(substr(reverse({d}), k::INT, 1) AS INT)"
    weighted = f"CASE WHEN k % 2 = 1 THEN {digit} WHEN {digit} >= 5 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    total = f"list_sum(list_transform(range(1, length({d}) + 1), lambda k: {weighted}))"
    return f"(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
# The patterns in this engine's dialect.
_PATTERNS = {
    "url": ("URL_CREDS", r"""[a-zA-Z][a-zA-Z0-9+\-.]+://[^:@\s"']*:[^@\s"']+@[^\s"']+"""),
    "api_key": (
        "API_KEY",
        "(?:sk-|pk_live_|pk_test_|sk_live_|sk_test_|rk_live_|rk_test_|ghp_|gho_|ghs_|ghr_"
        r"|glpat-|xoxb-|xoxp-)[A-Za-z0-9_\-]{16,}",
    ),
    "email": ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    "card": ("CREDIT_CARD", r"\b[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b"),
    "ssn": ("SSN", r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b"),
    "phone": ("PHONE", r"(?:\+1[\s\-.]?)?\(?[0-9]{3}\)?[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{4}"),
    "ipv4": ("IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"),
}


def _passes(names, source: str, key: str, text: str, extra=()) -> str:
    """CTEs z0..zn: one pass per pattern, with the values found so far."""
    todo = [_PATTERNS[n] for n in names] + list(extra)
    valid = [_luhn("x") if n == "card" else "true" for n in names] + ["true"] * len(extra)
    none = "[]::STRUCT(k VARCHAR, t VARCHAR, v VARCHAR)[]"
    ctes = [f"z0 AS (SELECT {key}, {text} AS t, {none} AS found FROM {source})"]
    for i, (tag, regex) in enumerate(todo, 1):
        ctes.append(
            f"""m{i} AS (SELECT {key}, found, regexp_extract_all(t, {_q(regex)}) AS m,
        string_split_regex(t, {_q(regex)}) AS g FROM z{i - 1}),
      v{i} AS (SELECT {key}, found, m, g, list_filter(m, lambda x: {valid[i - 1]}) AS v FROM m{i}),
      u{i} AS (SELECT {key}, found, m, g, list_filter(v, lambda x, i: list_position(v, x) = i) AS u FROM v{i}),
      z{i} AS (SELECT {key}, array_to_string(list_transform(range(1, len(g) + 1), lambda k:
          g[k] || CASE WHEN k > len(m) THEN '' WHEN list_contains(u, m[k])
            THEN '[{tag}_' || list_position(u, m[k]) || ']' ELSE m[k] END), '') AS t,
        list_concat(found, list_transform(u, lambda x, i: {{'k': '{tag}_' || i, 't': '{tag}', 'v': x}})) AS found
        FROM u{i})"""
        )
    return ", ".join(ctes)


_ALL = list(_PATTERNS)


def _docs(name: str, names, sql: str, extra=()) -> None:
    last = f"z{len(names) + len(extra)}"
    _add(name, f", {_passes(names, 'docs_pii', 'doc_id, team_id', 'text', extra)} {sql.format(z=last)}", "docs_pii")


_TEXT = "SELECT doc_id, t AS text, len(found)::INT AS unique_tokens FROM {z}"
for _n in _ALL:
    _docs(f"redact_{_n}", [_n], _TEXT)
_docs("redact_documents", _ALL, _TEXT)
ORACLES["stream_redact"] = ORACLES["redact_documents"]
_docs("redact_disabled_patterns", [n for n in _ALL if n not in ("ipv4", "phone")], _TEXT)
_docs(
    "redaction_map_json",
    _ALL,
    """SELECT doc_id, CASE WHEN len(found) = 0 THEN '' ELSE to_base64(encode(
      replace(replace(replace('{{' || array_to_string(list_transform(list_sort(found),
        lambda e: to_json(e.k)::VARCHAR || ':' || to_json(e.v)::VARCHAR), ',') || '}}',
      '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'))) END AS map_header,
    len(found) > 0 AS has_redactions FROM {z}""",
)
_docs(
    "pii_counts_by_type_team",
    _ALL,
    """SELECT e.t AS pii_type, team_id, count(*) AS redacted
    FROM (SELECT team_id, unnest(found) AS e FROM {z}) GROUP BY ALL""",
)
_docs(
    "requests_with_pii",
    _ALL,
    """SELECT team_id, count(*) AS requests, sum(len(found))::BIGINT AS unique_tokens FROM {z}
    WHERE len(found) > 0 GROUP BY ALL""",
)
_add("redact_restore", "SELECT doc_id, text AS response FROM docs_pii", "docs_pii")
_add(
    "redact_extra_pattern",
    f""", {_passes(_ALL, 'request_events', 'event_id', 'prompt_text', [('QUESTION', 'question [0-9]+')])}
    SELECT event_id, t AS prompt_text, len(found)::INT AS unique_tokens FROM z8""",
    "request_events",
)
_add(
    "luhn_valid",
    f"""SELECT event_id, {_luhn('d')} AS valid
    FROM (SELECT event_id, CAST(4000000000000000 + event_id * 7919 AS VARCHAR) AS d FROM events)""",
)


def _request_passes() -> str:
    """The same with values numbered over all turns of a conversation."""
    ctes = ["z0 AS (SELECT conv_id, turn, role, text AS t FROM conv_turns)"]
    for i, n in enumerate(_ALL, 1):
        tag, regex = _PATTERNS[n]
        valid = _luhn("x") if n == "card" else "true"
        ctes.append(
            f"""m{i} AS (SELECT *, regexp_extract_all(t, {_q(regex)}) AS m,
        string_split_regex(t, {_q(regex)}) AS g FROM z{i - 1}),
      w{i} AS (SELECT conv_id, x, min(turn * 1000000 + pos) AS f FROM (
          SELECT conv_id, turn, unnest(m) AS x, generate_subscripts(m, 1) AS pos FROM m{i})
        WHERE {valid} GROUP BY conv_id, x),
      u{i} AS (SELECT conv_id, list(x ORDER BY f) AS u FROM w{i} GROUP BY conv_id),
      z{i} AS (SELECT m{i}.conv_id, turn, role, array_to_string(list_transform(range(1, len(g) + 1), lambda k:
          g[k] || CASE WHEN k > len(m) THEN '' WHEN list_contains(u, m[k])
            THEN '[{tag}_' || list_position(u, m[k]) || ']' ELSE m[k] END), '') AS t
        FROM m{i} LEFT JOIN u{i} ON u{i}.conv_id = m{i}.conv_id)"""
        )
    counts = " UNION ALL ".join(f"SELECT conv_id, len(u) AS n FROM u{i}" for i in range(1, len(_ALL) + 1))
    ctes.append(f"total AS (SELECT conv_id, sum(n)::INT AS n FROM ({counts}) GROUP BY conv_id)")
    return ", ".join(ctes)


_add(
    "redact_conversations",
    f""", {_request_passes()} SELECT z.conv_id, z.turn, z.t AS text, z.t <> c.text AS has_redactions
    FROM z7 z JOIN conv_turns c ON c.conv_id = z.conv_id AND c.turn = z.turn""",
    "conv_turns",
)
_add(
    "redact_request_rows",
    f""", {_request_passes()} SELECT z.conv_id, (row_number() OVER (PARTITION BY z.conv_id ORDER BY turn) - 1)::INT AS pos,
    role, t AS text, coalesce(n, 0)::INT AS unique_tokens FROM z7 z LEFT JOIN total ON total.conv_id = z.conv_id""",
    "conv_turns",
)
_add(
    "redact_bad_input",
    f""", {_request_passes()}, r AS (SELECT conv_id, bool_or(contains(t, '[EMAIL_1]')) AS masked FROM z7 GROUP BY conv_id)
    SELECT r.conv_id AS request_id, CASE WHEN r.conv_id % 11 = 0 THEN 'body_read' END AS redaction_error,
    r.conv_id % 11 = 0 AS blocked,
    CASE WHEN r.conv_id % 11 = 0 OR r.conv_id % 13 = 0 THEN 0 ELSE coalesce(n, 0) END::INT AS unique_tokens,
    CASE WHEN r.conv_id % 11 <> 0 THEN masked AND r.conv_id % 13 <> 0 END AS masked
    FROM r LEFT JOIN total ON total.conv_id = r.conv_id""",
    "conv_turns",
)
_PLACE = "(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS pos"
_add(
    "redact_bodies_open",
    f""", {_request_passes()} SELECT conv_id AS request_id, {_PLACE}, role, t AS text FROM z7
    WHERE conv_id % 11 <> 0 AND conv_id % 13 <> 0""",
    "conv_turns",
)
_add(
    "redact_switched_off",
    f"""SELECT conv_id AS request_id, {_PLACE}, role, text FROM conv_turns
    WHERE conv_id % 11 <> 0 AND conv_id % 13 <> 0""",
    "conv_turns",
)
_add(
    "redact_bodies_closed",
    """SELECT DISTINCT conv_id AS request_id, conv_id % 11 = 0 AS blocked, conv_id % 11 <> 0 AS sent,
    CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 13 = 0 THEN '{{' ELSE '{"' END AS opening FROM conversations""",
)
_add(
    "redact_checked_pattern",
    """, r AS (SELECT *, regexp_extract(prompt_text, 'question [0-9]+') AS v,
      regexp_extract(prompt_text, '([0-9]+)$', 1)::BIGINT % 2 = 1 AS odd FROM request_events)
    SELECT event_id, CASE WHEN odd THEN replace(prompt_text, v, '[QUESTION_1]') ELSE prompt_text END AS prompt_text,
    odd::INT AS unique_tokens,
    CASE WHEN odd THEN to_base64(encode('{"QUESTION_1":"' || v || '"}')) ELSE '' END AS map_header FROM r""",
    "request_events",
)
_add(
    "redaction_errors",
    """SELECT 'body_read' AS cause, count(DISTINCT conv_id) AS errors FROM conversations
    WHERE conv_id % 11 = 0""",
)

# ---- cost, cache, model, latency and team reports

_usage("cost_total", "SELECT coalesce(sum(cost_usd), 0)::DOUBLE AS cost_usd FROM u")
_usage("cost_by_model", "SELECT team_id, model_used AS model, sum(cost_usd)::DOUBLE AS cost_usd FROM u GROUP BY ALL")
_usage("cost_by_feature", "SELECT team_id, feature_tag AS feature, sum(cost_usd)::DOUBLE AS cost_usd FROM u GROUP BY ALL")
_usage(
    "cost_by_day",
    "SELECT team_id, strftime(created_at, '%Y-%m-%d') AS day, sum(cost_usd)::DOUBLE AS cost_usd FROM u GROUP BY ALL",
)
_usage("cache_savings", "SELECT coalesce(sum(cost_usd) FILTER (cache_hit), 0)::DOUBLE AS savings_usd FROM u")
_usage(
    "cost_summary",
    """, l AS (
      SELECT team_id, unnest([{'s': 'total', 'l': ''}, {'s': 'model', 'l': model_used},
        {'s': 'feature', 'l': feature_tag}, {'s': 'day', 'l': strftime(created_at, '%Y-%m-%d')}]) AS k,
        cost_usd, CASE WHEN cache_hit THEN cost_usd ELSE 0 END AS saved FROM u)
    SELECT team_id, k.s AS section, k.l AS label, sum(cost_usd)::DOUBLE AS cost_usd,
      sum(saved)::DOUBLE AS savings_usd, (sum(cost_usd) - sum(saved))::DOUBLE AS spent_usd,
      CASE WHEN k.s = 'total' THEN round(sum(cost_usd)::DOUBLE / 30 * 30, 6) END AS projected_monthly_usd
    FROM l GROUP BY team_id, k.s, k.l""",
)
for _g, _c in (
    ("model", "model_used"),
    ("feature", "feature_tag"),
    ("day", "strftime(created_at, '%Y-%m-%d')"),
):
    _usage(
        f"breakdown_{_g}",
        f"""SELECT team_id, {_c} AS label, sum(cost_usd)::DOUBLE AS cost_usd, count(*) AS request_count,
        round(avg(cost_usd)::DOUBLE, 9) AS avg_cost_per_request FROM u GROUP BY ALL""",
    )
_STATS = """SELECT team_id, count(*) AS total_lookups, count(*) FILTER (cache_hit) AS hits,
    count(*) FILTER (NOT cache_hit) AS misses,
    round(count(*) FILTER (cache_hit) / count(*) * 100.0, 6) AS hit_rate_pct FROM {} GROUP BY ALL"""
_usage("cache_stats", _STATS.format("u"))
_add(
    "cache_stats_last_day",
    _STATS.format("usage_log WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00'"),
    "usage_log",
)
_add(
    "top_cached_prompts",
    """SELECT substring(prompt_text, 1, 100) AS prompt_preview, hit_count,
    (hit_count * cost_usd)::DOUBLE AS cost_saved_usd FROM prompt_cache WHERE team_id = 'default'
    ORDER BY hit_count DESC, id LIMIT 10""",
    "prompt_cache",
)
_usage(
    "complexity_distribution",
    """, t AS (SELECT team_id, count(*) AS total FROM u GROUP BY ALL),
    l AS (SELECT team_id, total, unnest(['simple', 'medium', 'complex']) AS complexity FROM t),
    n AS (SELECT team_id, complexity, count(*) AS requests FROM u GROUP BY ALL)
    SELECT l.team_id, l.complexity, coalesce(requests, 0) AS requests,
      round(coalesce(requests, 0) / total * 100.0, 6) AS pct
    FROM l LEFT JOIN n ON n.team_id = l.team_id AND n.complexity = l.complexity""",
)
_usage(
    "model_usage",
    """SELECT team_id, model_used AS model, count(*) AS request_count, sum(cost_usd)::DOUBLE AS total_cost_usd,
    round(avg(latency_ms), 6) AS avg_latency_ms FROM u GROUP BY ALL""",
)
_POINTS = ", ".join(
    f"round(quantile_cont(latency_ms, {p}), 4) AS p{round(p * 100)}_ms" for p in (0.5, 0.95, 0.99)
)
_SERVED = "CASE WHEN cache_hit THEN 'hit' ELSE 'miss' END"
_usage("latency_overall", f"SELECT team_id, {_POINTS} FROM u GROUP BY ALL")
_usage("latency_by_model", f"SELECT team_id, model_used, {_POINTS} FROM u GROUP BY ALL")
_usage("latency_by_cache_hit", f"SELECT team_id, {_SERVED} AS served, {_POINTS} FROM u GROUP BY ALL")
_usage(
    "latency_report",
    f"""SELECT team_id, 'overall' AS section, '' AS label, {_POINTS} FROM u GROUP BY ALL
    UNION ALL SELECT team_id, 'model', model_used, {_POINTS} FROM u GROUP BY ALL
    UNION ALL SELECT team_id, 'cache', {_SERVED}, {_POINTS} FROM u GROUP BY ALL""",
)
_usage(
    "team_summary",
    """SELECT team_id, sum(cost_usd)::DOUBLE AS total_cost_usd, count(*) AS total_requests,
    round(count(*) FILTER (cache_hit) / count(*), 6) AS cache_hit_rate,
    round(avg(latency_ms), 6) AS avg_latency_ms,
    round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms FROM u GROUP BY ALL""",
)
_usage(
    "team_hit_rate",
    "SELECT round(count(*) FILTER (cache_hit) / nullif(count(*), 0), 9) AS cache_hit_rate FROM u",
)
_usage(
    "team_model_breakdown",
    """SELECT team_id, model_used, count(*) AS request_count, sum(cost_usd)::DOUBLE AS total_cost_usd,
    sum(input_tokens + output_tokens)::BIGINT AS total_tokens, round(avg(latency_ms), 6) AS avg_latency_ms
    FROM u GROUP BY ALL""",
)
_usage(
    "team_top_features",
    """, n AS (SELECT team_id, feature_tag, count(*) AS request_count FROM u GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id
      ORDER BY request_count DESC, feature_tag) AS rank FROM n) WHERE rank <= 5""",
)

# ---- metric tables

_usage(
    "metric_requests",
    "SELECT team_id, model_used, complexity, cache_hit, count(*) AS value FROM u GROUP BY ALL",
)
_usage("metric_cost", "SELECT team_id, model_used, provider, sum(cost_usd)::DOUBLE AS value FROM u GROUP BY ALL")
_usage(
    "metric_tokens",
    """SELECT team_id, model_used, 'input' AS type, sum(input_tokens)::BIGINT AS value FROM u GROUP BY ALL
    UNION ALL SELECT team_id, model_used, 'output', sum(output_tokens)::BIGINT FROM u GROUP BY ALL""",
)
_LE = "(VALUES (50.0), (100), (250), (500), (1000), (2500), (5000), (10000), (-1)) AS b(le)"
_HIST = f"""h AS (SELECT model_used, cache_hit, complexity, le::DOUBLE AS le,
    count(*) FILTER (latency_ms <= le OR le < 0) AS cumulative, sum(latency_ms)::BIGINT AS sum, count(*) AS count
    FROM u CROSS JOIN {_LE} GROUP BY ALL)"""
_usage("metric_latency_histogram", f", {_HIST} SELECT * FROM h")
_QUANTILE = """o AS (SELECT *, CASE WHEN le < 0 THEN 1e300 ELSE le END AS hi FROM h),
    st AS (SELECT *, coalesce(lag(hi) OVER w, 0) AS lo, coalesce(lag(cumulative) OVER w, 0) AS before,
      0.99::DOUBLE * max(cumulative) OVER (PARTITION BY {k}) AS rank
      FROM o WINDOW w AS (PARTITION BY {k} ORDER BY hi)),
    x AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY hi) AS rn FROM st WHERE cumulative >= rank AND rank > 0),
    qt AS (SELECT *, CASE WHEN hi = 1e300 THEN lo ELSE lo + (hi - lo) * (rank - before) / (cumulative - before) END
      AS quantile FROM x WHERE rn = 1)"""
_LABELS = "model_used, cache_hit, complexity"
_usage(
    "metric_histogram_quantile",
    f", {_HIST}, {_QUANTILE.format(k=_LABELS)} SELECT {_LABELS}, round(quantile, 4) AS quantile FROM qt",
)
_add(
    "metric_proxy_status",
    "SELECT method, status, count(*) AS value FROM request_events GROUP BY ALL",
    "request_events",
)
_add(
    "metric_proxy_errors",
    """SELECT error_type, count(*) AS value FROM request_events WHERE error_type IS NOT NULL GROUP BY ALL""",
    "request_events",
)
_add(
    "metric_embedding_requests",
    """WITH k AS (SELECT DISTINCT text FROM conversations WHERE role = 'system')
    SELECT CASE WHEN text IN (SELECT text FROM k) THEN 'hit' ELSE 'miss' END AS cache_hit,
    count(*) AS requests FROM conversations GROUP BY ALL""",
)

# ---- cache lookups

_NEAREST = """
d AS (SELECT p.query_id, c.id, round(list_cosine_similarity(p.embedding, c.embedding::DOUBLE[]), 9) AS sim
  FROM probes p JOIN prompt_cache c ON c.team_id = p.team_id),
best AS (SELECT query_id, id AS matched_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rn FROM d) WHERE rn = 1)
"""
_LOOKUP = f"""{_NEAREST},
x AS (SELECT p.query_id, p.team_id, p.label, p.prompt_text, c.id AS exact_id FROM probes p
  LEFT JOIN prompt_cache c ON c.team_id = p.team_id AND c.prompt_text = p.prompt_text),
l AS (SELECT x.*, CASE WHEN exact_id IS NOT NULL THEN 1.0::DOUBLE WHEN sim >= 0.85 THEN sim END AS similarity,
    CASE WHEN exact_id IS NOT NULL THEN 'exact_hash' WHEN sim >= 0.92 THEN 'semantic' END AS layer,
    CASE WHEN exact_id IS NOT NULL OR sim >= 0.92 THEN 'hit' WHEN sim >= 0.85 THEN 'near_miss' ELSE 'miss' END AS outcome,
    coalesce(exact_id, matched_id) AS matched_id
  FROM x LEFT JOIN best ON best.query_id = x.query_id)
"""


def _lookup(name: str, sql: str) -> None:
    _add(name, f", {_LOOKUP} {sql}", "prompt_cache", "probes")


_add(
    "exact_lookup",
    """SELECT query_id, p.team_id, c.id AS cache_id FROM probes p LEFT JOIN prompt_cache c
    ON c.team_id = p.team_id AND sha256(c.prompt_text) = sha256(p.prompt_text)""",
    "prompt_cache",
    "probes",
)
_lookup("semantic_lookup", "SELECT query_id, matched_id AS cache_id, round(sim, 6) AS similarity FROM best")
_lookup(
    "two_layer_lookup",
    """SELECT query_id, l.team_id, layer, outcome,
    CASE WHEN outcome = 'hit' AND similarity >= 1.0 THEN 'redis_hit' WHEN outcome = 'hit' THEN 'semantic_hit'
      ELSE 'miss' END AS cache_label,
    CASE WHEN outcome = 'hit' THEN matched_id END AS cache_id,
    CASE WHEN outcome = 'hit' THEN c.model_used END AS cached_model,
    CASE WHEN outcome = 'hit' THEN c.cost_usd END::DOUBLE AS cached_cost,
    round(similarity, 6) AS similarity FROM l LEFT JOIN prompt_cache c ON c.id = matched_id""",
)
ORACLES["semantic_lookup_all_lists"] = ORACLES["semantic_lookup"]
ORACLES["semantic_lookup_two_rounds"] = ORACLES["semantic_lookup"]
_add(
    "semantic_lookup_recall",
    """SELECT count(*) AS queries, true AS recall_reached FROM probes
    WHERE team_id IN (SELECT team_id FROM prompt_cache)""",
    "prompt_cache",
    "probes",
)
_add(
    "semantic_lookup_reading",
    """SELECT sum(n)::BIGINT AS all_pairs, true AS within FROM (SELECT count(*) * 16 AS n FROM probes p
    WHERE team_id IN (SELECT team_id FROM prompt_cache) GROUP BY team_id)""",
    "prompt_cache",
    "probes",
)
_add("vector_index_lists", "SELECT team_id, count(*) AS vectors, true AS bounded FROM prompt_cache GROUP BY team_id", "prompt_cache")
_add(
    "cache_scan_team",
    """SELECT id, sha256(prompt_text) AS prompt_hash, model_used, hit_count FROM prompt_cache
    WHERE team_id = 'default'""",
    "prompt_cache",
)
_lookup(
    "cached_replies",
    """SELECT query_id, matched_id AS cache_id, 'reply to ' || c.prompt_text AS reply
    FROM l JOIN prompt_cache c ON c.id = matched_id WHERE outcome = 'hit'""",
)
_add(
    "top_prompts_by_team",
    """SELECT team_id, rn AS rank, CASE WHEN length(prompt_text) > 80 THEN substr(prompt_text, 1, 80) || '...' ELSE prompt_text END AS prompt_preview,
    hit_count, (hit_count * cost_usd)::DOUBLE AS cost_saved_usd
    FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY hit_count DESC, id) AS rn FROM prompt_cache)
    WHERE rn <= 10""",
    "prompt_cache",
)
_lookup(
    "near_misses",
    """SELECT query_id, l.team_id, l.prompt_text, c.prompt_text AS cached_text, round(similarity, 6) AS similarity
    FROM l JOIN prompt_cache c ON c.id = matched_id WHERE outcome = 'near_miss'""",
)
_add(
    "threshold_sweep",
    f""", {_NEAREST}, t AS (SELECT unnest([0.86, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98])::DOUBLE AS threshold),
    r AS (SELECT CASE WHEN sim >= 0.85 THEN sim ELSE 0 END AS sim, p.label = c.label AS same
      FROM probes p JOIN best USING (query_id) JOIN prompt_cache c ON c.id = matched_id)
    SELECT threshold, count(*) AS lookups, count(*) FILTER (sim >= threshold) AS hits,
      count(*) FILTER (sim >= 0.85 AND sim < threshold) AS near_misses,
      count(*) FILTER (sim >= threshold AND NOT same) AS mismatched,
      round(CASE WHEN count(*) FILTER (sim >= threshold) > 0 THEN count(*) FILTER (sim >= threshold AND NOT same)
        / count(*) FILTER (sim >= threshold) ELSE 0 END, 6)::DOUBLE AS false_hit_rate
    FROM r, t GROUP BY threshold""",
    "prompt_cache",
    "probes",
)
_lookup(
    "cache_quality",
    """SELECT team_id, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'near_miss') AS near_misses,
    round(avg(similarity) FILTER (outcome = 'hit'), 6) AS avg_similarity_on_hits FROM l GROUP BY team_id""",
)
_lookup(
    "metric_cache",
    """, w AS (SELECT team_id, count(*) FILTER (layer = 'exact_hash') AS a, count(*) FILTER (layer = 'semantic') AS b,
      count(*) FILTER (exact_id IS NULL) AS c, count(*) FILTER (outcome = 'near_miss') AS d,
      count(*) FILTER (outcome <> 'hit') AS e FROM l GROUP BY team_id)
    SELECT team_id, 'cache_hits_total' AS metric, 'exact_hash' AS label, a AS value FROM w
    UNION ALL SELECT team_id, 'cache_hits_total', 'semantic', b FROM w
    UNION ALL SELECT team_id, 'cache_misses_total', '', c FROM w
    UNION ALL SELECT team_id, 'cache_near_misses_total', 'intent_mismatch', d FROM w
    UNION ALL SELECT team_id, 'cache_true_misses_total', '', e FROM w""",
)
_lookup(
    "hit_count_update",
    """, h AS (SELECT matched_id, count(*) AS n FROM l WHERE outcome = 'hit' GROUP BY ALL)
    SELECT id, team_id, (hit_count + coalesce(n, 0))::INT AS hit_count
    FROM prompt_cache LEFT JOIN h ON matched_id = id""",
)
_BUCKETS = """
w AS (SELECT h, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS b, count(*) AS n
  FROM (SELECT h, unnest(string_split(text, ' ')) AS w FROM src) GROUP BY ALL),
nrm AS (SELECT h, sqrt(sum(n * n)::DOUBLE) AS norm FROM w GROUP BY h)
"""
_add(
    "embed_pending",
    f"""WITH src AS (SELECT DISTINCT sha256(text) AS h, text FROM conversations),
    known AS (SELECT DISTINCT sha256(text) AS h FROM conversations WHERE role = 'system'), {_BUCKETS}
    SELECT w.h AS text_hash, CASE WHEN w.h IN (SELECT h FROM known) THEN 'cached' ELSE 'computed' END AS source,
    round(list_sum(list(((n / norm)::FLOAT)::DOUBLE * (b + 1) ORDER BY b)), 3) AS weighted
    FROM w JOIN nrm ON nrm.h = w.h GROUP BY w.h""",
)
_VALID = """, ev AS (SELECT team_id, prompt_text, sha256(prompt_text) AS h, epoch_us(created_at) AS us FROM request_events),
    early AS (SELECT sha256('common question ' || i) AS h, epoch_us(TIMESTAMP '2023-12-31 18:00:00') AS us
      FROM range(0, {early}) AS r(i) WHERE sha256('common question ' || i) IN (SELECT h FROM ev)),
    d AS (SELECT DISTINCT h, us FROM ev UNION SELECT h, us FROM early),
    nx AS (SELECT *, min(us) OVER (PARTITION BY h ORDER BY us
      RANGE BETWEEN 86400000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM d),
    r AS (SELECT h, min(us) AS us FROM d GROUP BY h
      UNION ALL SELECT nx.h, nx.next FROM r JOIN nx ON r.h = nx.h AND r.us = nx.us WHERE nx.next IS NOT NULL),
    used AS (SELECT ev.*, r.us AS made FROM ev JOIN r ON r.h = ev.h AND r.us <= ev.us AND ev.us < r.us + 86400000000)"""
_add(
    "embed_valid_24h",
    f"""{_VALID.format(early=5)}, src AS (SELECT DISTINCT h, prompt_text AS text FROM ev), {_BUCKETS},
    v AS (SELECT w.h, round(list_sum(list(((n / norm)::FLOAT)::DOUBLE * (b + 1) ORDER BY b)), 3) AS weighted
      FROM w JOIN nrm ON nrm.h = w.h GROUP BY w.h)
    SELECT used.h AS text_hash, strftime(make_timestamp(made), '%Y-%m-%d %H:%M:%S.%f') AS computed_at,
    count(*) AS requests, any_value(weighted) AS weighted FROM used JOIN v ON v.h = used.h GROUP BY used.h, made""",
    "request_events",
)
_add(
    "embedding_sources",
    f"""{_VALID.format(early=0)} SELECT team_id, CASE WHEN us = made THEN 'computed' ELSE 'cached' END AS source,
    count(*) AS requests FROM used GROUP BY ALL""",
    "request_events",
)
_add(
    "cache_insert_if_absent",
    """, r AS (SELECT team_id, sha256(prompt_text) AS prompt_hash,
      arg_min(event_id, (created_at, event_id)) AS event_id FROM request_events WHERE status BETWEEN 200 AND 299
      GROUP BY ALL)
    SELECT team_id, prompt_hash, event_id, sha256(team_id || ':' || prompt_hash) AS id FROM r
    WHERE NOT EXISTS (SELECT 1 FROM prompt_cache c WHERE c.team_id = r.team_id AND sha256(c.prompt_text) = r.prompt_hash)""",
    "request_events",
    "prompt_cache",
)

# ---- rolling rates, alerts, limits, replay

_SEC = "(epoch_us(created_at) // {n}000000)"
_RATE = f"""SELECT team_id, {_at('(p - k) * 10')} AS window_start, count(*) FILTER (cache_hit) AS hits,
    count(*) AS lookups, round(count(*) FILTER (cache_hit) / count(*), 9) AS cache_hit_rate
    FROM (SELECT *, {_SEC.format(n=10)} AS p, unnest([0, 1, 2]) AS k FROM u) GROUP BY team_id, p - k"""
_usage("hit_rate_30s", _RATE)
_usage("stream_hit_rate", _RATE)
# What is closed a minute before the newest row.
_usage(
    "stream_hit_rate_append",
    f"{_RATE} HAVING ((p - k) * 10 + 30) * 1000000 <= (SELECT max(epoch_us(created_at)) FROM u) - 60000000",
)


def _held(keys: str, hold: int) -> str:
    """Runs over samples s({keys}, tick, breach) of a gauge held between samples."""
    return f"""
    i AS (SELECT *, row_number() OVER w - sum(breach::INT) OVER w AS run,
      coalesce(lead(tick) OVER w, tick) AS nxt FROM s WINDOW w AS (PARTITION BY {keys} ORDER BY tick)),
    runs AS (SELECT {keys}, min(tick) AS a, max(nxt) AS z, count(*) AS samples FROM i WHERE breach GROUP BY {keys}, run)
    SELECT {keys}, {_at('a')} AS started_at, {_at('z')} AS ended_at, {_at(f'a + {hold}')} AS fired_at, samples
    FROM runs WHERE z - a >= {hold}"""


_usage(
    "alert_low_hit_rate",
    f""", s AS (SELECT team_id, ({_SEC.format(n=3600)} + 1) * 3600 AS tick,
      count(*) FILTER (cache_hit) / count(*) < 0.2 AS breach FROM u GROUP BY ALL), {_held('team_id', 7200)}""",
)
_usage(
    "alert_high_latency",
    f""", raw AS (SELECT *, ({_SEC.format(n=3600)} + 1) * 3600 AS tick FROM u),
    samples AS (SELECT DISTINCT {_LABELS}, tick FROM raw),
    h AS (SELECT s.model_used, s.cache_hit, s.complexity, s.tick, le::DOUBLE AS le,
      count(*) FILTER (r.latency_ms <= le OR le < 0) AS cumulative
      FROM samples s JOIN raw r ON r.model_used = s.model_used AND r.cache_hit = s.cache_hit
        AND r.complexity = s.complexity AND r.tick <= s.tick CROSS JOIN {_LE} GROUP BY ALL),
    {_QUANTILE.format(k=_LABELS + ', tick')},
    s AS (SELECT {_LABELS}, tick, quantile > 2475.0 AS breach FROM qt), {_held(_LABELS, 5 * 3600)}""",
)
_add(
    "alert_error_rate",
    f""", p AS (SELECT error_type, {_SEC.format(n=1800)} - unnest([0, 1, 2, 3]) AS w FROM request_events
      WHERE error_type IS NOT NULL),
    b AS (SELECT error_type, w, w * 1800 + 7200 AS tick FROM p GROUP BY ALL HAVING count(*) / 7200.0 > 0.0008),
    i AS (SELECT *, w - row_number() OVER (PARTITION BY error_type ORDER BY w) AS run FROM b),
    r AS (SELECT error_type, min(tick) AS a, max(tick) AS z, count(*) AS samples FROM i GROUP BY error_type, run)
    SELECT error_type, {_at('a')} AS started_at, {_at('z')} AS ended_at, {_at('a + 3600')} AS fired_at, samples
    FROM r WHERE z - a >= 3600""",
    "request_events",
)
_add(
    "rate_limit_audit",
    f"""SELECT team_id, {_at('h * 3600')} AS window_start, count(*) AS requests,
    round(count(*) - (0.001::DOUBLE * 3600 + 2), 4) AS excess
    FROM (SELECT team_id, {_SEC.format(n=3600)} AS h FROM request_events)
    GROUP BY team_id, h HAVING count(*) > 0.001::DOUBLE * 3600 + 2""",
    "request_events",
)
_LIMIT = """, ev AS (SELECT team_id, event_id, epoch_us(created_at) AS us,
      row_number() OVER (PARTITION BY team_id ORDER BY created_at, event_id) AS rn FROM request_events),
    r AS (SELECT team_id, event_id, rn, true AS allowed, 19.0::DOUBLE AS tokens, us AS last FROM ev WHERE rn = 1
      UNION ALL
      SELECT team_id, event_id, rn, ok, CASE WHEN ok THEN now - 1 ELSE tokens END, CASE WHEN ok THEN us ELSE last END
      FROM (SELECT *, (1.0::DOUBLE - now) / 0.001::DOUBLE * 1e9 < 1.0 AS ok FROM (
        SELECT ev.team_id, ev.event_id, ev.rn, ev.us, r.tokens, r.last,
          least(20.0::DOUBLE, r.tokens + (ev.us - r.last) * 0.001::DOUBLE / 1e6) AS now
        FROM r JOIN ev ON ev.team_id = r.team_id AND ev.rn = r.rn + 1)))
    SELECT event_id, team_id, allowed FROM r"""
_add("rate_limit_exact", _LIMIT, "request_events")
_add("stream_rate_limit", _LIMIT, "request_events")
_TTL = """, ev AS (SELECT team_id, sha256(prompt_text) AS h, epoch_us(created_at) AS us FROM request_events),
    d AS (SELECT DISTINCT * FROM ev),
    nx AS (SELECT *, min(us) OVER (PARTITION BY team_id, h ORDER BY us
      RANGE BETWEEN 86400000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM d),
    r AS (SELECT team_id, h, min(us) AS us FROM ev GROUP BY ALL
      UNION ALL
      SELECT nx.team_id, nx.h, nx.next FROM r JOIN nx ON r.team_id = nx.team_id AND r.h = nx.h AND r.us = nx.us
      WHERE nx.next IS NOT NULL),
    n AS (SELECT team_id, h, count(*) AS requests FROM ev GROUP BY ALL),
    s AS (SELECT team_id, h, count(*) AS sets FROM r GROUP BY ALL),
    t AS (SELECT team_id, count(*) AS prompts, sum(requests)::BIGINT AS requests, sum(sets)::BIGINT AS sets,
      sum(requests - sets)::BIGINT AS exact_hits, sum(sets - 1)::BIGINT AS renewals
      FROM n JOIN s USING (team_id, h) GROUP BY team_id)"""
_add("ttl_exact_replay", f"{_TTL} SELECT * FROM t", "request_events")
_add(
    "stream_ttl_cache",
    f"""{_TTL} SELECT team_id, unnest(['set', 'renewed', 'hit']) AS kind,
    unnest([prompts, renewals, exact_hits]) AS requests FROM t""",
    "request_events",
)

# ---- streams

_add(
    "stream_usage_append",
    """SELECT id, team_id, model_used, latency_ms, strftime(created_at, '%Y-%m-%d') AS day FROM usage_raw
    WHERE team_id IS NOT NULL AND input_tokens >= 0 AND cost_usd >= 0 AND latency_ms >= 0 AND cost_usd < 100
      AND complexity IN ('simple', 'medium', 'complex')""",
    "usage_raw",
)
_add(
    "stream_daily_cost",
    """SELECT team_id, strftime(created_at, '%Y-%m-%d') AS day, sum(cost_usd)::DOUBLE AS cost_usd,
    count(*) AS requests FROM usage_log GROUP BY ALL""",
    "usage_log",
)
_add(
    "stream_daily_cost_append",
    """SELECT team_id, strftime(d, '%Y-%m-%d') AS day, sum(cost_usd)::DOUBLE AS cost_usd, count(*) AS requests
    FROM (SELECT *, date_trunc('day', created_at) AS d FROM usage_log) GROUP BY team_id, d
    HAVING d + INTERVAL 1 DAY <= (SELECT max(created_at) FROM usage_log) - INTERVAL 1 HOUR""",
    "usage_log",
)
_add(
    "stream_late_rows",
    """, ev AS (SELECT *, least(least((day(created_at) - 1) // 6, 4) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END, 4)::BIGINT
      AS batch FROM request_events),
    m AS (SELECT batch, max(max(created_at)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM ev GROUP BY batch)
    SELECT team_id, ev.batch, count(*) AS dropped FROM ev JOIN m ON m.batch = ev.batch
    WHERE created_at < newest - INTERVAL 1 HOUR GROUP BY ALL""",
    "request_events",
)
_add(
    "stream_counters",
    """SELECT team_id, model_used, provider, complexity, cache_hit, count(*) AS requests,
    sum(cost_usd)::DOUBLE AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(latency_ms)::BIGINT AS latency_ms_sum
    FROM usage_log GROUP BY ALL""",
    "usage_log",
)
_add(
    "stream_dedup",
    "SELECT DISTINCT team_id, sha256(prompt_text) AS prompt_hash FROM request_events",
    "request_events",
)
def _population(pieces: int) -> str:
    """Micro-batch after micro-batch: what is asked, what the entries before it serve, what becomes an entry."""
    ctes = [
        """ev AS (SELECT *, least((day(created_at) - 1) // 6, 4) AS piece, sha256(prompt_text) AS h FROM request_events),
    src AS (SELECT DISTINCT h, prompt_text AS text FROM ev)""",
        _BUCKETS,
        """x AS (SELECT w.h, b, ((n / norm)::FLOAT)::DOUBLE AS v FROM w JOIN nrm ON nrm.h = w.h),
    len AS (SELECT h, sqrt(sum(v * v)) AS l, round(list_sum(list(v * (b + 1) ORDER BY b)), 3) AS weighted FROM x GROUP BY h),
    sims AS (SELECT q.h AS qh, c.h AS ch, round(sum(q.v * c.v) / (any_value(lq.l) * any_value(lc.l)), 9) AS sim
      FROM x q JOIN x c ON c.b = q.b JOIN len lq ON lq.h = q.h JOIN len lc ON lc.h = c.h
      GROUP BY q.h, c.h HAVING sim >= 0.85),
    e0 AS (SELECT team_id, h, sha256(team_id || ':' || h) AS id, event_id FROM ev WHERE false)""",
    ]
    for k in range(pieces):
        ctes.append(
            f"""q{k} AS (SELECT team_id, h, count(*) AS n,
        arg_min(event_id, (created_at, event_id)) FILTER (status BETWEEN 200 AND 299) AS event_id
      FROM ev WHERE piece = {k} GROUP BY ALL),
    x{k} AS (SELECT q.*, e.id AS exact_id FROM q{k} q LEFT JOIN e{k} e ON e.team_id = q.team_id AND e.h = q.h),
    s{k} AS (SELECT team_id, h, id AS near_id FROM (
        SELECT q.team_id, q.h, e.id, s.sim, row_number() OVER (PARTITION BY q.team_id, q.h ORDER BY s.sim DESC, e.id) AS rn
        FROM x{k} q JOIN sims s ON s.qh = q.h JOIN e{k} e ON e.team_id = q.team_id AND e.h = s.ch
        WHERE q.exact_id IS NULL) WHERE rn = 1 AND sim >= 0.92),
    l{k} AS (SELECT q.*, near_id FROM x{k} q LEFT JOIN s{k} s ON s.team_id = q.team_id AND s.h = q.h),
    e{k + 1} AS (SELECT * FROM e{k} UNION ALL SELECT team_id, h, sha256(team_id || ':' || h), event_id FROM l{k}
      WHERE exact_id IS NULL AND near_id IS NULL AND event_id IS NOT NULL)"""
        )
    hits = " UNION ALL ".join(
        f"SELECT coalesce(exact_id, near_id) AS id, CASE WHEN exact_id IS NULL THEN 0 ELSE n END AS a,"
        f" CASE WHEN exact_id IS NULL THEN n ELSE 0 END AS b FROM l{k}"
        for k in range(pieces)
    )
    ctes.append(f"hit AS (SELECT id, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM ({hits}) WHERE id IS NOT NULL GROUP BY id)")
    ctes.append(_PRICE)
    ctes.append(
        f"""o AS (SELECT e.id, e.team_id, e.h, ev.prompt_text, e.event_id, strlen(ev.prompt_text) // 4 AS tin,
      e.event_id % 100 AS tout, ['groq/gpt-oss-20b', 'openai/gpt-4o', 'anthropic/claude-haiku-3'][e.event_id % 3 + 1] AS model
      FROM e{pieces} e JOIN ev ON ev.event_id = e.event_id)"""
    )
    return ", ".join(ctes)


_add(
    "stream_cache_population",
    f""", {_population(5)}
    SELECT o.id, o.team_id, o.h AS prompt_hash, prompt_text, event_id, model AS model_used, tin::INT AS input_tokens,
    tout::INT AS output_tokens, ({_priced('tin', 'tout')})::DOUBLE AS cost_usd, 'reply ' || event_id AS reply, weighted,
    (coalesce(a, 0) + coalesce(b, 0))::BIGINT AS hit_count, coalesce(a, 0)::BIGINT AS exact_hits,
    coalesce(b, 0)::BIGINT AS semantic_hits
    FROM o JOIN price ON pm = model JOIN len ON len.h = o.h LEFT JOIN hit ON hit.id = o.id""",
    "request_events",
)

# ---- end to end

ORACLES["request_usage_rows"] = f"""
WITH conv_turns AS ({W.CONV_TURNS}), cached AS ({W.PROMPTS}), {_request_passes()},
prompts AS (SELECT conv_id AS request_id,
    CASE conv_id % 4 WHEN 0 THEN 'team-alpha' WHEN 1 THEN 'team-beta' WHEN 2 THEN 'team-gamma'
      ELSE 'default' END AS team_id,
    CASE WHEN conv_id % 5 = 0 THEN 'untagged' ELSE 'chat' END AS feature_tag,
    CASE WHEN conv_id % 6 = 0 THEN 'openai/gpt-4o' ELSE '' END AS model_override,
    arg_min(t, turn) FILTER (role = 'user') AS prompt_text
  FROM z7 WHERE conv_id % 13 <> 0 GROUP BY conv_id
  HAVING coalesce(arg_min(t, turn) FILTER (role = 'user'), '') <> ''),
{_CLASS}, {_PRICE},
src AS (SELECT sha256(prompt_text) AS h, min(prompt_text) AS text
  FROM (SELECT prompt_text FROM cached UNION ALL SELECT prompt_text FROM prompts WHERE team_id = 'default')
  GROUP BY ALL),
{_BUCKETS}, x AS (SELECT w.h, b, ((n / norm)::FLOAT)::DOUBLE AS v FROM w JOIN nrm ON nrm.h = w.h),
len AS (SELECT h, sqrt(sum(v * v)) AS l FROM x GROUP BY h),
keys AS (SELECT DISTINCT sha256(prompt_text) AS h FROM cached),
sims AS (SELECT q.h AS qh, c.h AS ch, sum(q.v * c.v) / (any_value(lq.l) * any_value(lc.l)) AS sim
  FROM x q JOIN x c ON c.b = q.b JOIN keys ON keys.h = c.h
  JOIN (SELECT DISTINCT sha256(prompt_text) AS h FROM prompts WHERE team_id = 'default') a ON a.h = q.h
  JOIN len lq ON lq.h = q.h JOIN len lc ON lc.h = c.h GROUP BY q.h, c.h),
hits AS (SELECT qh AS h FROM sims GROUP BY qh HAVING round(max(sim), 9) >= 0.92
  UNION SELECT h FROM keys),
replies AS (SELECT conv_id, arg_min(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
o AS (SELECT routed.*, team_id = 'default' AND sha256(prompt_text) IN (SELECT h FROM hits) AS hit, reply
  FROM routed LEFT JOIN replies ON conv_id = request_id),
p AS (SELECT *, CASE WHEN hit THEN 'groq/gpt-oss-20b' ELSE model END AS used, strlen(reply) // 4 AS out_bytes
  FROM o WHERE hit OR reply IS NOT NULL)
SELECT request_id AS id, {_at('1704067200 + request_id * 600')} AS created_at, team_id, feature_tag,
  used AS model_used, CASE WHEN hit THEN 'groq' ELSE provider END AS provider,
  CASE WHEN hit THEN 0 ELSE bytes END::INT AS input_tokens,
  CASE WHEN hit THEN 0 ELSE out_bytes END::INT AS output_tokens,
  CASE WHEN hit THEN 0.000125 ELSE {_priced('bytes', 'out_bytes')} END::DOUBLE AS cost_usd,
  CASE WHEN reply IS NULL THEN 0 ELSE 200 + request_id % 1000 END::INT AS latency_ms,
  hit AS cache_hit, complexity
FROM p LEFT JOIN price ON pm = model
"""
_add(
    "routing_whatif",
    f""", {_PRICE}, x AS (SELECT t.*, CASE complexity WHEN 'simple' THEN 'groq/gpt-oss-20b'
      WHEN 'medium' THEN 'groq/llama-3.3-70b-versatile' ELSE 'groq/gpt-oss-120b' END AS model FROM traffic t),
    y AS (SELECT team_id, cache_hit, CAST((input_tokens * 2500 + output_tokens * 10000 + 5) // 10 AS DECIMAL(18, 0))
      * CAST('0.00000001' AS DECIMAL(9, 8)) AS base, {_priced('input_tokens', 'output_tokens')} AS routed
      FROM x JOIN price ON pm = model),
    z AS (SELECT team_id, count(*) AS requests, sum(base)::DOUBLE AS baseline_usd, sum(routed)::DOUBLE AS routed_usd,
      sum(CASE WHEN cache_hit THEN 0 ELSE routed END)::DOUBLE AS routed_cached_usd FROM y GROUP BY team_id)
    SELECT *, round((1.0 - routed_usd / baseline_usd) * 100.0, 6) AS routed_reduction_pct,
      round((1.0 - routed_cached_usd / baseline_usd) * 100.0, 6) AS cached_reduction_pct FROM z""",
    "traffic",
)
