from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from usagelens.functions import pricing, text as T
from usagelens.functions.timerange import range_days, range_hours, since_days
from usagelens.functions.vectors import cosine, outcome, outcome_label
from usagelens.operators import routing
from usagelens.session import scratch_path
from usagelens.sources import requests


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def texts(spark, values, make):
    return one(spark, [(v,) for v in values], "t string", make(F.col("t")))


def test_prompt_hash(spark):
    assert texts(spark, ["hello world", ""], T.prompt_hash) == [
        "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9",
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    ]


def test_word_tokens(spark):
    cases = {
        "": 0,
        "hello": 1,
        "Hello world": 2,
        "Hello, world!": 2,
        "hello    world": 2,
        "hello\tworld\ntest": 3,
        # The backtick is a symbol, not punctuation.
        "```\nprint('hello')\n```": 4,
        "a\u00a0b\u2003c\u0085d": 4,
        None: None,
    }
    assert texts(spark, list(cases), T.word_tokens) == list(cases.values())


def test_code_fence_and_bytes(spark):
    assert texts(spark, ["Hello world", "Use `var`", "```\nx\n```", "```python\n```"], T.code_fence) == [
        False, False, True, True,
    ]
    assert texts(spark, ["abcd", "abc", "éé", "ééé"], T.byte_tokens) == [1, 0, 1, 1]


def test_keyword_score_counts_overlaps_between_keywords(spark):
    values = ["explain why", "Analyze X and analyze Y", "nothing", "debugdebug"]
    assert texts(spark, values, T.keyword_score) == [2, 2, 0, 2]


CLASSES = [
    ("Hi", "simple"),
    ("What is 2+2?", "simple"),
    ("What's the weather like?", "simple"),
    ("Hello, how are you?", "simple"),
    ("Can you explain what a REST API is in simple terms?", "medium"),
    ("Explain what Docker is", "medium"),
    ("```\nprint('hello')\n```", "complex"),
    ("word " * 76, "medium"),
    ("word " * 345, "complex"),
    ("word " * 49, "simple"),
    ("word " * 50, "medium"),
    ("word " * 300, "medium"),
    ("word " * 301, "complex"),
    ("Compare and contrast the pros and cons of two designs", "complex"),
    ("First, explain what Docker is. And then describe it. After that, deploy it.", "complex"),
    ("debug this python code for me", "medium"),
    ("```python\npass\n```\ndebug this", "complex"),
    ("Analyze the performance of this algorithm", "medium"),
    ("Analyze the performance and analyze the memory usage", "complex"),
    ("Critique this design decision", "medium"),
    ("Explain step by step how HTTPS works", "complex"),
    ("Evaluate this approach", "medium"),
    ("What are the implications of this change", "medium"),
    ("First, do this", "simple"),
]


def test_complexity(spark):
    df = spark.createDataFrame([(t,) for t, _ in CLASSES], "prompt_text string").coalesce(1)
    got = [r["complexity"] for r in routing.classified(df).collect()]
    assert got == [c for _, c in CLASSES]


def test_routes_and_override(spark):
    rows = [
        ("What is 2+2?", "openai/gpt-4o"),
        ("What is 2+2?", ""),
        ("Explain what Docker is", None),
        ("```x```", ""),
    ]
    df = spark.createDataFrame(rows, "prompt_text string, model_override string").coalesce(1)
    out = routing.routed(routing.classified(df)).select("model", "provider", "reason").collect()
    assert [tuple(r) for r in out] == [
        ("openai/gpt-4o", "openai", "model_override"),
        ("groq/gpt-oss-20b", "groq", "simple_prompt"),
        ("groq/llama-3.3-70b-versatile", "groq", "medium_prompt"),
        ("groq/gpt-oss-120b", "groq", "complex_prompt"),
    ]


def test_unknown_class_takes_the_default(spark):
    df = spark.createDataFrame([("odd", "")], "complexity string, model_override string")
    row = routing.routed(df).first()
    assert (row["model"], row["reason"]) == (pricing.DEFAULT_MODEL, "default_model")


@pytest.mark.parametrize("with_table", [False, True])
def test_cost(spark, with_table):
    rows = [
        ("openai/gpt-4o-mini", 1_000_000, 1_000_000),
        ("nobody/knows", 1_000_000, 1_000_000),
        ("groq/gpt-oss-20b", 1, 1),
    ]
    df = spark.createDataFrame(rows, "model string, input_tokens int, output_tokens int").coalesce(1)
    table = pricing.price_table(spark) if with_table else None
    out = {r["model"]: r["cost_usd"] for r in pricing.with_cost(df, table).collect()}
    assert out["openai/gpt-4o-mini"] == Decimal("0.75")
    assert out["nobody/knows"] == Decimal("1.5")
    assert out["groq/gpt-oss-20b"] == Decimal("0.00000038")


def test_cost_without_fallback_price_is_zero(spark):
    table = pricing.price_table(spark, [("a", "1", "1")])
    df = spark.createDataFrame([("b", 10, 10)], "model string, input_tokens int, output_tokens int")
    assert pricing.with_cost(df, table).first()["cost_usd"] == 0


def test_provider_and_wire_names(spark):
    models = ["openai/gpt-4o", "anthropic/claude-haiku-3", "groq/new", "openai/x", "other/y", "openaix"]
    assert texts(spark, models, pricing.provider_of) == [
        "openai", "anthropic", "groq", "openai", "unknown", "unknown",
    ]
    assert texts(spark, models, pricing.wire_name) == [
        "gpt-4o", "claude-3-haiku-20240307", "new", "x", "other/y", "openaix",
    ]


def test_ranges():
    assert [range_days(x) for x in ("7d", "24h", "12h", "2m", "x", " 30D ")] == [7, 1, 0, 60, 7, 30]
    assert range_days("2m", months=False) == 7
    assert [range_hours(x) for x in ("24h", "7d", "?")] == [24, 168, 24]
    now = datetime(2024, 1, 31)
    assert since_days(now, "12h") == now


def test_outcomes(spark):
    sims = [(1.0,), (0.92,), (0.9199,), (0.85,), (0.8499,), (None,)]
    assert one(spark, sims, "s double", outcome(F.col("s"))) == [
        "hit", "hit", "near_miss", "near_miss", "miss", "miss",
    ]
    label = outcome_label(F.col("s") >= 0.92, F.col("s"))
    assert one(spark, sims[:3], "s double", label) == ["redis_hit", "semantic_hit", "miss"]


def test_cosine_of_zero_vector_is_null(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])]
    got = one(spark, rows, "a array<float>, b array<float>", cosine(F.col("a"), F.col("b")))
    assert got[0] == pytest.approx(0.5**0.5)
    assert got[1] is None


def test_key_audit(spark):
    rows = [("t", "/x", "good"), ("t", "/x", "bad"), ("t", "/x", ""), ("t", "/x", None), ("t", "/health", "bad")]
    df = spark.createDataFrame(rows, "team_id string, path string, api_key string")
    got = {r["problem"]: (r["requests"], r["key_sha256_prefix"]) for r in routing.key_audit(df, ["good"]).collect()}
    assert got["missing"] == (2, "")
    assert got["invalid"][0] == 1 and len(got["invalid"][1]) == 8
    assert routing.key_audit(df, []).count() == 0


def test_bodies_of_wrong_types_are_invalid(spark):
    good = '{"model": "m", "messages": [{"role": "user", "content": "hi"}], "max_tokens": 5, "x": [1]}'
    bodies = [
        good,
        '{"messages": [{"role": "user", "content": [{"type": "text"}]}]}',
        '{"messages": [{"role": "user", "content": 5}]}',
        '{"messages": [{"role": "user", "content": "hi"}], "max_tokens": "a"}',
        '{"messages": "x"}',
        "[1]",
        '{"messages": [{"role": "user", "content": "hi"}], "stream": "yes"}',
        '{"messages": []}',
        "{",
    ]
    rows = [(k, "", "", "", b, False) for k, b in enumerate(bodies)] + [(99, "", "", "", None, True)]
    df = spark.createDataFrame(
        rows, "request_id long, team_header string, feature_header string, model_header string, body string, oversize boolean"
    )
    got = {r["request_id"]: r["reject_reason"] for r in requests.decode(df).collect()}
    assert got == {0: None, **{k: "invalid_body" for k in (1, 2, 3, 4, 5, 6, 8)}, 7: "no_prompt", 99: "too_large"}


def test_a_model_priced_twice_doubles_no_row(spark):
    prices = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0)], "model string, input_per_1m double, output_per_1m double")
    prices = prices.selectExpr("model", "cast(input_per_1m as decimal(12,6)) input_per_1m", "cast(output_per_1m as decimal(12,6)) output_per_1m")
    df = spark.createDataFrame([("a", 10, 10)], "model string, input_tokens int, output_tokens int")
    assert pricing.with_cost(df, prices=prices, model="model").count() == 1


def test_provider_files_keep_order_and_text(spark):
    texts = ['quote " and \\ slash', "line\nfeed", "{}],\"body\":", "é 😀", ""]
    messages = [("system", "first"), ("user", texts[0]), ("assistant", texts[1]), ("system", "last"), ("user", texts[2]), ("user", texts[3]), ("user", texts[4])]
    rows = [(f'id "{i}"', m, messages, False, 0, 0.0) for i, m in enumerate(["anthropic/claude-haiku-3", "groq/gpt-oss-20b", "nobody/x"])]
    schema = "request_id string, model string, messages array<struct<role:string,content:string>>, stream boolean, max_tokens int, temperature double"
    shaped = requests.provider_body(spark.createDataFrame(rows, schema))
    path = scratch_path(spark, "files")
    requests.write_provider_files(shaped, path)
    back = {r["request_id"]: r for r in requests.read_provider_files(spark, path).collect()}
    assert set(back) == {'id "0"', 'id "1"'}
    assert [tuple(m) for m in back['id "1"']["messages"]] == messages and back['id "1"']["system"] is None
    assert [tuple(m) for m in back['id "0"']["messages"]] == [m for m in messages if m[0] != "system"]
    assert back['id "0"']["system"] == "last" and back['id "0"']["provider"] == "anthropic"
    # A reader of one provider reads its folder only.
    assert spark.read.text(f"{path}/provider=groq").count() == 1
