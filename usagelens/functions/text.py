"""Prompt text features and the complexity class built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Phrase lists and thresholds that decide the class.
COMPLEX_KEYWORDS = (
    "analyze",
    "compare",
    "synthesize",
    "explain why",
    "explain",
    "step by step",
    "walk me through",
    "evaluate",
    "contrast",
    "pros and cons",
    "what are the implications",
    "critique",
    "debug",
    "and then",
    "after that",
)
MULTI_STEP_PHRASES = ("and then", "after that", "first ", "next ", "finally ")
SIMPLE_BELOW = 50
COMPLEX_ABOVE = 300
CODE_FENCE = "```"
# One token is a run of characters that are neither white space nor punctuation.
WORD = r"[^\t-\r\x{85}\p{Z}\p{P}]+"


def prompt_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(team: Column, hashed: Column) -> Column:
    return F.concat_ws(":", F.lit("cache"), team, hashed)


def embedding_key(hashed: Column) -> Column:
    return F.concat_ws(":", F.lit("emb"), hashed)


def word_tokens(text: Column) -> Column:
    """Word count used by the classifier."""
    return F.regexp_count(text, F.lit(WORD))


def byte_tokens(text: Column) -> Column:
    """Billing estimate: a quarter of the UTF-8 length, rounded down."""
    return F.floor(F.octet_length(text) / F.lit(4)).cast("int")


def code_fence(text: Column) -> Column:
    return F.contains(text, F.lit(CODE_FENCE))


def keyword_score(text: Column, keywords=COMPLEX_KEYWORDS) -> Column:
    """All keyword occurrences; each keyword is counted on its own."""
    low = F.lower(text)
    # Keywords are ASCII, so byte lengths give the same count without decoding.
    per_keyword = [
        (
            (F.octet_length(low) - F.octet_length(F.replace(low, F.lit(k), F.lit(""))))
            / F.lit(len(k))
        ).cast("int")
        for k in keywords
    ]
    return reduce(lambda a, b: a + b, per_keyword)


def multi_step(text: Column, phrases=MULTI_STEP_PHRASES) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def complexity(
    tokens: Column,
    fence: Column,
    score: Column,
    steps: Column,
    simple_below: int = SIMPLE_BELOW,
    complex_above: int = COMPLEX_ABOVE,
) -> Column:
    plain = ~fence & ~steps
    return (
        F.when(plain & (score == 0) & (tokens < simple_below), F.lit("simple"))
        .when(~plain | (score >= 2) | (tokens > complex_above), F.lit("complex"))
        .otherwise(F.lit("medium"))
    )


def preview(text: Column, chars: int = 100) -> Column:
    return F.substring(text, 1, chars)
