"""Vector arithmetic on array columns, and the outcome of a similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A hit needs this similarity; the band below it is a near miss.
HIT_AT = 0.92
NEAR_AT = 0.85


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    squares = F.aggregate(
        a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def outcome(similarity: Column, hit_at: float = HIT_AT, near_at: float = NEAR_AT) -> Column:
    return (
        F.when(similarity >= hit_at, F.lit("hit"))
        .when(similarity >= near_at, F.lit("near_miss"))
        .otherwise(F.lit("miss"))
    )


def outcome_label(is_hit: Column, similarity: Column) -> Column:
    return (
        F.when(is_hit & (similarity >= 1.0), F.lit("redis_hit"))
        .when(is_hit, F.lit("semantic_hit"))
        .otherwise(F.lit("miss"))
    )
