"""Bloom filters built and asked with DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import written


@dataclass(frozen=True)
class Level:
    """A filter per slice of the keys: rows `slice, words`. The number gives each level hashes of its own."""

    number: int
    hashes: int
    bits: int
    words: DataFrame


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    one, two = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    size = F.lit(bits).cast("long")
    return [F.pmod(F.pmod(one, size) + F.pmod(two, size) * F.lit(j), size) for j in range(hashes)]


def inside(key: Column, level: Level, number: int = 0) -> Column:
    """Whether the slice's filter of this level has the key; the filter comes as a scalar, without a join."""
    words = level.words.where(F.col("slice") == number).select("words").scalar()
    tests = []
    for at in _positions(key, level.number, level.hashes, level.bits):
        word = F.element_at(words, (F.shiftrightunsigned(at, 6) + 1).cast("int"))
        shifted = F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int"))
        tests.append(shifted.bitwiseAND(F.lit(1)) == 1)
    return reduce(lambda a, b: a & b, tests)


def build(keys: DataFrame, number: int, slices: int, hashes: int, bits: int) -> Level:
    """Filters of `bits` bits, one for each slice of `keys(key, slice)`."""
    spark = keys.sparkSession
    set_bits = keys.select("slice", F.explode(F.array(*_positions(F.col("key"), number, hashes, bits))).alias("at"))
    words = set_bits.select(
        "slice",
        F.shiftright("at", 6).alias("word"),
        F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bits"),
    )
    count = bits // 64
    zeros = spark.range(slices * count).select(
        (F.col("id") / count).cast("int").alias("slice"), (F.col("id") % count).alias("word"), F.lit(0).cast("long")
    )
    rows = words.union(zeros).groupBy("slice", "word").agg(F.bit_or("bits").alias("bits"))
    filters = rows.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all"))
    filters = filters.select("slice", F.transform("all", lambda x: x["bits"]).alias("words"))
    return Level(number, hashes, bits, written(filters, "bloom"))
