"""Passages of a benchmark in documents, found by spaced seeds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import free_name, row_key, slices, written

#: Offsets that each seed looks at, seven of them. In any SPAN neighbouring tokens, whichever two are substituted, some
#: seed at some place inside looks at neither.
SPAN = 12
MASKS = (
    (0, 1, 3, 4, 5, 6, 7),
    (0, 1, 2, 3, 5, 7, 8),
    (0, 1, 5, 6, 8, 9, 10),
    (0, 1, 2, 3, 4, 10, 11),
)
SEEDS = len(MASKS)
#: More than the ways to leave out two places of fewer than SPAN.
_WAYS = 64
#: An overlap: so many tokens side by side (or a whole shorter item) of which this share is equal.
OVERLAP, SHARE = 13, 0.8
#: Tokens kept on either side of a hit for verification.
MARGIN = 24
#: Bits of the filter that documents' hashes pass before the join: its size is fixed, whatever the benchmark's.
FILTER_BITS = 1 << 25
_CHARS, _CACHE = 1 << 21, 100_000
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _factors() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 3) | 1 for i in range(SPAN)], dtype=np.uint64)


class Tokens:
    """Token hashes of texts: words at white space, without outer punctuation, in lower case; the rest is skipped."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        for word in (text or "").split():
            h = known.get(word)
            if h is None:
                if len(known) >= _CACHE:
                    known.clear()
                bare = word.strip(_PUNCTUATION).lower()
                h = known[word] = xxhash.xxh64_intdigest(bare, 5) | 1 if bare else 0
            if h:
                out.append(h)
        return np.array(out, dtype=np.uint64)


def _needed(length: int) -> int:
    """Equal places that an overlap of so many tokens needs."""
    return math.ceil(length * SHARE)


def _left_out(length: int) -> list[tuple[int, ...]]:
    """All ways to leave out as many places of a whole short item as may be substituted."""
    return list(combinations(range(length), length - _needed(length)))


def _length_of(number: int) -> int:
    """Tokens that a seed spans."""
    return MASKS[number][-1] + 1 if number < SEEDS else (number - SEEDS) // _WAYS


def _seed_hashes(tokens: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(seed number, hash at every start) of each mask; then of whole runs of the lengths given, once for each way to
    leave out the places that may differ.
    """
    factors = _factors()
    for number, mask in enumerate(MASKS):
        n = len(tokens) - mask[-1]
        if n > 0:
            total = np.zeros(n, dtype=np.uint64)
            for j in mask:
                total += tokens[j : j + n] * factors[j]
            yield number, _mixed(total + np.uint64(number))
    for length in lengths:
        n = len(tokens) - length + 1
        if n > 0:
            total = np.zeros(n, dtype=np.uint64)
            for j in range(length):
                total += tokens[j : j + n] * factors[j]
            for way, places in enumerate(_left_out(length)):
                kept = total.copy()
                for j in places:
                    kept -= tokens[j : j + n] * factors[j]
                number = SEEDS + length * _WAYS + way
                yield number, _mixed(kept + np.uint64(number))


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(FILTER_BITS - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`item_id, tokens, seeds(number, hash, at)`: an item of fewer than SPAN tokens has the seeds of its whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Tokens()
        for batch in batches:
            tokens, seeds = [], []
            for text in batch.column(1):
                t = hashed(text.as_py())
                tokens.append(t.view(np.int64))
                found = _seed_hashes(t, [])
                if 0 < len(t) < SPAN:
                    found = (x for x in _seed_hashes(t, [len(t)]) if x[0] >= SEEDS)
                seeds.append(
                    [
                        {"number": number, "hash": int(h), "at": at}
                        for number, hashes in found
                        for at, h in enumerate(hashes.view(np.int64))
                    ]
                )
            kind = pa.list_(pa.struct([("number", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.list_(pa.int64())), pa.array(seeds, kind)],
                names=["item_id", "tokens", "seeds"],
            )

    kind = "item_id long, tokens array<long>, seeds array<struct<number:int,hash:long,at:int>>"
    return benchmark.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, kind)


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits of all benchmark hashes: words are put together by Spark; at most FILTER_BITS / 64 reach the driver."""
    low = F.lit(FILTER_BITS - 1)
    first = F.col("hash").bitwiseAND(low)
    second = F.shiftrightunsigned("hash", 32).bitwiseAND(low)
    words = (
        seeds.select(F.explode(F.array(first, second)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _regions(docs: DataFrame, id_cols: list[str], bits, short: list[int]) -> DataFrame:
    """Stretches of documents around hashes that pass the filter: ids, start, tokens, seeds(number, hash, at)."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, words = Tokens(), bits.value
        kind = pa.list_(pa.struct([("number", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lengths = [len(t) if (t := x.as_py()) else 0 for x in texts]
            for first, last in slices(lengths, _CHARS):
                parts = [hashed(texts[k].as_py()) for k in range(first, last)]
                sizes = np.array([len(p) for p in parts])
                flat = np.concatenate(parts)
                ends = np.repeat(np.cumsum(sizes), sizes)
                rows = []
                for number, hashes in _seed_hashes(flat, short):
                    a, b = _bits(hashes)
                    there = (words[a >> 6] >> (a & 63).astype(np.uint64)) & np.uint64(1)
                    at = np.flatnonzero(there)
                    b = b[at]
                    at = at[((words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)]
                    span = _length_of(number)
                    at = at[at + span <= ends[at]]
                    rows.append(np.stack([at, np.full(len(at), number), hashes[at].view(np.int64)], axis=1))
                hits = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
                if not len(hits):
                    continue
                hits = hits[np.argsort(hits[:, 0], kind="stable")]
                starts = np.cumsum(sizes) - sizes
                doc = np.searchsorted(np.cumsum(sizes), hits[:, 0], side="right")
                new = np.r_[True, (doc[1:] != doc[:-1]) | (np.diff(hits[:, 0]) > 2 * MARGIN)]
                take, begin, tokens, seeds = [], [], [], []
                for group in np.split(np.arange(len(hits)), np.flatnonzero(new)[1:]):
                    d = int(doc[group[0]])
                    low = max(starts[d], hits[group[0], 0] - MARGIN)
                    high = min(starts[d] + sizes[d], hits[group[-1], 0] + SPAN + MARGIN)
                    take.append(first + d)
                    begin.append(int(low - starts[d]))
                    tokens.append(flat[low:high].view(np.int64))
                    seeds.append(
                        [{"number": int(n), "hash": int(h), "at": int(p - low)} for p, n, h in hits[group].tolist()]
                    )
                ids = batch.take(pa.array(take)).columns[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *ids,
                        pa.array(begin, pa.int32()),
                        pa.array(tokens, pa.list_(pa.int64())),
                        pa.array(seeds, kind),
                    ],
                    names=[*id_cols, "start", "tokens", "seeds"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])
    return docs.mapInArrow(
        run, f"{kinds}, start int, tokens array<long>, seeds array<struct<number:int,hash:long,at:int>>"
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_cols: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item it holds a passage of: ids, `item_id`, `doc_start`, `item_start`,
    `tokens` and `matches` of the best overlap.

    Seeds ignore fixed token positions, so a hit survives substitutions there; the seeds together meet every overlap
    with up to two substitutions, the most that the rule allows. Documents' seed hashes first pass a
    bit filter of fixed size, then join the benchmark's by equality; the two token rows are laid side by side along
    the hit's diagonal, and an overlap counts when OVERLAP neighbouring tokens (a whole item where that is shorter)
    agree in SHARE of their places. Places count tokens that have a letter or digit. Items of fewer than SPAN tokens
    are looked for as a whole, by seeds that leave out every choice of places that may be substituted.

    Of overlaps with equally many matches the first in the document counts, then the first in the item. A null or empty
    text holds nothing; an empty item is in no document; very long texts are read in slices, and only the stretches
    around hits are kept. Null ids stay null; repeated rows share one result; repeated items are listed each; an
    empty table on either side gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = written(items_of(benchmark, item_col, item_text_col), "items")
    seeds = items.select("item_id", F.explode("seeds").alias("s")).select(
        "item_id", "s.number", "s.hash", F.col("s.at").alias("item_at")
    )
    length = F.floor((F.col("number") - SEEDS) / _WAYS).cast("int").alias("length")
    lengths = seeds.where(F.col("number") >= SEEDS).select(length).distinct().collect()  # fewer than SPAN rows
    short = sorted(r["length"] for r in lengths)
    bits = spark.sparkContext.broadcast(_filter(seeds))
    ids = [f"id{i}" for i in range(len(id_cols))]
    plain = docs.select(*(docs[c].alias(i) for c, i in zip(id_cols, ids)), docs[text_col].alias("text"))
    regions = written(_regions(plain, ids, bits, short).withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.explode("seeds").alias("s")).select("region", "s.number", "s.hash", "s.at")
    diagonals = (
        hits.join(seeds, ["number", "hash"])
        .select("region", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    sides = (
        diagonals.join(regions.select("region", *ids, "start", "tokens"), "region")
        .join(items.select("item_id", F.col("tokens").alias("item")).distinct(), "item_id")
        .withColumn("low", F.greatest(F.lit(0), -F.col("shift")))
        .withColumn("high", F.least(F.size("item"), F.size("tokens") - F.col("shift")))
        .withColumn("need", F.least(F.lit(OVERLAP), F.size("item")))
        .where("high - low >= need")
    )
    equal = F.expr(
        "zip_with(slice(item, low + 1, high - low), slice(tokens, low + shift + 1, high - low),"
        " (x, y) -> IF(x = y, 1, 0))"
    )
    sums = F.expr(
        "transform(sequence(0, high - low - need), i -> struct("
        "aggregate(slice(equal, i + 1, need), 0, (s, x) -> s + x) AS matches, -i AS place))"
    )
    best = (
        sides.withColumn("equal", equal)
        .withColumn("best", F.array_max(sums))
        .where(F.col("best.matches") >= F.ceil(F.col("need") * SHARE))
        .select(
            *ids,
            "item_id",
            F.struct(
                F.col("best.matches").alias("matches"),
                (-(F.col("start") + F.col("low") + F.col("shift") - F.col("best.place"))).alias("doc"),
                (-(F.col("low") - F.col("best.place"))).alias("item"),
                F.col("need").alias("tokens"),
            ).alias("found"),
        )
        .groupBy(*ids, "item_id")
        .agg(F.max("found").alias("found"))
    )
    return best.select(
        *(F.col(i).alias(c) for c, i in zip(id_cols, ids)),
        F.col("item_id").alias(item_col),
        (-F.col("found.doc")).alias("doc_start"),
        (-F.col("found.item")).alias("item_start"),
        F.col("found.tokens").alias("tokens"),
        F.col("found.matches").alias("matches"),
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that hold no passage of the benchmark, with their columns as they are (repeats and null ids as well)."""
    key = free_name(docs, "row_key")
    marked = docs.withColumn(key, row_key(docs[id_col], docs[text_col]))
    found = leaks(marked, benchmark, (key,), text_col).select(key).distinct()
    return marked.join(found, key, "left_anti").drop(key)
