"""Hashed terms of texts: a bounded labelled sample for training, and scoring of whole tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from usagelens.llm.common import written

#: Terms kept from one token to the next occurrence, per worker.
CACHE = 60_000
#: Lengths of the word beginnings that are terms: inflected and compound forms share them.
HEADS = range(3, 9)
#: Seeds of the kinds of terms: the same string is another term in another kind.
WORD, MARK, HEAD, TAIL, SHAPE = range(7, 12)
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def terms_of(token: str) -> tuple[int, ...]:
    """Hashes of what a token shows: its word, its beginnings and what it is made of."""
    word = token.strip(_PUNCTUATION).lower()
    out = [xxh64_intdigest(word, WORD)] if word else [xxh64_intdigest(token[:3], MARK)]
    out += [xxh64_intdigest(word[:n], HEAD) for n in HEADS if n <= len(word)]
    tail = token[len(token.rstrip(_PUNCTUATION)) :]
    if len(tail) >= 2 and word:
        out.append(xxh64_intdigest(tail[-3:], TAIL))
    if len(word) > 1 and token.isupper():
        out.append(xxh64_intdigest("upper", SHAPE))
    return tuple(out)


def counts_of(text: str | None, cache: dict) -> dict[int, int]:
    """Term hashes of a whole text and how often each occurs; a token that repeats the one before it counts as one."""
    tokens = (text or "").split()
    counts: Counter = Counter()
    for token, n in Counter(tokens).items():
        terms = cache.get(token)
        if terms is None:
            if len(cache) >= CACHE:
                cache.clear()
            terms = cache[token] = terms_of(token)
        for t in terms:
            counts[t] += n
    again = sum(map(str.__eq__, tokens, tokens[1:]))
    if again:
        counts[xxh64_intdigest("again", SHAPE)] = again
    return counts


def bounded_sample(labelled: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hash of the id: the same rows in every run."""
    return labelled.orderBy(F.xxhash64(id_col), id_col).limit(most)


def hashed(sample: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """`terms, counts, tokens, label` of a bounded sample of texts, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            terms, counts, tokens = [], [], []
            for text in batch.column(0):
                found = counts_of(text.as_py(), cache)
                terms.append(np.fromiter(found.keys(), np.uint64, len(found)).view(np.int64))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
                tokens.append(len((text.as_py() or "").split()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.list_(pa.int64())),
                    pa.array(counts, pa.list_(pa.int32())),
                    pa.array(tokens, pa.int64()),
                    batch.column(1),
                ],
                names=["terms", "counts", "tokens", "label"],
            )

    rows = sample.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    return written(rows.mapInArrow(run, "terms array<long>, counts array<int>, tokens long, label int"), "hashed")


def screened(texts: DataFrame, most: int, least_docs: int) -> np.ndarray:
    """The `most` terms that move the mean label most among those in `least_docs` texts or more, sorted."""
    mean = texts.agg(F.avg("label")).first()[0] or 0.0
    score = F.abs(F.col("labels") - F.col("n") * mean) / F.sqrt(F.col("n") + 1)
    rows = (
        texts.select(F.explode("terms").alias("term"), "label")
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("label").alias("labels"))
        .where(F.col("n") >= least_docs)
        .orderBy(score.desc(), "term")
        .limit(most)
        .collect()
    )
    return np.sort(np.array([r["term"] for r in rows], np.int64))


def placed(texts: DataFrame, vocabulary: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Places in the vocabulary, counts, numbers of tokens and labels of the sample: what the fit needs, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, counts = [], []
            for t, c in zip(batch.column(0), batch.column(1)):
                t, c = t.values.to_numpy(zero_copy_only=False), c.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(vocabulary, t), max(len(vocabulary) - 1, 0))
                known = vocabulary[at] == t if len(vocabulary) else np.zeros(len(t), bool)
                where.append(at[known].astype(np.int32).tobytes())
                counts.append(c[known].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.binary()), pa.array(counts, pa.binary()), batch.column(2), batch.column(3)],
                names=["places", "counts", "tokens", "label"],
            )

    rows = texts.mapInArrow(run, "places binary, counts binary, tokens long, label int").toPandas()
    return (
        [np.frombuffer(t, np.int32) for t in rows["places"]],
        [np.frombuffer(c, np.int32) for c in rows["counts"]],
        rows["tokens"].to_numpy(np.int64),
        rows["label"].to_numpy(np.int64),
    )


def scored(text: Column, vocabulary: np.ndarray, predict: Callable[[np.ndarray, np.ndarray, int], tuple], kind: str):
    """A column of `predict(positions in the vocabulary, counts, tokens)` for each whole text (null: empty)."""
    fields = kind.replace("double", "").replace(",", " ").split()

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        places = {int(h) & (2**64 - 1): i for i, h in enumerate(vocabulary)}
        again = places.get(xxh64_intdigest("again", SHAPE))
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            out = []
            for text in texts:
                tokens = (text or "").split()
                counts: dict[int, int] = {}
                for token, n in Counter(tokens).items():
                    at = known.get(token)
                    if at is None:
                        if len(known) >= CACHE:
                            known.clear()
                        at = known[token] = tuple(p for t in terms_of(token) if (p := places.get(t)) is not None)
                    for p in at:
                        counts[p] = counts.get(p, 0) + n
                if again is not None and (n := sum(map(str.__eq__, tokens, tokens[1:]))):
                    counts[again] = n
                where = np.fromiter(counts.keys(), np.int64, len(counts))
                out.append(predict(where, np.fromiter(counts.values(), np.float64, len(counts)), len(tokens)))
            yield pd.DataFrame(out, columns=fields)

    return score(text)
