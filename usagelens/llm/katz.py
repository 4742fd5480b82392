"""Katz backoff scores of texts: Good-Turing discounted counts of words and word pairs, exactly normalised.

Texts are cut into chunks of a few million tokens. A chunk asks for each of its distinct words and pairs once, in
packed blocks dealt to buckets by hash; a bucket adds up what all chunks have counted and answers each of them. So a
word or pair of any frequency costs a bucket one entry per chunk, and a chunk's texts stay together. Pairs are dealt by
their first word; those of a word with more than a bucket's share of all tokens are dealt by both words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest

from usagelens.llm.common import written

#: Tokens in a chunk (a longer text is a chunk of its own), and characters of the corpus per bucket.
CHUNK = 1 << 21
BUCKET_CHARS = 1 << 23
#: Largest count that is discounted.
MOST = 5
#: Ids beside those of known words: any word that was never counted, and what stands before a text's first word.
UNKNOWN, START = 1 << 62, (1 << 62) + 1


def _packed(values: np.ndarray) -> bytes:
    """The bytes of all values by significance, compressed."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), 3)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def discounts(counted: list[int]) -> np.ndarray:
    """Factors for counts 0 to MOST from the numbers of things counted 1 to MOST + 1 times (Good-Turing, as Katz).

    The largest discounted count is lowered until all factors lie in (0, 1]; without such a count nothing is
    discounted.
    """
    n = [0, *counted]
    for k in range(MOST, 1, -1):
        if not all(n[1 : k + 2]):
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest != 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (MOST - k)])
    return np.ones(MOST + 1)


def _freed(d: np.ndarray, by_count: np.ndarray) -> np.ndarray:
    """The count that discounting frees, from numbers of things counted 1 to MOST times (last axis)."""
    return by_count @ ((1 - d[1:]) * np.arange(1, MOST + 1))


def _discounted(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts * d[np.where(counts <= MOST, counts, 0)]


@dataclass(frozen=True)
class Words:
    """The unigram level: tokens, distinct words, texts learnt from, discounts, denominator, share of the unknown."""

    tokens: int
    distinct: int
    texts: int
    d: np.ndarray
    total: float
    unknown: float

    def share(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(self.d, counts) / max(self.total, 1), self.unknown)


def words_level(tokens: int, distinct: int, texts: int, counted: list[int]) -> Words:
    """Where discounting frees nothing, one more token, of an unknown word, is counted: its share is never zero."""
    d = discounts(counted)
    freed = float(_freed(d, np.array(counted[:MOST])))
    total = tokens if freed > 0 else tokens + 1
    return Words(tokens, distinct, texts, d, total, (freed if freed > 0 else 1) / total)


def _tokenised(docs: DataFrame, buckets: int, most: int) -> DataFrame:
    """Chunks: ids, held, lengths, tokens as places in the chunk's word list, and the words dealt to buckets."""

    id_type = to_arrow_type(docs.schema["id"].dataType)

    def chunk(number: int, ids: list, held: list, lengths: list, tokens: list, known: dict) -> pa.RecordBatch:
        places = np.concatenate(tokens)
        learnt = np.repeat(~np.array(held), lengths)
        counts = np.bincount(places[learnt], minlength=len(known))
        marks = np.frombuffer(b"".join(map(xxh3_128_digest, known)), np.uint64).reshape(-1, 2)
        bucket = marks[:, 0] % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        blocks = [
            {"bucket": int(bucket[part[0]]), "marks": marks[part].tobytes(), "counts": _packed(counts[part])}
            for part in np.split(order, cuts)
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([_packed(places)]),
                pa.array([_packed(order.astype(np.int32))]),
                pa.array([blocks], pa.list_(_BLOCK)),
            ],
            names=["chunk", "ids", "held", "lengths", "places", "dealt", "blocks"],
        )

    def fresh() -> tuple[list, list, list, list, dict]:
        # The empty string is no word: it stands for a text's end.
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        return [], [], [], [], known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        now = fresh()
        for batch in batches:
            for id_, text, kept in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                words = (text.as_py() or "").encode().lower().split()
                words.append(b"")
                if size and size + len(words) > most:
                    yield chunk(task << 32 | made, *now)
                    now, made, size = fresh(), made + 1, 0
                ids, held, lengths, tokens, known = now
                ids.append(id_.as_py())
                held.append(kept)
                lengths.append(len(words))
                tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size += len(words)
        if size:
            yield chunk(task << 32 | made, *now)

    kind = docs.schema["id"].dataType.simpleString()
    columns = f"chunk long, ids array<{kind}>, held array<boolean>, lengths array<int>, places binary, dealt binary"
    blocks = "blocks array<struct<bucket: long, marks: binary, counts: binary>>"
    return written(docs.select("id", "text", "held").mapInArrow(run, f"{columns}, {blocks}"), "chunks")


_BLOCK = pa.struct([("bucket", pa.int64()), ("marks", pa.binary()), ("counts", pa.binary())])
_COUNTED = [f"n{r}" for r in range(1, MOST + 2)]


def _groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of numbers: the place of each distinct pair, in order, and each row's place among them."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _words_answered(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket the ids and counts of the chunk's words; per bucket (chunk null) how often counts occur.

    A bucket numbers its words by falling count, so that frequent words have small ids, which pack well.
    """

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        asked = [np.frombuffer(m, np.uint64).reshape(-1, 2) for m in group.column("marks").to_pylist()]
        counts = np.concatenate([_unpacked(c, np.int64) for c in group.column("counts").to_pylist()])
        marks = np.concatenate(asked)
        first, inverse = _groups(marks[:, 0], marks[:, 1])
        total = np.zeros(len(first), np.int64)
        np.add.at(total, inverse, counts)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        ids = np.where(total > 0, rank * buckets + bucket, UNKNOWN)[inverse]
        counts = total[inverse]
        cuts = np.cumsum([0, *map(len, asked)])
        rows = [
            {"chunk": c, "bucket": bucket, "first": _packed(ids[i:j]), "second": _packed(counts[i:j])}
            for c, i, j in zip(group.column("chunk").to_pylist(), cuts, cuts[1:])
        ]
        often = np.bincount(total[total <= MOST + 1], minlength=MOST + 2)[1:].tolist()
        sums = {"tokens": int(total.sum()), "things": int((total > 0).sum())} | dict(zip(_COUNTED, often))
        return pa.Table.from_pylist([*rows, {"chunk": None, "bucket": bucket} | sums], _ANSWER)

    blocks = chunks.select("chunk", F.explode("blocks").alias("block")).select("chunk", "block.*")
    return written(blocks.groupBy("bucket").applyInArrow(run, _ANSWER_SQL), "words")


_HOT = pa.struct([("id", pa.int64()), *((n, pa.int64()) for n in _COUNTED[:MOST]), ("seen", pa.float64())])
_ANSWER = pa.schema(
    [
        ("chunk", pa.int64()),
        ("bucket", pa.int64()),
        ("first", pa.binary()),
        ("second", pa.binary()),
        ("third", pa.binary()),
        ("fourth", pa.binary()),
        ("tokens", pa.int64()),
        ("things", pa.int64()),
        *((n, pa.int64()) for n in _COUNTED),
        ("hot", pa.list_(_HOT)),
    ]
)
_LONGS = ", ".join(f"{n} long" for n in ("tokens", "things", *_COUNTED))
_HOT_SQL = "array<struct<id: long, " + ", ".join(f"{n}: long" for n in _COUNTED[:MOST]) + ", seen: double>>"
_BLOBS = "first binary, second binary, third binary, fourth binary"
_ANSWER_SQL = f"chunk long, bucket long, {_BLOBS}, {_LONGS}, hot {_HOT_SQL}"


@dataclass(frozen=True)
class Chunk:
    """A chunk read back: its tokens' pairs, dealt to buckets."""

    lengths: np.ndarray
    learnt: np.ndarray
    count: np.ndarray  # of each token's word
    pair: np.ndarray  # each token's place among the distinct pairs
    before: np.ndarray  # of each distinct pair: id of the first word
    word: np.ndarray  # id of the second
    before_count: np.ndarray
    word_count: np.ndarray
    bucket: np.ndarray
    order: np.ndarray  # the pairs by bucket, first word, second word


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _read(chunk: dict, answers: list[dict], words: Words, buckets: int) -> Chunk:
    places, dealt = _unpacked(chunk["places"], np.int32), _unpacked(chunk["dealt"], np.int32)
    answers = sorted((a for a in answers if a["third"] is None), key=lambda a: a["bucket"])
    ids, counts = (np.empty(len(dealt), np.int64) for _ in range(2))
    ids[dealt] = np.concatenate([_unpacked(a["first"], np.int64) for a in answers])
    counts[dealt] = np.concatenate([_unpacked(a["second"], np.int64) for a in answers])
    lengths = np.array(chunk["lengths"], np.int64)
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1]
    before[np.cumsum(lengths) - lengths] = len(ids)
    ids, counts = np.append(ids, START), np.append(counts, words.texts)
    # All unknown words are one, as they are for the model.
    unknown = np.flatnonzero(ids == UNKNOWN)
    if len(unknown):
        same = np.arange(len(ids))
        same[unknown] = unknown[0]
        places, before = same[places], same[before]
    keys, pair = np.unique(before.astype(np.int64) << 32 | places, return_inverse=True)
    first, second = keys >> 32, keys & 0xFFFFFFFF
    mark = _mixed(ids[first])
    hot = _hot(counts[first], words, buckets)
    mark = np.where(hot, _mixed(mark + _mixed(ids[second])), mark)
    bucket = (mark % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids[second], ids[first], bucket))
    order = order[ids[first][order] != UNKNOWN]
    return Chunk(
        lengths,
        np.repeat(~np.array(chunk["held"], bool), lengths),
        counts[places],
        pair,
        ids[first],
        ids[second],
        counts[first],
        counts[second],
        bucket,
        order,
    )


def _hot(counts: np.ndarray, words: Words, buckets: int) -> np.ndarray:
    return counts * buckets > words.tokens


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _pairs_asked(chunks: DataFrame, answers: DataFrame, words: Words, buckets: int) -> DataFrame:
    """Per chunk and bucket: first words, how many pairs each begins, second words, the chunk's counts, word counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], _ASKED)
        c = _read(rows[0], right.to_pylist(), words, buckets)
        counts = np.bincount(c.pair[c.learnt], minlength=len(c.before))
        out = []
        for part in np.split(c.order, _runs(c.bucket[c.order])[1:]):
            if not len(part):
                continue
            starts = _runs(c.before[part])
            out.append(
                {
                    "chunk": rows[0]["chunk"],
                    "bucket": int(c.bucket[part[0]]),
                    "first": _packed(np.diff(c.before[part][starts], prepend=0)),
                    "begun": _packed(np.diff(np.append(starts, len(part)))),
                    "before_counts": _packed(c.before_count[part][starts]),
                    "second": _packed(np.diff(c.word[part], prepend=0)),
                    "counts": _packed(counts[part]),
                    "word_counts": _packed(c.word_count[part]),
                }
            )
        return pa.Table.from_pylist(out, _ASKED)

    tokens = chunks.select("chunk", "held", "lengths", "places", "dealt")
    both = tokens.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    columns = "first binary, begun binary, before_counts binary, second binary, counts binary, word_counts binary"
    return both.applyInArrow(run, f"chunk long, bucket long, {columns}")


_ASKED = pa.schema(
    [
        ("chunk", pa.int64()),
        ("bucket", pa.int64()),
        *((n, pa.binary()) for n in ("first", "begun", "before_counts", "second", "counts", "word_counts")),
    ]
)


def _pairs_answered(asked: DataFrame, words: Words, buckets: int) -> DataFrame:
    """Per chunk and bucket: counts of its pairs; of its first words the continuations counted 1 to MOST times and the
    share of all words that are continuations. Per bucket (chunk null): how often counts occur, and hot first words.
    """

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()

        def column(name: str) -> list[np.ndarray]:
            return [_unpacked(b, np.int64) for b in group.column(name).to_pylist()]

        firsts, begun = [np.cumsum(f) for f in column("first")], column("begun")
        before = np.concatenate([np.repeat(f, n) for f, n in zip(firsts, begun)])
        seconds = [np.cumsum(s) for s in column("second")]
        word = np.concatenate(seconds)
        place, inverse = _groups(before, word)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, inverse, np.concatenate(column("counts")))
        seen = total > 0
        share = np.where(seen, words.share(np.concatenate(column("word_counts"))[place]), 0.0)
        # The distinct pairs are in order, so those of a first word stand together.
        starts = _runs(before[place])
        names = before[place][starts]
        by_count = np.column_stack([np.add.reduceat((total == r).astype(np.int64), starts) for r in range(1, MOST + 1)])
        shares = np.add.reduceat(share, starts)
        rows = []
        cuts = np.cumsum([0, *map(len, seconds)])
        for c, f, i, j in zip(group.column("chunk").to_pylist(), firsts, cuts, cuts[1:]):
            at = np.searchsorted(names, f)
            rows.append(
                {
                    "chunk": c,
                    "bucket": bucket,
                    "first": _packed(total[inverse[i:j]]),
                    "second": _packed(by_count[at].T.ravel()),
                    "third": _packed(shares[at]),
                }
            )
        counts = dict(zip(np.concatenate(firsts).tolist(), np.concatenate(column("before_counts")).tolist()))
        hot = [
            {"id": int(w), "seen": float(s)} | dict(zip(_COUNTED, n))
            for w, s, n in zip(names, shares, by_count.tolist())
            if _hot(np.array(counts[int(w)]), words, buckets)
        ]
        often = np.bincount(total[total <= MOST + 1], minlength=MOST + 2)[1:].tolist()
        stats = {"chunk": None, "bucket": bucket, "hot": hot} | dict(zip(_COUNTED, often))
        return pa.Table.from_pylist([*rows, stats], _ANSWER)

    return written(asked.groupBy("bucket").applyInArrow(run, _ANSWER_SQL), "pairs")


def _scored(chunks: DataFrame, answers: DataFrame, words: Words, d: np.ndarray, hot: dict, buckets: int, kind: str):
    """Per text its numbers of tokens and known tokens, and the scores of the plain model and of this one."""
    hot_ids = np.array(sorted(hot), np.int64)
    hot_stats = np.array([hot[i] for i in hot_ids.tolist()], np.float64).reshape(-1, MOST + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return schema.empty_table()
        answers = right.to_pylist()
        c = _read(rows[0], answers, words, buckets)
        told = sorted((a for a in answers if a["third"] is not None), key=lambda a: a["bucket"])
        # Pairs after an unknown word are not asked for: they leave the word's own share.
        logs = np.log10(words.share(c.word_count))
        at = 0
        for a in told:
            counts = _unpacked(a["first"], np.int64)
            part = c.order[at : at + len(counts)]
            at += len(part)
            starts = _runs(c.before[part])
            begun = np.diff(np.append(starts, len(part)))
            by_count, seen = _unpacked(a["second"], np.int64).reshape(MOST, -1).T, _unpacked(a["third"], np.float64)
            heavy = np.flatnonzero(_hot(c.before_count[part][starts], words, buckets))
            if len(heavy):
                by_count, seen = by_count.copy(), seen.copy()
                known = hot_stats[np.searchsorted(hot_ids, c.before[part][starts][heavy])]
                by_count[heavy], seen[heavy] = known[:, :-1], known[:, -1]
            stats = np.repeat(by_count, begun, axis=0), np.repeat(seen, begun)
            logs[part] = log_probabilities(counts, c.word_count[part], c.before_count[part], *stats, words, d)
        starts = np.cumsum(c.lengths) - c.lengths
        plain = np.log10((c.count + 1) / (words.tokens + words.distinct + 1))
        return pa.Table.from_arrays(
            [
                pa.array(rows[0]["ids"], schema.field("id").type),
                pa.array(rows[0]["held"]),
                pa.array(c.lengths),
                pa.array(np.add.reduceat((c.count > 0).astype(np.int64), starts)),
                pa.array(np.full(len(starts), words.tokens, np.int64)),
                pa.array(np.add.reduceat(plain, starts)),
                pa.array(np.add.reduceat(logs[c.pair], starts)),
            ],
            schema=schema,
        )

    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = to_arrow_schema(StructType.fromDDL(out))
    tokens = chunks.select("chunk", "ids", "held", "lengths", "places", "dealt")
    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, out)


def log_probabilities(
    pairs: np.ndarray,
    word: np.ndarray,
    before: np.ndarray,
    by_count: np.ndarray,
    seen: np.ndarray,
    words: Words,
    d: np.ndarray,
) -> np.ndarray:
    """log10 of P(word | word before) from counts of the pair, the word and the word before (0: unknown).

    A pair that was counted has its discounted share of the word before. Any other backs off to the word's own share,
    scaled so that all words together make exactly 1: by what discounting frees (where it frees nothing, one more
    continuation is counted), over the share of all words that never followed. A word before that is unknown leaves
    the word's own share.
    """
    freed = _freed(d, by_count)
    spare = freed > 0
    total = np.where(spare, before, before + 1).astype(np.float64)
    back = np.where(spare, freed, 1.0) / total / (1.0 - seen)
    share = np.where(pairs > 0, _discounted(d, pairs) / total, back * words.share(word))
    return np.log10(np.where(before > 0, share, words.share(word)))


def katz_scores(
    docs: DataFrame,
    held: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_tokens: int = CHUNK,
    bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """log10 probabilities of every whole text, learnt from the texts for which `held` is not true.

    Tokens are the words between white space (A-Z in lower case), then one end. A null text is empty: its end only. A
    null id is kept; where `held` is null the text is learnt from. Repeated rows count and are scored each. With no
    text to learn from every token is unknown and certain, its logarithm 0. An empty table gives an empty result. Other
    columns are not read. Words are told apart by 128 bits.

    `n_known` counts the tokens seen in learning, `train_tokens` all of those learnt from, `base_score` is the sum of
    log10((count + 1) / (train_tokens + distinct + 1)).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held")
    )
    size = rows.agg(F.sum(F.char_length("text")), F.count(F.when(~F.col("held"), 1))).first()
    buckets = (size[0] or 0) // bucket_chars + 8
    chunks = _tokenised(rows, buckets, chunk_tokens)
    answers = _words_answered(chunks, buckets)
    stats = [F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "things", *_COUNTED)]
    tokens, distinct, *counted = answers.where("chunk IS NULL").agg(*stats).first()
    words = words_level(tokens, distinct, size[1], counted)
    answers = answers.where("chunk IS NOT NULL")
    told = _pairs_answered(_pairs_asked(chunks, answers, words, buckets), words, buckets)
    d = discounts([*told.where("chunk IS NULL").agg(*stats[2:]).first()])
    hot = told.where("chunk IS NULL").select(F.explode("hot").alias("h")).groupBy("h.id")
    hot = hot.agg(*(F.sum(f"h.{n}") for n in (*_COUNTED[:MOST], "seen"))).collect()
    both = answers.unionByName(told.where("chunk IS NOT NULL"))
    scores = _scored(chunks, both, words, d, {r[0]: r[1:] for r in hot}, buckets, kind)
    return scores.withColumnRenamed("id", id_col)
