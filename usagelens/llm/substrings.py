"""Removal of repeated passages: windows of words that start earlier elsewhere, found by FM-indexes of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import slices, written
from usagelens.llm.fm_index import FMIndex

#: Words of a window, and of the anchors by which windows are dealt to shards.
WINDOW, ANCHOR = 20, 6
#: Words that a shard's index should hold, and at most.
SHARD_WORDS = 400_000
#: A run's place and its number of windows share a long.
_RUN = 32
_CHARS, _CACHE = 1 << 21, 300_000
_MULTIPLIER, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Hashes:
    """64-bit hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for k, h in enumerate(out):
                if h is None:
                    out[k] = known[words[k]] = xxhash.xxh64_intdigest(words[k], 9)
        return np.array(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _OTHER
    return x ^ (x >> np.uint64(29))


def _sequence_hashes(values: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(max(len(values) - length + 1, 0), dtype=np.uint64)
    for j in range(length):
        total = total * _MULTIPLIER + values[j : j + len(total)]
    return _mixed(total)


def _segments(values: np.ndarray, sizes: np.ndarray, window: int, anchor: int):
    """Runs of windows that have their anchor at one place: (first window, windows, anchor's hash, content's hash).

    A window's anchor is its word sequence of `anchor` words with the smallest hash, the leftmost of equal ones, so
    equal windows have equal anchors at the same place inside them, and never lie in one run.
    """
    n = len(values) - window + 1
    if n <= 0:
        return None
    grams = _sequence_hashes(values, anchor)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window - anchor + 1):
        smaller = grams[j : j + n] < least
        least[smaller] = grams[j : j + n][smaller]
        place[smaller] = np.flatnonzero(smaller) + j
    ends = np.repeat(np.cumsum(sizes), sizes)[:n]
    whole = np.arange(n) + window <= ends
    new = whole & np.r_[True, (place[1:] != place[:-1]) | ~whole[:-1]]
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    count = np.bincount(run[whole], minlength=len(first))
    # Hash of the run's words: a polynomial of their mixed hashes, from sums of the words times powers.
    powers = np.ones(len(values) + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(len(values), _MULTIPLIER), out=powers[1:])
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(_mixed(values) * powers[:-1], out=sums[1:])
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    back = np.ones(len(values) + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(len(values), inverse), out=back[1:])
    content = _mixed((sums[first + count + window - 1] - sums[first]) * back[first] + count.astype(np.uint64))
    return first, count, least[first], content


def _scan(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows of every text; `at` holds a run's first place and its number of windows."""
    hashes = _Hashes()
    for batch in batches:
        ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
        lengths = [len(t) if (t := x.as_py()) else 0 for x in texts]
        for low, high in slices(lengths, _CHARS):
            parts = [hashes(_words(texts[k].as_py())) for k in range(low, high)]
            sizes = np.array([len(p) for p in parts])
            found = _segments(np.concatenate(parts), sizes, window, anchor)
            if found is None or not len(found[0]):
                continue
            first, count, least, content = found
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, first, side="right")
            where = pa.array(low + doc)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(where),
                    keys.take(where),
                    pa.array((first - (ends - sizes)[doc]).astype(np.int64) * _RUN + count),
                    pa.array(least.view(np.int64)),
                    pa.array(content.view(np.int64)),
                ],
                names=["id", "key", "at", "anchor", "content"],
            )


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of the runs asked for, one row per run."""
    for batch in batches:
        ids, keys, texts, wanted = (batch.column(k) for k in range(4))
        where, at, shard, cut = [], [], [], []
        for k in range(batch.num_rows):
            words = _words(texts[k].as_py())
            for run in wanted[k].as_py():
                start, n = divmod(run["at"], _RUN)
                where.append(k)
                at.append(run["at"])
                shard.append(run["shard"])
                cut.append(b" ".join(words[start : start + n + window - 1]))
        where = pa.array(where, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(where), keys.take(where), pa.array(at), pa.array(shard), pa.array(cut, pa.binary())],
            names=["id", "key", "at", "shard", "words"],
        )


def _repeats(words: list[bytes], window: int) -> np.ndarray:
    """A bit for each window of each run that occurs earlier in these runs, which come in reading order.

    The runs become one text, parted by a symbol of their own, over which the index is built. Every window of every
    run is then searched backward in it; windows with the same interval are the same words, and all but the one read
    first are repeats.
    """
    split = [w.split() for w in words]
    sizes = np.array([len(s) for s in split])
    names: dict[bytes, int] = {}
    flat = [names.setdefault(w, len(names) + 1) for s in split for w in s]
    text = np.zeros(len(flat) + len(split) + 1, dtype=np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(split)), sizes) + 1] = flat
    begin = np.cumsum(sizes) - sizes + np.arange(len(split)) + 1
    counts = sizes - window + 1
    run = np.repeat(np.arange(len(split)), counts)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    group, _ = FMIndex(text, window).matching(text, begin[run] + offset, window)
    found = np.flatnonzero(group >= 0)
    found = found[np.argsort(group[found], kind="stable")]
    again = found[1:][group[found][1:] == group[found][:-1]]
    bits = np.zeros(len(split), dtype=np.int64)
    np.bitwise_or.at(bits, run[again], np.int64(1) << offset[again])
    return bits


def _index(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Indexes shard after shard; rows are sorted by shard, then reading order."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        bits = _repeats(rows["words"].to_pylist(), window)
        hit = pa.array(np.flatnonzero(bits))
        columns = [rows[c].take(hit).combine_chunks() for c in ("id", "key", "at")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(bits[bits != 0])], names=["id", "key", "at", "bits"])

    now = last = None
    for batch in batches:
        # Repeats of a row come side by side: the first of them stands for all.
        new = np.ones(batch.num_rows, dtype=bool)
        for k, place in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            new[k], last = place != last, place
        batch = batch.filter(pa.array(new))
        shards = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.empty(0, int)
        for low, high in zip(edges, np.r_[edges[1:], len(shards)]):
            if held and shards[low] != now:
                yield done()
                held = []
            now = shards[low]
            held.append(batch.slice(int(low), int(high - low)))
    if held:
        yield done()


def _finish(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Takes the covered words away."""
    for batch in batches:
        texts, repeats = batch.column(1), batch.column(2)
        n_words, n_removed, kept = [], [], []
        for k in range(batch.num_rows):
            words = _words(texts[k].as_py())
            runs = repeats[k].as_py()
            if runs:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for r in runs:
                    at = r["at"] // _RUN + np.flatnonzero((r["bits"] >> np.arange(window)) & 1)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                left = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                rest = [words[i] for i in left]
            else:
                rest = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
            ],
            names=["id", "n_words", "n_removed", "kept"],
        )


def repeated_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`id, key, at, bits` of `docs(id, key, text)`: runs with windows that also start earlier in reading order.

    1. Every text is cut into runs of windows that share their anchor; equal windows have equal anchors.
    2. Anchors met once in the corpus are let go. Equal runs are collapsed to the one read first; in the others every
       window is a repeat.
    3. The different runs of an anchor go to one shard of bounded size. The runs of an anchor with very many different
       ones are cut into their windows, which are collapsed once more.
    4. Each shard's words get a compressed index, and its runs are streamed against it.
    """
    runs = written(
        docs.select("id", "key", "text").mapInArrow(
            lambda b: _scan(b, window, anchor), "id long, key long, at long, anchor long, content long"
        ),
        "runs",
    )
    shared = runs.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    candidates = written(runs.join(shared, "anchor"), "candidates")
    place = F.struct("id", "key", "at")
    content = ["anchor", "content"]
    first = written(candidates.groupBy(*content).agg(F.min(place).alias("first")), "contents")
    later = (
        candidates.join(first, content)
        .where(place != F.col("first"))
        .select("id", "key", "at", F.expr(f"shiftleft(1L, CAST(at % {_RUN} AS INT)) - 1").alias("bits"))
    )
    words = F.col("first.at") % _RUN + (window - 1)
    several = written(
        first.groupBy("anchor").agg(F.count("*").alias("runs"), F.sum(words).alias("words")).where("runs > 1"), "anchors"
    )
    hot = F.col("words") > shard_words // 10
    total = several.where(~hot).agg(F.sum("words")).first()[0] or 0
    shards = F.lit(max(1, -(-int(total) // shard_words))).cast("long")
    asked = first.join(several, "anchor").select("first.*", hot.alias("hot"), F.pmod(F.xxhash64("anchor"), shards).alias("shard"))
    whole = asked.where("NOT hot").select("id", "key", "at", "shard")
    single = asked.where("hot").select(
        "id",
        "key",
        F.explode(F.expr(f"transform(sequence(0, at % {_RUN} - 1), i -> (at div {_RUN} + i) * {_RUN} + 1)")).alias("at"),
        F.lit(-1).cast("long").alias("shard"),
    )
    wanted = whole.unionByName(single).groupBy("id", "key").agg(F.collect_list(F.struct("at", "shard")).alias("wanted"))
    cut = written(
        docs.join(wanted, ["id", "key"])
        .select("id", "key", "text", "wanted")
        .mapInArrow(lambda b: _cut(b, window), "id long, key long, at long, shard long, words binary"),
        "cut",
    )
    single = cut.where("shard < 0").drop("shard")
    single_first = single.groupBy("words").agg(F.min(place).alias("first"))
    single_later = (
        single.join(single_first, "words")
        .where(place != F.col("first"))
        .select("id", "key", "at", F.lit(1).cast("long").alias("bits"))
    )
    indexed = (
        cut.where("shard >= 0")
        .select("shard", "id", "key", "at", "words")
        .repartition("shard")
        .sortWithinPartitions("shard", "id", "key", "at")
        .mapInArrow(lambda b: _index(b, window), "id long, key long, at long, bits long")
    )
    return later.unionByName(single_later).unionByName(indexed)


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The id, `n_words`, `n_removed` and `kept` (the words left, joined by one space) of every row.

    A word goes when a window of `window` words that covers it also starts earlier: in a document with a smaller id,
    or in the same one further left. Rows of equal id and different texts follow each other in a fixed order; exact
    repeats of a row count as one and get equal results. Rows without id have no place in the order: they lose
    nothing and make nothing a repeat. A null text has no words. An empty table gives no rows. Other columns are not
    read.
    """
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn(
        "key", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    judged = plain.where("id IS NOT NULL")
    # Repeats of a row would repeat each other: their runs are equal, place included, so they collapse to one.
    found = repeated_runs(judged, window, anchor, shard_words).distinct()
    runs = found.groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(
        F.collect_list(F.struct("at", "bits")).alias("runs")
    )
    return (
        plain.join(runs, (plain["id"] == runs["i"]) & (plain["key"] == runs["k"]), "left")
        .select("id", "text", "runs")
        .mapInArrow(lambda b: _finish(b, window), "id long, n_words long, n_removed long, kept string")
        .withColumnRenamed("id", id_col)
    )
