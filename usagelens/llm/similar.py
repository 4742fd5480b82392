"""Near duplicates by the similarity of their word shingles, for texts too far apart for a few bits of a fingerprint.

Two texts of which four fifths of the shingles agree differ in about ten bits of a 64-bit SimHash; no two segments of
it find them. Their shingle sets share many minima under random orders, so bands of minima meet by equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.bloom import build, inside
from usagelens.llm.common import written
from usagelens.llm.components import components
from usagelens.llm.shingles import shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Bands and minima per band: a pair at a similarity of 0.8 shares a band with probability 0.998.
BANDS, MINIMA = 16, 5
#: Buckets up to this size give their pairs; the nodes of larger ones are compared in blocks.
PAIRED = 32
#: Nodes and shingles in a block, and nodes and columns of the matrices that a task multiplies at a time.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
_ROWS, _COLUMNS = 256, 1 << 15
#: Bits at most of the filter that picks the texts to compare.
FILTER_BITS = 1 << 25
_HASHES = 1 << 12
_ORDERS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * MINIMA), dtype=np.uint64)


def bands_of(values: np.ndarray) -> list[int]:
    """A key per band of minima; a text without words has none."""
    if not len(values):
        return []
    shift, factor = _ORDERS[0], _ORDERS[1] * np.uint64(2) + np.uint64(1)
    blocks = (values[i : i + _HASHES, None] for i in range(0, len(values), _HASHES))
    least = reduce(np.minimum, (((b ^ shift) * factor).min(axis=0) for b in blocks)).reshape(BANDS, MINIMA)
    return [xxhash.xxh64_intdigest(least[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def sketch(text: Column, words: int = WORDS) -> Column:
    """`n` (distinct shingles) and `bands` of each whole text."""

    @F.pandas_udf("n long, bands array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            values = np.unique(shingle_hashes(t, words))
            rows.append((len(values), bands_of(values)))
        return pd.DataFrame(rows, columns=["n", "bands"])

    return sketched(text)


def shingle_set(text: Column, words: int = WORDS) -> Column:
    """The distinct shingles of each whole text, as 32-bit hashes."""

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words).astype(np.uint32)).view(np.int32) for t in texts])

    return hashed(text)


def _grouped(buckets: DataFrame, verified: DataFrame, sketches: DataFrame) -> DataFrame:
    """`group, pool, node, n` of the nodes in large buckets.

    Buckets that share a node make a group. A node linked to a bucket's centre is covered by it, and the nodes that a
    centre covers are one pool: they need not be compared with each other any more. Other nodes have no pool.
    """
    centres = buckets.select(F.col("low.node").alias("centre")).distinct()
    groups = components(buckets.select(F.col("node").alias("a"), F.col("low.node").alias("b")))
    both = verified.select("a", "b").unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cover = both.join(centres, F.col("b") == F.col("centre")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("pool"))
    own = centres.select(F.col("centre").alias("node"), F.col("centre").alias("_own"))
    return (
        groups.join(cover, "node", "left")
        .join(own, "node", "left")
        .join(sketches.select("node", "n"), "node")
        .select(
            F.col("root").alias("group"),
            F.coalesce("_own", "pool").alias("pool"),
            "node",
            "n",
        )
    )


def _forest(up: list[int], pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the pairs those that join two trees; `up` holds each node's parent and is changed."""

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(columns, s)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == s]] = 1
    return out


def _similar(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose similarity is `least` or more."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    shared = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(common), _COLUMNS):
        part = common[k : k + _COLUMNS]
        shared += _incidence(left, part) @ _incidence(right, part).T
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    return np.nonzero((shared > 0) & (shared >= least * (sizes - shared)))


def _compared(blocks: DataFrame, least: float) -> DataFrame:
    """Links `a, b` that connect all similar nodes of each pair of `blocks(same, left, right)`; not every link.

    Nodes of one pool are connected from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                names, sets, pools = [], [], []
                for side in (left.values, right.values)[: 1 if same else 2]:
                    names += side.field("node").to_pylist()
                    pools += side.field("pool").to_pylist()
                    sets += [np.sort(s.values.to_numpy(zero_copy_only=False)) for s in side.field("set")]
                first: dict[int, int] = {}
                up = [k if p is None else first.setdefault(p, k) for k, p in enumerate(pools)]
                cut = 0 if same else len(left.values)
                out = []
                for i in range(0, len(left.values), _ROWS):
                    rows = sets[i : min(i + _ROWS, len(left.values))]
                    for j in range(i if same else cut, len(sets), _ROWS):
                        a, b = _similar(rows, sets[j : j + _ROWS], least)
                        a, b = a + i, b + j
                        fresh = a < b
                        out += _forest(up, zip(a[fresh].tolist(), b[fresh].tolist()))
                ends = zip(*out) if out else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in side], pa.int64()) for side in ends], names=["a", "b"]
                )

    return blocks.select("same", "left", "right").mapInArrow(run, "a long, b long")


def _block_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """`same, left, right`: every two blocks of a group, but for those of one pool. No two nodes are paired.

    A pool of a block or more has blocks of its own; smaller ones share the group's.
    """
    large = members.where("pool IS NOT NULL").groupBy("group", "pool").agg(F.count("*").alias("size")).where(F.col("size") >= BLOCK)
    large = large.select("group", "pool", F.lit(True).alias("_own"))
    own = F.coalesce("_own", F.lit(False))
    placed = members.join(large, ["group", "pool"], "left").select(
        "group", own.alias("own"), F.when(own, F.col("pool")).otherwise(F.lit(0)).alias("home"), "pool", "node", "n"
    )
    home = ["group", "own", "home"]
    sizes = placed.groupBy(*home).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    )
    cut = placed.join(sizes, home).withColumn("k", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    packed = cut.join(sets, "node").groupBy(*home, "k").agg(F.collect_list(F.struct("node", "set", "pool")).alias("rows"))
    packed = written(packed.select("group", F.struct("own", "home", "k").alias("at"), "rows"), "blocks")
    x, y = (packed.select("group", F.col("at").alias(f"{c}_at"), F.col("rows").alias(c)) for c in ("left", "right"))
    done = F.col("left_at.own") & F.col("right_at.own") & (F.col("left_at.home") == F.col("right_at.home"))
    return x.join(y, "group").where((F.col("left_at") <= F.col("right_at")) & ~done).select(
        (F.col("left_at") == F.col("right_at")).alias("same"), "left", "right"
    )


def links_of(
    sketches: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    least: float = SIMILARITY,
    paired: int = PAIRED,
    more: DataFrame | None = None,
) -> DataFrame:
    """Links `a, b` that connect all nodes of `sketches(node, n, bands)` that share a band and are similar.

    `sets_of(wanted)` gives `node, set` of wanted nodes; `more(a, b)` are further pairs to compare. A bucket of up to
    `paired` nodes gives its pairs. The nodes of larger ones meet the centres of their buckets first. Those found
    similar to a centre are one with it, whatever their number. All others are compared with each other and with
    these, in blocks, once for all their buckets: inside tasks, which return a tree per class and never the pairs. So
    copies cost one pair each, while the work on nodes that share much of their text without being similar grows with
    the square of their number.
    """
    index = sketches.select("node", "n", F.explode("bands").alias("band"))
    place = F.struct(F.xxhash64("band", "node").alias("at"), "node", "n")
    buckets = index.groupBy("band").agg(F.count("*").alias("members"), F.min(place).alias("low")).where("members > 1")
    met = written(index.join(buckets, "band"), "buckets")
    small, large = met.where(F.col("members") <= paired), met.where(F.col("members") > paired)
    side = small.select("band", F.struct("node", "n").alias("x"))
    whole = side.join(side.withColumnRenamed("x", "y"), "band").where("x.node < y.node").select("x", "y")
    stars = large.select(F.struct("node", "n").alias("x"), F.struct("low.node", "low.n").alias("y"))
    pairs = (
        whole.unionByName(stars.where("x.node <> y.node"))
        .where(F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n"))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    )
    if more is not None:
        pairs = pairs.unionByName(more.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = written(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    sets = written(sets_of(wanted), "sets")
    sides = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    near = (shared > 0) & (shared >= least * (F.size("set_a") + F.size("set_b") - shared))
    verified = written(sides.where(near).select("a", "b"), "verified")
    members = written(_grouped(large, verified, sketches), "members")
    return verified.unionByName(_compared(_block_pairs(members, sets), least))


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The `rows` whose node is wanted; a filter of bounded size lets few others through to the join that decides."""
    bits = min(FILTER_BITS, max(64, 64 * (wanted.count() * 10 // 64)))
    keys = build(wanted.select(F.col("node").alias("key"), F.lit(0).alias("slice")), 0, 1, 4, bits)
    return rows.where(inside(F.col("node"), keys)).join(wanted, "node", "left_semi")


def similar_links(rows: DataFrame, words: int = WORDS, least: float = SIMILARITY, paired: int = PAIRED) -> DataFrame:
    """`links_of` the rows `node, text`, a node per row.

    Candidates are compared on their whole sets. Null and empty texts link to nothing; a text of fewer words is one
    shingle; an empty table has no links.
    """
    sketches = rows.select("node", sketch(F.col("text"), words).alias("s")).select("node", "s.n", "s.bands")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return likely(rows, wanted).select("node", shingle_set(F.col("text"), words).alias("set"))

    return links_of(written(sketches, "sketches"), sets_of, least, paired)
