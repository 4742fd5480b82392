"""SimHash near-duplicates, found by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import free_name, written
from usagelens.llm.components import components
from usagelens.llm.shingles import shingle_hashes
from usagelens.llm.similar import SIMILARITY, bands_of, likely, links_of, shingle_set

BITS, HALF = 64, 32
#: Buckets above this many fingerprints are cut again by the other half's variants.
BUCKET = 4096
_BLOCK = 1 << 14


def _fingerprint(values: np.ndarray) -> int:
    if not len(values):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(values), _BLOCK):
        block = values[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)[0])


def fingerprint(text, words: int = 3):
    """64-bit SimHash of a text column as a long: XXH64 of every word shingle, repeats included."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return hashed(text)


def variants(fingerprints: DataFrame) -> DataFrame:
    """`key, fp`: each 32-bit half with one bit left out, 64 keys per fingerprint.

    Two fingerprints with at most three differing bits differ in at most one bit of one half, and share the key that
    leaves this bit out.
    """
    keys = []
    for half in range(2):
        value = F.shiftrightunsigned("fp", HALF * half).bitwiseAND(F.lit((1 << HALF) - 1))
        for bit in range(HALF):
            keys.append(value.bitwiseAND(F.lit(~(1 << bit))) + F.lit((half * HALF + bit) << HALF))
    return fingerprints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def finer(rows: DataFrame) -> DataFrame:
    """Cuts buckets again: the half that the key does not cover, in two quarters, one bit of one left out.

    The pairs sought still differ by at most three bits there. A bucket then has 18 free bits at most.
    """
    other = F.when(F.col("key") >= F.lit(HALF << HALF), F.col("fp")).otherwise(F.shiftrightunsigned("fp", HALF))
    keys = []
    for quarter in range(2):
        value = F.shiftrightunsigned(other, 16 * quarter).bitwiseAND(F.lit(0xFFFF))
        for bit in range(16):
            tag = (quarter * 16 + bit) << 16
            keys.append(F.col("key") * F.lit(1 << 21) + value.bitwiseAND(F.lit(~(1 << bit))) + F.lit(tag))
    return rows.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _links_of(run: np.ndarray, most: int) -> tuple[list, list]:
    """A spanning star of each component of one bucket: breadth first, so every fingerprint is visited once."""
    left, a, b = run, [], []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = _near(left, front.pop(), most)
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                a.extend(found)
                b.extend([root] * len(found))
    return a, b


def _bucket_links(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys (sorted)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):
        block = values[starts[sizes == size][:, None] + np.arange(size)]
        for i in range(size):
            for j in range(i + 1, size):
                near = _near(block[:, i], block[:, j], most)
                a.append(block[near, i])
                b.append(block[near, j])
    for k in np.flatnonzero(sizes > 8):
        x, y = _links_of(values[starts[k] : starts[k] + sizes[k]], most)
        a.append(np.array(x, dtype=np.uint64))
        b.append(np.array(y, dtype=np.uint64))
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def bucket_links(rows: DataFrame, most: int, limit: int | None) -> DataFrame:
    """`key, a, b` of the buckets of `rows(key, fp)`: links have a null key; rows of buckets above `limit` come back.

    Equal keys meet by one shuffle and sort; a task reads its rows as a stream and holds one bucket of at most
    `limit` fingerprints at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, a, b):
            return pa.RecordBatch.from_arrays(
                [key, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["key", "a", "b"]
            )

        def returned(key, values):
            return out(pa.array(np.full(len(values), key, dtype=np.int64)), values, values)

        keys, values, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.r_[keys, new]
            values = np.r_[values, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            if over is not None:
                n = int(np.searchsorted(keys, over, side="right"))
                if n:
                    yield returned(over, values[:n])
                if n == len(keys):
                    keys, values = keys[:0], values[:0]
                    continue
                keys, values, over = keys[n:], values[n:], None
            yield from done(keys, values, returned, out, last=False)
            n = int(np.searchsorted(keys, keys[-1]))
            keys, values = keys[n:], values[n:]
            if limit and len(keys) > limit:
                over = int(keys[0])
                yield returned(over, values)
                keys, values = keys[:0], values[:0]
        if len(keys):
            yield from done(keys, values, returned, out, last=True)

    def done(keys, values, returned, out, last):
        end = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        keys, values = keys[:end], values[:end]
        if limit and len(keys):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            for k in np.flatnonzero(sizes > limit):
                yield returned(int(keys[starts[k]]), values[starts[k] : starts[k] + sizes[k]])
            small = np.repeat(sizes <= limit, sizes)
            keys, values = keys[small], values[small]
        if len(keys):
            a, b = _bucket_links(keys, values, most)
            if len(a):
                yield out(pa.nulls(len(a), pa.int64()), a, b)

    return (
        rows.repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(scan, "key long, a long, b long")
    )


def near_fingerprints(fingerprints: DataFrame, most: int = 3, limit: int = BUCKET) -> DataFrame:
    """Links `a, b` that connect all fingerprints (column `fp`, distinct) within `most` (3 at most) differing bits.

    Not every pair is listed: a bucket gives a star per component. Buckets above `limit` are cut again by the variants
    of the other half, so no task holds more than 2^18 fingerprints, and none is left out.
    """
    if most > 3:
        raise ValueError("two segments find pairs of at most three differing bits")
    first = written(bucket_links(variants(fingerprints), most, limit), "simhash")
    hot = first.where("key is not null").select("key", F.col("a").alias("fp"))
    second = bucket_links(finer(hot), most, None)
    return first.where("key is null").select("a", "b").unionByName(second.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", words: int = 3, most: int = 3
) -> DataFrame:
    """The id columns, `fingerprint` (hex), `component_id` and `stays` of every row.

    Texts (null: empty) are lower-cased in A-Z and cut into words at ASCII white space. Fingerprints with at most
    `most` differing bits link; the component's id is the smallest first id reachable, itself included. `stays` marks
    the smallest (id columns) of each component, rows with null ids last. A text without words has fingerprint zero
    and links like any other. Rows with a null id take part; a component of such rows alone has a null id. Repeated
    rows give repeated results. Distinct fingerprints are compared, not rows, so copies in any number are one. An
    empty table gives no rows; other columns are not read.
    """
    ids = [f"id{i}" for i in range(len(id_cols))]
    rows = written(
        docs.select(*(docs[c].alias(i) for c, i in zip(id_cols, ids)), fingerprint(docs[text_col], words).alias("fp")),
        "fingerprints",
    )
    first = F.struct(F.col("id0").isNull().alias("none"), *ids)
    prints = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "prints")
    roots = components(near_fingerprints(prints.select("fp"), most))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    placed = placed.join(least, "root").select("fp", "least")
    return rows.join(placed, "fp").select(
        *(F.col(i).alias(c) for c, i in zip(id_cols, ids)),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.id0").alias("component_id"),
        (first == F.col("least")).alias("stays"),
    )


def sketch(text, words: int):
    """`fp`, `n` (distinct shingles) and `bands` of each whole text, from one hashing of its shingles."""

    @F.pandas_udf("fp long, n long, bands array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            values = shingle_hashes(t, words)
            fp = _fingerprint(values)
            values = np.unique(values)
            rows.append((fp, len(values), bands_of(values)))
        return pd.DataFrame(rows, columns=["fp", "n", "bands"])

    return sketched(text)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = SIMILARITY
) -> DataFrame:
    """One document of each group of near duplicates, with the columns of the input.

    Five words make a shingle here. Every distinct text is a node. Nodes whose fingerprints are within three bits, and
    nodes that share a band of minima, are compared by their sets of shingles; a similarity of `least` or more is a
    link, and texts without words (null, empty, white space) are linked. All links together make the groups. Of each
    group the row with the smallest id stays; rows without id stay only where their group has no other; of rows with
    this id and the same text one, of rows with this id and different texts the one whose text hash is smallest. An
    empty table gives an empty one.
    """
    node, number, wanted_id = (free_name(docs, c) for c in ("node", "number", "kept_id"))
    body = F.coalesce(docs[text_col], F.lit(""))
    marked = docs.withColumn(node, F.xxhash64(body))
    rows = marked.select(marked[node].alias("node"), marked[id_col].alias("id"), body.alias("text"))
    sketches = written(rows.select("node", "id", sketch(F.col("text"), words).alias("s")).select("node", "id", "s.*"), "sketches")
    place = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("place")
    nodes = sketches.groupBy("node").agg(place, *(F.any_value(c).alias(c) for c in ("fp", "n", "bands")))
    nodes = written(nodes, "nodes")
    prints = written(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first")), "prints")
    first, second = (prints.toDF(fp, end) for fp, end in (("a", "x"), ("b", "y")))
    close = near_fingerprints(prints.select("fp")).join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.where("n > 0").join(prints, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        # One row of each wanted text; copies and repeated rows are not worked on.
        chosen = nodes.join(wanted, "node").select("node", F.col("place.id").alias("at"))
        texts = likely(rows, wanted).join(chosen, "node").where(F.col("id").eqNullSafe(F.col("at")))
        texts = texts.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy(F.lit(1)))).where("turn = 1")
        return texts.select("node", shingle_set(F.col("text"), words).alias("set"))

    blank = nodes.where("n = 0").select(F.col("node").alias("a"))
    blank = blank.withColumn("b", F.lit(blank.agg(F.min("a")).first()[0]).cast("long"))
    links = links_of(nodes.select("node", "n", "bands"), sets_of, least, more=close.unionByName(same))
    roots = components(links.unionByName(blank))
    placed = nodes.select("node", "place").join(roots, "node", "left").select(
        F.coalesce("root", "node").alias("root"), F.struct("place", "node").alias("place")
    )
    stays = placed.groupBy("root").agg(F.min("place").alias("p"))
    stays = stays.select(F.col("p.node").alias(node), F.col("p.place.id").alias(wanted_id))
    return (
        marked.join(stays, node)
        .where(marked[id_col].eqNullSafe(F.col(wanted_id)))
        .withColumn(number, F.row_number().over(Window.partitionBy(node).orderBy(F.lit(1))))
        .where(F.col(number) == 1)
        .select(*docs.columns)
    )
