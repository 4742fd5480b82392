"""Nearest entries through an inverted file of vectors that is kept as a table.

``centres`` holds the centres of the lists. ``blocks`` holds the vectors,
partitioned by version and list; a row is a block of up to ``BLOCK`` vectors of
one team, in id order, with the narrowest and widest angle to the list's centre. Centres are
trained once, on a bounded sample; later rows are appended under a version of
their own without training anew. Writing a version again replaces it, and a
reader may ask for the versions before one. ``spill`` holds the vectors once more
in the lists that are next closest (``placements``), for searches of a few lists;
exact searches don't read it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.operators.nearest import TIE_DIGITS
from usagelens.session import stored

#: Vectors in a block, and at most in the sample the centres are trained on.
BLOCK, SAMPLE = 1024, 16_384
#: What a version is before anything was written.
NOTHING = -1
_CENTRES = "list int, centre array<double>"


def lists_for(count: int) -> int:
    """Number of lists for so many vectors: 16, from 65,536 vectors on a sixteenth of their square root."""
    return max(16, math.isqrt(max(count, 0)) // 16)


def placements(lists: int) -> int:
    """Number of lists that a vector is put in: one below nine lists, two of 16, one more each time lists double."""
    return 1 + max(0, math.ceil(math.log2(max(lists, 1) / 8)))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def trained_centres(vectors: DataFrame, key: str, lists: int, embedding: str = "embedding", seed: int = 7) -> np.ndarray:
    """Centres of a spherical k-means over at most ``SAMPLE`` vectors, those with the smallest hash of their key.

    Vectors of another length than the commonest of the sample, and zero
    vectors, have no part in it. Without vectors there are no centres.
    """
    sample = vectors.filter(F.col(embedding).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    found = [r[0] for r in sample.select(F.col(embedding).cast("array<double>")).collect()]
    sizes = [len(v) for v in found]
    dims = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    rows = _unit(np.array([v for v in found if len(v) == dims and any(v)], float).reshape(-1, max(dims, 1)))
    if not len(rows) or not dims:
        return np.empty((0, dims))
    pick = np.random.default_rng(seed)
    centres = rows[pick.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(12):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        # A list that lost its members keeps its centre.
        centres = _unit(np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, sums, centres))
    return centres


def begin(spark: SparkSession, path: str, key_type: str) -> None:
    """An index without centres and vectors, so it can be read before anything was written."""
    spark.createDataFrame([], _CENTRES).write.mode("overwrite").parquet(f"{path}/centres/version={NOTHING}")
    empty = spark.createDataFrame([], _blocks(key_type).replace("list int, ", ""))
    for part in ("blocks", "spill"):
        empty.write.mode("overwrite").parquet(f"{path}/{part}/version={NOTHING}/list=0")


def _blocks(key_type: str) -> str:
    return f"team_id string, ids array<{key_type}>, vectors binary, inner double, width double, list int, version bigint"


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    """Bounded by the number of lists."""
    rows = spark.read.schema(f"{_CENTRES}, version bigint").parquet(f"{path}/centres").collect()
    first = min((r.version for r in rows), default=NOTHING)
    return np.array([r.centre for r in sorted(rows, key=lambda r: r.list) if r.version == first], float)


def train(vectors: DataFrame, path: str, key: str, lists: int, embedding: str = "embedding", version: int = 0) -> np.ndarray:
    """Centres for an index that has none yet; those it has otherwise."""
    spark = vectors.sparkSession
    centres = centres_of(spark, path)
    if not len(centres):
        centres = trained_centres(vectors, key, lists, embedding)
        if len(centres):
            rows = [(i, c.tolist()) for i, c in enumerate(centres)]
            spark.createDataFrame(rows, _CENTRES).write.mode("overwrite").parquet(f"{path}/centres/version={version}")
    return centres


def append(
    vectors: DataFrame, path: str, key: str = "id", embedding: str = "embedding", version: int = 0, places: int | None = None
) -> None:
    """Write the vectors as one version, each to the list of the closest centre and, as spill, to the next ones.

    ``places`` is the number of lists; one if the index is searched exactly only.

    Rows are dealt by list, team and hash of their key, so a list that holds most
    of all vectors is cut over many tasks. Null and zero vectors and those of
    another length than the centres' are left out (``unusable``).
    """
    spark = vectors.sparkSession
    centres = centres_of(spark, path)
    dims = centres.shape[1] if centres.ndim == 2 else 0
    key_type = vectors.schema[key].dataType.simpleString()
    rows = vectors.select("team_id", F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("u"))
    rows = rows.filter(usable(F.col("u"), dims))

    def assign(ranks):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                sims = _unit(_rows(b.column(2), dims)) @ centres.T
                for rank in ranks:
                    at = sims.argmax(axis=1)
                    best = sims[np.arange(len(at)), at].copy()
                    sims[np.arange(len(at)), at] = -np.inf
                    if rank:
                        yield pa.RecordBatch.from_arrays(
                            [*b.columns, pa.array(at.astype("int32")), pa.array(np.arccos(np.clip(best, -1.0, 1.0)))],
                            names=["team_id", "id", "u", "list", "angle"],
                        )

        return run

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            places = list(zip(b.column(3).to_pylist(), b.column(0).to_pylist()))
            starts = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]]
            starts = [k for i, j in zip(starts, [*starts[1:], len(places)]) for k in range(i, j, BLOCK)]
            u, angle = _rows(b.column(2), dims), b.column(4).to_numpy()
            spans = list(zip(starts, [*starts[1:], len(places)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([places[i][1] for i, _ in spans], pa.string()),
                    pa.ListArray.from_arrays(pa.array([*starts, len(places)], pa.int32()), b.column(1)),
                    pa.array([u[i:j].tobytes() for i, j in spans], pa.binary()),
                    pa.array([float(angle[i:j].min()) for i, j in spans]),
                    pa.array([float(angle[i:j].max()) for i, j in spans]),
                    pa.array([places[i][0] for i, _ in spans], pa.int32()),
                ],
                names=["team_id", "ids", "vectors", "inner", "width", "list"],
            )

    more = min(places or placements(len(centres)), len(centres)) - 1
    # Per written part, which of the closest lists it takes.
    for part, ranks in (("blocks", [True]), ("spill", [False] + [True] * more)):
        if not any(ranks):
            continue
        placed = rows.mapInArrow(assign(ranks), f"team_id string, id {key_type}, u array<double>, list int, angle double")
        placed = placed.repartitionByRange("list", "team_id", F.xxhash64("id")).sortWithinPartitions("list", "team_id", "id")
        blocks = placed.mapInArrow(cut, _blocks(key_type).replace(", version bigint", ""))
        blocks.write.mode("overwrite").partitionBy("list").parquet(f"{path}/{part}/version={version}")


def usable(vector, dims: int):
    return (F.size(vector) == dims) & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def unusable(vectors: DataFrame, path: str, embedding: str = "embedding") -> DataFrame:
    """The rows that an index can't hold."""
    centres = centres_of(vectors.sparkSession, path)
    fine = usable(F.col(embedding).cast("array<double>"), centres.shape[1] if centres.ndim == 2 else 0)
    return vectors.filter(~F.coalesce(fine, F.lit(False)))


def create(
    vectors: DataFrame, path: str, key: str = "id", embedding: str = "embedding", lists: int | None = None, places: int | None = None
) -> None:
    """Train and fill an index with one version; ``places`` as in ``append``."""
    begin(vectors.sparkSession, path, vectors.schema[key].dataType.simpleString())
    lists = lists or lists_for(vectors.count())
    if len(train(vectors, path, key, lists, embedding)):
        append(vectors, path, key, embedding, places=places)


def blocks_of(spark: SparkSession, path: str, key_type: str, before: int | None = None, part: str = "blocks") -> DataFrame:
    rows = spark.read.schema(_blocks(key_type)).parquet(f"{path}/{part}")
    return rows if before is None else rows.filter(F.col("version") < before)


def compact(spark: SparkSession, path: str, key_type: str, before: int, into: str, places: int | None = None) -> None:
    """An index at ``into`` with all versions before ``before`` in one, their small blocks joined."""
    begin(spark, into, key_type)
    centres = centres_of(spark, path)
    if not len(centres):
        return
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, _CENTRES).write.mode("overwrite").parquet(f"{into}/centres/version=0")
    dims = centres.shape[1]

    def opened(batches):
        for b in batches:
            for team, ids, blob in zip(*(c.to_pylist() for c in b.columns)):
                u = np.frombuffer(blob).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([team] * len(ids), pa.string()), pa.array(ids), pa.array(list(u), pa.list_(pa.float64()))],
                    names=["team_id", "id", "embedding"],
                )

    old = blocks_of(spark, path, key_type, before).select("team_id", "ids", "vectors")
    append(old.mapInArrow(opened, f"team_id string, id {key_type}, embedding array<double>"), into, places=places)


def probe(
    queries: DataFrame,
    path: str,
    probes: int | None = 4,
    floor: float | None = None,
    query_id: str = "query_id",
    embedding: str = "embedding",
    key_type: str = "bigint",
    before: int | None = None,
) -> DataFrame:
    """``query_id, cache_id, similarity``: the best entry of the query's team in the lists that are looked at.

    These are the ``probes`` closest ones or, with ``probes=None``, all that can
    hold an entry as similar as ``floor`` (an entry within ``acos(floor)`` of the
    query lies at most its list's width from the centre, and at least the list's
    narrowest angle), which loses nothing; without a floor, all lists. Ties go to
    the lowest id.
    """
    asked = queries.select(F.col(query_id), "team_id", F.col(embedding).alias("u"), F.lit(floor).cast("double").alias("bound"))
    routed = _routed(asked, path, probes, False, query_id, key_type, before)
    found = _searched(routed, path, query_id, key_type, before, spill=probes is not None)
    return _best(found if floor is None else found.filter(F.col("similarity") >= floor), query_id)


def nearest(
    queries: DataFrame,
    path: str,
    query_id: str = "query_id",
    embedding: str = "embedding",
    key_type: str = "bigint",
    before: int | None = None,
) -> DataFrame:
    """The most similar entry of the query's team, exactly and without a floor, in two rounds.

    The closest list is searched first. What it gives bounds the search of the
    others: lists that can't hold a better entry, nor one as good, are left out.
    """
    asked = queries.select(F.col(query_id), "team_id", F.col(embedding).alias("u"), F.lit(None).cast("double").alias("bound"))
    first, second = _two_rounds(asked, path, query_id, key_type, before)
    return _best(first.unionByName(_searched(second, path, query_id, key_type, before)), query_id)


def looked_at(
    queries: DataFrame, path: str, query_id: str = "query_id", embedding: str = "embedding", key_type: str = "bigint"
) -> DataFrame:
    """How much ``nearest`` reads: ``pairs`` of a query and a list of its team, out of ``all_pairs``."""
    asked = queries.select(F.col(query_id), "team_id", F.col(embedding).alias("u"), F.lit(None).cast("double").alias("bound"))
    _, second = _two_rounds(asked, path, query_id, key_type, None)
    lists = blocks_of(queries.sparkSession, path, key_type).select("team_id", "list").distinct()
    dims = centres_of(queries.sparkSession, path).shape[-1]
    asked = asked.filter(usable(F.col("u"), dims))
    later = second.join(lists, ["team_id", "list"]).agg(F.coalesce(F.sum(F.size("asked")), F.lit(0)).alias("n"))
    teams = lists.groupBy("team_id").agg(F.count("*").alias("lists"))
    every = asked.join(teams, "team_id").agg(F.count("*").alias("first"), F.coalesce(F.sum("lists"), F.lit(0)).alias("all_pairs"))
    counts = every.select(F.col("first").alias("pairs"), "all_pairs").unionByName(later.select(F.col("n").alias("pairs"), F.lit(0).alias("all_pairs")))
    return counts.agg(F.sum("pairs").alias("pairs"), F.sum("all_pairs").cast("bigint").alias("all_pairs"))


def _two_rounds(asked, path, query_id, key_type, before) -> tuple[DataFrame, DataFrame]:
    """What the closest lists give, and the queries as they are sent to the others."""
    first = stored(_searched(_routed(asked, path, 1, False, query_id, key_type, before), path, query_id, key_type, before), "first")
    best = _best(first, query_id).select(query_id, F.col("similarity").alias("_best"))
    bounded = asked.join(best, query_id, "left").withColumn("bound", F.col("_best")).drop("_best")
    return first, _routed(bounded, path, None, True, query_id, key_type, before)


#: A list is left out only if it can't even reach what counts as a tie.
_SLACK = 10.0 ** (1 - TIE_DIGITS)


def _by_list(ids: pa.Array, teams: list, q: np.ndarray, near: np.ndarray):
    """Blocks of the queries by list and team; a batch holds those of one list, so it is never larger than what came in."""
    by_team = np.array(sorted(range(len(teams)), key=lambda i: teams[i] or ""), dtype=int)
    for at in range(near.shape[1]):
        row = by_team[near[by_team, at]]
        if not len(row):
            continue
        places = [teams[r] for r in row]
        starts = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]]
        starts = [k for i, j in zip(starts, [*starts[1:], len(places)]) for k in range(i, j, BLOCK)]
        spans = list(zip(starts, [*starts[1:], len(places)]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([at] * len(spans), pa.int32()),
                pa.array([places[i] for i, _ in spans], pa.string()),
                pa.ListArray.from_arrays(pa.array([*starts, len(places)], pa.int32()), ids.take(pa.array(row))),
                pa.array([q[row[i:j]].tobytes() for i, j in spans], pa.binary()),
            ],
            names=["list", "team_id", "asked", "q"],
        )


def _routed(asked, path, probes, others, query_id, key_type, before) -> DataFrame:
    """``list, team_id, asked, q``: blocks of the queries that look at a list, written to the shared folder.

    ``others`` leaves the closest list out.
    """
    spark = asked.sparkSession
    centres = centres_of(spark, path)
    id_type = asked.schema[query_id].dataType.simpleString()
    out = f"list int, team_id string, asked array<{id_type}>, q binary"
    if not len(centres):
        return spark.createDataFrame([], out)
    dims = centres.shape[1]
    width, inner = np.full(len(centres), -1.0), np.zeros(len(centres))
    if probes is None:
        # Bounded by the number of lists.
        rings = blocks_of(spark, path, key_type, before).groupBy("list").agg(F.min("inner").alias("inner"), F.max("width").alias("width"))
        for r in rings.collect():
            width[r.list], inner[r.list] = r.width, r.inner
    rows = asked.select(F.col(query_id).alias("id"), "team_id", F.col("u").cast("array<double>").alias("u"), "bound")

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = _unit(_rows(b.column(2), dims))
            sims = q @ centres.T
            if probes is not None:
                n = min(probes, len(centres))
                near = np.zeros(sims.shape, bool)
                np.put_along_axis(near, np.argpartition(-sims, n - 1, axis=1)[:, :n], True, axis=1)
            else:
                angle = np.arccos(np.clip(sims, -1.0, 1.0))
                bound = np.nan_to_num(b.column(3).to_numpy(zero_copy_only=False).astype(float), nan=-1.0)
                reach = np.arccos(np.clip(bound - _SLACK, -1.0, 1.0))[:, None] + 1e-9
                near = (angle - width <= reach) & (inner - angle <= reach) & (width >= 0)
                if others:
                    near[np.arange(len(q)), sims.argmax(axis=1)] = False
            yield from _by_list(b.column(0), b.column(1).to_pylist(), q, near)

    return stored(rows.filter(usable(F.col("u"), dims)).mapInArrow(route, out), "routed")


def _searched(routed, path, query_id, key_type, before, spill=False) -> DataFrame:
    """``query_id, similarity, cache_id``: the best entry of each block that a query meets.

    Only the partitions of lists that some query looks at are read. Blocks of
    queries meet blocks of entries by team and list, and a task multiplies two
    blocks at a time.
    """
    id_type = routed.schema["asked"].dataType.elementType.simpleString()
    # At most one row per list, so small enough for every task; it prunes partitions while the query runs.
    wanted = F.broadcast(routed.select("list").filter("list >= 0").distinct())
    entries = blocks_of(routed.sparkSession, path, key_type, before).join(wanted, "list", "left_semi")
    if spill:
        again = blocks_of(routed.sparkSession, path, key_type, before, "spill").join(wanted, "list", "left_semi")
        entries = entries.unionByName(again)
    pairs = routed.join(entries, ["list", "team_id"])

    def best(batches):
        for b in batches:
            for asked_ids, q, ids, vectors in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                left = np.frombuffer(q.as_py()).reshape(len(asked_ids.values), -1)
                sims = left @ _unit(np.frombuffer(vectors.as_py()).reshape(-1, left.shape[1])).T
                # Rounded to find ties only; ids are in order, so the first of equals is the lowest.
                at = np.round(sims, TIE_DIGITS).argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [asked_ids.values, pa.array(sims[np.arange(len(at)), at]), ids.values.take(pa.array(at))],
                    names=[query_id, "similarity", "cache_id"],
                )

    out = f"`{query_id}` {id_type}, similarity double, cache_id {key_type}"
    return pairs.select("asked", "q", "ids", "vectors").mapInArrow(best, out)


def _best(found: DataFrame, query_id: str) -> DataFrame:
    place = F.struct(F.round(-F.col("similarity"), TIE_DIGITS).alias("d"), F.col("cache_id"), F.col("similarity"))
    return found.groupBy(query_id).agg(F.min(place).alias("_b")).select(
        query_id, F.col("_b.cache_id").alias("cache_id"), F.col("_b.similarity").alias("similarity")
    )
