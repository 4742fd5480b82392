"""Nearest cached prompt by cosine similarity.

Vectors of a team are spread over cells around pivot vectors, and cells over
blocks of bounded size, so a team or a cell that holds a large part of all rows
becomes many tasks. A task multiplies one block of queries with one block of
cache vectors and returns one row per query: its best match in that block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 4096
# Similarities closer than this count as ties, which the lowest id wins.
TIE_DIGITS = 9
NO_MATCH = -2.0


@dataclass(frozen=True)
class Cells:
    """Pivots of unit length and, per cell, the widest angle of its members."""

    pivots: np.ndarray
    radius: np.ndarray


def keyed_vectors(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """(key, team, vector) in the width it is stored in; tasks scale it."""
    return df.select(key, "team_id", F.col(embedding).alias("u")).filter(F.col("u").isNotNull())


def _matrix(column) -> np.ndarray:
    """Rows of unit length; a zero vector has no direction and stays zero.

    Vectors of unequal length cannot be compared, so they are an error.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of unequal length: {sorted(sizes)}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = flat.reshape(len(column), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def choose_pivots(vectors: DataFrame, key: str, count: int) -> np.ndarray:
    """A fixed choice of ``count`` members, by hash of their id."""
    rows = vectors.orderBy(F.xxhash64(key), key).limit(count).select("u").collect()
    pivots = np.array([r["u"] for r in rows], dtype=float)
    length = np.linalg.norm(pivots, axis=1, keepdims=True)
    return pivots / np.where(length == 0, 1.0, length)


def trained_pivots(vectors: DataFrame, count: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """Centres of a k-means over the unit vectors."""
    from pyspark import StorageLevel
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    raw = vectors.select(array_to_vector(F.col("u").cast("array<double>")).alias("raw"))
    points = Normalizer(inputCol="raw", outputCol="v").transform(raw).select("v")
    # Every round reads the points again.
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(
            k=count, seed=seed, maxIter=rounds, featuresCol="v", initMode="random"
        ).fit(points)
    finally:
        points.unpersist()
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def _to_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each vector with its nearest pivot's cell and the angle to it."""

    def assign(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            sims = _matrix(b.column("u")) @ pivots.T
            cell = sims.argmax(axis=1)
            best = sims[np.arange(len(cell)), cell]
            angle = np.arccos(np.clip(best, -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell.astype("int32")), pa.array(angle)],
                names=[*b.schema.names, "cell", "angle"],
            )

    fields = f"{_ddl(vectors)}, cell int, angle double"
    return vectors.mapInArrow(assign, fields)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def build_cells(vectors: DataFrame, pivots: np.ndarray) -> Cells:
    """Measure the cells once, as one builds an index; one number per pivot."""
    sized = _to_cells(vectors, pivots).groupBy("cell").agg(F.max("angle").alias("r")).collect()
    radius = np.full(len(pivots), -1.0)
    for row in sized:
        radius[row["cell"]] = row["r"]
    return Cells(pivots, radius)


def _routes(queries: DataFrame, pick) -> DataFrame:
    """Explode each query to the cells that ``pick`` names for its batch."""

    def route(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            row, cell = pick(_matrix(b.column("u")))
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(cell.astype("int32"))],
                names=[*b.schema.names, "cell"],
            )

    return queries.mapInArrow(route, f"{_ddl(queries)}, cell int")


def _possible(cells: Cells, floor: float):
    """Cells that may hold a vector at least ``floor`` similar to the query."""
    reach = math.acos(max(-1.0, min(1.0, floor))) + 1e-9

    def pick(q: np.ndarray):
        angle = np.arccos(np.clip(q @ cells.pivots.T, -1.0, 1.0))
        return np.nonzero((angle - cells.radius <= reach) & (cells.radius >= 0))

    return pick


def _closest(cells: Cells, probes: int):
    def pick(q: np.ndarray):
        sims = q @ cells.pivots.T
        sims[:, cells.radius < 0] = NO_MATCH
        n = min(probes, sims.shape[1])
        cell = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(q)), n), cell.ravel()

    return pick


def _best_in_blocks(
    queries: DataFrame, cache: DataFrame, query_id: str, cache_id: str, block_rows: int
) -> DataFrame:
    """Best match of each query among the cache rows of its (team, cell)."""
    place = ["team_id", "cell"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count("*") / F.lit(block_rows)).cast("int")
        return df.groupBy(*place).agg(n.alias(name))

    grid = blocks(queries, "_qn").join(blocks(cache, "_cn"), place)
    left = (
        queries.join(grid, place)
        .withColumn("_q", F.pmod(F.xxhash64(query_id), F.col("_qn")).cast("int"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_cn") - 1)))
        .select(*place, "_q", "_c", query_id, "u")
    )
    right = (
        cache.join(grid, place)
        .withColumn("_c", F.pmod(F.xxhash64(cache_id), F.col("_cn")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qn") - 1)))
        .select(*place, "_q", "_c", F.col(cache_id).alias("cache_id"), "u")
    )
    id_type = queries.schema[query_id].dataType.simpleString()
    cid_type = cache.schema[cache_id].dataType.simpleString()

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return pa.table({query_id: q[query_id].slice(0, 0), "similarity": pa.array([], pa.float64()), "cache_id": c["cache_id"].slice(0, 0)})
        # In id order, so the first of equal matches is the lowest id.
        c = c.sort_by("cache_id")
        left, right = _matrix(q["u"]), _matrix(c["u"])
        if left.shape[1] != right.shape[1]:
            raise ValueError(f"queries have {left.shape[1]} dimensions, entries {right.shape[1]}")
        sims = left @ right.T
        sims[:, ~right.any(axis=1)] = NO_MATCH
        # Rounded to find ties only; the similarity itself stays as it is.
        at = np.round(sims, TIE_DIGITS).argmax(axis=1)
        top = sims[np.arange(len(at)), at]
        keep = np.nonzero(left.any(axis=1) & (top > NO_MATCH))[0]
        return pa.table(
            {
                query_id: q[query_id].take(pa.array(keep)),
                "similarity": pa.array(top[keep]),
                "cache_id": c["cache_id"].take(pa.array(at[keep])),
            }
        )

    keys = [*place, "_q", "_c"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(best, f"{query_id} {id_type}, similarity double, cache_id {cid_type}")
    )
    place_of = F.struct(F.round(-F.col("similarity"), TIE_DIGITS).alias("d"), F.col("cache_id"), F.col("similarity"))
    return found.groupBy(query_id).agg(F.min(place_of).alias("_b")).select(
        query_id, F.col("_b.cache_id").alias("cache_id"), F.col("_b.similarity").alias("similarity")
    )


def nearest(
    queries: DataFrame,
    cache: DataFrame,
    query_id: str = "query_id",
    cache_id: str = "id",
    floor: float | None = None,
    cells: Cells | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact nearest entry of the query's own team.

    With a floor, only matches at least that similar are returned, and cells too
    far away to hold one are skipped: an entry within ``acos(floor)`` of the
    query lies at most its cell's radius from the pivot, so the pivot is within
    the sum of the two. The skipping loses nothing.
    """
    q, c = keyed_vectors(queries, query_id), keyed_vectors(cache, cache_id)
    if cells is not None and floor is not None:
        c = _to_cells(c, cells.pivots).drop("angle")
        q = _routes(q, _possible(cells, floor))
    else:
        q, c = q.withColumn("cell", F.lit(0)), c.withColumn("cell", F.lit(0))
    found = _best_in_blocks(q, c, query_id, cache_id, block_rows)
    return found if floor is None else found.filter(F.col("similarity") >= floor)


def nearest_approximate(
    queries: DataFrame,
    cache: DataFrame,
    cells: Cells,
    probes: int = 4,
    query_id: str = "query_id",
    cache_id: str = "id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Nearest entry among the ``probes`` closest inverted lists."""
    c = _to_cells(keyed_vectors(cache, cache_id), cells.pivots).drop("angle")
    q = _routes(keyed_vectors(queries, query_id), _closest(cells, probes))
    return _best_in_blocks(q, c, query_id, cache_id, block_rows)
