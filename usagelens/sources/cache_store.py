"""The prompt cache as stored tables: full entries by version, hits, and the index of their vectors.

A version is what one micro-batch (or one load) adds. Writing it again replaces
it, and a reader asks for the cache as it stood before a version. Compaction
joins old versions into a base of its own and then announces it, so readers see
either the old files or the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.session import scratch_path
from usagelens.sources import vector_index
from usagelens.sources.prompt_cache import KEY

ENTRY = (
    "id string, team_id string, prompt_hash string, prompt_text string, embedding array<float>,"
    " response_json string, model_used string, input_tokens int, output_tokens int, cost_usd decimal(10,8),"
    " created_at timestamp, event_id bigint"
)
HITS = "id string, layer string, new_hits bigint"
#: Version of the rows that compaction has joined.
BASE = -2
_BASES = "base int, below bigint"


class CacheStore:
    """Entries, hits and vector index below one folder."""

    def __init__(self, spark: SparkSession, path: str, lists: int = 16):
        self.spark, self.path, self.lists = spark, path, lists

    def begin(self) -> CacheStore:
        """Empty first versions, so everything can be read before anything was written; harmless on a filled store."""
        for name, schema in (("entries", ENTRY), ("hits", HITS)):
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("overwrite").parquet(f"{self.path}/{name}/version={vector_index.NOTHING}")
        self.spark.createDataFrame([], _BASES).write.mode("overwrite").parquet(f"{self.path}/bases/none")
        vector_index.begin(self.spark, self._index(0), "string")
        return self

    def _base(self) -> tuple[int, int]:
        """The number of the newest base, and the first version that is not in it. One small row per compaction."""
        rows = self.spark.read.schema(_BASES).option("recursiveFileLookup", "true").parquet(f"{self.path}/bases").collect()
        return max(((r.base, r.below) for r in rows), default=(0, BASE))

    def _index(self, base: int) -> str:
        return f"{self.path}/index-{base}"

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        base, below = self._base()
        rows = self.spark.read.schema(f"{schema}, version bigint").parquet(f"{self.path}/{name}")
        rows = rows.filter(F.col("version") >= below)
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        rows = rows.drop("version")
        if base:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}-{base}").unionByName(rows)
        return rows

    def entries(self, before: int | None = None) -> DataFrame:
        """Entries of all versions, or of those before the given one."""
        return self._read("entries", ENTRY, before)

    def hits(self, before: int | None = None) -> DataFrame:
        return self._read("hits", HITS, before)

    def table(self) -> DataFrame:
        """The entries with the hits of all versions added up."""
        total = self.hits().groupBy("id").agg(F.sum("new_hits").cast("int").alias("hit_count"))
        return self.entries().join(total, "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))

    def add(self, rows: DataFrame, version: int) -> None:
        """Full entries of one version, and their vectors. Keys must be new (``prompt_cache.new_entries``)."""
        names = [c.split()[0] for c in ENTRY.split(", ")]
        place = f"{self.path}/entries/version={version}"
        rows.select(*names).write.mode("overwrite").parquet(place)
        # Read back, so the vectors are worked out once.
        written = self.spark.read.schema(ENTRY).parquet(place)
        index = self._index(self._base()[0])
        if len(vector_index.train(written, index, "id", self.lists, version=version)):
            vector_index.append(written, index, version=version, places=1)

    def add_hits(self, hits: DataFrame, version: int) -> None:
        hits.select("id", "layer", "new_hits").write.mode("overwrite").parquet(f"{self.path}/hits/version={version}")

    def similar(self, queries: DataFrame, floor: float, query_id: str, before: int | None = None) -> DataFrame:
        """The most similar entry of the team, exactly, where one is at least as similar as ``floor``."""
        index = self._index(self._base()[0])
        return vector_index.probe(queries, index, None, floor, query_id, key_type="string", before=before)

    def compact(self, below: int) -> None:
        """Join all versions below ``below`` into a new base; run it between micro-batches.

        The base is announced by a row written last. Until then readers use the old files, which stay.
        """
        base, since = self._base()
        if below <= since:
            return
        self.entries(below).write.mode("overwrite").parquet(f"{self.path}/entries-{base + 1}")
        summed = self.hits(below).groupBy("id", "layer").agg(F.sum("new_hits").alias("new_hits"))
        summed.write.mode("overwrite").parquet(f"{self.path}/hits-{base + 1}")
        new = self._index(base + 1)
        vector_index.compact(self.spark, self._index(base), "string", below, new, places=1)
        for version in self._versions(below):
            part = self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries/version={version}")
            vector_index.append(part, new, version=version, places=1)
        row = self.spark.createDataFrame([(base + 1, below)], _BASES)
        row.write.mode("overwrite").parquet(f"{self.path}/bases/{base + 1}")

    def _versions(self, since: int) -> list[int]:
        """Versions from ``since`` on that hold entries; few, as compaction keeps their number down."""
        rows = self.spark.read.schema(f"{ENTRY}, version bigint").parquet(f"{self.path}/entries")
        return [r.version for r in rows.filter(F.col("version") >= since).select("version").distinct().collect()]


def write_bucketed(cache: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """The cache as a table bucketed by (team, prompt hash), with Bloom filters on the hash.

    A lookup or an insert by key then moves only its own side, and a search for
    single hashes skips row groups. More rows may be appended by the same call.
    """
    spark = cache.sparkSession
    (
        cache.write.mode("append")
        .option("path", path or scratch_path(spark, table))
        .option("parquet.bloom.filter.enabled#prompt_hash", "true")
        .bucketBy(buckets, *KEY)
        .sortBy(*KEY)
        .saveAsTable(table)
    )
    return spark.table(table)
