import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.operators import embedding, lookup, nearest
from usagelens.plans import workload as W
from usagelens.session import conf, scratch_path
from usagelens.sources import cache_store, prompt_cache as PC, vector_index
from usagelens.sources.cache_store import CacheStore
from usagelens.streaming import cache_fill

DIMS = 8


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors; one team and one cluster of copies hold most rows."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(5, DIMS))
    cache, probes = [], []
    for i in range(400):
        centre = centres[0] if i % 3 else centres[i % 5]
        noise = 0.0 if i % 3 == 1 else 0.3
        team = "big" if i % 4 else f"t{i % 8}"
        cache.append((i, team, [float(x) for x in centre + noise * rnd.normal(size=DIMS)]))
    for i in range(120):
        centre = centres[i % 5]
        team = "big" if i % 4 else f"t{i % 8}"
        probes.append((i, team, [float(x) for x in centre + 0.4 * rnd.normal(size=DIMS)]))
    probes.append((999, "big", [0.0] * DIMS))
    kinds = "{} long, team_id string, embedding array<double>"
    return (
        spark.createDataFrame(cache, kinds.format("id")),
        spark.createDataFrame(probes, kinds.format("query_id")),
        cache,
        probes,
    )


def brute(cache, probes, floor=-2.0):
    best = {}
    for q, team, v in probes:
        v = np.array(v)
        if not v.any():
            continue
        sims = [
            (-round(float(v @ np.array(c)) / float(np.linalg.norm(v) * np.linalg.norm(c)), 9), i)
            for i, t, c in cache
            if t == team
        ]
        if sims and -min(sims)[0] >= floor:
            best[q] = (min(sims)[1], -min(sims)[0])
    return best


def found(df):
    return {r["query_id"]: (r["cache_id"], r["similarity"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][0] == want[k][0]
        assert got[k][1] == pytest.approx(want[k][1], abs=1e-8)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_nearest_is_exact(vectors, block_rows):
    cache, probes, c, p = vectors
    same(found(nearest.nearest(probes, cache, block_rows=block_rows)), brute(c, p))


@pytest.mark.parametrize("floor", [0.85, 0.97])
def test_skipping_cells_loses_nothing(vectors, floor):
    cache, probes, c, p = vectors
    u = nearest.keyed_vectors(cache, "id")
    cells = nearest.build_cells(u, nearest.choose_pivots(u, "id", 6))
    got = nearest.nearest(probes, cache, floor=floor, cells=cells, block_rows=32)
    same(found(got), brute(c, p, floor))


def test_inverted_lists_find_most_and_all_lists_find_all(vectors):
    cache, probes, c, p = vectors
    u = nearest.keyed_vectors(cache, "id")
    cells = nearest.build_cells(u, nearest.trained_pivots(u, 6))
    want = brute(c, p)
    few = found(nearest.nearest_approximate(probes, cache, cells, probes=2))
    assert sum(few.get(q, (None, 0))[1] >= s - 1e-6 for q, (_, s) in want.items()) / len(want) >= 0.8
    same(found(nearest.nearest_approximate(probes, cache, cells, probes=6)), want)


def test_ivf_recall_on_the_sample(spark):
    folder = "/root/testdata/sf0.01"
    cache, probes = W.view(spark, folder, "prompt_cache"), W.view(spark, folder, "probes")
    u = nearest.keyed_vectors(cache, "id")
    cells = nearest.build_cells(u, nearest.trained_pivots(u, 16))
    exact = found(nearest.nearest(probes, cache))
    got = found(nearest.nearest_approximate(probes, cache, cells, probes=4))
    assert sum(got.get(q, (None,))[0] == i for q, (i, _) in exact.items()) / len(exact) >= 0.85


def test_two_layer_looks_each_prompt_up_once(spark):
    cache = spark.createDataFrame(
        [(1, "t", "known", [1.0, 0.0], "m", 0.5), (2, "t", "other", [0.0, 1.0], "m", 0.25)],
        "id long, team_id string, prompt_text string, embedding array<double>, model_used string, cost_usd double",
    ).withColumn("prompt_hash", F.sha2("prompt_text", 256))
    rows = [(i, "t", "known", [0.0, 1.0]) for i in range(50)]
    rows += [(100, "t", "close", [0.1, 1.0]), (101, "t", "near", [0.5, 1.0]), (102, "t", "far", [-1.0, 0.1]), (103, "u", "known", [1.0, 0.0])]
    asked = spark.createDataFrame(rows, "query_id long, team_id string, prompt_text string, embedding array<double>")
    got = {r["query_id"]: r for r in lookup.two_layer(asked, cache).collect()}
    assert len(got) == len(rows)
    assert {got[i]["layer"] for i in range(50)} == {"exact_hash"} and got[0]["cache_label"] == "redis_hit"
    assert (got[100]["layer"], got[100]["cache_id"], got[100]["cache_label"]) == ("semantic", 2, "semantic_hit")
    assert (got[101]["outcome"], got[101]["cache_id"], got[101]["matched_id"]) == ("near_miss", None, 2)
    assert got[102]["outcome"] == got[103]["outcome"] == "miss"
    hits = {r["id"]: r["hit_count"] for r in PC.with_hits(cache.withColumn("hit_count", F.lit(1)), lookup.two_layer(asked, cache)).collect()}
    assert hits == {1: 51, 2: 2}


def test_embed_only_what_is_missing(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(batch):
        calls.add(len(batch))
        return embedding.word_buckets(batch)

    texts = spark.createDataFrame([("a b",)] * 40 + [("c",), ("d",)], "text string")
    known = embedding.embed(spark.createDataFrame([("c",)], "text string").withColumn("text_hash", F.sha2("text", 256)))
    out = embedding.embed_missing(texts, known, embedder=counting, batch_size=2).collect()
    assert calls.value == 2
    assert sorted(r["source"] for r in out) == ["cached", "computed", "computed"]
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1.0) for r in out)
    counts = {r["cache_hit"]: r["requests"] for r in embedding.request_counts(texts, known).collect()}
    assert counts == {"hit": 1, "miss": 41}


REPLY = "response_json string, model_used string, input_tokens int, output_tokens int, cost_usd decimal(10,8)"


def _batches(spark, folder, batches):
    """One file per micro-batch."""
    from datetime import datetime, timedelta
    from decimal import Decimal

    start, n = datetime(2024, 1, 1), 0
    schema = f"team_id string, prompt_text string, status int, created_at timestamp, event_id long, {REPLY}"
    for rows in batches:
        full = []
        for r in rows:
            full.append((*r, start + timedelta(seconds=n), n, f"reply {n}", "m", 1, 2, Decimal("0.00000100")))
            n += 1
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


# "c b a" and "a b c" have the same words and so the same vector.
BATCHES = [
    [("t", "a", 200), ("t", "a", 200), ("t", "b", 502), ("t", "a b c", 200)],
    [("t", "a", 200), ("u", "a", 200), ("t", "b", 200), ("t", "c b a", 200), ("u", "c b a", 502)],
    [("t", "a", 200), ("t", "b", 200), ("t", "c b a", 200), ("t", "a b c", 200)],
    [("t", "b", 502), ("u", "c b a", 502)],
]


def _filled(store):
    hits = {(r["id"], r["layer"]): r["new_hits"] for r in store.hits().groupBy("id", "layer").agg(F.sum("new_hits").alias("new_hits")).collect()}
    return {
        (r["team_id"], r["prompt_text"]): (r["event_id"], r["response_json"], hits.get((r["id"], "exact_hash"), 0), hits.get((r["id"], "semantic"), 0), r["hit_count"])
        for r in store.table().collect()
    }


@pytest.mark.parametrize("compact_every", [None, 1, 2])
def test_cache_fill_over_several_batches(spark, tmp_path, compact_every):
    files = _batches(spark, str(tmp_path / "in"), BATCHES)
    state = scratch_path(spark, "state")
    store = CacheStore(spark, scratch_path(spark, "cache"))
    want = {
        ("t", "a"): (0, "reply 0", 2, 0, 2),
        ("t", "a b c"): (3, "reply 3", 1, 2, 3),
        ("u", "a"): (5, "reply 5", 0, 0, 0),
        ("t", "b"): (6, "reply 6", 2, 0, 2),
    }
    assert _filled(cache_fill.fill(files, store, state, compact_every=compact_every)) == want
    # A second run finds nothing new, and a batch that is tried again changes nothing.
    assert _filled(cache_fill.fill(files, store, state, compact_every=compact_every)) == want
    entries = store.entries(4).filter("event_id = 6")
    store.add(spark.createDataFrame(entries.collect(), entries.schema), 1 if compact_every is None else 3)
    assert store.entries().filter("event_id = 6").count() <= 2


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    """The work of the second batch is done twice, as after a crash before its commit."""
    files = _batches(spark, str(tmp_path / "in"), BATCHES)
    store = CacheStore(spark, scratch_path(spark, "cache"))
    kept = cache_fill.each_batch

    def twice(stream, work, checkpoint):
        kept(stream, lambda batch, n: [work(batch, n) for _ in range(2)], checkpoint)

    cache_fill.each_batch = twice
    try:
        got = _filled(cache_fill.fill(files, store, scratch_path(spark, "state")))
    finally:
        cache_fill.each_batch = kept
    assert {k: v[2:] for k, v in got.items()} == {("t", "a"): (2, 0, 2), ("t", "a b c"): (1, 2, 3), ("u", "a"): (0, 0, 0), ("t", "b"): (2, 0, 2)}


@pytest.fixture(scope="module")
def indexed(spark, vectors):
    cache, probes, c, p = vectors
    path = scratch_path(spark, "index")
    vector_index.create(cache, path, lists=6)
    return path


@pytest.mark.parametrize("floor", [None, 0.85, 0.97])
def test_stored_index_is_exact_over_all_lists(vectors, indexed, floor):
    cache, probes, c, p = vectors
    want = brute(c, p) if floor is None else brute(c, p, floor)
    same(found(vector_index.probe(probes, indexed, None, floor)), want)


def test_two_rounds_are_exact_and_read_little_of_clustered_vectors(spark, vectors, indexed):
    cache, probes, c, p = vectors
    same(found(vector_index.nearest(probes, indexed)), brute(c, p))
    # Tight clusters far apart: the closest list bounds the rest away.
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(24, 32))
    rows = [(i, "t", [float(x) for x in centres[i % 24] + 0.05 * rnd.normal(size=32)]) for i in range(960)]
    asked = [(i, "t", [float(x) for x in centres[i % 24] + 0.05 * rnd.normal(size=32)]) for i in range(96)]
    cache = spark.createDataFrame(rows, "id long, team_id string, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, team_id string, embedding array<double>")
    path = scratch_path(spark, "index")
    vector_index.create(cache, path, lists=24)
    same(found(vector_index.nearest(queries, path)), brute(rows, asked))
    (read,) = vector_index.looked_at(queries, path).collect()
    assert read["pairs"] < read["all_pairs"] / 5


def test_stored_index_finds_most_in_few_lists(vectors, indexed):
    cache, probes, c, p = vectors
    want, few = brute(c, p), found(vector_index.probe(probes, indexed, 2))
    assert sum(few.get(q, (None, 0))[1] >= s - 1e-6 for q, (_, s) in want.items()) / len(want) >= 0.8


def test_index_grows_by_versions_without_training(spark, vectors):
    cache, probes, c, p = vectors
    path = scratch_path(spark, "index")
    vector_index.create(cache.filter("id < 100"), path, lists=6)
    centres = vector_index.centres_of(spark, path)
    for _ in range(2):
        # The second time replaces the first.
        vector_index.append(cache.filter("id >= 100 AND id < 250"), path, version=1)
        vector_index.append(cache.filter("id >= 250"), path, version=2)
    assert np.array_equal(vector_index.centres_of(spark, path), centres)
    same(found(vector_index.probe(probes, path, None)), brute(c, p))
    early = [r for r in c if r[0] < 250]
    same(found(vector_index.probe(probes, path, None, 0.85, before=2)), brute(early, p, 0.85))
    into = scratch_path(spark, "index")
    vector_index.compact(spark, path, "bigint", 2, into)
    same(found(vector_index.probe(probes, into, None)), brute(early, p))


def test_index_puts_out_what_it_cannot_hold(spark, vectors, indexed):
    rows = [(1, "big", None), (2, "big", [1.0, 2.0]), (3, "big", [0.0] * DIMS), (4, "big", [1.0] * DIMS), (5, "big", [None] + [1.0] * (DIMS - 1))]
    odd = spark.createDataFrame(rows, "id long, team_id string, embedding array<double>")
    assert sorted(r["id"] for r in vector_index.unusable(odd, indexed).collect()) == [1, 2, 3, 5]
    assert vector_index.probe(odd.withColumnRenamed("id", "query_id"), indexed, 4).count() == 1
    empty = scratch_path(spark, "index")
    vector_index.create(odd.limit(0), empty)
    assert vector_index.probe(odd.withColumnRenamed("id", "query_id"), empty, 4).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probe_reads_only_the_lists_it_needs(vectors, indexed):
    cache, probes, c, p = vectors
    assert "dynamicpruning" in _plan(vector_index.probe(probes.limit(1), indexed, 1)).lower()


def test_lookup_does_not_move_the_bucketed_cache(spark):
    rows = [(i, "t", f"prompt {i}") for i in range(200)]
    cache = spark.createDataFrame(rows, "id long, team_id string, prompt_text string").withColumn("prompt_hash", F.sha2("prompt_text", 256))
    stored = cache_store.write_bucketed(cache, "bucketed_cache", 8)
    asked = cache.filter("id % 3 = 0").select("team_id", "prompt_hash", F.col("id").alias("query_id"))
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        looked = lookup.exact(asked, stored)
        plan = _plan(looked).split("Exchange")
        # One exchange, of the queries; the cache is read in its buckets.
        assert len(plan) == 2 and "Bucketed: true" in plan[0] + plan[1]
        assert looked.filter("cache_id = query_id").count() == 67
        fresh = PC.new_entries(asked.withColumn("n", F.lit(1)), stored, ["query_id"])
        assert "Bucketed: true" in _plan(fresh) and fresh.count() == 0
    cache_store.write_bucketed(cache.withColumn("team_id", F.lit("u")), "bucketed_cache", 8, _path_of(spark, "bucketed_cache"))
    assert spark.table("bucketed_cache").count() == 400


def _path_of(spark, table):
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").collect()
    return next(r["data_type"] for r in rows if r["col_name"] == "Location")


def test_hashed_words_are_the_function_s(spark):
    texts = ["", " ", "a", "a b", "a  b ", "unique question 17", "x y " * 500, "é 日本 😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["v"] for r in rows.select("text", embedding.hashed_words(F.col("text")).alias("v")).collect()}
    for t, w in zip(texts, embedding.word_buckets(texts).astype("float32")):
        assert np.array_equal(np.array(got[t], "float32"), w)
    assert "Python" not in _plan(embedding.embed_missing(rows, embedding.embed(rows.withColumn("text_hash", F.sha2("text", 256)))))


def _times(rows, known, ttl):
    """Each text's requests in turn."""
    out = []
    for text in {t for t, _ in rows}:
        made = known.get(text)
        for at in sorted(a for t, a in rows if t == text):
            if made is None or at >= made + ttl:
                made = at
            out.append((text, at, made))
    return sorted(out)


def test_embeddings_are_made_again_after_a_day(spark):
    import random
    from datetime import datetime, timedelta, timezone

    pick, start = random.Random(2), datetime(2024, 1, 1)
    rows = [("hot", pick.randrange(30 * 86400)) for _ in range(600)]
    rows += [(f"t{pick.randrange(20)}", pick.randrange(30 * 86400)) for _ in range(300)]
    rows += [("edge", 0), ("edge", 86399), ("edge", 86400), ("edge", 86400), ("known", 10), ("known", 3600)]
    known = {"known": -86000, "t1": -50, "never asked": -5}
    asked = spark.createDataFrame([(t, start + timedelta(seconds=a)) for t, a in rows], "text string, created_at timestamp")
    before = spark.createDataFrame([(t, start + timedelta(seconds=a)) for t, a in known.items()], "text string, computed_at timestamp")
    before = embedding.embed(before.select(F.sha2("text", 256).alias("text_hash"), "text")).join(before.select(F.sha2("text", 256).alias("text_hash"), "computed_at"), "text_hash")
    out = embedding.embedding_times(asked, before).collect()
    second = lambda t: round((t - start).total_seconds())
    want = _times(rows, known, 86400)
    assert sorted((r["text"], second(r["created_at"]), second(r["computed_at"])) for r in out) == want
    assert all((r["source"] == "computed") == (r["created_at"] == r["computed_at"]) for r in out)
    calls = spark.sparkContext.accumulator(0)

    def counting(batch):
        calls.add(len(batch))
        return embedding.word_buckets(batch)

    used = embedding.embed_valid(asked, before, embedder=counting).collect()
    assert len(used) == len({(t, m) for t, _, m in want}) and sum(r["requests"] for r in used) == len(rows)
    native = embedding.embed_valid(asked, before).collect()
    assert sorted(map(str, used)) == sorted(map(str, native)) and all(r["embedding"] for r in native)
    assert calls.value >= len({t for t, _, m in want if m >= 0}) - 2


def test_only_prompts_left_over_are_embedded(spark):
    """With an embedder at hand, texts that the first layer serves are never embedded, and others once."""
    texts = ["a b c", "d e f", "known", "c b a", "d e f"]
    cache = embedding.embed(spark.createDataFrame([("a b c",), ("known",)], "text string").withColumn("text_hash", F.sha2("text", 256)))
    cache = cache.select(F.col("text_hash").alias("id"), F.lit("t").alias("team_id"), F.col("text_hash").alias("prompt_hash"), "embedding", F.lit("m").alias("model_used"))
    path = scratch_path(spark, "index")
    vector_index.create(cache, path)
    asked = spark.createDataFrame([(i, "t", x) for i, x in enumerate(texts)], "query_id long, team_id string, prompt_text string")
    seen = []

    def embed(rows):
        seen.extend(r["text"] for r in rows.collect())
        return embedding.embed(rows)

    got = {r["query_id"]: (r["layer"], r["outcome"]) for r in lookup.two_layer(asked, cache, index=path, embed=embed).collect()}
    assert got == {0: ("exact_hash", "hit"), 1: (None, "miss"), 2: ("exact_hash", "hit"), 3: ("semantic", "hit"), 4: (None, "miss")}
    assert sorted(seen) == ["c b a", "d e f"]


def test_four_of_sixteen_lists_find_random_vectors(spark):
    """Vectors without clusters, as in the sample: 0.88 of 51,282 were found with each in its closest list only."""
    rnd = np.random.default_rng(3)
    rows = rnd.normal(size=(12_000, 24))
    asked = rows[:2_000] + np.array([0.0, 0.25, 0.45, 0.8, 2.0])[np.arange(2_000) % 5][:, None] * rnd.normal(size=(2_000, 24))
    kinds = "{} long, team_id string, embedding array<double>"
    cache = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(rows)], kinds.format("id"))
    queries = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(asked)], kinds.format("query_id"))
    path = scratch_path(spark, "index")
    vector_index.create(cache, path, lists=16)
    want, few = found(vector_index.probe(queries, path, None)), found(vector_index.probe(queries, path, 4))
    once = vector_index.blocks_of(spark, path, "bigint")
    again = vector_index.blocks_of(spark, path, "bigint", part="spill")
    assert [b.agg(F.sum(F.size("ids"))).first()[0] for b in (once, again)] == [12_000, 12_000]
    # No vector twice in one list.
    pairs = once.unionByName(again).select("list", F.explode("ids").alias("id"))
    assert pairs.distinct().count() == 24_000
    recall = sum(few[i][0] == want[i][0] for i in want) / len(want)
    only_closest = once.select("list", F.explode("ids").alias("id"))
    homes = {r["id"]: r["list"] for r in only_closest.collect()}
    centres = vector_index.centres_of(spark, path)
    top = np.argsort(-(asked @ centres.T), axis=1)[:, :4]
    before = sum(homes[want[i][0]] in top[i] for i in want) / len(want)
    assert recall >= 0.9 and recall > before + 0.03


def test_routing_holds_one_list_at_a_time():
    import pyarrow as pa

    n, lists, dims = 3_000, 40, 16
    q = np.random.default_rng(1).normal(size=(n, dims))
    teams = [("a", "b", None)[i % 3] for i in range(n)]
    batches = list(vector_index._by_list(pa.array(range(n)), teams, q, np.ones((n, lists), bool)))
    assert len(batches) == lists and max(b.nbytes for b in batches) < 1.3 * q.nbytes
    for at, b in enumerate(batches):
        assert set(b.column(0).to_pylist()) == {at}
        seen = [(t, i) for t, ids in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) for i in ids]
        assert sorted(i for _, i in seen) == list(range(n)) and all(teams[i] == t for t, i in seen)
        assert max(map(len, b.column(2).to_pylist())) <= vector_index.BLOCK
        for ids, blob in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            assert np.array_equal(np.frombuffer(blob).reshape(-1, dims), q[ids])


def test_a_batch_searches_each_vector_once(spark, tmp_path):
    asked = []

    class Watched(CacheStore):
        def similar(self, queries, *rest):
            asked.append(queries.count())
            return super().similar(queries, *rest)

    same_words = [("t", "c b a", 200), ("t", "a b c", 200), ("t", "b c a", 200)]
    files = _batches(spark, str(tmp_path / "in"), [same_words[:1], [*same_words[1:], ("t", "d", 200)]])
    store = cache_fill.fill(files, Watched(spark, scratch_path(spark, "cache")), scratch_path(spark, "state"))
    assert asked == [1, 2]
    assert {k: v[3] for k, v in _filled(store).items()} == {("t", "c b a"): 2, ("t", "d"): 0}


def test_prompts_of_teams_without_entries_are_not_embedded(spark):
    cache = embedding.embed(spark.createDataFrame([("a b c",)], "text string").withColumn("text_hash", F.sha2("text", 256)))
    cache = cache.select(F.col("text_hash").alias("id"), F.lit("t").alias("team_id"), F.col("text_hash").alias("prompt_hash"), "embedding", F.lit("m").alias("model_used"))
    path = scratch_path(spark, "index")
    vector_index.create(cache, path, places=1)
    # Searched exactly only: nothing is stored for searches of a few lists.
    assert vector_index.blocks_of(spark, path, "string", part="spill").count() == 0
    asked = [(0, "t", "c b a"), (1, "t", "x"), (2, "u", "c b a"), (3, "u", "y"), (4, "t", "a b c")]
    asked = spark.createDataFrame(asked, "query_id long, team_id string, prompt_text string")
    seen = []

    def embed(rows):
        seen.extend(r["text"] for r in rows.collect())
        return embedding.embed(rows)

    for index in (path, None):
        seen.clear()
        got = {r["query_id"]: (r["layer"], r["outcome"]) for r in lookup.two_layer(asked, cache, index=index, embed=embed).collect()}
        miss = (None, "miss")
        assert got == {0: ("semantic", "hit"), 1: miss, 2: miss, 3: miss, 4: ("exact_hash", "hit")}
        assert sorted(seen) == ["c b a", "x"]


def test_hashed_words_take_no_step_per_word_but_the_hash(spark):
    """No comparison by a lambda and no list that grows word by word; a missing text gives places without numbers."""
    rows = spark.createDataFrame([("a b " * 20_000 + "c",), (None,)], "text string").select("text", embedding.hashed_words(F.col("text")).alias("v"))
    assert "array_sort" not in _plan(rows) and _plan(rows).count("aggregate(") == 1
    got = {r["text"]: r["v"] for r in rows.collect()}
    assert got.pop(None) == [None] * 64
    (text, vector), = got.items()
    assert np.array_equal(np.array(vector, "float32"), embedding.word_buckets([text]).astype("float32")[0])
