import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from usagelens.operators import alerts, costs, metrics, ratelimit, replay, reports
from usagelens.schemas import USAGE_LOG
from usagelens.session import conf, scratch_path
from usagelens.sources import usage_log as U
from usagelens.streaming import run, stateful, usage as SU

START = datetime(2024, 1, 1)


def requests(spark, seconds, teams=("a",), prompts=("p",)):
    rnd = random.Random(1)
    rows = [
        (i, rnd.choice(teams), rnd.choice(prompts), START + timedelta(seconds=s))
        for i, s in enumerate(seconds)
    ]
    return rows, spark.createDataFrame(
        rows, "event_id long, team_id string, prompt_text string, created_at timestamp"
    ).repartition(5)


def bucket_by_hand(rows, rate, burst):
    state, out = {}, {}
    for i, team, _, at in sorted(rows, key=lambda r: (r[3], r[0])):
        b = state.setdefault(team, ratelimit.Bucket(rate, burst))
        out[i] = b.allow(round((at - START).total_seconds() * 1e6) + 10**12)
    return out


@pytest.mark.parametrize("slice_seconds", [3, 60, 100000])
def test_rate_limit_is_the_same_however_it_is_cut(spark, slice_seconds):
    rnd, t, seconds = random.Random(2), 0.0, []
    for _ in range(800):
        t += rnd.choice([0.0, 0.05, 0.2, 1.0, 6.0])
        seconds.append(t)
    rows, df = requests(spark, seconds, teams=("a", "a", "a", "b"))
    got = {r["event_id"]: r["allowed"] for r in ratelimit.decide(df, 2.0, 5, slice_seconds=slice_seconds).collect()}
    want = bucket_by_hand(rows, 2.0, 5)
    assert got == want and len(set(want.values())) == 2


def test_steady_light_traffic_is_cut_into_pieces(spark):
    # Never a pause long enough to fill the bucket, yet it is full most of the time.
    rows, df = requests(spark, [i * 0.9 for i in range(300)])
    with conf(spark, spark__sql__adaptive__enabled="false"):
        out = ratelimit.decide(df, 2.0, 5, slice_seconds=20).withColumn("part", F.spark_partition_id())
        got = out.collect()
    assert {r["event_id"]: r["allowed"] for r in got} == bucket_by_hand(rows, 2.0, 5)
    assert len({r["part"] for r in got}) > 1


def test_rate_limit_values():
    with pytest.raises(ValueError):
        ratelimit.check_limits(0, 20)
    with pytest.raises(ValueError):
        ratelimit.check_limits(100, 0)
    ratelimit.check_limits(ratelimit.RATE, ratelimit.BURST)


def test_token_bucket_stream_matches_batch(spark, tmp_path):
    seconds = [i * 0.1 for i in range(200)]
    rows, df = requests(spark, seconds, teams=("a", "b"))
    for part in range(2):
        half = [r for r in rows if (r[0] >= 100) == bool(part)]
        spark.createDataFrame(half, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = run.file_stream(spark, str(tmp_path), df.schema, files_per_trigger=1)
    got = {r["event_id"]: r["allowed"] for r in run.drain(stateful.rate_limited(stream, 2.0, 5)).collect()}
    assert got == bucket_by_hand(rows, 2.0, 5)


def replay_by_hand(rows, ttl):
    last, sets = {}, {}
    for _, team, prompt, at in sorted(rows, key=lambda r: r[3]):
        k = team, prompt
        if k not in last or at >= last[k] + timedelta(seconds=ttl):
            last[k] = at
            sets[k] = sets.get(k, 0) + 1
    return sets


def test_replay_equals_a_fold(spark):
    rnd, t, seconds = random.Random(4), 0.0, []
    for _ in range(400):
        t += rnd.choice([1, 5, 30, 200])
        seconds.append(t)
    # One prompt takes most of the requests.
    rows, df = requests(spark, seconds, teams=("a", "b"), prompts=("hot", "hot", "hot", "x", "y"))
    keyed = df.withColumn("prompt_hash", F.col("prompt_text"))
    got = {
        (r["team_id"], r["prompt_hash"]): r["n"]
        for r in replay.settings(keyed, 3600)
        .groupBy("team_id", "prompt_hash")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    assert got == replay_by_hand(rows, 3600)


def test_replay_of_a_dense_prompt_takes_one_pass(spark):
    # One prompt with 60,000 moments in each slice; a frame that shrinks would compare each with all that follow.
    moments = spark.range(180_000).select(
        F.lit("t").alias("team_id"), F.lit("hot").alias("prompt_hash"), F.timestamp_millis(F.col("id") * 60).alias("created_at")
    )
    times = moments.select("team_id", "prompt_hash", F.unix_micros("created_at").alias("_us"))
    followers = replay._followers(times, 3_600_000_000, replay.KEY)
    assert "unboundedfollowing" not in followers._jdf.queryExecution().executedPlan().toString().lower()
    assert followers.filter("next = _us + 3600000000").count() == 120_000
    assert sorted(r["_set"] for r in replay.settings(moments, 3600).collect()) == [0, 3_600_000_000, 7_200_000_000]


def log(spark, rows):
    """rows: (seconds, team, model, latency, hit)."""
    full = [
        (i, START + timedelta(seconds=s), team, "f", model, "openai", 1, 1, None, lat, hit, "simple")
        for i, (s, team, model, lat, hit) in enumerate(rows)
    ]
    df = spark.createDataFrame(full, USAGE_LOG)
    return df.withColumn("cost_usd", F.lit("0.5").cast("decimal(10,8)"))


def test_empty_log(spark):
    empty = log(spark, [(0, "t", "m", 1, True)]).filter("id < 0")
    assert costs.total(empty).first()["cost_usd"] == 0
    assert costs.savings(empty).first()["savings_usd"] == 0
    assert reports.hit_rate(empty).first()["cache_hit_rate"] is None
    assert costs.breakdown(empty, "model").count() == 0
    assert costs.summary(empty, 7).count() == 0


def test_breakdown_of_an_unknown_group_is_empty(spark):
    assert costs.breakdown(log(spark, [(0, "t", "m", 1, True)]), "colour").count() == 0


def test_projection_over_no_days_is_zero(spark):
    rows = costs.summary(log(spark, [(0, "t", "m", 1, True)]), 0)
    assert rows.filter("section = 'total'").first()["projected_monthly_usd"] == 0


def test_percentiles_interpolate(spark):
    df = log(spark, [(i, "t", "m", v, False) for i, v in enumerate([10, 20, 30, 40])])
    row = reports.latency_percentiles(df).first()
    assert row["p50_ms"] == 25 and row["p95_ms"] == pytest.approx(38.5)


def test_every_class_is_listed(spark):
    out = reports.complexity_distribution(log(spark, [(0, "t", "m", 1, True)])).collect()
    assert {r["complexity"]: r["pct"] for r in out} == {"simple": 100.0, "medium": 0.0, "complex": 0.0}


def test_histogram_quantile(spark):
    df = log(spark, [(i, "t", "m", v, False) for i, v in enumerate([60, 70, 80, 90])])
    labels = ["model_used", "cache_hit", "complexity"]
    q = metrics.histogram_quantile(metrics.request_latency(df), 0.5, labels).first()["quantile"]
    assert q == 75.0
    slow = log(spark, [(0, "t", "m", 20000, False)])
    assert metrics.histogram_quantile(metrics.request_latency(slow), 0.99, labels).first()["quantile"] == 10000.0


def test_low_hit_rate_holds_over_silence(spark):
    # A breach at 0 s, then nothing until a good minute at 900 s.
    df = log(spark, [(0, "t", "m", 1, False), (900, "t", "m", 1, True)])
    (row,) = alerts.low_hit_rate(df).collect()
    assert (row["ended_at"] - row["started_at"]).total_seconds() == 900
    assert alerts.low_hit_rate(df, hold=901).count() == 0


def test_error_rate_needs_consecutive_steps(spark):
    def errors(seconds):
        rows = [("provider_forward", START + timedelta(seconds=s)) for s in seconds]
        return spark.createDataFrame(rows, "error_type string, created_at timestamp")

    assert alerts.high_error_rate(errors(range(0, 300, 20))).count() == 1
    assert alerts.high_error_rate(errors([0, 1])).count() == 0


def test_rolling_counts_every_window(spark):
    df = log(spark, [(0, "t", "m", 1, True), (12, "t", "m", 1, False)])
    out = {(r["window_start"] - START).total_seconds(): (r["hits"], r["lookups"]) for r in alerts.rolling_hit_rate(df).collect()}
    assert out == {-20: (1, 1), -10: (1, 2), 0: (1, 2), 10: (0, 1)}


def test_daily_cost_stream_holds_open_days_back(spark, tmp_path):
    df = log(spark, [(0, "t", "m", 1, True), (86400, "t", "m", 1, True), (3 * 86400, "t", "m", 1, True)])
    df.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = run.file_stream(spark, str(tmp_path), df.schema)
    days = [r["day"].day for r in run.drain(SU.daily_cost(stream)).collect()]
    assert sorted(days) == [1, 2]
    assert run.drain(SU.daily_cost(stream), "complete").count() == 3


def test_append_twice_adds_once(spark, tmp_path):
    df = log(spark, [(0, "t", "m", 1, True), (5, "t", "m", -1, True)])
    df.coalesce(1).write.mode("append").parquet(str(tmp_path))
    out, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    for _ in range(2):
        SU.append_usage(run.file_stream(spark, str(tmp_path), df.schema), out, state).awaitTermination()
    assert U.read_usage_log(spark, out).count() == 1


def test_written_log_is_pruned_by_day(spark):
    path = scratch_path(spark, "log")
    U.write_usage_log(log(spark, [(d * 86400, "t", "m", 1, True) for d in range(5)]), path)
    kept = U.scan(U.read_usage_log(spark, path), "t", START + timedelta(days=3))
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan


def test_late_rows_are_counted(spark, tmp_path):
    source = tmp_path / "in"
    for day in (10, 20, 0):
        log(spark, [(day * 86400, "t", "m", 1, True)]).coalesce(1).write.mode("append").parquet(str(source))
    stream = run.file_stream(spark, str(source), USAGE_LOG, files_per_trigger=1)
    query = (
        SU.daily_cost(stream)
        .writeStream.foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save())
        .option("checkpointLocation", scratch_path(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert SU.dropped_late(query) == 1


def test_late_rows_outlive_the_progress_kept(spark):
    class Progress:
        def __init__(self, batch, dropped):
            self.runId, self.batchId, self.stateOperators = "r", batch, [type("O", (), {"numRowsDroppedByWatermark": dropped})]

    late = SU.LateRows()
    for batch in range(5):
        late.onQueryProgress(type("E", (), {"progress": Progress(batch, 1)}))
    query = type("Q", (), {"recentProgress": [Progress(4, 1)], "runId": "r"})
    assert SU.dropped_late(query, late) == 5 and SU.dropped_late(query) == 1


def test_drain_goes_on_where_it_stopped(spark, tmp_path):
    source = str(tmp_path / "in")
    log(spark, [(0, "t", "m", 1, True), (5, "t", "m", 1, False)]).write.parquet(source)
    stream = run.file_stream(spark, source, USAGE_LOG).select("id", "team_id")
    places = {"checkpoint": str(tmp_path / "state"), "out": str(tmp_path / "out")}
    assert run.drain(stream, **places).count() == 2
    assert run.drain(stream, **places).count() == 2


def test_day_filter_in_any_zone(spark, tmp_path):
    rows = log(spark, [(23 * 3600 + 1800, "t", "m", 1, True)])
    U.write_usage_log(rows, str(tmp_path / "log"))
    since = START.replace(tzinfo=timezone(timedelta(hours=9))) + timedelta(hours=32)
    for df in (rows, U.read_usage_log(spark, str(tmp_path / "log"))):
        assert U.scan(df, since=since).count() == 1


def test_expiring_cache_stream(spark, tmp_path):
    rows, df = requests(spark, [0, 10, 3600, 3700, 9000])
    df.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = run.file_stream(spark, str(tmp_path), df.schema)
    got = {r["event_id"]: r["kind"] for r in run.drain(stateful.expiring_cache(stream, 3600)).collect()}
    assert got == {0: "set", 1: "hit", 2: "renewed", 3: "hit", 4: "renewed"}


def test_expiry_by_batch_equals_the_keyed_state(spark, tmp_path):
    # Rows of later batches may be older than their entry; some moments and a key are shared, some keys are null.
    rnd, rows = random.Random(8), []
    for i in range(90):
        at = START + timedelta(seconds=(i // 30) * 9000 + rnd.randrange(0, 14000, 200))
        rows.append((i, rnd.choice(["a", "b", None]), rnd.choice(["hot", "hot", "x", None]), at))
    kinds = "event_id long, team_id string, prompt_text string, created_at timestamp"
    for b in range(3):
        spark.createDataFrame(rows[b * 30 : b * 30 + 30], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = stateful.expired_by_batch(
        run.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kinds).schema, files_per_trigger=1), ttl_seconds=3600
    )
    last, want = {}, {}
    for b in range(3):
        for i, team, prompt, at in sorted(rows[b * 30 : b * 30 + 30], key=lambda r: (r[3], r[0])):
            k = team, prompt
            if k not in last or at >= last[k] + timedelta(seconds=3600):
                want[i] = "renewed" if k in last else "set"
                last[k] = at
            else:
                want[i] = "hit"
    assert {r["event_id"]: r["kind"] for r in got.collect()} == want
