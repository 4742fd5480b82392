"""Streams over several micro-batches: what is emitted, what state is left, what comes too late."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from usagelens.session import scratch_path
from usagelens.streaming import run, usage as SU

START = datetime(2024, 1, 1)


def usage(spark, rows):
    """Usage rows from (id, team, hours after the start, cache hit)."""
    full = [
        (i, START + timedelta(hours=h), team, "chat", "m", "p", 1, 1, Decimal("0.5"), 10, hit, "simple")
        for i, team, h, hit in rows
    ]
    return spark.createDataFrame(full, "id long, created_at timestamp, team_id string, feature_tag string, model_used string, provider string, input_tokens int, output_tokens int, cost_usd decimal(10,8), latency_ms int, cache_hit boolean, complexity string")


def files(spark, folder, batches):
    for rows in batches:
        usage(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    return run.file_stream(spark, folder, usage(spark, []).schema, files_per_trigger=1)


# Five batches of two days each; every hour a row of one of two teams.
BATCHES = [[(b * 48 + h, f"t{h % 2}", b * 48 + h, h % 3 == 0) for h in range(48)] for b in range(5)]


def progress(spark, stream):
    query = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p for p in query.recentProgress if p.stateOperators]


@pytest.mark.parametrize("make, span", [(SU.daily_cost, 24.0), (lambda e: SU.rolling_hit_rate(e, "2 hours", "1 hour"), 2.0)])
def test_windows_are_emitted_once_and_leave_the_state(spark, tmp_path, make, span):
    stream = make(files(spark, str(tmp_path / "in"), BATCHES))
    seen = progress(spark, stream)
    assert len(seen) >= len(BATCHES)
    # State holds the windows of one batch and those still open before it, however many batches came; in the end the open ones.
    held = [p.stateOperators[0].numRowsTotal for p in seen]
    assert max(held) <= min(held[: len(BATCHES)]) + 8 and held[-1] <= 6
    out = run.drain(stream)
    keys = [c for c in out.columns if c in ("team_id", "day", "window_start")]
    assert out.groupBy(*keys).count().filter("count > 1").count() == 0
    if span == 24.0:
        days = {(r["team_id"], r["day"]): r["requests"] for r in out.collect()}
        # The last day is open until a row comes an hour after its end.
        assert days == {(t, START + timedelta(days=d)): 12 for t in ("t0", "t1") for d in range(9)}


def test_late_rows_are_told_apart_by_batch(spark, tmp_path):
    batches = [
        [(1, "t", 0, True), (2, "t", 10, True)],
        [(3, "t", 9, True), (4, "t", 9.5, True), (5, "u", 8, True), (6, "t", 20, True)],
        [(7, "t", 18.9, True), (8, "t", 19, True), (9, "u", 1, True)],
        [],
        [(10, "t", 30, True), (11, "t", 2, True)],
    ]
    stream = files(spark, str(tmp_path / "in"), batches)
    out, state = scratch_path(spark, "parted"), scratch_path(spark, "state")
    rows, late = SU.part_late(stream, out, state)
    # Nine hours are just in time an hour after ten; the newest row of a batch bounds the batches after it.
    assert {(r["id"], r["batch_id"]) for r in late.collect()} == {(5, 1), (7, 2), (9, 2), (11, 4)}
    assert {r["id"] for r in rows.collect()} == {1, 2, 3, 4, 6, 8, 10}
    again, late = SU.part_late(stream, out, state)
    assert again.count() == 7 and late.count() == 4


def test_a_late_batch_tried_again_decides_as_before(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), [[(1, "t", 5, True)], [(2, "t", 3, True), (3, "t", 9, True)]])
    kept = SU.each_batch

    def twice(stream, work, checkpoint):
        kept(stream, lambda batch, n: [work(batch, n) for _ in range(2)], checkpoint)

    SU.each_batch = twice
    try:
        rows, late = SU.part_late(stream, scratch_path(spark, "parted"), scratch_path(spark, "state"))
    finally:
        SU.each_batch = kept
    assert [r["id"] for r in late.collect()] == [2] and sorted(r["id"] for r in rows.collect()) == [1, 3]
    assert late.agg(F.max("batch_id")).first()[0] == 1


def test_a_table_stream_reads_a_file_and_a_folder(spark, tmp_path):
    import shutil

    usage(spark, [(i, "t", i, True) for i in range(6)]).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    usage(spark, [(7, "t", 1, True)]).coalesce(1).write.parquet(str(tmp_path / "one"))
    shutil.copy(next((tmp_path / "one").glob("part-*")), tmp_path / "single.parquet")
    for name, rows in (("many", 6), ("single", 1)):
        stream = run.table_stream(spark, str(tmp_path / f"{name}.parquet"), usage(spark, []).schema)
        assert run.drain(stream).count() == rows


def test_stream_queries_read_tables_of_many_files(spark, tmp_path):
    from checks.queries import QUERIES

    source = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        spark.read.parquet(f"{source}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_redact", "stream_usage_append"):
        assert QUERIES[name](spark, str(tmp_path)).count() == QUERIES[name](spark, source).count() > 0
