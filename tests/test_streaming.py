"""Streams over several files equal the batch form, also after a restart from the checkpoint."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidloom.operators import lifecycle as C
from evidloom.plans import registry
from evidloom.plans import streaming_queries as Q
from evidloom.session import new_table_path
from evidloom.streaming import flows as W

registry.load_all()

START = dt.datetime(2024, 1, 1)
STATES = ["created", "validating", "parsing", "failed", "created", "completed", "validating", "validating"]


def events(n=240):
    return [(i, i * 7 % 5, START + dt.timedelta(minutes=i), STATES[(i * 3 + i // 11) % len(STATES)], f"key{i % 50}") for i in range(n)]


SCHEMA = "event_id bigint, analysis_id bigint, occurred_at timestamp, status string, idempotency_key string"


def write_files(spark, folder, rows, parts):
    """One file per slice, in the given order of slices."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture()
def folder(spark):
    return new_table_path(spark, "events")


def stream(spark, folder):
    return W.event_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def test_status_changelog_keeps_the_latest_version(spark, folder):
    write_files(spark, folder, events(), 4)
    shaped = lambda df: df.select(
        F.col("analysis_id").alias("aggregate_id"), "occurred_at", "event_id", F.col("status").alias("reason"),
        F.element_at(F.create_map(*[F.lit(x) for x in (
            "created", "document.source.registered", "failed", "document.parsing.failed", "parsing", "document.parsed")]),
            F.col("status")).alias("event_type"), F.lit("a").alias("quality_grade"))
    got = W.collect_to_table(
        W.document_status(shaped(stream(spark, folder)), ["occurred_at", "event_id"]), "status", "update", ["aggregate_id"])
    want = C.document_status(shaped(spark.read.parquet(folder)), ["occurred_at", "event_id"])
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_feed_stops_at_the_first_terminal_event_across_batches_and_restart(spark, folder):
    rows = events()
    path, mark = new_table_path(spark, "feed"), new_table_path(spark, "mark")
    shaped = lambda: stream(spark, folder).select("analysis_id", F.col("event_id").alias("sequence"), "event_id", "status")
    write_files(spark, folder, rows[:120], 3)
    W.feed(shaped(), ["failed", "completed"], path, mark)
    write_files(spark, folder, rows[120:], 3)
    W.feed(shaped(), ["failed", "completed"], path, mark)
    got = {r.event_id for r in W.read_feed(spark, path, shaped().schema).collect()}
    want, ended = set(), set()
    for event_id, analysis, _, status, _ in rows:
        if analysis not in ended:
            want.add(event_id)
            if status in ("failed", "completed"):
                ended.add(analysis)
    assert got == want


def test_feedback_repeats_of_any_age_are_ignored(spark, folder):
    rows = events()
    path, mark = new_table_path(spark, "feedback"), new_table_path(spark, "mark")
    shaped = lambda: stream(spark, folder).select(
        F.col("event_id").alias("feedback_id"), F.lit("w").alias("workspace_id"), "idempotency_key",
        F.col("occurred_at").alias("created_at"), F.lit("source_evidence").alias("category"))
    write_files(spark, folder, rows[:100], 2)
    W.feedback_intake(shaped(), path, mark)
    write_files(spark, folder, rows[100:], 2)
    W.feedback_intake(shaped(), path, mark)
    schema = shaped().withColumn("priority_score", F.lit(0.0)).schema
    got = W.read_batches(spark, path, schema).collect()
    assert sorted(r.feedback_id for r in got) == list(range(50))
    assert {r.priority_score for r in got} == {90.0}


def test_deduplication_inside_the_horizon(spark, folder):
    rows = events(60)
    write_files(spark, folder, [r for r in rows for _ in (1, 2)], 3)
    got = W.collect_to_table(W.deduplicate(stream(spark, folder), "occurred_at", ["event_id"]), "dedup")
    assert sorted(r.event_id for r in got.select("event_id").collect()) == list(range(60))


def test_lifecycle_machine_accepts_files_out_of_order_within_the_lateness(spark, folder):
    rows = events()
    # neighbouring events swap files, by less than the allowed lateness
    swapped = [rows[i ^ 3] for i in range(len(rows))]
    write_files(spark, folder, swapped, 6)
    shaped = stream(spark, folder).select("event_id", "analysis_id", "occurred_at", "status")
    got = {(r.event_id, r.previous, r.outcome) for r in W.collect_to_table(W.lifecycle(shaped), "life").collect()}
    batch = C.transition_check(spark.read.parquet(folder), "analysis_id", ["occurred_at", "event_id"])
    limit = rows[-1][2] - dt.timedelta(minutes=10)
    want = {(r.event_id, r.previous, r.outcome) for r in batch.collect() if r.occurred_at <= limit}
    assert got == want


def test_stage_ledger_equals_batch(spark, folder):
    write_files(spark, folder, events(), 5)
    shaped = lambda df: df.select(
        F.col("analysis_id").alias("run"), F.col("status").alias("stage"), F.col("idempotency_key").alias("fingerprint"),
        "status", "occurred_at", "event_id")
    keys = ["run", "stage", "fingerprint"]
    got = W.collect_to_table(W.stage_ledger(shaped(stream(spark, folder))), "ledger", "update", keys)
    want = C.stage_attempts(shaped(spark.read.parquet(folder)), *keys, ["occurred_at", "event_id"])
    assert sorted(got.select(*keys, "status", "events").collect()) == sorted(want.select(*keys, "status", "events").collect())


def test_feed_is_the_same_for_any_order_of_files(spark):
    """Sequences 1 and 3 come first, the terminal 2 later: 3 is withdrawn."""
    parts = [[(1, 1, "created"), (1, 3, "parsing"), (2, 5, "completed"), (2, 1, "created")],
             [(1, 2, "failed"), (2, 9, "parsing"), (3, 1, "created")],
             [(1, 4, "completed"), (2, 4, "failed"), (2, 3, "parsing"), (3, 2, "validating")]]
    found, gone = set(), {}
    for turn in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        folder, path, mark = (new_table_path(spark, n) for n in ("events", "feed", "mark"))
        for n in turn:
            spark.createDataFrame([(s * 10 + a, a, START, status, str(s)) for a, s, status in parts[n]], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        rows = stream(spark, folder).select("analysis_id", F.col("idempotency_key").cast("int").alias("sequence"), "status")
        W.feed(rows, ["failed", "completed"], path, mark)
        found.add(tuple(sorted((r.analysis_id, r.sequence) for r in W.read_feed(spark, path, rows.schema).collect())))
        gone[tuple(turn)] = sorted((r.analysis_id, r.sequence) for r in W.read_batches(spark, f"{path}-withdrawn", rows.schema).collect())
    assert found == {((1, 1), (1, 2), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2))}
    assert gone[0, 1, 2] == [(1, 3), (2, 5)]


def test_finished_analyses_leave_the_state(spark, folder):
    """Ten files, each with new analyses that end: state rows stay level; a row behind the watermark is counted."""
    for n in range(10):
        at = START + dt.timedelta(hours=n)
        rows = [(100 * n + 2 * i + k, 50 * n + i, at + dt.timedelta(minutes=i % 5, seconds=k), ("created", "cancelled")[k], "")
                for i in range(20) for k in (0, 1)]
        if n == 9:
            rows.append((5000, 7, START, "created", ""))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    shaped = stream(spark, folder).select("event_id", "analysis_id", "occurred_at", "status")
    path, mark = new_table_path(spark, "life"), new_table_path(spark, "mark")
    query = W.run(W.lifecycle(shaped, keep_ms=60_000), W.append_batches(path), mark)
    held = [n for n in W.state_rows(query) if n]
    assert len(held) >= 9 and max(held[5:]) <= max(held[:4])
    assert sum(W.dropped_rows(query)) == 1
    got = W.read_batches(spark, path, W.lifecycle(shaped).schema)
    assert {(r.outcome, r.previous) for r in got.collect()} == {("start", None), ("accepted", "created")}


def test_feedback_keeps_one_small_row_a_key(spark, folder):
    rows = events(400)
    path, mark = new_table_path(spark, "feedback"), new_table_path(spark, "mark")
    shaped = lambda: stream(spark, folder).select(
        F.col("event_id").alias("feedback_id"), F.lit("w").alias("workspace_id"), "idempotency_key",
        F.col("occurred_at").alias("created_at"), F.lit("other").alias("category"))
    sizes = []
    for part in range(4):
        write_files(spark, folder, rows[part * 100:part * 100 + 100], 1)
        W.feedback_intake(shaped(), path, mark)
        sizes.append(W.read_batches(spark, path, shaped().withColumn("priority_score", F.lit(0.0)).schema).count())
    assert sizes == [50, 50, 50, 50]


def test_lifecycle_query_gives_out_every_event(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = registry.spark_callable("e5_lifecycle_machine")(spark, sf_dir)
    assert sorted(r.event_id for r in got.select("event_id").collect()) == sorted(
        r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())


@pytest.mark.parametrize("minutes", [1, 0])
def test_event_files_are_dealt_over_equal_batches_in_order_of_time(spark, monkeypatch, minutes):
    """Many files a micro-batch; equal times leave slices empty, and batches must not reach into each other."""
    monkeypatch.setattr(Q, "ROWS_PER_FILE", 10)
    sf_dir = new_table_path(spark, "tables")
    rows = [(i, START + dt.timedelta(minutes=minutes * i), i % 5, "view", 1.0, "{}") for i in range(240)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(
        f"{sf_dir}/events.parquet")
    v, seen = registry.Inputs(spark, sf_dir), []
    source = Q.event_files(v)
    W.run(source.select("*", F.col("_metadata.file_path").alias("file")), lambda batch, _: seen.append(batch.collect()),
          new_table_path(spark, "mark"))
    assert sorted(r.event_id for part in seen for r in part) == list(range(240))
    files = [len({r.file for r in part}) for part in seen if part]
    assert min(files) > 1
    ends = [(min(r.ts for r in part), max(r.ts for r in part)) for part in seen if part]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert len(spark.read.parquet(v.event_folder).inputFiles()) == Q.BATCHES * v.event_parts
