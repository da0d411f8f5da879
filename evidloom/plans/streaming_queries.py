"""Registered streaming queries (E1-E9): each processes the whole event table with availableNow and
returns the table it wrote, which must equal the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.operators import lifecycle as C
from evidloom.operators.skew import number_rows
from evidloom.plans import operations_queries as OQ
from evidloom.plans import views
from evidloom.plans.governance_queries import ROUTED
from evidloom.plans.registry import Inputs, query
from evidloom.session import new_table_path
from evidloom.sources import files as S
from evidloom.streaming import flows as W


BATCHES = 4
ROWS_PER_FILE = 100_000


def event_files(v: Inputs, closed: bool = False) -> DataFrame:
    """The event table as a stream of ``BATCHES`` micro-batches in order of time, each dealt over equally many files.

    The number of files follows the number of rows, so that writing and reading a micro-batch is the work of many
    tasks.  ``closed`` adds a file with one empty event, late enough for the watermark to pass all others.
    """
    if not hasattr(v, "event_folder"):
        v.event_folder = new_table_path(v.spark, "event-files")
        events, ts = v("events"), F.col("ts")
        found = events.agg(F.percentile_approx("ts", [i / BATCHES for i in range(1, BATCHES)]).alias("cuts"),
                           F.count(F.lit(1)).alias("n")).first()
        cuts = found.cuts or []
        v.event_parts = max(1, -(-found.n // (BATCHES * ROWS_PER_FILE)))
        for i in range(len(cuts) + 1):
            rows = events.where(ts > F.lit(cuts[i - 1])) if i else events
            rows = rows.where(ts.isNull() | (ts <= F.lit(cuts[i]))) if i < len(cuts) else rows
            rows.repartition(v.event_parts).write.mode("append").parquet(v.event_folder)
            # a part without rows leaves no file, and a micro-batch must not reach into the next one
            written = len(v.spark.read.schema(events.schema).parquet(v.event_folder).inputFiles())
            for _ in range((i + 1) * v.event_parts - written):
                events.limit(0).coalesce(1).write.mode("append").parquet(v.event_folder)
        if closed and found.n:
            end = F.max("ts") + F.expr(f"INTERVAL {W.LATENESS}") + F.expr("INTERVAL 1 SECOND")
            kinds = {f.name: f.dataType for f in events.schema}
            events.agg(end.alias("ts")).select(*[
                (F.col(c) if c == "ts" else F.lit(None)).cast(kinds[c]).alias(c) for c in events.columns]).coalesce(1).write.mode(
                "append").parquet(v.event_folder)
    return W.event_stream(v.spark, v.event_folder, v("events").schema, files_per_batch=v.event_parts)


def stream_of(v: Inputs, view: str, closed: bool = False) -> DataFrame:
    """A view over ``events`` as a stream of the same columns."""
    source = event_files(v, closed)
    chain = views.needed(views.spark_text(view)) + [view]
    source.createOrReplaceTempView("stream_events")
    for name in chain:
        text = views.spark_text(name).replace("FROM events", "FROM stream_events")
        for done in chain:
            text = text.replace(f"FROM {done}", f"FROM stream_{done}")
        v.spark.sql(text).createOrReplaceTempView(f"stream_{name}")
    return v.spark.table(f"stream_{view}")


def _paths(v: Inputs, *names: str) -> list[str]:
    return [new_table_path(v.spark, n) for n in names]


@query("e1_dead_letters", f"""
SELECT event_id, problem, 'dead' AS sink FROM (SELECT event_id, {OQ.ENVELOPE_PROBLEM} AS problem FROM events) WHERE problem IS NOT NULL
UNION ALL SELECT event_id, problem, 'valid' FROM (SELECT event_id, {OQ.ENVELOPE_PROBLEM} AS problem FROM events) WHERE problem IS NULL""")
def e1(v):
    valid, dead, mark = _paths(v, "valid", "dead", "checkpoint")
    rows = stream_of(v, "v_envelopes").withColumnRenamed("event_id", "source_id")
    checked = S.read_envelopes(rows, "envelope", ["source_id"])
    W.split_envelopes(checked, valid, dead, mark)
    read = lambda p, s: W.read_batches(v.spark, p, checked.schema).select(
        F.col("source_id").alias("event_id"), "problem", F.lit(s).alias("sink"))
    return read(dead, "dead").union(read(valid, "valid"))


@query("e2_stream_routing", ROUTED)
def e2(v):
    return W.collect_to_table(W.route(stream_of(v, "v_outbox")), "routed").select("event_id", "handler", "action")


@query("e3_deduplicated_events", "SELECT event_id, event_type FROM v_outbox")
def e3(v):
    rows = stream_of(v, "v_outbox").select("event_id", "event_type", F.col("occurred_at").cast("timestamp").alias("at"))
    # at-least-once delivery: every event arrives twice
    twice = rows.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    # files come in order of time, so no row is late and the stream alone must give every event once
    return W.collect_to_table(W.deduplicate(twice, "at", ["event_id"]), "deduplicated").select("event_id", "event_type")


@query("e4_continuous_status", OQ.DOC_STATUS)
def e4(v):
    stream = W.document_status(stream_of(v, "v_parse_events"), ["occurred_at", "event_id"])
    return W.collect_to_table(stream, "status", "update", ["aggregate_id"]).select(
        "aggregate_id", "status", "latest_quality_grade", "limitation")


PASSED = "epoch_us(occurred_at) // 1000 <= (SELECT max(epoch_us(occurred_at)) // 1000 FROM v_lifecycle) - 600000"


def _lifecycle(v, closed=False):
    """Rows that the stream gave out: all that its watermark has passed, and with ``closed`` that is every row."""
    rows = stream_of(v, "v_lifecycle", closed).select(
        "event_id", "analysis_id", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "status")
    # the table covers less time than a finished analysis is kept
    return W.collect_to_table(W.lifecycle(rows, keep_ms=3_650 * W.DAY_MS), "lifecycle")


@query("e5_lifecycle_machine", f"""
SELECT event_id, analysis_id, status, previous, outcome FROM ({OQ.TRANSITIONS.strip()})""")
def e5(v):
    return _lifecycle(v, closed=True)


@query("e5_rows_left_to_recovery", f"""
SELECT event_id, outcome FROM ({OQ.TRANSITIONS.strip()}) JOIN v_lifecycle l USING (event_id) WHERE NOT {PASSED}""")
def e5_rest(v):
    batch = C.transition_check(v("v_lifecycle"), "analysis_id", ["occurred_at", "event_id"])
    return W.not_emitted(_lifecycle(v), batch, ["event_id"]).select("event_id", "outcome")


@query("e6_stage_ledger", OQ.ATTEMPTS)
def e6(v):
    ledger = W.collect_to_table(W.stage_ledger(OQ.attempt_events(Streamed(v))), "ledger", "update",
                                ["run", "stage", "fingerprint"])
    return number_rows(ledger, ["run", "stage"], ["first_seen", "fingerprint"], F.to_date("first_seen"), "attempt").select(
        "run", "stage", "fingerprint", "status", "events", F.col("attempt").cast("bigint").alias("attempt"))


class Streamed:
    """Inputs whose views are streams, for builders shared with the batch form."""

    def __init__(self, inputs: Inputs) -> None:
        self.inputs = inputs

    def __call__(self, view: str) -> DataFrame:
        return stream_of(self.inputs, view)


@query("e7_alert_windows", OQ.ALERTS_OUT)
def e7(v):
    rows = event_files(v).select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    counts = W.collect_to_table(W.alert_counts(rows, OQ.alert_counts), "alerts", "update", ["start"])
    return C.alert_windows(counts).select(
        F.unix_seconds("start").alias("start_s"), "created", "failed", "failure_rate_high", "quote_failures_high", "stalled")


@query("e8_analysis_feed", """
SELECT analysis_id, event_id FROM (SELECT *, coalesce(sum((status = 'failed')::INT) OVER (PARTITION BY analysis_id ORDER BY occurred_at, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM v_lifecycle) WHERE ended = 0""")
def e8(v):
    path, mark = _paths(v, "feed", "checkpoint")
    rows = stream_of(v, "v_lifecycle").select(
        "analysis_id", F.struct("occurred_at", "event_id").alias("sequence"), "event_id", "status")
    W.feed(rows, ["failed"], path, mark)
    return W.read_feed(v.spark, path, rows.schema).select("analysis_id", "event_id")


@query("e9_feedback_intake", """
SELECT feedback_id, CASE WHEN category IN ('source_evidence', 'reference_resolution') THEN 90.0 ELSE 50.0 END::DOUBLE AS priority_score
FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key ORDER BY created_at, feedback_id) AS rn FROM v_feedback) WHERE rn = 1""")
def e9(v):
    path, mark = _paths(v, "feedback", "checkpoint")
    rows = stream_of(v, "v_feedback")
    W.feedback_intake(rows, path, mark)
    schema = rows.withColumn("priority_score", F.lit(0.0)).schema
    return W.read_batches(v.spark, path, schema).select("feedback_id", "priority_score")
