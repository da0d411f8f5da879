"""Structured Streaming forms of the event operators.

Every flow reads an append-only event folder, keeps bounded state (a watermark, or one row per
live key) and writes per-batch folders ``batch_id=N``.  A repeated batch overwrites its own folder,
so a restart from the checkpoint leaves the same table.  Nothing is kept on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from evidloom import vocab
from evidloom.operators import governance as G
from evidloom.operators import lifecycle as C
from evidloom.session import new_table_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 minutes"
DAY_MS = 86_400_000
FEED_PARTS = 64


def event_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``files_per_batch`` bounds a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
        mode: str = "append"):
    """Process everything that is available, then stop; the finished query, with the progress of its batches."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def dropped_rows(query) -> list[int]:
    """Rows that came too late for the watermark, for each finished micro-batch of a query with state."""
    return [sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]


def state_rows(query) -> list[int]:
    """Rows held in state after each finished micro-batch."""
    return [sum(int(s.get("numRowsTotal", 0)) for s in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def read_batches(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows of all finished batches; ``before`` prunes to earlier ones."""
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    rows = spark.read.schema(full).parquet(path)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version per key of a table written in update mode."""
    values = [c for c in rows.columns if c not in keys + ["batch_id"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("v")).select(*keys, "v.*")


def collect_to_table(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a flow into a new table of the shared folder and read it back."""
    spark = stream.sparkSession
    path, checkpoint = new_table_path(spark, name), new_table_path(spark, f"{name}-checkpoint")
    run(stream, append_batches(path), checkpoint, mode)
    rows = read_batches(spark, path, stream.schema)
    return latest(rows, keys) if keys else rows.drop("batch_id")


def not_emitted(streamed: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch form that a flow has not emitted: too late, or not yet passed by the watermark."""
    return batch.join(streamed.select(*keys), keys, "left_anti")


def recover(streamed: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The flow's rows completed by the batch form, so that late and last rows are not lost."""
    return streamed.unionByName(not_emitted(streamed, batch, keys).dropDuplicates(keys))


def split_envelopes(checked: DataFrame, valid_path: str, dead_path: str, checkpoint: str) -> None:
    """Valid envelopes to one table, the others with their problem to a dead-letter table."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        rows.where("problem IS NULL").write.mode("overwrite").parquet(batch_folder(valid_path, batch_id))
        rows.where("problem IS NOT NULL").write.mode("overwrite").parquet(batch_folder(dead_path, batch_id))
        rows.unpersist()

    run(checked, write, checkpoint)


def route(stream: DataFrame) -> DataFrame:
    """Stream joined with the fixed route table."""
    return G.route_events(stream)


def deduplicate(stream: DataFrame, time: str, keys: list[str], horizon: str = LATENESS) -> DataFrame:
    """Drop repeats of a key inside the horizon; state is dropped when the watermark passes."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def document_status(stream: DataFrame, order: list[str]) -> DataFrame:
    """W7 kept up to date; update mode, one state row per aggregate."""
    return C.status_columns(stream.groupBy("aggregate_id").agg(*C.status_aggregates(order)))


def stage_ledger(stream: DataFrame) -> DataFrame:
    """W11's attempts per (run, stage, fingerprint); update mode."""
    at = F.struct("occurred_at", "event_id")
    return stream.groupBy("run", "stage", "fingerprint").agg(
        F.min("occurred_at").alias("first_seen"), F.max_by("status", at).alias("status"),
        F.count(F.lit(1)).alias("events"))


class LifecycleProcessor(StatefulProcessor):
    """E5: recorded states of one analysis in event-time order.

    Rows wait in state until the watermark passes them, so files may arrive out of order.  New rows are appended to the
    wait list; it holds what arrived within the lateness, and one micro-batch at most.  ``keep_ms`` after its
    last move a finished analysis leaves the state; what comes still later starts anew.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at_ms bigint")
        self.waiting = handle.getListState("waiting", "event_id bigint, at_us bigint, status string")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def _wake(self, at_ms: int | None) -> None:
        """One timer at most: at the earliest waiting row, or at the end of a finished analysis."""
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if set_for == at_ms:
            return
        if set_for is not None:
            self.handle.deleteTimer(set_for)
        if at_ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at_ms)
            self.timer.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.event_id, r.at_us, r.status) for r in rows]
        first = min(r[1] for r in new) // 1000
        if self.waiting.exists():
            first = min(first, self.timer.get()[0])
        self.waiting.appendList(new)
        self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if not held:
            self.last.clear()
            return iter([])
        ready = sorted((r for r in held if r[1] // 1000 <= passed), key=lambda r: (r[1], r[0]))
        rest = [r for r in held if r[1] // 1000 > passed]
        previous, at_ms = self.last.get() if self.last.exists() else (None, 0)
        edges = set(vocab.STATE_EDGES)
        out = []
        for event_id, at_us, status in ready:
            if previous is None:
                outcome = "start"
            elif previous == status:
                outcome = "same"
            else:
                outcome = "accepted" if (previous, status) in edges else "invalid"
            out.append(Row(event_id=event_id, analysis_id=key[0], status=status, previous=previous, outcome=outcome))
            at_ms = at_us // 1000
            if outcome != "invalid":
                previous = status
        if previous is not None:
            self.last.update((previous, at_ms))
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[1] for r in rest) // 1000)
        else:
            self.waiting.clear()
            if previous is not None and not vocab.STATE_MOVES.get(previous):
                self._wake(at_ms + self.keep_ms)
        return iter(out)

    def close(self) -> None:
        pass


def lifecycle(stream: DataFrame, lateness: str = LATENESS, keep_ms: int = 30 * DAY_MS) -> DataFrame:
    """E5 on (event_id, analysis_id, occurred_at TIMESTAMP, status)."""
    rows = stream.withWatermark("occurred_at", lateness).withColumn("at_us", F.unix_micros("occurred_at"))
    return rows.groupBy("analysis_id").transformWithState(
        LifecycleProcessor(keep_ms),
        "event_id bigint, analysis_id bigint, status string, previous string, outcome string",
        "Append", "eventTime")


def alert_counts(stream: DataFrame, counts: Callable[[DataFrame], DataFrame], lateness: str = LATENESS) -> DataFrame:
    """Counts of sliding windows; rules are applied to the resulting table."""
    return counts(stream.withWatermark("at", lateness))


def feed(stream: DataFrame, terminal: list[str], path: str, checkpoint: str) -> None:
    """Events per analysis up to and with its first terminal one, whatever order the files come in.

    ``stream`` carries analysis_id, sequence, status.  Each batch notes the terminal sequences that it has
    seen in a narrow table beside the feed.  An event comes out when it lies at or before the first terminal one known by
    then; when an earlier terminal one arrives, events beyond it that are out already are withdrawn: they are
    written to ``path-withdrawn``, and :func:`read_feed` leaves them out.  The feed is parted by a hash of the analysis,
    so a withdrawal reads only the parts of the analyses concerned.
    """
    ended_path, withdrawn_path = f"{path}-ended", f"{path}-withdrawn"
    noted = stream.select("analysis_id", F.col("sequence").alias("stop")).schema
    fed = StructType([*stream.schema.fields, StructField("part", LongType())])
    part = F.pmod(F.xxhash64("analysis_id"), F.lit(FEED_PARTS)).alias("part")

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows.persist()
        now = rows.where(F.col("status").isin(*terminal)).groupBy("analysis_id").agg(F.min("sequence").alias("stop"))
        now.write.mode("overwrite").parquet(batch_folder(ended_path, batch_id))
        stops = lambda before: read_batches(spark, ended_path, noted, before).groupBy("analysis_id").agg(
            F.min("stop").alias("stop"))
        stop = stops(batch_id + 1)
        out = rows.join(stop, "analysis_id", "left").where("stop IS NULL OR sequence <= stop").drop("stop")
        out.select("*", part).write.mode("overwrite").partitionBy("part").parquet(batch_folder(path, batch_id))
        if batch_id > 0:
            ended = now.join(stops(batch_id).withColumnRenamed("stop", "before"), "analysis_id", "left").where(
                "before IS NULL OR stop < before").select("analysis_id", "stop", "before", part)
            parts = [r.part for r in ended.select("part").distinct().collect()]
            earlier = read_batches(spark, path, fed, batch_id).where(F.col("part").isin(parts))
            # what lay beyond an earlier stop is out of the feed already
            gone = earlier.join(ended.drop("part"), "analysis_id").where(
                "sequence > stop AND (before IS NULL OR sequence <= before)")
            gone.select(stream.columns).write.mode("overwrite").parquet(batch_folder(withdrawn_path, batch_id))
        rows.unpersist()

    run(stream, write, checkpoint)


def read_feed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The feed as it stands: all events that came out, without those beyond the first terminal event known now."""
    kind = {f.name: f.dataType for f in schema.fields}
    noted = StructType([StructField("analysis_id", kind["analysis_id"]), StructField("stop", kind["sequence"])])
    stop = read_batches(spark, f"{path}-ended", noted).groupBy("analysis_id").agg(F.min("stop").alias("stop"))
    fed = StructType([*schema.fields, StructField("part", LongType())])
    rows = read_batches(spark, path, fed).join(stop, "analysis_id", "left")
    return rows.where("stop IS NULL OR sequence <= stop").select(*schema.names)


class FirstOfKey(StatefulProcessor):
    """The first row of a key, by time and id within a batch; a key that has been seen gives nothing."""

    def __init__(self, columns: list[str], order: list[str]) -> None:
        self.columns, self.order = columns, order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return iter([])
        self.seen.update((True,))
        first = min(rows, key=lambda r: tuple(r[c] for c in self.order))
        return iter([Row(**{c: first[c] for c in self.columns})])

    def close(self) -> None:
        pass


def feedback_intake(stream: DataFrame, path: str, checkpoint: str) -> None:
    """First feedback per (workspace, key) with its queue priority; repeats of any age are ignored.

    A key that has been taken is one small state row, looked up by key: a batch reads nothing of what was
    written before.
    """
    keys = ["workspace_id", "idempotency_key"]
    urgent = F.col("category").isin("source_evidence", "reference_resolution")
    queued = stream.withColumn("priority_score", F.when(urgent, 90.0).otherwise(50.0))
    first = queued.groupBy(*keys).transformWithState(
        FirstOfKey(queued.columns, ["created_at", "feedback_id"]), queued.schema, "Append", "None")
    run(first, append_batches(path), checkpoint)
