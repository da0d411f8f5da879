"""Event projections, lifecycle checks, queues and operational rollups (W7-W12, O1, O2, A17, A26,
A28, A29, D9, S6, S10, E7 rules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom import vocab
from evidloom.functions import text as T
from evidloom.operators.skew import (
    attach_groups, exact_percentiles, lead_rows, number_rows, top_rows,
)

STATUS_OF_EVENT = {
    "document.parsing.failed": "failed", "document.parsing.limited": "parsed_with_limits",
    "document.parsed": "parsed",
}


def status_aggregates(order: list[str]) -> list[Column]:
    """Aggregates of W7 and E4, mergeable, so they serve batch and streaming alike."""
    kind, at = F.col("event_type"), F.struct(*order)
    graded = kind.isin("document.parsed", "document.parsing.limited")
    limited = kind.isin("document.parsing.failed", "document.parsing.limited")
    return [
        F.max_by(F.when(kind.isin(*STATUS_OF_EVENT), kind), F.when(kind.isin(*STATUS_OF_EVENT), at)).alias("last_kind"),
        F.bool_or(kind == "document.source.registered").alias("registered"),
        F.max_by(F.when(graded, F.col("quality_grade")), F.when(graded, at)).alias("latest_quality_grade"),
        F.max_by(F.when(limited, F.col("reason")), F.when(limited, at)).alias("limitation"),
    ]


def status_columns(rows: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for kv in STATUS_OF_EVENT.items() for x in kv]
    status = F.coalesce(
        F.element_at(F.create_map(*pairs), F.col("last_kind")),
        F.when(F.col("registered"), "parsing").otherwise("registered"))
    return rows.withColumn("status", status).drop("last_kind", "registered")


def document_status(events: DataFrame, order: list[str]) -> DataFrame:
    """Status per aggregate from its events in order.

    The last of failed / limited / parsed decides; with none of them a registered document is
    parsing.  Grade and limitation are the last ones seen and are not cleared by later events.
    """
    return status_columns(events.groupBy("aggregate_id").agg(*status_aggregates(order)))


def _next_state(state: Column, move: Column) -> Column:
    """The state after a recorded move: refused moves leave it alone, no state takes any."""
    pairs = [x for a, moves in vocab.STATE_MOVES.items() for x in (F.lit(a), F.array(*[F.lit(m) for m in moves]))]
    moves = F.create_map(*pairs)
    allowed = F.coalesce(F.array_contains(F.element_at(moves, state), move), F.lit(False))
    return F.when(state.isNull() | allowed, move).otherwise(state)


def transition_check(history: DataFrame, key: str, order: list[str], slice_by: str = "hour") -> DataFrame:
    """Every recorded state against the state that the accepted moves before it have left.

    outcome: start, same, accepted or invalid; an invalid move leaves the state (terminal states have no
    exits).  Also percent and completed_at.  A busy key is cut into time slices: the moves of a slice
    compose to a map from state to state, a fold over a key's maps gives the state at each slice's
    start, and slices are then replayed on their own.
    """
    rows = history.withColumn("__slice", F.date_trunc(slice_by, F.col(order[0]).cast("timestamp")))
    names = [c for c in history.columns if c not in (key, *order)]
    slices = rows.groupBy(key, "__slice").agg(F.array_sort(F.collect_list(F.struct(*order, *names))).alias("moves"))
    starts = [F.lit(None).cast("string"), *[F.lit(x) for x in vocab.STATE_PERCENT]]
    identity = F.map_from_arrays(F.array(*[F.coalesce(x, F.lit("")) for x in starts]), F.array(*starts))
    after = F.aggregate("moves", identity, lambda m, e: F.transform_values(m, lambda _, s: _next_state(s, e["status"])))
    maps = slices.select(key, "__slice", after.alias("map")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("__slice", F.map_entries("map").alias("entries")))).alias("maps"))
    no_state = F.lit(None).cast("string")
    none = F.struct(no_state.alias("state"), F.array().cast("array<struct<s:timestamp,state:string>>").alias("found"))

    def follow(done: Column, part: Column) -> Column:
        found = F.concat(done["found"], F.array(F.struct(part["__slice"].alias("s"), done["state"].alias("state"))))
        state = F.element_at(F.map_from_entries(part["entries"]), F.coalesce(done["state"], F.lit("")))
        return F.struct(state.alias("state"), found.alias("found"))

    begins = maps.select(key, F.explode(F.aggregate("maps", none, follow, lambda done: done["found"])).alias("b")).select(
        key, F.col("b.s").alias("__slice"), F.col("b.state").alias("__begin"))
    states = F.aggregate(
        "moves", F.array(F.col("__begin")),
        lambda done, e: F.concat(done, F.array(_next_state(F.element_at(done, F.lit(-1)), e["status"]))))
    replayed = slices.join(begins, [key, "__slice"]).select(
        key, "moves", F.slice(states, F.lit(1), F.size("moves")).alias("__states"))
    rows = replayed.select(key, F.explode(F.arrays_zip("moves", "__states")).alias("r")).select(
        key, "r.moves.*", F.col("r.__states").alias("previous"))
    state = _next_state(F.col("previous"), F.col("status"))
    outcome = (
        F.when(F.col("previous").isNull(), "start").when(F.col("previous") == F.col("status"), "same")
        .when(state == F.col("status"), "accepted").otherwise("invalid"))
    return rows.select(*history.columns, "previous").withColumn("outcome", outcome).withColumn(
        "percent", T.state_percent(F.col("status"))).withColumn(
        "completed_at",
        F.when(T.is_terminal(F.col("status")) & F.col("outcome").isin("start", "accepted"), F.col(order[0])))


def replay_after(events: DataFrame, cursors: DataFrame, key: str, sequence: str, terminal: Column,
                 batch: int = 50) -> DataFrame:
    """Per key the next ``batch`` events beyond its cursor, up to and with the first terminal
    event among them.  A key without a cursor starts at the beginning."""
    later = events.join(cursors.select(key, F.col("cursor")), key, "left").where(
        F.col(sequence) > F.coalesce("cursor", F.lit(-1)))
    page = top_rows(later, [key], [F.asc(sequence)], batch, "position")
    page = page.withColumn("is_terminal", terminal)
    # at most ``batch`` rows per key from here on
    stop = Window.partitionBy(key).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("is_terminal").cast("int")).over(stop), F.lit(0))
    return page.withColumn("ended", ended).where("ended = 0").drop("ended", "cursor")


def idempotent_requests(requests: DataFrame, keys: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """First request per key is created; later ones replay it or conflict with it."""
    at = F.struct(*order)
    rows = attach_groups(requests, keys, first_print=F.min_by(fingerprint, at), first_at=F.min(at))
    outcome = (
        F.when(F.struct(*order) == F.col("first_at"), "created")
        .when(F.col(fingerprint) == F.col("first_print"), "replay").otherwise("conflict"))
    return rows.withColumn("outcome", outcome).drop("first_print", "first_at")


def stage_attempts(events: DataFrame, run: str, stage: str, fingerprint: str, order: list[str]) -> DataFrame:
    """One attempt per (run, stage, fingerprint) with its last status, numbered per run and
    stage by first appearance."""
    at = F.struct(*order)
    attempts = events.groupBy(run, stage, fingerprint).agg(
        F.min(order[0]).alias("first_seen"), F.max_by("status", at).alias("status"),
        F.count(F.lit(1)).alias("events"))
    return number_rows(attempts, [run, stage], ["first_seen", fingerprint], F.to_date("first_seen"), "attempt")


def stage_durations(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Seconds spent in each recorded state (NULL for the last one)."""
    rows = lead_rows(history, [key], order, F.to_date(order[0]), [order[0]], "next")
    seconds = F.unix_micros(F.col(f"next.{order[0]}").cast("timestamp")) - F.unix_micros(F.col(order[0]).cast("timestamp"))
    return rows.withColumn("seconds", seconds / 1e6).drop("next")


def adjudication_queue(feedback: DataFrame) -> DataFrame:
    """O1: one item per feedback, evidence and resolution issues first, arrival order within."""
    urgent = F.col("category").isin("source_evidence", "reference_resolution")
    return feedback.withColumn("priority_score", F.when(urgent, 90.0).otherwise(50.0)).withColumn(
        "reported_issue_count", F.lit(1)).orderBy(F.desc("priority_score"), "created_at", "feedback_id")


# Mode, feature and weight of the reading priority.
PRIORITY_WEIGHTS = [
    ("understand", "foundational", 0.4), ("understand", "background", 0.2),
    ("implement", "adopted_method", 0.5), ("implement", "dataset", 0.3),
    ("review", "contradicts", 0.6), ("review", "scope_mismatch", 0.4),
    ("survey", "lineage", 0.5), ("present", "novelty", 0.5), ("present", "key_benchmark", 0.5),
]


def reading_priority(references: DataFrame) -> DataFrame:
    """O2: score, band and reasons per reference and mode; 0.5 when no feature fires but the
    reference has intents."""
    modes = list(dict.fromkeys(m for m, _, _ in PRIORITY_WEIGHTS))
    scored = []
    for mode in modes:
        total, names = F.lit(0.0), []
        for m, feature, weight in PRIORITY_WEIGHTS:
            fired = F.coalesce(F.col(feature), F.lit(False))
            if m == mode:
                total = total + F.when(fired, F.lit(weight)).otherwise(0.0)
        scored.append(F.struct(F.lit(mode).alias("mode"), F.least(F.lit(1.0), total).alias("raw")))
    features = list(dict.fromkeys(f for _, f, _ in PRIORITY_WEIGHTS))
    names = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in features]))
    rows = references.withColumn("reasons", names).withColumn("m", F.explode(F.array(*scored)))
    score = F.when((F.col("m.raw") == 0) & (F.col("intent_count") > 0), 0.5).otherwise(F.col("m.raw"))
    band = (
        F.when(score >= 0.80, "must_read").when(score >= 0.60, "high").when(score >= 0.35, "medium")
        .otherwise("low"))
    reasons = F.when(F.size("reasons") == 0, F.array(F.lit("default_reason"))).otherwise(F.col("reasons"))
    return rows.select("reference_entry_id", F.col("m.mode").alias("mode"), score.alias("score"),
                       band.alias("band"), reasons.alias("reasons"))


def intent_features(references: DataFrame) -> DataFrame:
    """The default feature profile: only the intents ``method`` and ``background`` count."""
    has = lambda i: F.array_contains("citation_intents", i)
    return references.withColumns({
        "adopted_method": has("method"), "background": has("background"),
        "intent_count": F.size("citation_intents"),
        **{f: F.lit(False) for f in ("foundational", "dataset", "contradicts", "scope_mismatch",
                                     "lineage", "novelty", "key_benchmark")}})


def latency_summary(samples: DataFrame) -> DataFrame:
    """Exact percentiles per stage and over all stages, with counts and error shares."""
    probs = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    per_stage = exact_percentiles(samples, ["stage"], "duration_ms", probs)
    overall = exact_percentiles(samples, [], "duration_ms", probs).withColumn("stage", F.lit("(all)"))
    return per_stage.unionByName(overall)


def load_summary(samples: DataFrame) -> DataFrame:
    """Throughput as count over mean duration, and the real rate over the observed span."""
    d = F.col("duration_ms") / 1000
    start = F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    n = F.count(F.lit(1))
    return samples.agg(
        n.alias("sample_count"), (n / F.nullif(F.avg(d), F.lit(0.0))).alias("throughput_rps"),
        (n / F.nullif(F.max(start + d) - F.min(start), F.lit(0.0))).alias("observed_rps"))


def status_counts(samples: DataFrame) -> DataFrame:
    """Samples per HTTP status; 0 is an error."""
    label = F.when(F.col("http_status") == 0, "error").otherwise(F.col("http_status").cast("string"))
    return samples.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("n"))


COST_DIMENSIONS = ("provider", "model", "stage", "purpose", "workspace_id")


def cost_rollup(executions: DataFrame, verified_links: Column, by: tuple[str, ...] = COST_DIMENSIONS) -> DataFrame:
    """Tokens, latency, cost and retries with subtotals of the dimensions in order.

    ``by`` may also name ``analysis_run_id``, which gives a row per analysis.
    """
    return executions.rollup(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.sum("retry_count").alias("retries"),
        (F.sum("cost_usd") / F.nullif(verified_links, F.lit(0))).alias("cost_per_verified_link"))


def activation_funnel(events: DataFrame, steps: list[str], window_days: int = 14) -> DataFrame:
    """Users reaching each step in order, the later steps within ``window_days`` of the first.

    Each step is the earliest matching event after the previous step: one aggregate and one
    join per step, none of it per user in a window.
    """
    reached = events.where(F.col("step") == steps[0]).groupBy("user_id").agg(F.min("at").alias("t0"))
    out = reached.agg(F.lit(0).alias("position"), F.lit(steps[0]).alias("step"), F.count(F.lit(1)).alias("users"))
    last = reached.withColumn("t", F.col("t0"))
    for i, step in enumerate(steps[1:], start=1):
        nxt = events.where(F.col("step") == step).join(last, "user_id").where(
            (F.col("at") > F.col("t"))
            & (F.col("at") <= F.col("t0") + F.make_dt_interval(F.lit(window_days))))
        last = nxt.groupBy("user_id", "t0").agg(F.min("at").alias("t"))
        out = out.union(last.agg(F.lit(i), F.lit(step), F.count(F.lit(1))))
    return out


def weekly_retention(events: DataFrame) -> DataFrame:
    """Active users per week and how many return the week after."""
    weeks = events.select("user_id", F.date_trunc("week", "at").cast("date").alias("week")).distinct()
    again = weeks.select("user_id", F.date_sub("week", 7).alias("week"), F.lit(1).alias("back"))
    return weeks.join(again, ["user_id", "week"], "left").groupBy("week").agg(
        F.count(F.lit(1)).alias("active"), F.count("back").alias("returning"))


def workload_distribution(rows: DataFrame, measures: list[str]) -> DataFrame:
    """p50 / p90 / p99 of several measures of a document in one pass over long form."""
    long = rows.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        [], measures, "measure", "value")
    return exact_percentiles(long, ["measure"], "value", {"p50": 0.50, "p90": 0.90, "p99": 0.99})


def split_leakage(rows: DataFrame) -> DataFrame:
    """D9, exact form: families of equal normalised text that span several splits.

    Families are counted, not paired, so a block of copies costs one row per split.
    """
    key = F.sha2(T.normalise(F.lower("text")), 256)
    per_split = rows.groupBy(key.alias("family"), "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return per_split.groupBy("family").agg(
        F.count(F.lit(1)).alias("splits"), F.sum("n").alias("members"), F.min("first_doc").alias("first_doc")
    ).where("splits > 1")


def new_assets(incoming: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Insert-if-absent on (workspace, sha256).  ``created`` is false for copies inside the
    batch and for content the workspace already holds."""
    key = ["workspace_id", "sha256"]
    rows = attach_groups(incoming, key, first_row=F.min(order))
    held = existing.select(*key).distinct().withColumn("held", F.lit(True))
    rows = rows.join(held, key, "left")
    created = (F.col(order) == F.col("first_row")) & F.col("held").isNull()
    return rows.withColumn("created", created).withColumn(
        "object_key", T.source_key(F.col("workspace_id"), F.col("sha256"))).drop("first_row", "held")


def synthetic_cases(index: DataFrame, column: str) -> DataFrame:
    """Generated cases; row i takes relation i mod 9 and domain i mod 12."""
    i = F.col(column)
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (i % len(values) + 1).cast("int"))
    relation, domain = pick(vocab.RELATIONS), pick(vocab.DOMAINS)
    closed = relation == "inaccessible_source"
    return index.select(
        F.concat(F.lit("synth-"), F.lpad(i.cast("string"), F.greatest(F.lit(4), F.char_length(i.cast("string"))), F.lit("0"))).alias("case_id"),
        F.lit("development").alias("split"), domain.alias("domain"), F.lit(True).alias("synthetic"),
        F.concat(F.lit("Synthetic claim "), i.cast("string"), F.lit(" about "), domain, F.lit(".")).alias("claim_text"),
        F.when(closed, "not_accessible").otherwise("open_access_full_text").alias("source_access_level"),
        relation.alias("relation"), F.when(closed, "inaccessible_source").alias("abstention"))


def alert_windows(counts: DataFrame, stalled_for: int = 10, failing_for: int = 5, quotes_for: int = 5) -> DataFrame:
    """E7 on window counts (start, created, failed, completed, quote_failures; one row per minute
    start of a sliding five-minute window).

    failure_rate: failed above a tenth of created (so failures without anything created count);
    quote_failures: more than 10 per second; stalled: created without completed.  An alert is on when
    its condition held in each of the last ``*_for`` windows.  ``counts`` has one row per window start, so
    consecutive windows are looked up by start time instead of a global order.
    """
    created, failed = F.col("created"), F.col("failed")
    rules = {
        "failure_rate_high": ((failed > 0) & (failed * 10 > created), failing_for),
        "quote_failures_high": (F.col("quote_failures") / 300.0 > 10, quotes_for),
        "stalled": ((created > 0) & (F.col("completed") == 0), stalled_for),
    }
    longest = max(span for _, span in rules.values())
    held = counts.select("start", *[F.coalesce(c, F.lit(False)).alias(f"now_{n}") for n, (c, _) in rules.items()])
    # a window speaks for itself and for those up to ``longest`` minutes after it
    spread = held.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))).withColumn(
        "start", F.timestamp_add("MINUTE", F.col("age"), F.col("start")))
    runs = spread.groupBy("start").agg(*[
        (F.count_if(F.col(f"now_{n}") & (F.col("age") < span)) == span).alias(n) for n, (_, span) in rules.items()])
    return counts.join(runs, "start", "left")
