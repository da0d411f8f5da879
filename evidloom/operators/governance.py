"""Listing, tenancy, retention, grading, audit and data-quality operators (P1-P5, P8-P12, P16-P21,
D1, D4-D7, J3, J7, J8, J12-J15, A16, A18, A24, A27, O5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom import vocab
from evidloom.functions import text as T
from evidloom.operators.evaluation import named_slices
from evidloom.operators.skew import attach_groups, top_rows
from evidloom.session import through_table


def list_links(links: DataFrame, analysis: int | str, status: str | None = None,
               relation: str | None = None, cursor: tuple | None = None, limit: int = 50) -> DataFrame:
    """One keyset page ordered by (created_at, link_id); ``cursor`` is the last pair seen.

    One row beyond the page decides ``has_more``; it is not returned.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie in 1..100")
    rows = links.where(F.col("analysis_run_id") == analysis)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if relation is not None:
        rows = rows.where(F.col("evidence_relation") == relation)
    if cursor is not None:
        at, ident = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("link_id") > ident)))
    order = [F.asc("created_at"), F.asc("link_id")]
    page = rows.orderBy(*order).limit(limit + 1)
    n = page.agg(F.count(F.lit(1)).alias("n"))
    return page.orderBy(*order).limit(limit).withColumn("has_more", n.scalar() > limit)


def in_workspace(rows: DataFrame, workspace: str, shared: bool = False) -> DataFrame:
    """Rows of one workspace; ``shared`` also keeps rows without one (event log)."""
    own = F.col("workspace_id") == workspace
    return rows.where(own | F.col("workspace_id").isNull()) if shared else rows.where(own)


def visible_children(child: DataFrame, chain: list[tuple[str, DataFrame, str]], workspace: str) -> DataFrame:
    """Child rows whose chain of parents ends in the workspace.

    ``chain`` goes upwards as (foreign key, parent frame, parent key); the last parent carries
    workspace_id.  The visible keys are narrowed from the top with left-semi joins.
    """
    _, top, key = chain[-1]
    visible = in_workspace(top, workspace).select(key)
    for (_, frame, frame_key), (foreign, _, parent_key) in zip(chain[-2::-1], chain[:0:-1]):
        keys = visible.withColumnRenamed(parent_key, foreign)
        visible = frame.join(keys, foreign, "left_semi").select(frame_key)
    return child.join(visible.withColumnRenamed(chain[0][2], chain[0][0]), chain[0][0], "left_semi")


def retention_state(assets: DataFrame, today: Column, grace_hours: int = vocab.DELETION_GRACE_HOURS) -> DataFrame:
    """Live / expiring / tombstoned / purge_due per asset.

    ``assets`` carries retention_profile, acquired_on, legal_hold, delete_requested_on, deleted.
    The profile's days for uploaded bytes apply; a hold wins; a delete request tombstones at once
    and the bytes become due after the grace period.
    """
    days = [(p, d["uploaded_source_bytes"]) for p, d in vocab.RETENTION_DAYS.items()]
    profiles = assets.sparkSession.createDataFrame(days, "retention_profile string, keep_days int")
    rows = assets.join(F.broadcast(profiles), "retention_profile", "left")
    expires = F.date_add("acquired_on", F.coalesce("keep_days", F.lit(30)))
    grace_days = F.ceil(F.lit(grace_hours) / 24).cast("int")
    requested = F.col("delete_requested_on")
    state = (
        F.when(F.col("deleted"), "purged")
        .when(F.col("legal_hold"), "live")
        .when(requested.isNotNull() & (F.date_add(requested, grace_days) <= today), "purge_due")
        .when(requested.isNotNull(), "tombstoned")
        .when(expires <= today, "expiring").otherwise("live")
    )
    return rows.withColumn("retention_expires_on", expires).withColumn("state", state)


def claimable_events(events: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """P5: the oldest pending or failed events that are available, attempts raised by one."""
    ready = events.where(F.col("status").isin("pending", "failed") & (F.col("available_at") <= now))
    return ready.orderBy("created_at", "event_id").limit(limit).withColumn("attempts", F.col("attempts") + 1)


def pending_view(events: DataFrame, now: Column) -> DataFrame:
    """Queue depth, retries and age of the oldest open event per type and status."""
    open_rows = events.where(F.col("status").isin("pending", "failed"))
    return open_rows.groupBy("event_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.max("attempts").alias("max_attempts"),
        F.count_if(F.col("attempts") > 0).alias("retried"),
        F.max(F.timestamp_diff("SECOND", F.col("created_at"), now)).alias("oldest_age_s"))


def parse_grade(counters: DataFrame) -> DataFrame:
    """Grade a-d with linkage, coordinate coverage and limitation codes in fixed order."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(1.0))
    rows = counters.withColumn("linkage", share("linked_citations", "total_citations")).withColumn(
        "coordinate_coverage", share("elements_with_coords", "total_elements"))
    unusable = ~F.col("has_meaningful_text") | ~F.col("has_bibliography") | F.col("has_malformed_hierarchy")
    link, cov = F.col("linkage"), F.col("coordinate_coverage")
    grade = (
        F.when(unusable, "d").when((link >= 0.98) & (cov >= 0.90), "a")
        .when((link >= 0.90) & (cov >= 0.70), "b").otherwise("c")
    )
    rows = rows.withColumn("grade", grade)
    return rows.withColumn("limitations", F.array_compact(F.array(
        F.when(~F.col("has_meaningful_text"), "no_meaningful_text"),
        F.when(~F.col("has_bibliography"), "no_bibliography"),
        F.when(F.col("has_malformed_hierarchy"), "malformed_hierarchy"),
        F.when(F.col("grade") == "c", "material_linkage_or_coordinate_limitations"))))


def document_counters(references: DataFrame, clusters: DataFrame, sections: DataFrame, key: str = "path") -> DataFrame:
    """The counters of P8 per document from its parsed tables.

    Section texts are only measured; the text itself is not gathered.  The raw text joins the
    non-empty sections with single spaces.
    """
    texts = sections.groupBy(key).agg(
        F.sum(F.char_length("text")).alias("chars"), F.count_if(F.col("text") != "").alias("parts"))
    refs = references.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("coords") != "").alias("refs_xy"))
    marks = clusters.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_marks"), F.count_if(F.col("coords") != "").alias("marks_xy"),
        F.count_if(F.size("targets") > 0).alias("linked"))
    rows = texts.join(refs, key, "full").join(marks, key, "full").fillna(
        0, ["chars", "parts", "n_refs", "refs_xy", "n_marks", "marks_xy", "linked"])
    return rows.select(
        key, F.col("n_marks").alias("total_citations"), F.col("linked").alias("linked_citations"),
        (F.col("n_marks") + F.col("n_refs")).alias("total_elements"),
        (F.col("marks_xy") + F.col("refs_xy")).alias("elements_with_coords"),
        (F.col("chars") + F.greatest(F.col("parts") - 1, F.lit(0)) > 100).alias("has_meaningful_text"),
        (F.col("n_refs") > 0).alias("has_bibliography"), F.lit(False).alias("has_malformed_hierarchy"))


def confidence(links: DataFrame) -> DataFrame:
    """Weakest stage (unclamped) and geometric mean of the clamped stages; missing is 1."""
    stages = [F.coalesce(F.col(s), F.lit(1.0)) for s in vocab.STAGES]
    clamped = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) for s in stages]
    logs = reduce(lambda a, b: a + b, [F.log(c) for c in clamped])
    balanced = F.when(F.least(*clamped) == 0, F.lit(0.0)).otherwise(F.exp(logs / len(stages)))
    return links.withColumn("weakest_link", F.least(*stages)).withColumn("balanced_score", balanced)


def publish_status(weakest: Column, balanced: Column) -> Column:
    """P10: verified / limited / blocked."""
    return (
        F.when((weakest >= vocab.PUBLISH_WEAKEST) & (balanced >= vocab.PUBLISH_BALANCED), "verified")
        .when(weakest >= vocab.PUBLISH_LIMITED, "limited").otherwise("blocked")
    )


def audit(links: DataFrame) -> DataFrame:
    """Eight checks as columns; only missing evidence and an ungrounded statement block.

    ``links`` carries source_text, quote, start_offset, end_offset, evidence_relation, n_spans,
    statements (array of kind and span_ids), claimed_access, asset_access, auditor_route.
    """
    relation, n = F.col("evidence_relation"), F.col("n_spans")
    evidence = relation.isin(*vocab.EVIDENCE_EXEMPT) | (n >= 1)
    ungrounded = F.exists(
        F.col("statements"), lambda s: (s["kind"] == "evidence_based") & (F.size(s["span_ids"]) < 1))
    start, end = F.col("start_offset"), F.col("end_offset")
    return links.withColumns({
        "quote_contained": F.contains("source_text", "quote"),
        "offsets_valid": (start >= 0) & (end <= F.char_length("source_text")) & (start <= end),
        "has_evidence": evidence,
        "statements_grounded": ~ungrounded,
        "access_disclosed": F.col("claimed_access") == F.col("asset_access"),
        "schema_ok": F.lit(True),
        "injection_free": ~T.has_injection_phrase(F.col("quote")),
        "auditor_independent": F.col("auditor_route") != vocab.GENERATION_ROUTE,
    }).withColumn("blocking_codes", F.array_compact(F.array(
        F.when(~F.col("has_evidence"), "missing_evidence"),
        F.when(~F.col("statements_grounded"), "ungrounded_statement"),
    ))).withColumn("audit_status", F.when(F.size("blocking_codes") > 0, "blocked").otherwise("passed"))


def outcome_rollup(links: DataFrame) -> DataFrame:
    """Link counts per analysis and its final status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return links.groupBy("analysis_run_id").agg(
        F.count(F.lit(1)).alias("total_cases"), *[n(s) for s in vocab.LINK_STATUSES]
    ).withColumn("analysis_status", F.when(F.col("limited") > 0, "completed_with_limits").otherwise("completed"))


def export_cases(rows: DataFrame, include_private_quotes: bool = False, anonymise_users: bool = True) -> DataFrame:
    """The nine named columns only; quotes of private sources dropped, user ids hashed by default.

    ``citing_claim`` and ``cited_source`` are structs; ``user_id`` in the one, ``access_level`` and ``quote`` in the other
    are what the policy looks at, where they exist.
    """
    out = rows.select(*vocab.EXPORT_COLUMNS)
    fields = lambda c: out.schema[c].dataType.fieldNames()
    if anonymise_users and "user_id" in fields("citing_claim"):
        hashed = F.sha2(F.col("citing_claim.user_id").cast("string"), 256)
        out = out.withColumn("citing_claim", F.col("citing_claim").withField("user_id", hashed))
    if not include_private_quotes and {"access_level", "quote"} <= set(fields("cited_source")):
        public = F.when(F.col("cited_source.access_level") != "user_private_full_text", F.col("cited_source.quote"))
        out = out.withColumn("cited_source", F.col("cited_source").withField("quote", public))
    return out


def invalid_label_rows(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows whose label map has a key outside the allowed names, with those keys."""
    allowed = F.array(*[F.lit(x) for x in vocab.METRIC_LABELS])
    return rows.withColumn("bad_labels", F.array_except(F.map_keys(labels), allowed)).where(F.size("bad_labels") > 0)


def displayed_quotes(spans: DataFrame) -> DataFrame:
    """P20: the quote a reader may see by access level; abstract sources show abstract spans only."""
    rules = spans.sparkSession.createDataFrame(list(vocab.QUOTE_DISPLAY.items()), "access_level string, rule string")
    rows = spans.join(F.broadcast(rules), "access_level", "left")
    shown = (F.col("rule") == "exact_evidence_spans") | (
        (F.col("rule") == "abstract_spans_only") & (F.col("evidence_type") == "abstract_span"))
    return rows.withColumn("displayed_quote", F.when(shown, F.col("quote")))


def since_instant(rows: DataFrame, column: str, instant: str) -> DataFrame:
    """Rows at or after an ISO-8601 instant."""
    kind = dict(rows.dtypes)[column]
    return rows.where(F.col(column) >= T.instant(F.lit(instant)).cast(kind))


def constraint_report(rows: DataFrame, rules: dict[str, Column], key: str, samples: int = 3) -> DataFrame:
    """Violations and the smallest offending keys per named rule, in one pass.

    A rule that is NULL for a row is not violated, as in a table constraint.
    """
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(~c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    hits = rows.select(key, F.explode(broken).alias("rule"))
    counts = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    first = top_rows(hits, ["rule"], [F.asc(key)], samples, "at").groupBy("rule").agg(
        F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("sample_keys"))
    names = rows.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    return (
        names.join(counts, "rule", "left").join(first, "rule", "left")
        .select("rule", F.coalesce("violations", F.lit(0)).alias("violations"), "sample_keys"))


def link_semantics(links: DataFrame) -> DataFrame:
    """(link_id, problem) rows of the semantic rules of an evidence link.

    ``links`` carries start_offset, end_offset, quote, quote_sha256, span_ids, span_assets,
    provenance_assets, checksum_assets, supporting_ids and claim_id.
    """
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0)
    allowed = F.array_append("span_ids", F.col("claim_id"))
    problems = F.array_compact(F.array(
        F.when(F.col("end_offset") <= F.col("start_offset"), "invalid_offsets"),
        F.when(F.sha2("quote", 256) != F.col("quote_sha256"), "quote_hash_mismatch"),
        F.when(differ("provenance_assets", "checksum_assets") | differ("checksum_assets", "provenance_assets"),
               "checksum_drift"),
        F.when(differ("span_assets", "provenance_assets"), "asset_not_in_provenance"),
        F.when(differ("supporting_ids", allowed), "unknown_supporting_id"),
    ))
    return links.select("link_id", F.explode(problems).alias("problem"))


def provenance_invariants(spans: DataFrame) -> DataFrame:
    """Violations of the testable provenance invariants, one row each.

    ``spans`` carries text, quote, quote_sha256, offsets, access_level, evidence_relation,
    link_version, span_version, asset_deleted, served and input_fingerprint.
    """
    start, end = F.col("start_offset"), F.col("end_offset")
    strong = F.col("evidence_relation").isin("direct_support", "partial_support", "contradicts")
    checks = {
        "offsets_within_text": (start >= 0) & (end <= F.char_length("text")),
        "quote_checksum_matches": F.sha2(
            F.substr(F.col("text"), (start + 1).cast("int"), (end - start).cast("int")), 256) == F.col("quote_sha256"),
        "compatible_version": F.col("link_version") == F.col("span_version"),
        "no_metadata_only_support": ~(strong & (F.col("access_level") == "metadata_only")),
        "no_deleted_asset_served": ~(F.col("asset_deleted") & F.col("served")),
        "fingerprint_present": F.col("input_fingerprint").isNotNull(),
    }
    got = spans.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return got.unpivot([], list(checks), "invariant", "violations")


def supersession_problems(history: DataFrame) -> DataFrame:
    """(id, problem) - more than one current row per reference, or a pointer cycle.

    ``history`` carries id, reference_entry_id, superseded_by_id.  Pointers are doubled: after k
    steps a row points 2^k ahead, and a row still pointing somewhere once 2^k exceeds the row
    count runs into a cycle.  Each step is written to the shared folder, so lineage stays short.
    """
    current = history.where("superseded_by_id IS NULL")
    doubled = attach_groups(current, ["reference_entry_id"], n_current=F.count(F.lit(1))).where(
        "n_current > 1").select("id", F.lit("several_current_rows").alias("problem"))
    hop = history.select("id", F.col("superseded_by_id").alias("to")).where("to IS NOT NULL")
    total = hop.count()
    hop = through_table(hop, "hops")
    reach = 1
    while reach <= total:
        reach *= 2
        ahead = hop.select(F.col("id").alias("to"), F.col("to").alias("next"))
        hop = through_table(hop.join(ahead, "to").select("id", F.col("next").alias("to")), "hops")
    cycles = hop.select("id", F.lit("pointer_cycle").alias("problem"))
    return doubled.unionByName(cycles)


def incomplete_payloads(links: DataFrame, required: list[str]) -> DataFrame:
    """Rows with a missing required field and the names of the missing ones."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return links.withColumn("missing_fields", missing).where(F.size("missing_fields") > 0)


def lookup_works(records: DataFrame, works: DataFrame) -> DataFrame:
    """Work per record by DOI, else by normalised title.

    A record is skipped only when it carried an identifier or a title and nothing matched.
    """
    doi_key, title_key = T.strip(F.col("doi")), T.title_key(F.col("title"))
    by_doi = top_rows(works.where("doi IS NOT NULL"), ["doi"], [F.asc("work_id")], 1, "at").select(
        F.col("doi").alias("k_doi"), F.col("work_id").alias("doi_work"))
    titled = works.withColumn("k_title", T.title_key(F.col("title")))
    by_title = top_rows(titled, ["k_title"], [F.asc("work_id")], 1, "at").select(
        "k_title", F.col("work_id").alias("title_work"))
    rows = records.withColumn("r_doi", doi_key).withColumn("r_title", title_key)
    rows = rows.join(by_doi, F.col("r_doi") == F.col("k_doi"), "left").join(
        by_title, F.col("r_title") == F.col("k_title"), "left")
    known = (F.coalesce("r_doi", F.lit("")) != "") | (F.coalesce("r_title", F.lit("")) != "")
    found = F.coalesce("doi_work", "title_work")
    return rows.withColumn("work_id", found).withColumn("skipped", found.isNull() & known).drop(
        "r_doi", "r_title", "k_doi", "k_title", "doi_work", "title_work")


def blocked_links(links: DataFrame, audits: DataFrame, code: str) -> DataFrame:
    """Links whose audit carries a blocking code, counted by workspace."""
    hits = audits.where(F.array_contains("blocking_codes", code)).select("link_id")
    return links.join(hits, "link_id").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))


def anchor_rows(clusters: DataFrame, references: DataFrame) -> DataFrame:
    """One row per marker target with its reference; markers without targets stay."""
    marks = clusters.select("document_id", "cluster_id", F.explode_outer("targets").alias("xml_id"))
    refs = references.select("document_id", "xml_id", "reference_entry_id")
    return marks.join(refs, ["document_id", "xml_id"], "left")


def smallest_container(spans: DataFrame, nodes: DataFrame, bucket: int = 4096) -> DataFrame:
    """Smallest node whose [start, end) contains a span, per document.

    Nodes are listed in every offset bucket they cover and a span looks in the bucket of its
    start, so a long document spreads over many join keys.
    """
    cover = nodes.where("end_offset > start_offset").withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("start_offset") / bucket), F.floor((F.col("end_offset") - 1) / bucket))))
    cover = cover.select("doc_id", "bucket", "node_id", F.col("start_offset").alias("ns"), F.col("end_offset").alias("ne"))
    at = spans.withColumn("bucket", F.floor(F.col("start_offset") / bucket))
    inside = at.join(cover, ["doc_id", "bucket"]).where("ns <= start_offset AND end_offset <= ne")
    best = inside.groupBy("doc_id", "span_id").agg(
        F.min_by("node_id", F.struct(F.col("ne") - F.col("ns"), "node_id")).alias("node_id"))
    return spans.join(best, ["doc_id", "span_id"], "left")


def upsert_links(current: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """New state of a link table; matched rows take the given columns, others are inserted.

    The caller writes the result to a new versioned path.
    """
    new = updates.select(*key, F.lit(True).alias("is_new"), *[F.col(c).alias(f"n_{c}") for c in columns])
    rows = current.withColumn("is_old", F.lit(True)).join(new, key, "full")
    take = lambda c: F.when(F.col("is_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    rest = [c for c in current.columns if c not in key + columns]
    action = (
        F.when(F.col("is_old").isNull(), "inserted").when(F.col("is_new"), "updated").otherwise("kept"))
    return rows.select(*key, *rest, *[take(c) for c in columns], action.alias("action"))


def route_events(events: DataFrame) -> DataFrame:
    """Handler by (type, version); unknown ones are acknowledged without work."""
    routes = events.sparkSession.createDataFrame(
        vocab.ROUTES, "event_type string, schema_version string, handler string")
    rows = events.join(F.broadcast(routes), ["event_type", "schema_version"], "left")
    return rows.withColumn("action", F.when(F.col("handler").isNull(), "acknowledge").otherwise("handle"))


def abstention_accuracy(links: DataFrame) -> DataFrame:
    """Share of inaccessible cases that abstained."""
    closed = F.col("access_level") == "not_accessible"
    return links.agg(
        F.count_if(closed).alias("inaccessible"),
        F.avg(F.when(closed, F.col("abstention_code").isNotNull().cast("double"))).alias("abstention_accuracy"))


def quality_rates(links: DataFrame, grain: str = "month") -> DataFrame:
    """Correction, abstention and audit-block rates per domain and period."""
    rate = lambda c: F.avg(c.cast("double"))
    return links.groupBy("domain", F.date_trunc(grain, "created_at").cast("date").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("abstention_code").isNotNull()).alias("abstention_rate"),
        rate(F.col("blocking_code").isNotNull()).alias("block_rate"), rate(F.col("corrected")).alias("correction_rate"))


def quality_slices(links: DataFrame, slices: list[list[str]]) -> DataFrame:
    """The rates of :func:`quality_rates` for each named slice (domain, provider, day, parse grade, or several
    columns), all in one pass, with the slice's share of all links: over grades that is their distribution."""
    rate = lambda c: F.avg(c.cast("double"))
    total = links.agg(F.count(F.lit(1))).scalar()
    rows = named_slices(
        links, slices, F.count(F.lit(1)).alias("n"), rate(F.col("abstention_code").isNotNull()).alias("abstention_rate"),
        rate(F.col("blocking_code").isNotNull()).alias("block_rate"), rate(F.col("corrected")).alias("correction_rate"))
    return rows.withColumn("share", F.col("n") / total)


def review_priority(links: DataFrame) -> DataFrame:
    """Operational triage of links.

    critical: audit block, or a strong relation resting on no readable source; high: contradiction,
    overgeneralisation or scope mismatch; medium: indirect support, insufficient evidence or a weak
    stage; low: the rest.
    """
    relation = F.col("evidence_relation")
    strong = relation.isin("direct_support", "partial_support", "contradicts")
    level = (
        F.when(F.col("blocking_code").isNotNull()
               | (strong & F.col("access_level").isin("metadata_only", "not_accessible")), "critical")
        .when(relation.isin("contradicts", "overgeneralized", "scope_mismatch"), "high")
        .when(relation.isin("indirect_support", "insufficient_evidence")
              | (F.col("weakest_link") < vocab.PUBLISH_LIMITED), "medium")
        .otherwise("low"))
    return links.withColumn("review_priority", level)
