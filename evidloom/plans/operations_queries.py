"""Registered source, lifecycle and operations queries (S1, S2, S4-S6, S8-S10, P9, W7-W12, O1, O2,
O4, A17, A26, A28, A29, D9, E10, K3, K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.operators import governance as G
from evidloom.operators import lifecycle as C
from evidloom.operators.families import leaking_families
from evidloom.plans.governance_queries import GRADE, RETENTION, retention
from evidloom.plans.registry import query
from evidloom.session import new_table_path, through_table
from evidloom.sources import files as S
from evidloom.sources import papers as X


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("s1_jsonl_cases", """
SELECT case_id, relation, len(citation_intents)::INT AS n_intents, synthetic FROM v_gold""")
def s1(v):
    path = new_table_path(v.spark, "cases")
    rows = v("v_gold").select(
        "case_id", F.lit("test").alias("split"), "synthetic", "domain",
        F.struct("relation", "citation_intents", "transformations").alias("gold"))
    # every case is written twice, the second time after a blank line; the later record wins
    twice = rows.withColumn("copy", F.explode(F.array(F.lit("old"), F.lit("new")))).withColumn(
        "split", F.col("copy")).drop("copy")
    twice.select(F.concat(F.lit("\n"), F.to_json(F.struct(*twice.columns))).alias("value")).write.text(path)
    cases = S.read_jsonl(v.spark, path, S.GOLD_CASE).where("case_id IS NOT NULL").drop("_corrupt_record")
    last = S.last_per_case(cases, F.when(F.col("split") == "new", 1).otherwise(0)).where("split = 'new'")
    return last.select("case_id", "gold.relation", F.size("gold.citation_intents").alias("n_intents"), "synthetic")


@query("s2_csv_jsonl_round_trip", """
SELECT case_id, claim_text, CAST(usefulness AS VARCHAR) AS usefulness,
       concat('["', array_to_string(gold_citation_intents_json, '","'), '"]') AS intents FROM v_annotations_a""")
def s2(v):
    rows = v("v_annotations_a").select("case_id", "claim_text", "usefulness", "gold_citation_intents_json")
    csv, jsonl = new_table_path(v.spark, "csv"), new_table_path(v.spark, "jsonl")
    S.jsonl_to_csv(rows, csv)
    S.csv_to_jsonl(v.spark, csv, rows.columns, jsonl)
    back = v.spark.read.schema(", ".join(f"{c} STRING" for c in rows.columns)).json(jsonl)
    return back.withColumnRenamed("gold_citation_intents_json", "intents")


def _papers(v, *tables):
    return X.parse_papers(v("v_papers").select("path", "content"), tables or X.TABLES)


@query("s4_paper_references", """
SELECT path, concat('b', path) AS xml_id, concat('[b', path, ']') AS label, concat('Cited ', path) AS title, concat('Kim Writer ', path) AS authors,
       '2020-05' AS year, concat('Journal ', path) AS venue, concat('10.1/', path) AS doi, CASE WHEN lang <> 'de' THEN '3,10.0,20.0' END AS coords
FROM v_papers WHERE lang <> 'es'""")
def s4a(v):
    return X.references(_papers(v, "refs")).select(
        "path", "xml_id", "label", "title", F.array_join("authors", "|").alias("authors"), "year", "venue",
        F.element_at("identifiers", "doi").alias("doi"), "coords")


@query("s4_citation_clusters", """
SELECT path, concat('[', path, ']') AS anchor_text, concat('b', path, '|c', path) AS targets, CASE WHEN lang <> 'de' THEN '3,10.0,20.0' END AS coords
FROM v_papers WHERE lang <> 'es'""")
def s4b(v):
    return X.clusters(_papers(v, "clusters")).select("path", "anchor_text", F.array_join("targets", "|").alias("targets"), "coords")


@query("s4_paper_sections", """
SELECT path, concat('sec', path) AS xml_id, concat('Part ', path) AS head, md5(concat('Part ', path, text, ' [', path, '] end.')) AS text_hash FROM v_papers WHERE lang <> 'es'""")
def s4c(v):
    return X.sections(_papers(v, "sections")).select("path", "xml_id", "head", F.md5("text").alias("text_hash"))


_COUNTERS = """
cnt AS (SELECT path, 1 AS total_citations, 1 AS linked_citations, 2 AS total_elements, CASE WHEN lang = 'de' THEN 0 ELSE 2 END AS elements_with_coords,
  length(text) + 2 * length(path) + 13 > 100 AS has_meaningful_text, true AS has_bibliography, false AS has_malformed_hierarchy, text
  FROM v_papers WHERE lang <> 'es')"""


@query("p9_document_counters", "WITH " + _COUNTERS + """
SELECT path, total_citations, linked_citations, total_elements, elements_with_coords, has_meaningful_text FROM cnt""")
def p9(v):
    parsed = through_table(_papers(v), "papers")
    return G.document_counters(X.references(parsed), X.clusters(parsed), X.sections(parsed)).select(
        "path", "total_citations", "linked_citations", "total_elements", "elements_with_coords", "has_meaningful_text")


_SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("k3_parsing_quality_job", "WITH " + _COUNTERS + "," + GRADE.format(src="cnt") + f""",
n AS (SELECT *, regexp_replace(nfc_normalize(concat('Part ', path, text, ' [', path, '] end.')), '{_SP}', ' ', 'g') AS norm FROM gr)
SELECT path, grade, CASE WHEN grade IN ('c', 'd') THEN 'document.parsing.limited' ELSE 'document.parsed' END AS event_type,
  CASE WHEN grade = 'd' THEN 'no_meaningful_text' WHEN grade = 'c' THEN 'material_linkage_or_coordinate_limitations' END AS limitation_reason,
  sha256(norm) AS text_sha256, strpos(norm, concat('[', path, ']')) - 1 AS anchor_start FROM n
UNION ALL SELECT path, NULL, 'document.parsing.failed', 'parsing_failed', NULL, NULL FROM v_papers WHERE lang = 'es'""")
def k3(v):
    # one parse of the corpus serves counters, normalised text, anchors and failures
    parsed = through_table(_papers(v), "papers")
    marks, secs = X.clusters(parsed), X.sections(parsed)
    grades = G.parse_grade(G.document_counters(X.references(parsed), marks, secs))
    # the sections of one document make up one text
    text = secs.where("text <> ''").groupBy("path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ").alias("raw"))
    norm = text.select("path", T.normalise(F.col("raw")).alias("norm"))
    anchors = marks.join(norm, "path").select("path", T.find_anchor(
        F.col("norm"), T.normalise(F.col("anchor_text"))).cast("bigint").alias("at"))
    first = anchors.groupBy("path").agg(F.min("at").alias("anchor_start"))
    limited = F.col("grade").isin("c", "d")
    good = grades.join(norm, "path").join(first, "path", "left").select(
        "path", "grade", F.when(limited, "document.parsing.limited").otherwise("document.parsed").alias("event_type"),
        F.when(limited, F.get("limitations", F.lit(0))).alias("limitation_reason"),
        T.text_fingerprint(F.col("norm")).alias("text_sha256"), "anchor_start")
    none = lambda t: F.lit(None).cast(t)
    failed = parsed.where("error IS NOT NULL").select(
        "path", none("string"), F.lit("document.parsing.failed"), F.lit("parsing_failed"), none("string"), none("bigint"))
    return good.union(failed)


@query("s5_asset_checks", """
SELECT page_id, sha256(c) AS sha256, octet_length(encode(c)) AS byte_size, CASE WHEN page_id % 3 = 0 THEN 'accepted' ELSE 'invalid_magic' END AS code
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('%PDF-', html) ELSE html END AS c FROM pages)""")
def s5(v):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-"), F.col("html"))).otherwise(F.col("html"))
    return S.asset_checks(v("pages").select("page_id", body.alias("content"))).select("page_id", "sha256", "byte_size", "code")


@query("s6_insert_if_absent", """
WITH i AS (SELECT doc_id, concat('ws', CAST(length(source) % 3 AS STRING)) AS workspace_id, sha256(text) AS sha, lang FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY workspace_id, sha ORDER BY doc_id) = 1
  AND NOT EXISTS (SELECT 1 FROM i e WHERE e.lang = 'de' AND e.workspace_id = i.workspace_id AND e.sha = i.sha) AS created,
  concat('workspaces/', workspace_id, '/source-assets/', substr(sha, 1, 2), '/', sha, '.pdf') AS object_key FROM i""")
def s6(v):
    rows = v("documents").select(
        "doc_id", F.concat(F.lit("ws"), (F.length("source") % 3).cast("string")).alias("workspace_id"),
        F.sha2("text", 256).alias("sha256"), "lang")
    return C.new_assets(rows, rows.where("lang = 'de'"), "doc_id").select("doc_id", "created", "object_key")


ENVELOPE_PROBLEM = """CASE WHEN event_id % 17 = 0 THEN 'missing_field:workspace_id' WHEN event_id % 20 = 19 THEN 'unsupported_version'
  WHEN event_type = 'purchase' THEN 'unknown_type' WHEN event_type = 'signup' THEN 'missing_payload:source_asset_id,workspace_id,sha256,byte_size,acquisition_method'
  WHEN event_type = 'click' THEN 'missing_payload:parser_version,quality_grade,limitation_reason' END"""


@query("s8_event_envelopes", f"SELECT event_id, {ENVELOPE_PROBLEM} AS problem FROM events")
def s8(v):
    rows = v("v_envelopes").withColumnRenamed("event_id", "source_id")
    return S.read_envelopes(rows, "envelope", ["source_id"]).select(F.col("source_id").alias("event_id"), "problem")


@query("s9_declared_tables", """
SELECT evidence_relation, count(*) AS n, count(abstention_code) AS abstained FROM v_links WHERE workspace_id = 'ws1' GROUP BY evidence_relation""")
def s9(v):
    path = new_table_path(v.spark, "evidence_link")
    S.write_declared(v("v_links"), "evidence_link", path)
    rows = G.in_workspace(S.read_declared(v.spark, "evidence_link", path), "ws1")
    return rows.groupBy("evidence_relation").agg(
        F.count(F.lit(1)).alias("n"), F.count("abstention_code").alias("abstained"))


@query("s10_synthetic_cases", """
SELECT concat('synth-', CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 4 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END) AS case_id,
  ['direct_support','partial_support','indirect_support','contradicts','overgeneralized','scope_mismatch','no_relevant_evidence','insufficient_evidence','inaccessible_source'][o_orderkey % 9 + 1] AS relation,
  CASE WHEN o_orderkey % 9 = 8 THEN 'not_accessible' ELSE 'open_access_full_text' END AS source_access_level,
  CASE WHEN o_orderkey % 9 = 8 THEN 'inaccessible_source' END AS abstention FROM orders""")
def s10(v):
    return C.synthetic_cases(v("orders").select("o_orderkey"), "o_orderkey").select(
        "case_id", "relation", "source_access_level", "abstention")


DOC_STATUS = """
SELECT aggregate_id,
  CASE arg_max(event_type, (occurred_at, event_id)) FILTER (WHERE event_type IN ('document.parsing.failed', 'document.parsing.limited', 'document.parsed'))
    WHEN 'document.parsing.failed' THEN 'failed' WHEN 'document.parsing.limited' THEN 'parsed_with_limits' WHEN 'document.parsed' THEN 'parsed'
    ELSE CASE WHEN bool_or(event_type = 'document.source.registered') THEN 'parsing' ELSE 'registered' END END AS status,
  arg_max(quality_grade, (occurred_at, event_id)) FILTER (WHERE event_type IN ('document.parsing.limited', 'document.parsed')) AS latest_quality_grade,
  arg_max(reason, (occurred_at, event_id)) FILTER (WHERE event_type IN ('document.parsing.failed', 'document.parsing.limited')) AS limitation
FROM v_parse_events GROUP BY aggregate_id"""


@query("w7_document_status", DOC_STATUS)
def w7(v):
    return C.document_status(v("v_parse_events"), ["occurred_at", "event_id"]).select(
        "aggregate_id", "status", "latest_quality_grade", "limitation")


_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in C.vocab.STATE_EDGES)
_PCT = " ".join(f"WHEN '{s}' THEN {p}" for s, p in C.vocab.STATE_PERCENT.items())
TRANSITIONS = f"""
WITH RECURSIVE e(f, t) AS (VALUES {_EDGES}),
h AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY occurred_at, event_id) AS rn FROM v_lifecycle),
r AS (
  SELECT event_id, analysis_id, status, rn, NULL::VARCHAR AS previous, status AS state FROM h WHERE rn = 1
  UNION ALL
  SELECT h.event_id, h.analysis_id, h.status, h.rn, r.state,
         CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.f = r.state AND e.t = h.status) THEN h.status ELSE r.state END
  FROM r JOIN h ON h.analysis_id = r.analysis_id AND h.rn = r.rn + 1)
SELECT event_id, analysis_id, status, previous, CASE WHEN previous IS NULL THEN 'start' WHEN previous = status THEN 'same'
  WHEN state = status THEN 'accepted' ELSE 'invalid' END AS outcome, (CASE status {_PCT} END)::DOUBLE AS percent FROM r"""


@query("w8_transition_check", TRANSITIONS)
def w8(v):
    return C.transition_check(v("v_lifecycle"), "analysis_id", ["occurred_at", "event_id"]).select(
        "event_id", "analysis_id", "status", "previous", "outcome", "percent")


REPLAY = """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY occurred_at, event_id) AS seq FROM v_lifecycle),
p AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY seq) AS position FROM s WHERE seq > analysis_id % 7),
e AS (SELECT *, coalesce(sum((status = 'failed')::INT) OVER (PARTITION BY analysis_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM p WHERE position <= 50)
SELECT analysis_id, event_id, seq, position FROM e WHERE ended = 0"""


def sequenced(v):
    return C.number_rows(v("v_lifecycle"), ["analysis_id"], ["occurred_at", "event_id"],
                         F.to_date("occurred_at"), "seq")


@query("w9_replay_after_cursor", REPLAY)
def w9(v):
    rows = sequenced(v)
    cursors = v("v_lifecycle").select("analysis_id").distinct().withColumn("cursor", F.col("analysis_id") % 7)
    return C.replay_after(rows, cursors, "analysis_id", "seq", F.col("status") == "failed").select(
        "analysis_id", "event_id", "seq", "position")


IDEMPOTENT = """
SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN event_type = first_value(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS outcome
FROM v_outbox WINDOW w AS (PARTITION BY workspace_id, idempotency_key ORDER BY occurred_at, event_id)"""


@query("w10_idempotent_create", IDEMPOTENT)
def w10(v):
    return C.idempotent_requests(v("v_outbox"), ["workspace_id", "idempotency_key"], ["occurred_at", "event_id"],
                                 "event_type").select("event_id", "outcome")


ATTEMPTS = """
SELECT run, stage, fingerprint, status, events, row_number() OVER (PARTITION BY run, stage ORDER BY first_seen, fingerprint) AS attempt FROM (
  SELECT aggregate_id AS run, event_type AS stage, k AS fingerprint, min(occurred_at) AS first_seen, arg_max(status, (occurred_at, event_id)) AS status, count(*) AS events
  FROM v_outbox GROUP BY ALL)"""


def attempt_events(v):
    return v("v_outbox").select(
        F.col("aggregate_id").alias("run"), F.col("event_type").alias("stage"), F.col("k").alias("fingerprint"),
        "status", "occurred_at", "event_id")


@query("w11_stage_attempts", ATTEMPTS)
def w11(v):
    return C.stage_attempts(attempt_events(v), "run", "stage", "fingerprint", ["occurred_at", "event_id"]).select(
        "run", "stage", "fingerprint", "status", "events", F.col("attempt").cast("bigint").alias("attempt"))


@query("w12_stage_durations", """
SELECT event_id, status, round((epoch_us(lead(occurred_at) OVER (PARTITION BY analysis_id ORDER BY occurred_at, event_id)) - epoch_us(occurred_at)) / 1e6, 6) AS seconds FROM v_lifecycle""")
def w12(v):
    return C.stage_durations(v("v_lifecycle"), "analysis_id", ["occurred_at", "event_id"]).select(
        "event_id", "status", *r6("seconds"))


QUEUE = """
SELECT feedback_id, CASE WHEN category IN ('source_evidence', 'reference_resolution') THEN 90.0 ELSE 50.0 END::DOUBLE AS priority_score, 1 AS reported_issue_count
FROM v_feedback ORDER BY priority_score DESC, created_at, feedback_id"""


@query("o1_adjudication_queue", QUEUE)
def o1(v):
    return C.adjudication_queue(v("v_feedback")).select("feedback_id", "priority_score", "reported_issue_count")


_PRIORITY = " UNION ALL ".join(
    f"SELECT reference_entry_id, '{m}' AS mode, intent_count, least(1, " + " + ".join(
        f"CASE WHEN {f} THEN {w} ELSE 0 END::DOUBLE" for mm, f, w in C.PRIORITY_WEIGHTS if mm == m) + ") AS raw FROM v_priority_refs"
    for m in dict.fromkeys(m for m, _, _ in C.PRIORITY_WEIGHTS))


@query("o2_reading_priority", f"""
SELECT reference_entry_id, mode, score, CASE WHEN score >= 0.8 THEN 'must_read' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT *, round(CASE WHEN raw = 0 AND intent_count > 0 THEN 0.5 ELSE raw END, 6) AS score FROM ({_PRIORITY}))""")
def o2(v):
    return C.reading_priority(v("v_priority_refs")).select("reference_entry_id", "mode", *r6("score"), "band")


@query("o2_default_profile", """
SELECT reference_entry_id, CASE WHEN list_contains(citation_intents, 'method') THEN 0.5 WHEN list_contains(citation_intents, 'background') THEN 0.5 ELSE 0.5 END::DOUBLE AS score,
  CASE WHEN list_contains(citation_intents, 'method') THEN 'adopted_method' WHEN list_contains(citation_intents, 'background') THEN 'background' ELSE 'default_reason' END AS reasons
FROM v_references""")
def o2b(v):
    rows = C.reading_priority(C.intent_features(v("v_references"))).where("mode = 'implement'")
    return rows.select("reference_entry_id", "score", F.array_join("reasons", ",").alias("reasons"))


@query("o4_fifo_and_top_k", """
SELECT aggregate_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY k DESC, event_id) AS rank FROM v_outbox) WHERE rank <= 3""")
def o4(v):
    from evidloom.operators.skew import top_rows

    return top_rows(v("v_outbox"), ["aggregate_id"], [F.desc("k"), F.asc("event_id")], 3).select(
        "aggregate_id", "event_id", "rank")


@query("a17_latency_percentiles", """
SELECT stage, count(*) AS n, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM v_samples GROUP BY stage
UNION ALL SELECT '(all)', count(*), round(quantile_cont(duration_ms, 0.5), 6), round(quantile_cont(duration_ms, 0.95), 6), round(quantile_cont(duration_ms, 0.99), 6) FROM v_samples""")
def a17(v):
    return C.latency_summary(v("v_samples")).select("stage", "n", *r6("p50", "p95", "p99"))


@query("a17_load_summary", """
SELECT count(*) AS sample_count, round(count(*) / avg(duration_ms / 1000), 6) AS throughput_rps,
  round(count(*) / (max(epoch_us(started_at) / 1e6 + duration_ms / 1000) - min(epoch_us(started_at) / 1e6)), 6) AS observed_rps FROM v_samples""")
def a17b(v):
    return C.load_summary(v("v_samples")).select("sample_count", *r6("throughput_rps", "observed_rps"))


@query("a17_status_counts", """
SELECT CASE WHEN http_status = 0 THEN 'error' ELSE CAST(http_status AS VARCHAR) END AS status, count(*) AS n FROM v_samples GROUP BY ALL""")
def a17c(v):
    return C.status_counts(v("v_samples"))


def _cost(by):
    return f"""
SELECT {by}, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  round(sum(cost_usd), 4) AS cost_usd, round(avg(latency_ms), 6) AS mean_latency_ms, sum(retry_count)::BIGINT AS retries,
  round(sum(cost_usd) / (SELECT count(*) FROM v_links WHERE evidence_relation = 'direct_support'), 6) AS cost_per_verified_link
FROM v_executions GROUP BY ROLLUP ({by})"""


def _cost_rows(v, by):
    verified = v("v_links").where("evidence_relation = 'direct_support'").agg(F.count(F.lit(1)))
    return C.cost_rollup(v("v_executions"), F.lit(verified.scalar()), by).select(
        *by, "calls", "input_tokens", "output_tokens",
        F.round("cost_usd", 4).alias("cost_usd"), *r6("mean_latency_ms"), "retries", *r6("cost_per_verified_link"))


@query("a26_cost_rollup", _cost("provider, model, stage, purpose, workspace_id"))
def a26(v):
    return _cost_rows(v, C.COST_DIMENSIONS)


@query("a26_cost_by_analysis", _cost("analysis_run_id, stage"))
def a26_analysis(v):
    return _cost_rows(v, ("analysis_run_id", "stage"))


def _steps(v):
    return v("events").select("user_id", F.col("event_type").alias("step"), F.col("ts").alias("at"))


@query("a28_activation_funnel", """
WITH s0 AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id),
s1 AS (SELECT user_id, t0, min(ts) AS t FROM s0 JOIN events USING (user_id) WHERE event_type = 'view' AND ts > t0 AND ts <= t0 + INTERVAL 3 DAY GROUP BY ALL),
s2 AS (SELECT user_id, t0, min(ts) AS t FROM s1 JOIN events USING (user_id) WHERE event_type = 'click' AND ts > s1.t AND ts <= t0 + INTERVAL 3 DAY GROUP BY ALL),
s3 AS (SELECT user_id, t0, min(ts) AS t FROM s2 JOIN events USING (user_id) WHERE event_type = 'purchase' AND ts > s2.t AND ts <= t0 + INTERVAL 3 DAY GROUP BY ALL)
SELECT 0 AS position, 'signup' AS step, (SELECT count(*) FROM s0) AS users UNION ALL SELECT 1, 'view', (SELECT count(*) FROM s1)
UNION ALL SELECT 2, 'click', (SELECT count(*) FROM s2) UNION ALL SELECT 3, 'purchase', (SELECT count(*) FROM s3)""")
def a28(v):
    return C.activation_funnel(_steps(v), ["signup", "view", "click", "purchase"], window_days=3)


@query("a28_weekly_retention", """
WITH w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events)
SELECT a.week, count(*) AS active, count(b.user_id) AS returning FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.week = a.week + 7 GROUP BY a.week""")
def a28b(v):
    return C.weekly_retention(_steps(v))


@query("a29_workload_distribution", """
WITH m AS (SELECT n_chars::DOUBLE AS chars, ceil(n_chars / 500)::DOUBLE AS chunks, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::DOUBLE AS tokens FROM documents),
l AS (SELECT 'chars' AS measure, chars AS value FROM m UNION ALL SELECT 'chunks', chunks FROM m UNION ALL SELECT 'tokens', tokens FROM m)
SELECT measure, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM l GROUP BY measure""")
def a29(v):
    rows = v("documents").select(F.col("n_chars").alias("chars"), F.ceil(F.col("n_chars") / 500).alias("chunks"),
                                 T.token_count(F.col("text")).alias("tokens"))
    return C.workload_distribution(rows, ["chars", "chunks", "tokens"]).select("measure", "n", *r6("p50", "p90", "p99"))


@query("d9_split_leakage", f"""
WITH f AS (SELECT doc_id, doc_id % 4 AS split, sha256(regexp_replace(regexp_replace(nfc_normalize(lower(text)), '{_SP}', ' ', 'g'), '^ | $', '', 'g')) AS family FROM documents)
SELECT min(doc_id) AS first_doc, count(DISTINCT split) AS splits, count(*) AS members FROM f GROUP BY family HAVING count(DISTINCT split) > 1""")
def d9(v):
    rows = v("documents").select("doc_id", (F.col("doc_id") % 4).alias("split"), "text")
    return C.split_leakage(rows).select("first_doc", "splits", "members")


@query("d9_near_families", f"""
WITH RECURSIVE w AS (SELECT doc_id, string_split(norm, ' ') AS ws FROM (
  SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(lower(text)), '{_SP}', ' ', 'g'), '^ | $', '', 'g') AS norm FROM documents) WHERE norm <> ''),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 4 * count(*) >= 3 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
f AS (SELECT x, min(y) AS family FROM r GROUP BY x)
SELECT family, count(DISTINCT x % 4) AS splits, count(*) AS members FROM f GROUP BY family HAVING count(DISTINCT x % 4) > 1""")
def d9_near(v):
    return leaking_families(v("documents").select("doc_id", (F.col("doc_id") % 4).alias("split"), "text"))


@query("e10_retention_sweep", f"SELECT state, count(*) AS n FROM ({RETENTION}) WHERE state IN ('purge_due', 'expiring') GROUP BY state")
def e10(v):
    due = retention(v).where("state IN ('purge_due', 'expiring')")
    return due.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


ALERTS = """
WITH w AS (SELECT unnest(generate_series(date_trunc('minute', ts) - INTERVAL 4 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS start, event_type FROM events),
c AS (SELECT start, count(*) FILTER (WHERE event_type = 'signup') AS created, count(*) FILTER (WHERE event_type = 'error') AS failed,
  count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'click') AS quote_failures FROM w GROUP BY start)"""


def alert_counts(events):
    """Counts per sliding five-minute window, batch or streaming."""
    kind = lambda k, n: F.count_if(F.col("event_type") == k).alias(n)
    return events.groupBy(F.window("at", "5 minutes", "1 minute")).agg(
        kind("signup", "created"), kind("error", "failed"), kind("purchase", "completed"),
        kind("click", "quote_failures"),
    ).select(F.col("window.start").alias("start"), "created", "failed", "completed", "quote_failures")


def _held(rule, minutes):
    return (f"(SELECT count(*) FILTER (p.{rule}) FROM s p WHERE p.start BETWEEN s.start - INTERVAL {minutes - 1} MINUTE "
            f"AND s.start) = {minutes}")


ALERTS_OUT = ALERTS + f""",
s AS (SELECT *, created > 0 AND completed = 0 AS stall, failed > 0 AND failed * 10 > created AS failing,
  quote_failures / 300.0 > 10 AS quotes FROM c)
SELECT epoch(start)::BIGINT AS start_s, created, failed, {_held("failing", 5)} AS failure_rate_high,
  {_held("quotes", 5)} AS quote_failures_high, {_held("stall", 10)} AS stalled FROM s"""


@query("e7_alert_windows_batch", ALERTS_OUT)
def e7_batch(v):
    events = v("events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return C.alert_windows(alert_counts(events)).select(
        F.unix_seconds("start").alias("start_s"), "created", "failed", "failure_rate_high", "quote_failures_high", "stalled")


@query("k7_operations_job", """
SELECT (SELECT count(*) FROM v_outbox WHERE schema_version = '1.0' AND event_type IN ('analysis.references.ready', 'document.source.registered')) AS handled,
  (SELECT count(*) FROM (SELECT DISTINCT aggregate_id FROM v_outbox)) AS documents,
  (SELECT round(quantile_cont(duration_ms, 0.95), 6) FROM v_samples) AS p95,
  (SELECT round(sum(cost_usd), 4) FROM v_executions) AS cost_usd,
  (SELECT count(*) FROM v_outbox WHERE status IN ('pending', 'failed')) AS open_events""")
def k7(v):
    routed = G.route_events(v("v_outbox")).agg(F.count_if(F.col("action") == "handle").alias("handled"))
    status = C.document_status(v("v_parse_events"), ["occurred_at", "event_id"]).agg(F.count(F.lit(1)))
    p95 = C.exact_percentiles(v("v_samples"), [], "duration_ms", {"p95": 0.95}).select(F.round("p95", 6))
    cost = v("v_executions").agg(F.round(F.sum("cost_usd"), 4))
    waiting = G.pending_view(v("v_outbox").withColumn("created_at", F.col("occurred_at")),
                             F.lit("2024-02-01").cast("timestamp_ntz")).agg(F.sum("n"))
    return routed.select("handled", status.scalar().alias("documents"), p95.scalar().alias("p95"),
                         cost.scalar().alias("cost_usd"), waiting.scalar().alias("open_events"))
