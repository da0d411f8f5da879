"""Registered governance queries (P1-P5, P8, P10-P17, P19-P21, D1, D4-D7, J3, J7, J8, J12-J15,
A16, A18, A27, F10, F11, F14, F17-F19, O5, K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom import vocab
from evidloom.functions import text as T
from evidloom.operators import governance as G
from evidloom.operators import retrieval as R
from evidloom.operators.skew import lead_rows
from evidloom.plans.registry import query

_ST = ", ".join(f"coalesce({s}, 1.0::DOUBLE)" for s in vocab.STAGES)
_CL = [f"greatest(0::DOUBLE, least(1::DOUBLE, coalesce({s}, 1.0::DOUBLE)))" for s in vocab.STAGES]
CONFIDENCE = f"""
WITH conf AS (SELECT *, least({_ST}) AS weakest_link,
  CASE WHEN least({', '.join(_CL)}) = 0 THEN 0::DOUBLE ELSE exp((ln(nullif({_CL[0]}, 0)) + {' + '.join(f'ln(nullif({c}, 0))' for c in _CL[1:])}) / 6) END AS balanced_score
  FROM v_links)
"""
_STATUS = """CASE WHEN weakest_link >= 0.82 AND balanced_score >= 0.86 THEN 'verified' WHEN weakest_link >= 0.55 THEN 'limited' ELSE 'blocked' END"""
STATUS = CONFIDENCE + f", pub AS (SELECT *, {_STATUS} AS status FROM conf)\n"


def _published(v):
    rows = G.confidence(v("v_links"))
    # thresholds are met by values such as 1 - 0.18, so the last bits are rounded away first
    return rows.withColumn("status", G.publish_status(F.col("weakest_link"), F.col("balanced_score")))


@query("p1_link_page", STATUS + """
SELECT link_id, evidence_relation, has_more FROM (SELECT link_id, evidence_relation, count(*) OVER () > 50 AS has_more, row_number() OVER (ORDER BY created_at, link_id) AS rn
  FROM pub WHERE workspace_id = 'ws1' AND status = 'limited'
  AND (created_at, link_id) > (TIMESTAMP '1997-01-01', '')) WHERE rn <= 50""")
def p1(v):
    # the page runs over one workspace here, since an analysis of the fixture has only few links
    links = _published(v).withColumn("analysis_run_id", F.col("workspace_id"))
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    return G.list_links(links, "ws1", status="limited", cursor=(at, "")).select(
        "link_id", "evidence_relation", "has_more")


@query("p2_workspace_filter", "SELECT link_id FROM v_links WHERE workspace_id = 'ws2'")
def p2(v):
    return G.in_workspace(v("v_links"), "ws2").select("link_id")


@query("p3_inherited_visibility", """
SELECT node_id FROM v_nodes n WHERE EXISTS (SELECT 1 FROM documents d JOIN v_assets a ON a.asset_id = d.doc_id % 97
  WHERE d.doc_id = n.doc_id AND a.workspace_id = 'ws1')""")
def p3(v):
    docs = v("documents").select("doc_id", (F.col("doc_id") % 97).alias("source_asset_id"))
    return G.visible_children(v("v_nodes"), [
        ("doc_id", docs, "doc_id"), ("source_asset_id", v("v_assets"), "asset_id")], "ws1").select("node_id")


@query("j8_semi_and_anti_joins", """
SELECT 'visible' AS side, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j8(v):
    docs, labels = v("documents").select("doc_id"), v("labels").select("doc_id")
    n = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(docs.join(labels, "doc_id", "left_semi"), "visible").union(
        n(docs.join(labels, "doc_id", "left_anti"), "missing"))


RETENTION = """
SELECT asset_id, CASE WHEN deleted THEN 'purged' WHEN is_oa AND has_abstract THEN 'live'
  WHEN req IS NOT NULL AND req + 1 <= DATE '2024-03-15' THEN 'purge_due' WHEN req IS NOT NULL THEN 'tombstoned'
  WHEN retention_expires_on + CASE retention_profile WHEN 'standard-30d' THEN 30 ELSE 180 END <= DATE '2024-03-15' THEN 'expiring' ELSE 'live' END AS state
FROM (SELECT *, CASE WHEN host_type = 'other' THEN DATE '2024-03-10' WHEN access_level = 'abstract_only' THEN DATE '2024-03-15' END AS req FROM v_assets)"""


def retention(v):
    day = lambda s: F.lit(s).cast("date")
    assets = v("v_assets").select(
        "asset_id", "retention_profile", "deleted", F.col("retention_expires_on").alias("acquired_on"),
        (F.col("is_oa") & F.col("has_abstract")).alias("legal_hold"),
        F.when(F.col("host_type") == "other", day("2024-03-10"))
        .when(F.col("access_level") == "abstract_only", day("2024-03-15")).alias("delete_requested_on"))
    return G.retention_state(assets, day("2024-03-15")).select("asset_id", "state")


@query("p4_retention_state", RETENTION)
def p4(v):
    return retention(v)


@query("p5_claimable_events", """
SELECT event_id, event_type, attempts + 1 AS attempts FROM v_outbox WHERE status IN ('pending', 'failed') AND occurred_at <= TIMESTAMP '2024-01-20'
ORDER BY occurred_at, event_id LIMIT 20""")
def p5(v):
    rows = v("v_outbox").withColumn("available_at", F.col("occurred_at")).withColumn("created_at", F.col("occurred_at"))
    return G.claimable_events(rows, F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "event_type", "attempts")


@query("e11_pending_view", """
SELECT event_type, status, count(*) AS n, max(attempts) AS max_attempts, count(*) FILTER (WHERE attempts > 0) AS retried,
       max(date_sub('second', occurred_at, TIMESTAMP '2024-02-01')) AS oldest_age_s
FROM v_outbox WHERE status IN ('pending', 'failed') GROUP BY ALL""")
def e11(v):
    rows = v("v_outbox").withColumn("created_at", F.col("occurred_at"))
    return G.pending_view(rows, F.lit("2024-02-01").cast("timestamp_ntz"))


GRADE = """
g AS (SELECT *, CASE WHEN total_citations > 0 THEN linked_citations::DOUBLE / total_citations ELSE 1 END AS linkage,
  CASE WHEN total_elements > 0 THEN elements_with_coords::DOUBLE / total_elements ELSE 1 END AS cov FROM {src}),
gr AS (SELECT *, CASE WHEN NOT has_meaningful_text OR NOT has_bibliography OR has_malformed_hierarchy THEN 'd'
  WHEN linkage >= 0.98 AND cov >= 0.90 THEN 'a' WHEN linkage >= 0.90 AND cov >= 0.70 THEN 'b' ELSE 'c' END AS grade FROM g)"""


@query("p8_parse_grade", "WITH " + GRADE.format(src="v_parse_counters") + """
SELECT document_id, grade, round(linkage, 6) AS linkage, round(cov, 6) AS coordinate_coverage,
  array_to_string(list_filter([CASE WHEN NOT has_meaningful_text THEN 'no_meaningful_text' END, CASE WHEN NOT has_bibliography THEN 'no_bibliography' END,
    CASE WHEN has_malformed_hierarchy THEN 'malformed_hierarchy' END, CASE WHEN grade = 'c' THEN 'material_linkage_or_coordinate_limitations' END], lambda x: x IS NOT NULL), ',') AS limitations
FROM gr""")
def p8(v):
    return G.parse_grade(v("v_parse_counters")).select(
        "document_id", "grade", F.round("linkage", 6).alias("linkage"),
        F.round("coordinate_coverage", 6).alias("coordinate_coverage"), F.array_join("limitations", ",").alias("limitations"))


@query("a16_confidence_rollup", CONFIDENCE + """
SELECT link_id, round(weakest_link, 6) AS weakest_link, round(balanced_score, 6) AS balanced_score FROM conf""")
def a16(v):
    return G.confidence(v("v_links")).select(
        "link_id", F.round("weakest_link", 6).alias("weakest_link"), F.round("balanced_score", 6).alias("balanced_score"))


@query("p10_publish_status", STATUS + "SELECT link_id, status FROM pub")
def p10(v):
    return _published(v).select("link_id", "status")


@query("p11_relation_rule", """
SELECT link_id, CASE WHEN access_level = 'not_accessible' THEN 'inaccessible_source' WHEN explanation_grounding IS NULL THEN 'no_relevant_evidence' ELSE 'direct_support' END AS relation FROM v_links""")
def p11(v):
    spans = F.when(F.col("explanation_grounding").isNull(), 0).otherwise(1)
    return v("v_links").select("link_id", R.relation_rule(F.col("access_level"), spans).alias("relation"))


def _audit_input(v):
    texts = v("v_spans").join(v("documents").select("doc_id", "text", "lang"), "doc_id")
    n = F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1)
    kind = F.when(F.col("doc_id") % 3 == 0, "evidence_based").otherwise("limitation")
    ids = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s")))
    return texts.select(
        "doc_id", F.col("text").alias("source_text"), "quote", "start_offset", "end_offset",
        F.when(F.col("lang") == "fr", "insufficient_evidence").otherwise("direct_support").alias("evidence_relation"),
        n.alias("n_spans"), F.array(F.struct(kind.alias("kind"), ids.alias("span_ids"))).alias("statements"),
        F.lit("abstract_only").alias("claimed_access"),
        F.when(F.col("lang") == "de", "metadata_only").otherwise("abstract_only").alias("asset_access"),
        F.when(F.col("lang") == "es", "main_generation_route").otherwise("audit_route").alias("auditor_route"))


@query("p12_evidence_audit", """
WITH a AS (SELECT doc_id, text, lang, quote, start_offset, end_offset, CASE WHEN lang = 'fr' THEN true ELSE doc_id % 4 <> 0 END AS has_evidence,
  doc_id % 6 <> 0 AS grounded FROM v_spans JOIN documents USING (doc_id))
SELECT doc_id, contains(text, quote) AS quote_contained, start_offset >= 0 AND end_offset <= length(text) AND start_offset <= end_offset AS offsets_valid,
  has_evidence, grounded AS statements_grounded, lang <> 'de' AS access_disclosed, true AS schema_ok,
  NOT (contains(lower(quote), 'ignore previous') OR contains(lower(quote), 'system prompt') OR contains(lower(quote), 'instruction')) AS injection_free,
  lang <> 'es' AS auditor_independent,
  array_to_string(list_filter([CASE WHEN NOT has_evidence THEN 'missing_evidence' END, CASE WHEN NOT grounded THEN 'ungrounded_statement' END], lambda x: x IS NOT NULL), ',') AS blocking_codes,
  CASE WHEN has_evidence AND grounded THEN 'passed' ELSE 'blocked' END AS audit_status FROM a""")
def p12(v):
    return G.audit(_audit_input(v)).select(
        "doc_id", "quote_contained", "offsets_valid", "has_evidence", "statements_grounded", "access_disclosed",
        "schema_ok", "injection_free", "auditor_independent", F.array_join("blocking_codes", ",").alias("blocking_codes"),
        "audit_status")


@query("p13_url_admission", """
SELECT asset_id, url, CASE WHEN NOT starts_with(url, 'https://') THEN 'SCHEME_NOT_ALLOWED' END AS denial FROM v_assets
UNION ALL SELECT asset_id, concat('https://10.0.0.', CAST(asset_id % 250 AS STRING), '/x'), 'PRIVATE_ADDRESS' FROM v_assets
UNION ALL SELECT asset_id, concat('https://user@host', CAST(asset_id AS STRING), '.org:8443/x'), 'CREDENTIALS_NOT_ALLOWED' FROM v_assets
UNION ALL SELECT asset_id, concat('https://host', CAST(asset_id AS STRING), '.org:8443/x'), 'PORT_NOT_ALLOWED' FROM v_assets
UNION ALL SELECT asset_id, concat('https://host', CAST(asset_id AS STRING), '.org:99999999999/x'), 'PORT_NOT_ALLOWED' FROM v_assets
UNION ALL SELECT asset_id, concat('https://[::ffff:', CAST(asset_id % 224 AS STRING), '.9.8.7]/x'),
  CASE WHEN asset_id % 224 IN (0, 10, 127) THEN 'PRIVATE_ADDRESS' END FROM v_assets
UNION ALL SELECT asset_id, concat('https://[26', CAST(10 + asset_id % 90 AS STRING), ':db8::1]/x'), NULL FROM v_assets""")
def p13(v):
    a, n = v("v_assets"), F.col("asset_id").cast("string")
    made = [
        F.col("url"), F.concat(F.lit("https://10.0.0."), (F.col("asset_id") % 250).cast("string"), F.lit("/x")),
        F.concat(F.lit("https://user@host"), n, F.lit(".org:8443/x")),
        F.concat(F.lit("https://host"), n, F.lit(".org:8443/x")),
        F.concat(F.lit("https://host"), n, F.lit(".org:99999999999/x")),
        F.concat(F.lit("https://[::ffff:"), (F.col("asset_id") % 224).cast("string"), F.lit(".9.8.7]/x")),
        F.concat(F.lit("https://[26"), (F.col("asset_id") % 90 + 10).cast("string"), F.lit(":db8::1]/x"))]
    return a.select("asset_id", F.explode(F.array(*made)).alias("url")).select(
        "asset_id", "url", T.url_denial(F.col("url")).alias("denial"))


_RED = r"""regexp_replace(regexp_replace(regexp_replace(message, 'Bearer\s+[a-zA-Z0-9\-\._~+/]+=*', 'Bearer [REDACTED]', 'g'),
  'api[_-]?key[_-]?=?[a-zA-Z0-9\-\._~+/]+', 'api_key=[REDACTED]', 'gi'), 'sk-[a-zA-Z0-9]{20,}', 'sk-[REDACTED]', 'g')"""


@query("p14_secret_redaction", f"""
SELECT log_id, md5({_RED}) AS redacted_hash, len(regexp_extract_all(message, 'Bearer\\s+[a-zA-Z0-9\\-\\._~+/]+=*'))::INT AS hits_1,
       len(regexp_extract_all(message, '(?i)api[_-]?key[_-]?=?[a-zA-Z0-9\\-\\._~+/]+'))::INT AS hits_2 FROM v_logs""")
def p14(v):
    hits = T.redaction_hits(F.col("message"))
    return v("v_logs").select("log_id", F.md5(T.redact(F.col("message"))).alias("redacted_hash"), hits[0], hits[1])


@query("p15_markup_sanitiser", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?is)<(script|iframe|object|embed|applet)[^>]*>.*?</>', '', 'g'),
  '(?i)<(script|iframe|object|embed|applet)[^>]*>', '', 'g')) AS clean_hash FROM pages""")
def p15(v):
    return v("pages").select("page_id", F.md5(T.sanitise_markup(F.col("html"))).alias("clean_hash"))


@query("p16_injection_phrases", """
SELECT log_id, contains(lower(message), 'ignore previous') OR contains(lower(message), 'system prompt') OR contains(lower(message), 'instruction') AS flagged FROM v_logs""")
def p16(v):
    return v("v_logs").select("log_id", T.has_injection_phrase(F.col("message")).alias("flagged"))


@query("p17_evaluation_export", """
SELECT link_id AS case_id, concat('claim of ', analysis_run_id) AS claim_text, sha256(workspace_id) AS claim_user, access_level AS source_access,
  CASE WHEN access_level <> 'user_private_full_text' THEN concat('quote ', link_id) END AS source_quote, 1 AS intents, evidence_relation, 0 AS n_transformations,
  parse AS parse_confidence, CASE WHEN blocking_code IS NULL THEN 'passed' ELSE 'blocked' END AS audit_status,
  CASE WHEN abstention_code IS NULL THEN [] ELSE [abstention_code] END AS limitations FROM v_links""")
def p17(v):
    rows = v("v_links").select(
        F.col("link_id").alias("case_id"),
        F.struct(F.concat(F.lit("claim of "), F.col("analysis_run_id").cast("string")).alias("text"),
                 F.col("workspace_id").alias("user_id")).alias("citing_claim"),
        F.struct("access_level", F.concat(F.lit("quote "), F.col("link_id")).alias("quote")).alias("cited_source"),
        F.array(F.lit("background")).alias("citation_intents"), "evidence_relation",
        F.array().cast("array<string>").alias("transformations"), F.struct("parse").alias("confidence_vector"),
        F.when(F.col("blocking_code").isNull(), "passed").otherwise("blocked").alias("audit_status"),
        F.array_compact(F.array("abstention_code")).alias("limitations"), "workspace_id")
    out = G.export_cases(rows)
    return out.select(
        "case_id", F.col("citing_claim.text").alias("claim_text"), F.col("citing_claim.user_id").alias("claim_user"),
        F.col("cited_source.access_level").alias("source_access"), F.col("cited_source.quote").alias("source_quote"),
        F.size("citation_intents").alias("intents"), "evidence_relation", F.size("transformations").alias("n_transformations"),
        F.col("confidence_vector.parse").alias("parse_confidence"), "audit_status", "limitations")


@query("p19_metric_labels", """
SELECT sample_id, CASE WHEN http_status = 429 THEN 'user_id' END AS bad FROM v_samples WHERE http_status = 429""")
def p19(v):
    labels = F.when(F.col("http_status") == 429, F.create_map(
        F.lit("stage"), F.col("stage"), F.lit("user_id"), F.lit("u"))).otherwise(
        F.create_map(F.lit("stage"), F.col("stage"), F.lit("status"), F.col("http_status").cast("string")))
    bad = G.invalid_label_rows(v("v_samples").withColumn("labels", labels))
    return bad.select("sample_id", F.array_join("bad_labels", ",").alias("bad"))


@query("p20_quote_display", """
SELECT asset_id, CASE WHEN access_level IN ('user_private_full_text', 'open_access_full_text', 'repository_manuscript', 'publisher_open_full_text')
  OR (access_level = 'abstract_only' AND has_abstract) THEN url END AS displayed_quote FROM v_assets""")
def p20(v):
    spans = v("v_assets").select("asset_id", "access_level", F.col("url").alias("quote"),
                                 F.when(F.col("has_abstract"), "abstract_span").otherwise("text_span").alias("evidence_type"))
    return G.displayed_quotes(spans).select("asset_id", "displayed_quote")


@query("p21_time_window", "SELECT count(*) AS n FROM v_links WHERE created_at >= TIMESTAMP '1998-06-01 00:00:00'")
def p21(v):
    return G.since_instant(v("v_links"), "created_at", "1998-06-01T00:00:00Z").agg(F.count(F.lit(1)).alias("n"))


@query("f19_iso_instants", """
SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events""")
def f19(v):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return v("events").select("event_id", F.unix_millis(T.instant(iso)).alias("millis"))


@query("f14_json_paths", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def f14(v):
    return v("events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("f11_fingerprints", """
SELECT page_id, sha256(html) AS text_sha256, sha256(concat(html, 'parser-v1')) AS fingerprint, concat('doc_', substr(sha256(concat(html, 'parser-v1')), 1, 16)) AS document_id,
       sha256(concat('{"page_id":', CAST(page_id AS VARCHAR), ',"missing":null}')) AS request_sha256
FROM pages""")
def f11(v):
    mark = T.parse_fingerprint(F.col("html"), "parser-v1")
    return v("pages").select(
        "page_id", T.text_fingerprint(F.col("html")).alias("text_sha256"), mark.alias("fingerprint"),
        T.document_id(mark).alias("document_id"),
        T.request_fingerprint(F.col("page_id"), F.lit(None).cast("string").alias("missing")).alias("request_sha256"))


@query("f10_find_anchor", """
SELECT doc_id, strpos(text, quote) - 1 AS anchor_start, strpos(text, quote) - 1 + length(quote) AS anchor_end, split_part(coords, ',', 1) AS page
FROM (SELECT *, concat(CAST(doc_id % 9 AS STRING), ',1.0,2.0') AS coords FROM v_spans JOIN documents USING (doc_id)) WHERE strpos(text, quote) > 0""")
def f10(v):
    rows = v("v_spans").join(v("documents").select("doc_id", "text"), "doc_id")
    coords = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(",1.0,2.0"))
    at = T.find_anchor(F.col("text"), F.col("quote")).cast("bigint")
    return rows.select("doc_id", at.alias("anchor_start"), (at + F.char_length("quote")).alias("anchor_end"),
                       T.page_of(coords).alias("page")).where("anchor_start IS NOT NULL")


_PCT = " ".join(f"WHEN '{s}' THEN {p}" for s, p in vocab.STATE_PERCENT.items())


@query("f17_state_percent", f"""
SELECT event_id, (CASE status {_PCT} END)::DOUBLE AS percent, status IN ('completed', 'completed_with_limits', 'failed', 'cancelled') AS terminal FROM v_lifecycle""")
def f17(v):
    return v("v_lifecycle").select("event_id", T.state_percent(F.col("status")).alias("percent"),
                                   T.is_terminal(F.col("status")).alias("terminal"))


@query("f18_object_keys", """
SELECT asset_id, concat('workspaces/', workspace_id, '/source-assets/', substr(sha256(content), 1, 2), '/', sha256(content), '.pdf') AS source_key,
       concat('workspaces/', workspace_id, '/tei/', sha256(content), '.xml') AS text_key FROM v_assets""")
def f18(v):
    sha = F.sha2("content", 256)
    return v("v_assets").select("asset_id", T.source_key(F.col("workspace_id"), sha).alias("source_key"),
                                T.structured_text_key(F.col("workspace_id"), sha).alias("text_key"))


@query("d1_constraint_report", """
WITH h AS (SELECT link_id, 'score_in_range' AS rule FROM v_links WHERE NOT (relation_verification BETWEEN 0.5 AND 1)
  UNION ALL SELECT link_id, 'known_access' FROM v_links WHERE access_level = 'metadata_only'
  UNION ALL SELECT link_id, 'inaccessible_needs_level' FROM v_links WHERE evidence_relation = 'inaccessible_source' AND access_level <> 'not_accessible'
  UNION ALL SELECT link_id, 'year_in_range' FROM v_links WHERE year(created_at) NOT BETWEEN 1400 AND 2000),
r AS (SELECT rule, count(*) AS violations, array_to_string(list_sort(list(link_id) FILTER (WHERE rn <= 3)), ',') AS sample_keys
      FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY link_id) AS rn FROM h) GROUP BY rule)
SELECT n.rule, coalesce(violations, 0) AS violations, sample_keys FROM (VALUES ('score_in_range'), ('known_access'), ('inaccessible_needs_level'), ('year_in_range')) n(rule) LEFT JOIN r USING (rule)""")
def d1(v):
    rules = {
        "score_in_range": F.col("relation_verification").between(0.5, 1),
        "known_access": F.col("access_level") != "metadata_only",
        "inaccessible_needs_level": (F.col("evidence_relation") != "inaccessible_source") | (F.col("access_level") == "not_accessible"),
        "year_in_range": F.year("created_at").between(1400, 2000)}
    return G.constraint_report(v("v_links"), rules, "link_id")


@query("d4_link_semantics", """
WITH s AS (SELECT span_id AS link_id, * FROM v_spans)
SELECT link_id, 'invalid_offsets' AS problem FROM s WHERE end_offset <= start_offset
UNION ALL SELECT link_id, 'quote_hash_mismatch' FROM s WHERE doc_id % 9 = 0
UNION ALL SELECT link_id, 'checksum_drift' FROM s WHERE doc_id % 10 = 0
UNION ALL SELECT link_id, 'asset_not_in_provenance' FROM s WHERE doc_id % 12 = 0
UNION ALL SELECT link_id, 'unknown_supporting_id' FROM s WHERE doc_id % 14 = 0""")
def d4(v):
    n = F.col("doc_id")
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    links = v("v_spans").select(
        F.col("span_id").alias("link_id"), "start_offset", "end_offset", "quote",
        F.when(n % 9 == 0, "0").otherwise(F.sha2("quote", 256)).alias("quote_sha256"),
        arr("s1").alias("span_ids"), F.lit("claim").alias("claim_id"),
        F.when(n % 12 == 0, arr("a9")).otherwise(arr("a1")).alias("span_assets"),
        arr("a1", "a2").alias("provenance_assets"),
        F.when(n % 10 == 0, arr("a1")).otherwise(arr("a1", "a2")).alias("checksum_assets"),
        F.when(n % 14 == 0, arr("s1", "zz")).otherwise(arr("s1", "claim")).alias("supporting_ids"))
    return G.link_semantics(links)


@query("d5_provenance_invariants", """
WITH s AS (SELECT * FROM v_spans JOIN documents USING (doc_id))
SELECT 'offsets_within_text' AS invariant, count(*) FILTER (WHERE end_offset > length(text)) AS violations FROM s
UNION ALL SELECT 'quote_checksum_matches', count(*) FILTER (WHERE substring(text, start_offset + 1, end_offset - start_offset) <> quote) FROM s
UNION ALL SELECT 'compatible_version', count(*) FILTER (WHERE doc_id % 8 = 0) FROM s
UNION ALL SELECT 'no_metadata_only_support', count(*) FILTER (WHERE lang = 'de') FROM s
UNION ALL SELECT 'no_deleted_asset_served', count(*) FILTER (WHERE doc_id % 15 = 0) FROM s
UNION ALL SELECT 'fingerprint_present', count(*) FILTER (WHERE lang = 'es') FROM s""")
def d5(v):
    n = F.col("doc_id")
    rows = v("v_spans").join(v("documents").select("doc_id", "text", "lang"), "doc_id").select(
        "text", "quote", F.sha2("quote", 256).alias("quote_sha256"), "start_offset", "end_offset",
        F.when(F.col("lang") == "de", "metadata_only").otherwise("abstract_only").alias("access_level"),
        F.lit("direct_support").alias("evidence_relation"), F.lit(1).alias("link_version"),
        F.when(n % 8 == 0, 2).otherwise(1).alias("span_version"), (n % 3 == 0).alias("asset_deleted"),
        (n % 5 == 0).alias("served"), F.when(F.col("lang") != "es", "f").alias("input_fingerprint"))
    return G.provenance_invariants(rows)


@query("d6_supersession_check", """
WITH RECURSIVE h AS (SELECT event_id AS id, aggregate_id, CASE WHEN k = 7 THEN event_id
   WHEN k < 50 THEN lead(event_id) OVER (PARTITION BY aggregate_id ORDER BY event_id) END AS nxt FROM v_outbox),
c AS (SELECT aggregate_id, count(*) FILTER (WHERE nxt IS NULL) AS n FROM h GROUP BY aggregate_id),
w(id, root) AS (SELECT id, id FROM h WHERE nxt = id UNION SELECT h.id, w.root FROM h JOIN w ON h.nxt = w.id)
SELECT id, 'several_current_rows' AS problem FROM h JOIN c USING (aggregate_id) WHERE nxt IS NULL AND n > 1
UNION ALL SELECT DISTINCT id, 'pointer_cycle' FROM w""")
def d6(v):
    rows = lead_rows(v("v_outbox"), ["aggregate_id"], ["event_id"], F.floor(F.col("event_id") / 1000), ["event_id"])
    history = rows.select(
        F.col("event_id").alias("id"), F.col("aggregate_id").alias("reference_entry_id"),
        F.when(F.col("k") == 7, F.col("event_id")).when(F.col("k") < 50, F.col("next.event_id")).alias("superseded_by_id"))
    return G.supersession_problems(history)


@query("d7_pipeline_completeness", """
SELECT link_id, 'explanation_grounding' AS missing_fields FROM v_links WHERE explanation_grounding IS NULL""")
def d7(v):
    bad = G.incomplete_payloads(v("v_links"), ["link_id", "workspace_id", "evidence_relation", "explanation_grounding"])
    return bad.select("link_id", F.array_join("missing_fields", ",").alias("missing_fields"))


@query("j3_work_lookup", """
WITH works AS (SELECT reference_entry_id AS work_id, '10.1000/' || reference_entry_id AS doi, lower(title) AS title FROM v_references WHERE venue <> 'MACHINERY'),
rec AS (SELECT reference_entry_id AS record_id, doi, CASE WHEN venue <> 'BUILDING' THEN title END AS title FROM v_references)
SELECT record_id, coalesce(d.work_id, t.work_id) AS work_id, d.work_id IS NULL AND t.work_id IS NULL AND (r.doi IS NOT NULL OR r.title IS NOT NULL) AS skipped
FROM rec r LEFT JOIN works d ON d.doi = r.doi LEFT JOIN works t ON t.title = lower(r.title)""")
def j3(v):
    refs = v("v_references")
    works = refs.where("venue <> 'MACHINERY'").select(
        F.col("reference_entry_id").alias("work_id"),
        F.concat(F.lit("10.1000/"), F.col("reference_entry_id").cast("string")).alias("doi"), "title")
    records = refs.select(F.col("reference_entry_id").alias("record_id"), "doi",
                          F.when(F.col("venue") != "BUILDING", F.col("title")).alias("title"))
    return G.lookup_works(records, works).select("record_id", "work_id", "skipped")


@query("j7_blocked_links", """
SELECT workspace_id, count(*) AS n FROM v_links WHERE blocking_code = 'cross_tenant_access' GROUP BY workspace_id""")
def j7(v):
    audits = v("v_links").select("link_id", F.array_compact(F.array("blocking_code")).alias("blocking_codes")).distinct()
    return G.blocked_links(v("v_links"), audits, "cross_tenant_access")


@query("j12_anchor_rows", """
WITH m AS (SELECT o_orderkey AS cluster_id, o_custkey % 25 AS document_id, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [NULL]
  ELSE [concat('b', CAST(o_custkey AS STRING)), concat('b', CAST(o_orderkey AS STRING))] END) AS xml_id FROM orders)
SELECT cluster_id, m.xml_id, c_custkey AS reference_entry_id FROM m LEFT JOIN customer ON m.document_id = c_custkey % 25 AND m.xml_id = concat('b', CAST(c_custkey AS STRING))""")
def j12(v):
    b = lambda c: F.concat(F.lit("b"), F.col(c).cast("string"))
    clusters = v("orders").select(
        (F.col("o_custkey") % 25).alias("document_id"), F.col("o_orderkey").alias("cluster_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(
            F.array(b("o_custkey"), b("o_orderkey"))).alias("targets"))
    references = v("customer").select(
        (F.col("c_custkey") % 25).alias("document_id"), b("c_custkey").alias("xml_id"),
        F.col("c_custkey").alias("reference_entry_id"))
    return G.anchor_rows(clusters, references).select("cluster_id", "xml_id", "reference_entry_id")


@query("j13_smallest_container", """
SELECT span_id, (SELECT arg_min(node_id, (n.end_offset - n.start_offset) * 1000000000 + node_id) FROM v_nodes n
  WHERE n.doc_id = c.doc_id AND n.start_offset <= c.start_offset AND c.end_offset <= n.end_offset) AS node_id
FROM (SELECT doc_id, claim_id AS span_id, start_offset, end_offset FROM v_claims) c""")
def j13(v):
    spans = v("v_claims").select("doc_id", F.col("claim_id").alias("span_id"), "start_offset", "end_offset")
    return G.smallest_container(spans, v("v_nodes")).select("span_id", "node_id")


@query("j14_link_upsert", """
WITH cur AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '1-URGENT'),
up AS (SELECT o_orderkey AS k, lower(o_orderpriority) AS status FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(cur.k, up.k) AS k, o_custkey, CASE WHEN up.k IS NOT NULL THEN up.status ELSE cur.status END AS status,
       CASE WHEN cur.k IS NULL THEN 'inserted' WHEN up.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
FROM cur FULL JOIN up ON cur.k = up.k""")
def j14(v):
    o = v("orders")
    current = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderstatus").alias("status"))
    updates = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lower("o_orderpriority").alias("status"))
    return G.upsert_links(current, updates, ["k"], ["status"])


ROUTED = """
SELECT event_id, CASE WHEN schema_version = '1.0' AND event_type = 'analysis.references.ready' THEN 'evidence'
  WHEN schema_version = '1.0' AND event_type = 'document.source.registered' THEN 'parse_source' END AS handler,
  CASE WHEN schema_version = '1.0' AND event_type IN ('analysis.references.ready', 'document.source.registered') THEN 'handle' ELSE 'acknowledge' END AS action
FROM v_outbox"""


@query("j15_event_routing", ROUTED)
def j15(v):
    return G.route_events(v("v_outbox")).select("event_id", "handler", "action")


_ROLL = """SELECT analysis_run_id, count(*) AS total_cases, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'limited') AS limited,
  count(*) FILTER (WHERE status = 'review_required') AS review_required, count(*) FILTER (WHERE status = 'blocked') AS blocked,
  CASE WHEN count(*) FILTER (WHERE status = 'limited') > 0 THEN 'completed_with_limits' ELSE 'completed' END AS analysis_status FROM {src} GROUP BY analysis_run_id"""


@query("a18_outcome_rollup", STATUS + _ROLL.format(src="pub"))
def a18(v):
    return G.outcome_rollup(_published(v))


@query("a27_quality_rates", """
SELECT domain, CAST(date_trunc('month', created_at) AS DATE) AS period, count(*) AS n, round(avg((abstention_code IS NOT NULL)::INT::DOUBLE), 6) AS abstention_rate,
  round(avg((blocking_code IS NOT NULL)::INT::DOUBLE), 6) AS block_rate, round(avg((explanation_grounding IS NULL)::INT::DOUBLE), 6) AS correction_rate FROM v_links GROUP BY ALL""")
def a27(v):
    rows = v("v_links").withColumn("corrected", F.col("explanation_grounding").isNull())
    return G.quality_rates(rows).select("domain", "period", "n", *[
        F.round(c, 6).alias(c) for c in ("abstention_rate", "block_rate", "correction_rate")])


_GRADE = "CASE WHEN parse >= 0.98 THEN 'a' WHEN parse >= 0.95 THEN 'b' WHEN parse >= 0.93 THEN 'c' ELSE 'd' END"
_PROVIDER = "CASE analysis_run_id % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' ELSE 'semanticscholar' END"


@query("a27_quality_slices", f"""
WITH l AS (SELECT domain, {_PROVIDER} AS provider, CAST(created_at AS DATE) AS day, {_GRADE} AS grade, abstention_code, blocking_code,
           explanation_grounding IS NULL AS corrected FROM v_links)
SELECT concat_ws(',', CASE WHEN grouping(domain) = 0 THEN 'domain' END, CASE WHEN grouping(provider) = 0 THEN 'provider' END,
         CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(grade) = 0 THEN 'grade' END) AS slice,
       domain, provider, day, grade, count(*) AS n, round(avg((abstention_code IS NOT NULL)::INT::DOUBLE), 6) AS abstention_rate,
       round(avg((blocking_code IS NOT NULL)::INT::DOUBLE), 6) AS block_rate, round(avg(corrected::INT::DOUBLE), 6) AS correction_rate,
       round(count(*)::DOUBLE / (SELECT count(*) FROM l), 6) AS share
FROM l GROUP BY GROUPING SETS ((domain), (provider), (day), (grade), (provider, grade))""")
def a27_slices(v):
    rows = v("v_links").withColumn("corrected", F.col("explanation_grounding").isNull()).withColumns({
        "provider": F.expr(_PROVIDER), "day": F.col("created_at").cast("date"), "grade": F.expr(_GRADE)})
    found = G.quality_slices(rows, [["domain"], ["provider"], ["day"], ["grade"], ["provider", "grade"]])
    return found.select("slice", "domain", "provider", "day", "grade", "n", *[
        F.round(c, 6).alias(c) for c in ("abstention_rate", "block_rate", "correction_rate", "share")])


@query("o5_review_priority", CONFIDENCE + """
SELECT link_id, CASE WHEN blocking_code IS NOT NULL OR (evidence_relation IN ('direct_support', 'partial_support', 'contradicts') AND access_level IN ('metadata_only', 'not_accessible')) THEN 'critical'
  WHEN evidence_relation IN ('contradicts', 'overgeneralized', 'scope_mismatch') THEN 'high'
  WHEN evidence_relation IN ('indirect_support', 'insufficient_evidence') OR weakest_link < 0.55 THEN 'medium' ELSE 'low' END AS review_priority FROM conf""")
def o5(v):
    rows = G.confidence(v("v_links"))
    return G.review_priority(rows).select("link_id", "review_priority")


@query("k4_link_publication_job", STATUS + """,
au AS (SELECT *, CASE WHEN explanation_grounding IS NULL AND evidence_relation NOT IN ('insufficient_evidence', 'inaccessible_source') THEN 'blocked' ELSE status END AS final FROM pub),
fin AS (SELECT analysis_run_id, final AS status FROM au)
""" + _ROLL.format(src="fin"))
def k4(v):
    rows = _published(v).withColumns({
        "source_text": F.lit("x"), "quote": F.lit("x"), "start_offset": F.lit(0), "end_offset": F.lit(1),
        "n_spans": F.when(F.col("explanation_grounding").isNull(), 0).otherwise(1),
        "statements": F.array().cast("array<struct<kind:string,span_ids:array<string>>>"),
        "claimed_access": F.col("access_level"), "asset_access": F.col("access_level"),
        "auditor_route": F.lit("audit_route")})
    audited = G.audit(rows)
    final = F.when(F.col("audit_status") == "blocked", "blocked").otherwise(F.col("status"))
    return G.outcome_rollup(audited.withColumn("status", final))
