"""Vocabularies, thresholds, edges and profiles that results depend on."""

RELATIONS = [
    "direct_support", "partial_support", "indirect_support", "contradicts", "overgeneralized",
    "scope_mismatch", "no_relevant_evidence", "insufficient_evidence", "inaccessible_source",
]
INTENTS = [
    "background", "definition", "problem_framing", "method_adoption", "method_extension",
    "dataset_use", "metric_use", "benchmark_comparison", "result_support", "result_contrast",
    "limitation", "future_direction", "tool_or_software_use", "perfunctory_mention",
]
TRANSFORMATIONS = [
    "adopted_unchanged", "parameter_changed", "domain_transferred", "extended", "simplified",
    "combined", "benchmark_only", "dataset_reused", "metric_reused", "conceptual_inspiration",
]
ACCESS_LEVELS = [
    "user_private_full_text", "open_access_full_text", "repository_manuscript",
    "publisher_open_full_text", "abstract_only", "metadata_only", "not_accessible",
]
OPEN_FULL_TEXT = ["open_access_full_text", "publisher_open_full_text", "repository_manuscript"]
SPLITS = ["development", "calibration", "test", "challenge"]
DOMAINS = [
    "machine_learning", "natural_language_processing", "computer_vision", "robotics",
    "computational_biology", "physics", "economics", "psychology", "medicine", "chemistry",
    "earth_sciences", "mathematics",
]
LINK_STATUSES = ["verified", "limited", "review_required", "blocked"]
FEEDBACK_CATEGORIES = [
    "overall", "reference_resolution", "claim_span", "source_evidence", "relation",
    "transformation", "missing_evidence", "nuance", "explanation", "access", "other",
]

# Values of the annotation-row profile, which differ from the product enums above.
ANNOTATION_RESOLUTION = [
    "exact_version", "correct_work_wrong_or_uncertain_version", "ambiguous", "unresolved",
    "incorrect",
]
ANNOTATION_ACCESS = [
    "open_access_full_text", "open_access_abstract_only", "user_uploaded", "publisher_paywalled",
    "not_accessible",
]
ANNOTATION_STATUS = ["pending", "annotated_a", "annotated_b", "adjudicated", "rejected"]
ANNOTATION_COLUMNS = [
    "case_id", "split", "domain", "citing_asset_id", "citing_work_version_id",
    "citation_cluster_id", "citation_anchor_id", "reference_entry_id", "claim_text",
    "claim_start_offset", "claim_end_offset", "claim_qualifiers_json", "gold_work_id",
    "gold_work_version_id", "resolution_status", "source_access_level",
    "gold_source_span_ids_json", "gold_evidence_relation", "gold_scope_observations_json",
    "gold_citation_intents_json", "gold_transformations_json", "expected_abstention_code",
    "annotation_status", "annotator_a", "annotator_b", "adjudicator", "notes",
]
MERGE_SCALARS = [
    "gold_evidence_relation", "resolution_status", "source_access_level",
    "expected_abstention_code", "claim_text", "claim_start_offset", "claim_end_offset",
    "gold_work_id", "gold_work_version_id", "domain", "split",
]
MERGE_SETS = [
    "gold_citation_intents_json", "gold_transformations_json", "gold_source_span_ids_json",
    "gold_scope_observations_json", "claim_qualifiers_json",
]
DISAGREEMENT_FIELDS = [
    "gold_evidence_relation", "gold_citation_intents_json", "gold_transformations_json",
    "resolution_status", "source_access_level",
]

# Lifecycle: percent per state, terminal states and permitted moves.
STATE_PERCENT = {
    "created": 0.0, "validating": 5.0, "parsing": 15.0, "resolving_references": 30.0,
    "acquiring_sources": 45.0, "retrieving_evidence": 60.0, "verifying_relations": 75.0,
    "generating_explanations": 87.0, "auditing": 95.0, "completed": 100.0,
    "completed_with_limits": 100.0, "failed": 100.0, "cancelled": 100.0,
}
TERMINAL_STATES = ["completed", "completed_with_limits", "failed", "cancelled"]
# The states that each state may move to.
STATE_MOVES = {
    "created": ["validating", "cancelled"],
    "validating": ["parsing", "failed", "cancelled"],
    "parsing": ["resolving_references", "failed", "cancelled"],
    "resolving_references": ["acquiring_sources", "failed", "cancelled"],
    "acquiring_sources": ["retrieving_evidence", "failed", "cancelled"],
    "retrieving_evidence": ["verifying_relations", "failed", "cancelled"],
    "verifying_relations": ["generating_explanations", "failed", "cancelled"],
    "generating_explanations": ["auditing", "failed", "cancelled"],
    "auditing": ["completed", "completed_with_limits", "failed", "cancelled"],
}
STATE_EDGES = sorted((a, b) for a, moves in STATE_MOVES.items() for b in moves)

# Reference resolution.
RESOLUTION_WEIGHTS = {
    "identifier": 0.35, "title": 0.25, "authors": 0.15, "year": 0.08, "venue": 0.05,
    "version": 0.07, "provider_agreement": 0.05,
}
RESOLVE_ACCEPT, RESOLVE_MARGIN, RESOLVE_FLOOR = 0.90, 0.08, 0.80

# Confidence and publication.
STAGES = [
    "parse", "reference_resolution", "source_access", "evidence_retrieval",
    "relation_verification", "explanation_grounding",
]
PUBLISH_WEAKEST, PUBLISH_BALANCED, PUBLISH_LIMITED = 0.82, 0.86, 0.55

# Redaction patterns in order: regular expression and replacement.
REDACTIONS = [
    (r"(?U)Bearer\s+[a-zA-Z0-9\-\._~+/]+=*", "Bearer [REDACTED]"),
    (r"(?i)api[_-]?key[_-]?=?[a-zA-Z0-9\-\._~+/]+", "api_key=[REDACTED]"),
    (r"sk-[a-zA-Z0-9]{20,}", "sk-[REDACTED]"),
    (r"https?://[^/?#]+[^?#]*\?[^#]*X-Goog-Signature=[^&#]+", "[SIGNED_URL_REDACTED]"),
    (r"https?://[^/?#]+[^?#]*\?[^#]*X-Amz-Signature=[^&#]+", "[SIGNED_URL_REDACTED]"),
]
MARKUP_PATTERNS = [
    r"(?is)<(script|iframe|object|embed|applet)[^>]*>.*?</>",
    r"(?i)<(script|iframe|object|embed|applet)[^>]*>",
]
INJECTION_PHRASES = ["ignore previous", "system prompt", "instruction"]
METRIC_LABELS = ["stage", "status", "provider", "relation", "access_level", "reason_code"]
GENERATION_ROUTE = "main_generation_route"
EVIDENCE_EXEMPT = ["abstain", "insufficient_evidence", "inaccessible_source"]

MAX_ASSET_BYTES = 104_857_600
PDF_MAGIC = "%PDF-"

# Retention days per profile and artefact kind.
RETENTION_DAYS = {
    "standard-30d": {
        "uploaded_source_bytes": 30, "acquired_open_source_bytes": 90, "parsed_artifacts": 90,
        "generated_explanations": 365, "audit_metadata": 365, "raw_model_prompts": 0,
        "raw_model_outputs": 0, "feedback_events": 730,
    },
    "research-lab-180d": {
        "uploaded_source_bytes": 180, "acquired_open_source_bytes": 180, "parsed_artifacts": 365,
        "generated_explanations": 730, "audit_metadata": 730, "raw_model_prompts": 0,
        "raw_model_outputs": 0, "feedback_events": 1095,
    },
}
DELETION_GRACE_HOURS = 24

QUOTE_DISPLAY = {
    "user_private_full_text": "exact_evidence_spans",
    "open_access_full_text": "exact_evidence_spans",
    "repository_manuscript": "exact_evidence_spans",
    "publisher_open_full_text": "exact_evidence_spans",
    "abstract_only": "abstract_spans_only",
    "metadata_only": "metadata_fields_only",
    "not_accessible": "no_quote",
}

# Release rubric: metric, kind, operator, threshold.
RUBRIC = [
    ("fabricated_quote_count", "blocking", "eq", 0.0),
    ("schema_valid_rate", "blocking", "gte", 1.0),
    ("cross_tenant_access_failures", "blocking", "eq", 0.0),
    ("inaccessible_source_false_full_text_claims", "blocking", "eq", 0.0),
    ("unsupported_material_statement_rate", "blocking", "lte", 0.02),
    ("citation_anchor_precision", "quality", "gte", 0.98),
    ("citation_anchor_recall", "quality", "gte", 0.95),
    ("reference_resolution_top1_accuracy", "quality", "gte", 0.92),
    ("evidence_recall_at_5", "quality", "gte", 0.85),
    ("relation_macro_f1", "quality", "gte", 0.75),
    ("inaccessible_abstention_accuracy", "quality", "gte", 0.95),
    ("human_usefulness_mean", "quality", "gte", 4.0),
]
AGREEMENT_THRESHOLD = 0.7
MIN_CASES, MIN_DOMAINS = 300, 8

# Minimum composition of a release set: name and least number of cases.
RELEASE_MINIMUMS = [
    ("multi_reference_clusters", 50), ("inaccessible_or_abstract_only", 40),
    ("scope_overgeneral_contradiction", 40), ("method_transformation", 30),
    ("non_text_evidence", 30), ("adversarial", 30),
]

# Worker routes: event type, schema version, handler.
ROUTES = [
    ("analysis.references.ready", "1.0", "evidence"),
    ("document.source.registered", "1.0", "parse_source"),
]

# Event envelope and required payload keys per event type.
ENVELOPE_FIELDS = [
    "schema_version", "event_id", "event_type", "occurred_at", "trace_id", "workspace_id",
    "aggregate_type", "aggregate_id", "idempotency_key", "producer", "payload",
]
EVENT_PAYLOADS = {
    "analysis.requested": ["document_id", "mode", "scope", "audience", "source_policy_profile"],
    "analysis.cancel.requested": ["requested_by"],
    "analysis.stage.started": ["stage", "attempt", "input_fingerprint"],
    "analysis.stage.completed": [
        "stage", "attempt", "input_fingerprint", "output_artifact_ids", "limitations"],
    "analysis.stage.failed": ["stage", "attempt", "error_code", "retryable"],
    "source_asset.registered": ["checksum", "media_type", "access_level", "policy_profile"],
    "document.parsed": ["parsed_document_id", "parser_version", "quality_grade"],
    "document.parsing.limited": [
        "parsed_document_id", "parser_version", "quality_grade", "limitation_reason"],
    "document.parsing.failed": ["failure_reason"],
    "reference.resolved": [
        "resolution_id", "work_id", "work_version_id", "score", "margin", "decision_method"],
    "reference.resolution.ambiguous": ["resolution_id", "candidate_ids", "reason_codes"],
    "source.acquire.requested": ["work_version_id", "source_policy_profile"],
    "source.acquired": ["asset_id", "access_level", "acquisition_method"],
    "evidence.retrieved": ["query_plan_id", "candidate_ids", "retrieval_profile"],
    "relation.verified": ["evidence_link_id", "relation", "confidence_profile"],
    "evidence_link.audited": ["decision", "violation_codes"],
    "analysis.completed": ["status", "evidence_link_count", "limitation_count"],
    "feedback.submitted": ["feedback_event_id", "category", "verdict"],
    "document.source.registered": [
        "source_asset_id", "workspace_id", "sha256", "byte_size", "acquisition_method"],
    "reference.resolution.confirmed": ["resolution_id", "selected_candidate_id", "reason"],
    "analysis.references.ready": [
        "analysis_id", "total_references", "resolved", "ambiguous", "unresolved",
        "full_text_available", "abstract_only", "not_accessible", "limitations"],
    "document.references.resolved": ["parsed_document_id", "reference_pipeline_result"],
    "document.references.limited": ["parsed_document_id", "limitation_reasons"],
    "analysis.claims.extracted": ["analysis_id", "total_claims"],
    "analysis.evidence.retrieved": ["analysis_id", "total_candidates"],
    "analysis.relations.verified": ["analysis_id", "verified_relations"],
    "analysis.completed_with_limits": [
        "status", "evidence_link_count", "limitation_count", "limits"],
    "analysis.progress.updated": ["analysis_id", "sequence", "percent"],
}

# The columns of an exported evaluation case.
EXPORT_COLUMNS = [
    "case_id", "citing_claim", "cited_source", "citation_intents", "evidence_relation", "transformations",
    "confidence_vector", "audit_status", "limitations",
]
