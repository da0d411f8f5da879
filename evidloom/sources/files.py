"""Readers and writers of evaluation data, assets and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidloom import vocab

GOLD_CASE = """case_id STRING, split STRING, synthetic BOOLEAN, domain STRING,
claim STRUCT<text: STRING, qualifiers: ARRAY<STRUCT<kind: STRING, text: STRING>>>,
source_access_level STRING, source_spans ARRAY<STRUCT<id: STRING, quote: STRING, evidence_type: STRING>>,
gold STRUCT<relation: STRING, citation_intents: ARRAY<STRING>, transformations: ARRAY<STRING>,
abstention: STRUCT<code: STRING>>"""
PREDICTION = """case_id STRING, relation STRING, source_span_ids ARRAY<STRING>,
citation_intents ARRAY<STRING>, transformations ARRAY<STRING>, abstention STRUCT<code: STRING>,
fabricated_quote BOOLEAN, material_statements ARRAY<STRUCT<text: STRING, supporting_source_span_ids: ARRAY<STRING>>>"""

# Declared tables: name -> schema and partition column.
CATALOGUE: dict[str, tuple[str, str | None]] = {
    "workspace": ("id STRING, slug STRING, retention_profile STRING, source_policy_profile STRING, deleted_at TIMESTAMP", None),
    "work_version": ("id STRING, work_id STRING, version_kind STRING, title STRING, authors ARRAY<STRING>, publication_year INT, venue STRING, identifiers MAP<STRING, STRING>", None),
    "source_asset": ("id STRING, work_version_id STRING, sha256 STRING, media_type STRING, byte_size BIGINT, access_level STRING, retention_expires_at TIMESTAMP, deleted_at TIMESTAMP, workspace_id STRING", "workspace_id"),
    "parsed_document": ("id STRING, source_asset_id STRING, normalized_text STRING, normalized_text_sha256 STRING, parse_quality_grade STRING, coordinate_coverage DECIMAL(5,4)", None),
    "parsed_node": ("id STRING, parsed_document_id STRING, node_type STRING, order_index INT, section_path ARRAY<STRING>, start_offset INT, end_offset INT, text_content STRING", None),
    "reference_entry": ("id STRING, parsed_document_id STRING, local_label STRING, raw_reference STRING, parsed_title STRING, parsed_authors ARRAY<STRING>, parsed_year INT, parsed_venue STRING, parsed_identifiers MAP<STRING, STRING>", None),
    "citation_cluster": ("id STRING, parsed_document_id STRING, anchor_text STRING, start_offset INT, end_offset INT", None),
    "citation_anchor": ("id STRING, citation_cluster_id STRING, reference_entry_id STRING, parser_link_confidence DECIMAL(5,4)", None),
    "reference_candidate": ("id STRING, reference_entry_id STRING, provider STRING, provider_record_id STRING, total_score DECIMAL(7,6), hard_conflicts ARRAY<STRING>", None),
    "reference_resolution": ("id STRING, reference_entry_id STRING, status STRING, selected_candidate_id STRING, absolute_score DECIMAL(7,6), score_margin DECIMAL(7,6), superseded_by_id STRING, created_at TIMESTAMP", None),
    "citing_claim": ("id STRING, citation_cluster_id STRING, parsed_document_id STRING, claim_text STRING, start_offset INT, end_offset INT", None),
    "source_chunk": ("id STRING, parsed_document_id STRING, section_path ARRAY<STRING>, evidence_type STRING, start_offset INT, end_offset INT, chunk_text STRING, embedding ARRAY<FLOAT>", None),
    "source_span": ("id STRING, source_asset_id STRING, access_level STRING, evidence_type STRING, start_offset INT, end_offset INT, quote STRING, quote_sha256 STRING", None),
    "evidence_link": ("link_id STRING, analysis_run_id BIGINT, evidence_relation STRING, access_level STRING, abstention_code STRING, created_at TIMESTAMP_NTZ, workspace_id STRING", "workspace_id"),
    "explanation_statement": ("id STRING, evidence_link_id STRING, statement_kind STRING, statement_text STRING, supporting_source_span_ids ARRAY<STRING>, confidence DECIMAL(5,4)", None),
    "feedback_event": ("id STRING, evidence_link_id STRING, category STRING, comment STRING, idempotency_key STRING, created_at TIMESTAMP, workspace_id STRING", "workspace_id"),
    "audit_decision": ("id STRING, evidence_link_id STRING, status STRING, blocking_codes ARRAY<STRING>, created_at TIMESTAMP", None),
    "analysis_run": ("id STRING, status STRING, idempotency_key STRING, input_fingerprint STRING, total_cost_usd DECIMAL(12,6), started_at TIMESTAMP, completed_at TIMESTAMP, workspace_id STRING", "workspace_id"),
    "analysis_stage_run": ("id STRING, analysis_run_id STRING, stage_name STRING, attempt INT, input_fingerprint STRING, status STRING, started_at TIMESTAMP, finished_at TIMESTAMP", None),
    "model_execution": ("id STRING, analysis_stage_run_id STRING, purpose STRING, provider STRING, model_id STRING, input_tokens INT, output_tokens INT, latency_ms INT, cost_usd DECIMAL(12,6), retry_count INT, created_at TIMESTAMP", None),
    "outbox_event": ("id STRING, aggregate_type STRING, aggregate_id STRING, event_type STRING, schema_version STRING, payload STRING, status STRING, attempts INT, available_at TIMESTAMP, created_at TIMESTAMP, workspace_id STRING", "workspace_id"),
}


def declared(table: str) -> StructType:
    return StructType.fromDDL(CATALOGUE[table][0])


def read_declared(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Parquet read with the declared schema; partitioned tables prune by workspace."""
    return spark.read.schema(declared(table)).parquet(path)


def write_declared(rows: DataFrame, table: str, path: str) -> None:
    """Cast to the declared columns and write, clustered by the partition column.

    A rebalance by workspace splits one that holds most of the data by its size, and packs small ones.
    """
    schema, part = declared(table), CATALOGUE[table][1]
    out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if part is None:
        out.write.parquet(path)
    else:
        out.hint("rebalance", part).write.partitionBy(part).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line with an explicit schema; blank lines are skipped and a broken line
    shows in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record STRING").json(path, mode="PERMISSIVE")


def last_per_case(rows: DataFrame, order: Column) -> DataFrame:
    """Keep the last record of a duplicated case id by an explicit ordinal."""
    cols = [c for c in rows.columns if c != "case_id"]
    return rows.groupBy("case_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("case_id", "r.*")


def duplicate_cases(rows: DataFrame) -> DataFrame:
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def jsonl_to_csv(rows: DataFrame, path: str) -> None:
    """Array and map columns as JSON text, column order kept."""
    nested = ("array", "map", "struct")
    out = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name).cast("string").alias(f.name)
        for f in rows.schema
    ]
    rows.select(*out).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def csv_to_jsonl(spark: SparkSession, csv_path: str, columns: list[str], path: str) -> None:
    """Every CSV value stays a string."""
    schema = ", ".join(f"{c} STRING" for c in columns)
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(csv_path)
    rows.write.option("ignoreNullFields", False).json(path)


def asset_checks(assets: DataFrame, content: str = "content", max_bytes: int = vocab.MAX_ASSET_BYTES) -> DataFrame:
    """sha256, byte size and acceptance of binary assets; the size test comes first."""
    data = F.col(content).cast("binary")
    size = F.octet_length(data)
    magic = F.substring(data, 1, len(vocab.PDF_MAGIC)) == F.lit(vocab.PDF_MAGIC).cast("binary")
    code = F.when(size > max_bytes, "byte_limit_exceeded").when(~magic, "invalid_magic").otherwise("accepted")
    return assets.withColumns({"sha256": F.sha2(data, 256), "byte_size": size.cast("bigint"), "code": code})


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


ENVELOPE = """schema_version STRING, event_id STRING, event_type STRING, occurred_at STRING, trace_id STRING,
workspace_id STRING, aggregate_type STRING, aggregate_id STRING, idempotency_key STRING, producer STRING,
causation_id STRING, correlation_id STRING, payload MAP<STRING, STRING>"""


def read_envelopes(rows: DataFrame, json_col: str, keep: list[str], major: str = "1") -> DataFrame:
    """Parsed envelopes with ``problem`` (NULL when valid).

    Order of tests: required envelope fields, major version, known type, required payload keys.
    Unknown optional fields are ignored.
    """
    parsed = rows.select(*keep, F.from_json(json_col, ENVELOPE).alias("e"))
    missing = F.array_compact(F.array(*[
        F.when(F.col(f"e.{f}").isNull(), F.lit(f)) for f in vocab.ENVELOPE_FIELDS]))
    catalogue = F.create_map(*[
        x for k, need in vocab.EVENT_PAYLOADS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in need]))])
    need = F.element_at(catalogue, F.col("e.event_type"))
    absent = F.array_except(need, F.map_keys("e.payload"))
    problem = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_field:"), F.array_join(missing, ",")))
        .when(F.split_part(F.col("e.schema_version"), F.lit("."), F.lit(1)) != major, "unsupported_version")
        .when(need.isNull(), "unknown_type")
        .when(F.size(absent) > 0, F.concat(F.lit("missing_payload:"), F.array_join(absent, ","))))
    return parsed.select(*keep, "e.*", problem.alias("problem"))
