"""Table schemas, schema checks and the owner filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table layouts.
TABLE_DDL = {
    "documents": (
        "collection string, doc_id string, source_path string, file_type string, content_hash string, "
        "uploaded_at timestamp, title string, language string, user_id bigint"
    ),
    "parses": (
        "collection string, doc_id string, parse_hash string, parser string, created_at timestamp, "
        "params_json string, parsed_content string, user_id bigint"
    ),
    "chunks": (
        "collection string, doc_id string, parse_hash string, chunk_id string, index int, text string, "
        "page_number int, section string, anchor string, json_path string, chunk_hash string, "
        "config_hash string, created_at timestamp, metadata string, user_id bigint"
    ),
    "embeddings": (
        "collection string, doc_id string, chunk_id string, parse_hash string, model string, model_tag string, "
        "vector array<float>, vector_dimension int, text string, chunk_hash string, created_at timestamp, "
        "metadata string, user_id bigint"
    ),
    "main_pointers": (
        "collection string, doc_id string, step_type string, model_tag string, semantic_id string, "
        "technical_id string, created_at timestamp, updated_at timestamp, operator string"
    ),
    "prompt_templates": (
        "id string, collection string, name string, template string, version bigint, is_latest boolean, "
        "metadata string, user_id bigint, created_at timestamp, updated_at timestamp"
    ),
    "ingestion_runs": (
        "collection string, doc_id string, status string, message string, parse_hash string, "
        "created_at timestamp, updated_at timestamp, user_id bigint"
    ),
    "collection_config": "collection string, user_id bigint, config_json string, updated_at timestamp",
    "trace_events": (
        "event_id string, task_id bigint, build_id string, event_type string, timestamp timestamp, "
        "step_id string, parent_event_id string, data string"
    ),
    "tasks": (
        "id bigint, user_id bigint, title string, status string, created_at timestamp, updated_at timestamp, "
        "agent_id bigint, agent_type string, mode string, input_tokens bigint, output_tokens bigint, total_tokens bigint"
    ),
    "tool_usage": (
        "tool_name string, usage_count bigint, success_count bigint, error_count bigint, last_used_at timestamp"
    ),
}

# Merge keys.
TABLE_KEYS = {
    "documents": ["collection", "doc_id"],
    "parses": ["collection", "doc_id", "parse_hash"],
    "chunks": ["collection", "doc_id", "parse_hash", "chunk_id"],
    "embeddings": ["collection", "doc_id", "chunk_id", "parse_hash", "model"],
    "main_pointers": ["collection", "doc_id", "step_type", "model_tag"],
    "prompt_templates": ["id"],
    "ingestion_runs": ["collection", "doc_id"],
    "collection_config": ["collection", "user_id"],
    "trace_events": ["event_id"],
    "tasks": ["id"],
    "tool_usage": ["tool_name"],
}

# Ingestion states.
DOCUMENT_STATUSES = [
    "pending", "running", "success", "partially_embedded", "chunked", "failed", "cancelled",
]


def table_schema(name: str) -> T.StructType:
    """Declared schema of one of the knowledge-base tables."""
    return T.StructType.fromDDL(TABLE_DDL[name])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(name))


def check_schema(df: DataFrame, name: str, required: list[str] | None = None) -> DataFrame:
    """Return ``df`` if it holds every required field with the declared type, else raise ``ValueError``."""
    declared = table_schema(name)
    present = {field.name: field.dataType for field in df.schema.fields}
    problems = []
    for field_name in required or declared.fieldNames():
        if field_name not in present:
            problems.append(f"{field_name} is missing")
        elif present[field_name] != declared[field_name].dataType:
            problems.append(
                f"{field_name} is {present[field_name].simpleString()}, "
                f"expected {declared[field_name].dataType.simpleString()}"
            )
    if problems:
        raise ValueError(f"table {name}: " + "; ".join(problems))
    return df


def tenant_condition(user_id: int | None, is_admin: bool = False, column: str = "user_id") -> Column:
    """Admins see everything, users their own rows, nobody sees nothing."""
    if is_admin:
        return F.lit(True)
    if user_id is None:
        return F.lit(False)
    return F.coalesce(F.col(column) == F.lit(user_id), F.lit(False))


def tenant_filter(df: DataFrame, user_id: int | None, is_admin: bool = False, column: str = "user_id") -> DataFrame:
    """Apply the owner rule before any search or aggregate; Catalyst pushes it into the scan."""
    if is_admin:
        return df
    if user_id is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(column) == F.lit(user_id))
