"""Document ids, content and configuration hashes, registration."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.jsonpath import python_json_string
from quillstack.functions.text import file_stem, strip
from quillstack.operators.upsert import newest_per_key, pending, upsert

# Parameters that take part in the parse hash, per parse method.
PARSE_PARAMETERS = {
    "pypdf": [],
    "pdfplumber": ["extract_tables", "extract_images"],
    "unstructured": ["strategy", "include_metadata"],
    "pymupdf": ["extract_images", "extract_tables"],
    "docx_default": [],
    "xlsx_default": ["sheet_names", "include_headers"],
    "pptx_default": [],
    "txt_default": [],
    "md_default": [],
    "json_default": ["extract_arrays", "flatten_nested"],
    "html_default": ["extract_tables", "remove_tags"],
}

# Parameters that take part in the chunk hash.
CHUNK_PARAMETERS = [
    "chunk_strategy", "chunk_size", "chunk_overlap", "headers_to_split_on", "separators", "use_token_count",
    "tiktoken_encoding", "enable_protected_content", "protected_patterns", "table_context_size", "image_context_size",
]

# Patterns of valid names.
COLLECTION_NAME = r"\A[a-zA-Z0-9_-]+\z"
DOCUMENT_ID = r"\A[a-zA-Z0-9_.-]+\z"


def content_hash(text: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of text or bytes: sha256 (default), sha1 or md5."""
    return {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}[algorithm](text)


def sanitize_id(text: Column, max_length: int = 64) -> Column:
    """Letters, digits, ``_`` and ``-`` only, single underscores, none at the ends; a hash when nothing is left."""
    text = F.coalesce(text, F.lit(""))
    cleaned = F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"_+", "_"), r"\A_|_\z", "")
    digest = F.sha2(text, 256)
    cut = F.regexp_replace(F.substring(cleaned, 1, max_length), r"_+\z", "")
    return (
        F.when(text == "", F.substring(digest, 1, 8))
        .when(cleaned == "", F.substring(digest, 1, min(16, max_length)))
        .otherwise(cut)
    )


def document_id(collection: Column, path: Column) -> Column:
    """Same collection and path always give the same id: sanitized stem and eight hash digits."""
    key = F.concat_ws("|", collection, path)
    return F.concat_ws("_", sanitize_id(file_stem(path), 50), F.substring(F.sha2(key, 256), 1, 8))


def is_hash(value: Column, length: int = 64) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-fA-F]+\z") & (F.length(value) == length), F.lit(False))


def model_tag(model: Column) -> Column:
    """``Vendor/some name`` -> ``VENDOR_some_name``; without a vendor only the slug."""

    def slug(part: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(strip(part)), r"[^a-z0-9]+", "_"), r"\A_+|_+\z", "")

    name = strip(model)
    vendor = F.upper(strip(F.substring_index(name, "/", 1)))
    rest = slug(F.regexp_replace(name, r"(?s)\A[^/]*/", ""))
    return (
        F.when(~F.contains(name, F.lit("/")), slug(name))
        .when(rest == "", vendor)
        .otherwise(F.concat_ws("_", vendor, rest))
    )


def name_violations(df: DataFrame, column: str, pattern: str = DOCUMENT_ID) -> DataFrame:
    """Rows whose name breaks the rule, with the reason."""
    value = F.col(column)
    reason = (
        F.when(value.isNull() | (value == ""), F.lit("empty"))
        .when(~value.rlike(pattern), F.lit("invalid characters"))
    )
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def parse_hash(method: str, params: dict[str, Any] | None = None) -> str:
    """Hash of a parse configuration; the same for every row, so it is computed once on the driver."""
    kept = {k: v for k, v in (params or {}).items() if k in PARSE_PARAMETERS.get(method, [])}
    return hashlib.sha256(canonical_json({"parse_method": method, "params": kept}).encode()).hexdigest()


def config_hash(params: dict[str, Any]) -> str:
    kept = {k: v for k, v in params.items() if k in CHUNK_PARAMETERS}
    return hashlib.sha256(canonical_json(kept).encode()).hexdigest()


def chunk_hash(text: Column, params: dict[str, Any] | None = None) -> Column:
    """Hash of a chunk's text and chunking parameters."""
    kept = {k: v for k, v in (params or {}).items() if k in CHUNK_PARAMETERS}
    prefix = '{"chunk_params":' + canonical_json(kept) + ',"text":'
    return F.sha2(F.concat(F.lit(prefix), python_json_string(text), F.lit("}")), 256)


def embed_hash(text: Column, model: Column, params: dict[str, Any] | None = None) -> Column:
    """Hash of a text, model name and embedding parameters (``params`` already reduced to those that count)."""
    prefix = '{"embed_params":' + canonical_json(params or {}) + ',"model":'
    return F.sha2(
        F.concat(F.lit(prefix), python_json_string(model), F.lit(',"text":'), python_json_string(text), F.lit("}")), 256
    )


def register_documents(known: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Register files. ``incoming`` holds collection, source_path, content, uploaded_at and any other document columns.

    Returns the next documents table and, per incoming id, whether it was created and whether its content changed.
    """
    prepared = incoming.withColumn("doc_id", document_id(F.col("collection"), F.col("source_path"))).withColumn(
        "content_hash", content_hash(F.col("content"))
    ).drop("content")
    keys = ["collection", "doc_id"]
    fresh = newest_per_key(prepared, keys, ["uploaded_at", "content_hash"])
    before = known.select(*keys, F.col("content_hash").alias("__old"), F.lit(True).alias("__known"))
    report = fresh.join(before, keys, "left").select(
        *keys,
        "content_hash",
        F.col("__known").isNull().alias("created"),
        F.coalesce(F.col("__old") != F.col("content_hash"), F.lit(True)).alias("changed"),
    )
    return upsert(known, fresh, keys), report


def pending_chunks(chunks: DataFrame, embeddings: DataFrame, tag: str) -> DataFrame:
    """Chunks without an embedding for the model; the model filter prunes partitions."""
    done = embeddings.filter(F.col("model_tag") == tag)
    return pending(chunks, done, ["collection", "doc_id", "parse_hash", "chunk_id"])


def new_configurations(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Documents whose parse and chunk configuration has not run yet."""
    return pending(todo, done, ["doc_id", "parse_hash", "config_hash"])


def list_documents(documents: DataFrame, collection: str, limit: int | None = None) -> DataFrame:
    rows = documents.filter(F.col("collection") == collection).orderBy("doc_id")
    return rows if limit is None else rows.limit(limit)


def get_document(documents: DataFrame, collection: str, doc_id) -> DataFrame:
    return documents.filter((F.col("collection") == collection) & (F.col("doc_id") == doc_id))
