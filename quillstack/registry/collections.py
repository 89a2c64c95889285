"""Collection and document statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import collections as co
from quillstack.registry import register
from quillstack.registry.kb import KB, kb_tables
from quillstack.session import load_table

TAGGED = """tagged AS (SELECT collection, doc_id, 'd' AS k FROM documents_t UNION ALL SELECT collection, doc_id, 'p' FROM parses_t
 UNION ALL SELECT collection, doc_id, 'c' FROM chunks_t UNION ALL SELECT collection, doc_id, 'e' FROM embeddings_t)"""
COUNTS = """count(*) FILTER (k = 'd') AS documents, count(*) FILTER (k = 'p') AS parses,
 count(*) FILTER (k = 'c') AS chunks, count(*) FILTER (k = 'e') AS embeddings"""


@register(
    "m1_collection_counts",
    f"""
WITH {KB}, {TAGGED},
n AS (SELECT collection, count(DISTINCT regexp_extract(source_path, '[^/]*$')) AS names FROM documents_t GROUP BY collection),
c AS (SELECT collection, {COUNTS} FROM tagged GROUP BY collection)
SELECT c.*, coalesce(names, 0) AS names FROM c LEFT JOIN n USING (collection)
""",
)
def m1(spark, folder):
    return co.collection_counts(kb_tables(spark, folder))


@register(
    "m1_document_names",
    f"WITH {KB} SELECT DISTINCT collection, regexp_extract(source_path, '[^/]*$') AS name FROM documents_t",
)
def m1_names(spark, folder):
    return co.document_names(kb_tables(spark, folder)["documents"])


@register("m2_chunks_per_document", f"WITH {KB} SELECT collection, doc_id, count(*) AS rows FROM chunks_t GROUP BY ALL")
def m2(spark, folder):
    return co.document_row_counts(kb_tables(spark, folder)["chunks"])


STATUS = """CASE WHEN chunks = 0 THEN 'pending' WHEN embeddings = 0 THEN 'chunked' WHEN embeddings < chunks THEN 'partially_embedded'
 ELSE 'success' END"""
RUNS = "SELECT source AS collection, doc_id, 'failed' AS status, 'toxic text' AS message FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"


def runs(spark, folder):
    docs = load_table(spark, folder, "documents").join(load_table(spark, folder, "labels").filter("toxic = 1"), "doc_id")
    return docs.select(
        F.col("source").alias("collection"), "doc_id", F.lit("failed").alias("status"), F.lit("toxic text").alias("message"),
        F.timestamp_seconds(F.col("doc_id")).alias("updated_at"),
    )


@register(
    "m3_document_overview",
    f"""
WITH {KB}, {TAGGED}, r AS ({RUNS}), c AS (SELECT collection, doc_id, {COUNTS} FROM tagged GROUP BY collection, doc_id)
SELECT c.*, r.message, coalesce(r.status, {STATUS}) AS status, length(text) AS created_s,
  CASE WHEN r.status IS NULL THEN length(text) ELSE doc_id END AS updated_s
FROM c LEFT JOIN r USING (collection, doc_id) LEFT JOIN (SELECT collection, doc_id, text FROM documents_t) USING (collection, doc_id)
""",
)
def m3(spark, folder):
    """Documents were uploaded at a second that their length tells."""
    tables = kb_tables(spark, folder)
    tables["documents"] = tables["documents"].withColumn("uploaded_at", F.timestamp_seconds(F.length("text")))
    found = co.document_overview(tables, runs(spark, folder))
    return found.withColumn("created_s", F.unix_timestamp("created_at")).withColumn("updated_s", F.unix_timestamp("updated_at")).drop("created_at", "updated_at")


@register(
    "m4_inferred_status",
    f"""
WITH {KB}, {TAGGED}, c AS (SELECT collection, doc_id, {COUNTS} FROM tagged GROUP BY collection, doc_id)
SELECT collection, {STATUS} AS status, count(*) AS n FROM c GROUP BY ALL
""",
)
def m4(spark, folder):
    overview = co.document_overview(kb_tables(spark, folder))
    return overview.groupBy("collection", "status").agg(F.count(F.lit(1)).alias("n"))


@register(
    "m5_model_counts",
    f"WITH {KB} SELECT collection, doc_id, model, count(*) AS vectors FROM embeddings_t GROUP BY ALL",
)
def m5(spark, folder):
    return co.model_counts(kb_tables(spark, folder)["embeddings"])


@register("m6_document_ids", f"WITH {KB}, {TAGGED} SELECT DISTINCT collection, doc_id FROM tagged")
def m6(spark, folder):
    return co.document_ids(kb_tables(spark, folder))


def status_log(spark, folder):
    return load_table(spark, folder, "events").select(
        F.lit("log").alias("collection"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"),
        F.col("ts").alias("updated_at"), "event_id",
    )


@register(
    "m7_latest_status",
    """
SELECT user_id AS doc_id, event_type AS status, epoch_us(ts) AS updated_us FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""",
)
def m7(spark, folder):
    latest = co.latest_status(status_log(spark, folder), ["event_id"])
    return latest.select("doc_id", "status", F.unix_micros("updated_at").alias("updated_us"))


@register(
    "m8_retry_and_cancel",
    f"""
WITH {KB}, {TAGGED}, r AS ({RUNS}),
ids AS (SELECT DISTINCT collection, doc_id FROM tagged WHERE collection = 'src2'),
re AS (SELECT * FROM r WHERE doc_id % 2 = 0)
SELECT collection, doc_id, 'failed' AS status, 'cancelled by user' AS message, 99 AS updated_s FROM ids
UNION ALL SELECT collection, doc_id, 'pending', 'retry', 50 FROM re WHERE collection <> 'src2'
UNION ALL SELECT collection, doc_id, status, message, doc_id FROM r WHERE doc_id % 2 = 1 AND collection <> 'src2'
""",
)
def m8(spark, folder):
    """Even failed documents are retried, then a whole collection is cancelled."""
    recorded = runs(spark, folder)
    retried = co.change_status(
        recorded, recorded.filter("doc_id % 2 = 0"), "retry", "retry", F.timestamp_seconds(F.lit(50))
    )
    every = co.document_ids(kb_tables(spark, folder)).filter("collection = 'src2'")
    after = co.change_status(retried, every, "cancel", "cancelled by user", F.timestamp_seconds(F.lit(99)))
    return after.select("collection", "doc_id", "status", "message", F.unix_timestamp("updated_at").alias("updated_s"))


@register(
    "m9_delete_collection",
    f"""
WITH {KB}, parses_o AS (SELECT p.*, user_id FROM parses_t p JOIN documents_t USING (collection, doc_id)),
embeddings_o AS (SELECT e.*, user_id FROM embeddings_t e JOIN documents_t USING (collection, doc_id))
SELECT 'documents' AS table_name, count(*) AS rows FROM documents_t WHERE collection = 'src3' AND user_id = 1
UNION ALL SELECT 'parses', count(*) FROM parses_o WHERE collection = 'src3' AND user_id = 1
UNION ALL SELECT 'parses left', count(*) FROM parses_o WHERE NOT coalesce(collection = 'src3' AND user_id = 1, false)
UNION ALL SELECT 'embeddings', count(*) FROM embeddings_o WHERE collection = 'src3' AND user_id = 1
UNION ALL SELECT 'embeddings left', count(*) FROM embeddings_o WHERE NOT coalesce(collection = 'src3' AND user_id = 1, false)
UNION ALL SELECT 'chunks', count(*) FROM chunks_t WHERE collection = 'src3' AND user_id = 1
UNION ALL SELECT 'documents left', count(*) FROM documents_t WHERE NOT coalesce(collection = 'src3' AND user_id = 1, false)
UNION ALL SELECT 'chunks left', count(*) FROM chunks_t WHERE NOT coalesce(collection = 'src3' AND user_id = 1, false)
""",
)
def m9(spark, folder):
    """User 1 deletes their part of a collection from all tables; other owners' rows stay."""
    tables = kb_tables(spark, folder)
    owner = tables["documents"].select("collection", "doc_id", "user_id")
    owned = {n: df if "user_id" in df.columns else df.join(owner, ["collection", "doc_id"]) for n, df in tables.items()}
    left, counts = co.delete_where(owned, (F.col("collection") == "src3") & (F.col("user_id") == 1))
    for name, df in left.items():
        counts = counts.unionByName(
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"{name} left").alias("table_name"), "rows")
        )
    return counts


@register(
    "m10_rename_collection",
    f"""
WITH {KB}, r AS (SELECT 'documents' AS t, collection FROM documents_t UNION ALL SELECT 'parses', collection FROM parses_t
  UNION ALL SELECT 'chunks', collection FROM chunks_t UNION ALL SELECT 'embeddings', collection FROM embeddings_t)
SELECT t, CASE WHEN collection = 'src4' THEN 'renamed' ELSE collection END AS collection, count(*) AS n FROM r GROUP BY ALL
""",
)
def m10(spark, folder):
    renamed = co.rename_collection(kb_tables(spark, folder), "src4", "renamed")
    rows = None
    for name, df in renamed.items():
        part = df.select(F.lit(name).alias("t"), "collection")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("t", "collection").agg(F.count(F.lit(1)).alias("n"))


@register(
    "m11_counters",
    """
SELECT event_type AS collection, sum(k % 3)::BIGINT AS documents, sum(k)::BIGINT AS chunks
FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY event_type
""",
)
def m11(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    deltas = load_table(spark, folder, "events").select(
        F.col("event_type").alias("collection"), (k % 3).alias("documents"), k.alias("chunks")
    )
    return co.counters(deltas, ["documents", "chunks"])


@register(
    "m12_inferred_embedding",
    f"""
WITH {KB}, c AS (SELECT collection, model, count(*) AS vectors, max(len(vector)) AS dimension FROM embeddings_t GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY collection ORDER BY vectors DESC, model) = 1
""",
)
def m12(spark, folder):
    return co.inferred_embedding(kb_tables(spark, folder)["embeddings"])


@register(
    "m13_mixed_models",
    f"WITH {KB} SELECT collection, count(DISTINCT model) AS models FROM embeddings_t GROUP BY collection HAVING models > 1",
)
def m13(spark, folder):
    return co.mixed_models(kb_tables(spark, folder)["embeddings"])
