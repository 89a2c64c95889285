"""Version candidates, pointers, clean-up, prompts and migration."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.operators import versions as ve
from quillstack.registry import register
from quillstack.registry.kb import KB, kb_tables
from quillstack.session import load_table

CAND = "cand AS (SELECT collection, doc_id, parse_hash AS technical_id, 'parse_' || parser || '_' || parse_hash[1:8] AS semantic_id, created_s FROM parses_t)"


def seconds(name="created_at"):
    return F.unix_timestamp(name).alias("created_s")


@register("v1_parse_candidates", f"WITH {KB}, {CAND} SELECT * FROM cand")
def v1(spark, folder):
    found = ve.parse_candidates(kb_tables(spark, folder)["parses"])
    return found.select("collection", "doc_id", "technical_id", "semantic_id", seconds())


@register(
    "v2_chunk_candidates",
    f"""
WITH {KB} SELECT collection, doc_id, parse_hash AS technical_id, count(*) AS chunks, CAST(floor(avg(length(text))) AS INT) AS mean_length,
  min(created_s) AS created_s, 'chunk_' || parse_hash[1:8] AS semantic_id, 'candidate' AS state, 'unknown' AS operator FROM chunks_t GROUP BY collection, doc_id, parse_hash
""",
)
def v2(spark, folder):
    found = ve.chunk_candidates(kb_tables(spark, folder)["chunks"])
    return found.withColumn("created_s", F.unix_timestamp("created_at")).drop("created_at")


@register(
    "v3_embed_candidates",
    f"""
WITH {KB} SELECT collection, doc_id, model, parse_hash AS technical_id, count(*) AS vectors, max(len(vector)) AS dimension,
  'embed_' || model || '_' || parse_hash[1:8] AS semantic_id, 'candidate' AS state FROM embeddings_t GROUP BY ALL
""",
)
def v3(spark, folder):
    return ve.embed_candidates(kb_tables(spark, folder)["embeddings"]).drop("created_at", "operator")


@register(
    "v4_list_candidates",
    f"""
WITH {KB}, {CAND} SELECT *, count(*) OVER () AS total FROM cand ORDER BY created_s DESC, collection, doc_id, technical_id LIMIT 25
""",
)
def v4(spark, folder):
    found = ve.parse_candidates(kb_tables(spark, folder)["parses"])
    return ve.list_candidates(found, "created_at", True, 25, "candidate").select(
        "collection", "doc_id", "technical_id", "semantic_id", seconds(), "total"
    )


def pointers(spark, folder, shift, parity=None):
    found = ve.parse_candidates(kb_tables(spark, folder)["parses"])
    if parity is not None:
        found = found.filter(F.col("doc_id") % 2 == parity)
    at = F.timestamp_seconds(F.unix_timestamp("created_at") + shift)
    return found.select(
        "collection", "doc_id", F.lit("parse").alias("step_type"), F.lit(None).cast("string").alias("model_tag"),
        "semantic_id", "technical_id", at.alias("created_at"), at.alias("updated_at"),
    )


POINTERS = f"""
SELECT collection, doc_id, 'parse' AS step_type, '' AS model_tag, semantic_id, technical_id, created_s,
       CASE WHEN doc_id % 2 = 0 THEN created_s + 5000 ELSE created_s END AS updated_s FROM cand
"""


def set_twice(spark, folder):
    empty = pointers(spark, folder, 0).limit(0).withColumn("model_tag", F.lit(""))
    first = ve.set_pointers(empty, pointers(spark, folder, 0))
    return ve.set_pointers(first, pointers(spark, folder, 5000, 0))


def pointer_out(df):
    return df.withColumn("created_s", F.unix_timestamp("created_at")).withColumn(
        "updated_s", F.unix_timestamp("updated_at")
    ).drop("created_at", "updated_at")


@register("v5_set_pointers", f"WITH {KB}, {CAND} {POINTERS}")
def v5(spark, folder):
    """All pointers are set, then those of even documents again: the creation time stays."""
    return pointer_out(set_twice(spark, folder))


@register(
    "v5_list_and_delete_pointers",
    f"""WITH {KB}, {CAND}, p AS ({POINTERS}) SELECT * FROM p WHERE collection = 'src1' AND doc_id % 3 <> 0
ORDER BY updated_s DESC, doc_id LIMIT 10""",
)
def v5_list(spark, folder):
    after = set_twice(spark, folder)
    doomed = pointers(spark, folder, 0).filter("doc_id % 3 = 0")
    return pointer_out(ve.list_pointers(ve.delete_pointers(after, doomed), "src1", 10))


@register(
    "v6_resolve_ids",
    f"""
WITH {KB}, {CAND}, req AS (SELECT collection, doc_id, CASE doc_id % 3 WHEN 0 THEN technical_id WHEN 1 THEN semantic_id ELSE 'none' END AS selected,
 technical_id FROM cand)
SELECT collection, doc_id, selected, CASE WHEN selected <> 'none' THEN technical_id END AS technical_id FROM req
""",
)
def v6(spark, folder):
    found = ve.parse_candidates(kb_tables(spark, folder)["parses"])
    case = F.col("doc_id") % 3
    wanted = F.when(case == 0, F.col("technical_id")).when(case == 1, F.col("semantic_id")).otherwise(F.lit("none"))
    return ve.resolve_ids(found.select("collection", "doc_id", wanted.alias("selected")), found)


# The document with the most chunks is the one that is cleaned up.
TARGET = "tgt AS (SELECT collection, doc_id FROM chunks_t GROUP BY ALL ORDER BY count(*) DESC, doc_id LIMIT 1)"


def target(tables):
    counts = tables["chunks"].groupBy("collection", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "doc_id").first()


def md5_of(n):
    import hashlib

    return hashlib.md5(str(n).encode()).hexdigest()


def with_tags(tables):
    out = dict(tables)
    out["embeddings"] = tables["embeddings"].withColumn("model_tag", F.replace("model", F.lit("-"), F.lit("_")))
    return out


@register(
    "v7_promote",
    f"""
WITH {KB}, {TARGET}, n AS (SELECT c.* FROM chunks_t c, tgt WHERE c.collection = tgt.collection AND c.doc_id = tgt.doc_id)
SELECT 'plan chunks' AS item, count(*) AS n FROM n WHERE parse_hash <> md5('1')
UNION ALL SELECT 'chunks after', (SELECT count(*) FROM chunks_t) - (SELECT count(*) FROM n WHERE parse_hash <> md5('1'))
UNION ALL SELECT 'pointers after', 1
""",
)
def v7(spark, folder):
    """The odd parse of the largest document becomes current; chunks of the other one go."""
    tables = with_tags(kb_tables(spark, folder))
    doc = target(tables)
    tables["main_pointers"] = pointers(spark, folder, 0).limit(0).withColumn("model_tag", F.lit(""))
    result = ve.promote(
        tables, ve.chunk_candidates(tables["chunks"]), "chunk", doc["collection"], doc["doc_id"], "chunk_" + md5_of(1)[:8],
        F.timestamp_seconds(F.lit(1)), confirm=True,
    )
    plan = result.plan.filter("table_name = 'chunks'").select(F.lit("plan chunks").alias("item"), F.col("rows").alias("n"))

    def size(name, table):
        return result.tables[table].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")

    return plan.unionByName(size("chunks after", "chunks")).unionByName(size("pointers after", "main_pointers"))


EMBEDDED = """
v AS (SELECT *, replace(model, '-', '_') AS model_tag FROM embeddings_t
      UNION ALL SELECT collection, doc_id, 1, md5('9'), model, list_reverse(vector), replace(model, '-', '_') FROM embeddings_t),
one AS (SELECT collection, doc_id, model_tag FROM v ORDER BY doc_id, collection, model_tag LIMIT 1)"""


@register(
    "v7_promote_embedding",
    f"""
WITH {KB}, {EMBEDDED}, lost AS (SELECT v.* FROM v JOIN one USING (collection, doc_id, model_tag) WHERE parse_hash <> md5('9'))
SELECT 'plan embeddings' AS item, (SELECT count(*) FROM lost) AS n, 'embed' AS step, '' AS notes
UNION ALL SELECT 'embeddings after', (SELECT count(*) FROM v) - (SELECT count(*) FROM lost), 'embed', ''
UNION ALL SELECT 'pointers by someone', 1, 'embed', ''
UNION ALL SELECT 'plan chunks', (SELECT count(*) FROM chunks_t JOIN one USING (collection, doc_id)), 'parse', 'Requires re-chunk/embed'
""",
)
def v7_embed(spark, folder):
    """A second embedding of each document exists; it becomes the current one of a document. Its parse's promotion is previewed."""
    tables = with_tags(kb_tables(spark, folder))
    vectors = tables["embeddings"]
    again = vectors.withColumn("chunk_id", F.lit(1)).withColumn("parse_hash", F.lit(md5_of(9))).withColumn("vector", F.reverse("vector"))
    tables["embeddings"] = vectors.unionByName(again)
    tables["main_pointers"] = pointers(spark, folder, 0).limit(0).withColumn("model_tag", F.lit(""))
    doc = tables["embeddings"].orderBy("doc_id", "collection", "model_tag").first()
    at, ids = F.timestamp_seconds(F.lit(1)), (doc["collection"], doc["doc_id"])
    made = ve.promote(
        tables, ve.embed_candidates(tables["embeddings"], doc["model_tag"]), "embed", *ids, f"embed_{doc['model']}_{md5_of(9)[:8]}", at,
        confirm=True, model_tag=doc["model_tag"], operator="someone",
    )
    # A new parse whose chunks do not exist yet: all present chunks would go.
    parse = spark.createDataFrame([(*ids, "p-new", "parse_new_p-new")], "collection string, doc_id long, technical_id string, semantic_id string")
    seen = ve.promote(tables, parse, "parse", *ids, "p-new", at)

    def counted(item, frame, step, notes):
        return frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), "n", F.lit(step).alias("step"), F.lit("; ".join(notes)).alias("notes"))

    def planned(item, plan, table, step, notes):
        return plan.filter(F.col("table_name") == table).select(F.lit(item).alias("item"), F.col("rows").alias("n"), F.lit(step).alias("step"), F.lit("; ".join(notes)).alias("notes"))

    return (
        planned("plan embeddings", made.plan, "embeddings", "embed", made.notes)
        .unionByName(counted("embeddings after", made.tables["embeddings"], "embed", made.notes))
        .unionByName(counted("pointers by someone", made.tables["main_pointers"].filter("operator = 'someone'"), "embed", made.notes))
        .unionByName(planned("plan chunks", seen.plan, "chunks", "parse", seen.notes))
    )


@register(
    "v8_cascade_preview",
    f"""
WITH {KB}, {TARGET}, hit AS (SELECT 'chunks' AS table_name, c.parse_hash FROM chunks_t c JOIN tgt USING (collection, doc_id)
  UNION ALL SELECT 'parses', p.parse_hash FROM parses_t p JOIN tgt USING (collection, doc_id)
  UNION ALL SELECT 'embeddings', e.parse_hash FROM embeddings_t e JOIN tgt USING (collection, doc_id)),
docs AS (SELECT count(*) AS n FROM documents_t JOIN tgt USING (collection, doc_id)),
t(table_name) AS (VALUES ('chunks'), ('parses'), ('embeddings'))
SELECT 'document' AS scope, table_name, (SELECT count(*) FROM hit WHERE hit.table_name = t.table_name) AS rows FROM t
UNION ALL SELECT 'document', 'documents', n FROM docs
UNION ALL SELECT 'parse', table_name, (SELECT count(*) FROM hit WHERE hit.table_name = t.table_name AND parse_hash <> md5('0')) FROM t
UNION ALL SELECT 'chunk', 'embeddings', (SELECT count(*) FROM hit WHERE table_name = 'embeddings' AND parse_hash = md5('1'))
""",
)
def v8(spark, folder):
    tables = with_tags(kb_tables(spark, folder))
    doc = target(tables)
    key = (doc["collection"], doc["doc_id"])
    previews = {
        "document": ve.cascade_conditions("document", *key),
        "parse": ve.cascade_conditions("parse", *key, old_parse=md5_of(1), new_parse=md5_of(0)),
        "chunk": ve.cascade_conditions("chunk", *key, old_parse=md5_of(1)),
    }
    rows = None
    for scope, conditions in previews.items():
        part = ve.cascade_preview(tables, conditions).withColumn("scope", F.lit(scope))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register(
    "v9_cascade_delete",
    f"""
WITH {KB}, {TARGET}, r AS (SELECT 'documents' AS t, collection, doc_id FROM documents_t UNION ALL SELECT 'parses', collection, doc_id FROM parses_t
  UNION ALL SELECT 'chunks', collection, doc_id FROM chunks_t UNION ALL SELECT 'embeddings', collection, doc_id FROM embeddings_t)
SELECT t, count(*) AS n, count(DISTINCT doc_id) AS docs FROM r ANTI JOIN tgt USING (collection, doc_id) GROUP BY t
""",
)
def v9(spark, folder):
    tables = with_tags(kb_tables(spark, folder))
    doc = target(tables)
    after = ve.cascade_delete(tables, ve.cascade_conditions("document", doc["collection"], doc["doc_id"]))
    rows = None
    for name, df in after.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).withColumn("t", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register(
    "v10_backfill_owner",
    f"""
WITH {KB} SELECT c.collection, c.doc_id, c.chunk_id, coalesce(c.user_id, d.user_id, -1) AS user_id
FROM chunks_t c LEFT JOIN documents_t d ON c.collection = d.collection AND c.doc_id = d.doc_id
""",
)
def v10(spark, folder):
    tables = kb_tables(spark, folder)
    filled = ve.backfill_owner(tables["chunks"], tables["documents"])
    return filled.select("collection", "doc_id", "chunk_id", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


@register(
    "v10_backfill_report",
    f"""
WITH {KB} SELECT count(*) AS total, count(*) FILTER (c.user_id IS NULL AND d.user_id IS NOT NULL) AS backfilled,
  count(*) FILTER (c.user_id IS NULL AND d.user_id IS NULL) AS skipped
FROM chunks_t c LEFT JOIN documents_t d ON c.collection = d.collection AND c.doc_id = d.doc_id
""",
)
def v10_report(spark, folder):
    tables = kb_tables(spark, folder)
    return ve.backfill_report(ve.backfill_owner(tables["chunks"], tables["documents"]))


PROMPTS = "pr AS (SELECT p_brand AS collection, p_type AS name, p_size AS version, p_partkey AS id, p_name AS template FROM part)"


def prompts(spark, folder):
    return load_table(spark, folder, "part").select(
        F.col("p_brand").alias("collection"), F.col("p_type").alias("name"), F.col("p_size").alias("version"),
        F.col("p_partkey").alias("id"), F.col("p_name").alias("template"),
    )


@register(
    "v11_add_versions",
    f"""
WITH {PROMPTS}, m AS (SELECT collection, name, max(version) AS v FROM pr GROUP BY ALL),
a AS (SELECT * FROM pr UNION ALL SELECT collection, name, v + 1, 1000000, 'new' FROM m
      UNION ALL SELECT collection, 'brand new', 1, 1000000, 'new' FROM (SELECT DISTINCT collection FROM pr))
SELECT *, row_number() OVER (PARTITION BY collection, name ORDER BY version DESC, id DESC) = 1 AS is_latest FROM a
""",
)
def v11(spark, folder):
    """Every prompt gets one more version, and every collection a new prompt."""
    log = prompts(spark, folder)
    known = log.select("collection", "name").distinct()
    fresh = log.select("collection", F.lit("brand new").alias("name")).distinct()
    new = known.unionByName(fresh).withColumn("id", F.lit(1_000_000)).withColumn("template", F.lit("new"))
    return ve.add_versions(log, new)


@register(
    "v12_read_and_list",
    f"""
WITH {PROMPTS}, l AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY collection, name ORDER BY version DESC, id DESC) = 1)
(SELECT 'list' AS kind, * FROM l WHERE contains(name, 'O') ORDER BY collection, name, version DESC, id LIMIT 30)
UNION ALL SELECT 'v7', * FROM pr WHERE version = 7
""",
)
def v12(spark, folder):
    log = prompts(spark, folder)
    listed = ve.list_prompts(log, "O", latest_only=True, limit=30).withColumn("kind", F.lit("list"))
    return listed.unionByName(ve.read_prompts(log, version=7).withColumn("kind", F.lit("v7")))


@register(
    "v13_delete_versions",
    f"""
WITH {PROMPTS}, m AS (SELECT collection, name, max(version) AS version FROM pr GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY collection, name ORDER BY version DESC, id DESC) = 1 AS is_latest
FROM pr ANTI JOIN m USING (collection, name, version)
""",
)
def v13(spark, folder):
    log = prompts(spark, folder)
    return ve.delete_versions(log, log.groupBy("collection", "name").agg(F.max("version").alias("version")))


def target_schema():
    return T.StructType.fromDDL(
        "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal int, c_mktsegment int, user_id bigint, "
        "schema_version string"
    )


@register(
    "v14_migrate",
    """
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, trunc(c_acctbal)::INT AS c_acctbal, -1 AS c_mktsegment, -1 AS user_id,
  '1.0.0' AS schema_version FROM customer
""",
)
def v14(spark, folder):
    moved = ve.migrate(load_table(spark, folder, "customer"), target_schema(), {"schema_version": "1.0.0"})
    return moved.fillna(-1, ["c_mktsegment", "user_id"])


@register(
    "v14_migration_plan",
    """
SELECT * FROM (VALUES ('c_nationkey', 'cast', 0), ('c_acctbal', 'cast', 0), ('c_mktsegment', 'cast', (SELECT count(*) FROM customer)),
  ('user_id', 'add', 0), ('schema_version', 'add', 0)) t(column_name, action, lost)
""",
)
def v14_plan(spark, folder):
    return ve.migration_plan(load_table(spark, folder, "customer"), target_schema())
